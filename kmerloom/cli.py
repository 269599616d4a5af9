"""Command line: ``python -m kmerloom [optimize] -p INPUT -k K [-a NAME] [-o FOLDER] ...`` as DataFrame jobs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import bound, bounded, extract, masks, superstrings
from kmerloom.plans.runtime import cut
from kmerloom.sources import fasta, records
from kmerloom.streaming.superstring import streaming_superstring

# Names of constructors and mask goals, older names, and the largest k of the two that pack k-mers.
CONSTRUCTORS = ["global", "globalAC", "local", "localAC", "streaming", "csac", "loac"]
GOALS = ["ones", "zeros", "runs", "runsapprox", "runapprox"]
OLDER = {"greedy": "global", "greedyAC": "globalAC", "pseudosimplitigs": "local", "pseudosimplitigsAC": "localAC"}
LARGEST_K = 127

#: (refused if, message); o holds the options.
RULES = [
    (lambda o: o.p is None, "Required parameter p not set."),
    (lambda o: len(o.p) > 1, "Parameter p set twice."),
    (lambda o: not o.k, "Required parameter k not set."),
    (lambda o: o.k < 0, "k must be positive."),
    (lambda o: o.d is not None and o.d < 0, "d must be non-negative."),
    (lambda o: o.k > LARGEST_K and o.a in ("local", "global"), f"k > {LARGEST_K} needs the AC variant of the algorithm."),
    (lambda o: o.a not in (GOALS if o.optimize else CONSTRUCTORS), "Unknown algorithm."),
    (lambda o: o.d is not None and (o.optimize or o.a in ("global", "globalAC", "streaming")), "Parameter d does not apply to this algorithm."),
    (lambda o: o.m and o.a != "global", "Parameter m applies to global only."),
    (lambda o: o.l and o.a != "global", "The lower bound is computed for global only."),
    (lambda o: (o.run_penalty is not None or o.precision is not None) and o.a not in ("csac", "loac"), "Run penalty and precision apply to csac and loac only."),
    (lambda o: o.run_penalty is not None and o.run_penalty < 0, "Run penalty must not be negative."),
    (lambda o: o.precision is not None and o.precision < 1, "Precision must be at least one."),
]


class Refused(ValueError):
    """The options contradict each other or lack something."""


def parse(argv: list[str]) -> argparse.Namespace:
    """Options of one run, checked rule by rule; older names are replaced."""
    optimize = argv[:1] == ["optimize"]
    parser = argparse.ArgumentParser(prog="kmerloom", description="k-mer sets as masked superstrings; 'optimize' first: a new mask for a superstring")
    parser.add_argument("-p", action="append", help="FASTA or FASTQ input, plain, gzip or xz (a superstring with optimize)")
    parser.add_argument("-k", type=int, help="length of k-mers")
    parser.add_argument("-a", default="ones" if optimize else "global", help=f"constructor ({', '.join(CONSTRUCTORS)}) or goal ({', '.join(GOALS[:4])})")
    parser.add_argument("-o", help="output folder; without it the first lines are printed")
    parser.add_argument("-d", type=int, help="most letters a local step may add")
    parser.add_argument("-c", action="store_true", help="a k-mer and its reverse complement are the same")
    parser.add_argument("-l", action="store_true", help="print the lower bound of the length only")
    parser.add_argument("-m", action="store_true", help="accepted for global; has no effect")
    parser.add_argument("-x", "--run-penalty", type=int, help="letters a new run costs")
    parser.add_argument("-y", "--precision", type=int, help="with csac and loac; the whole search is always made, so the number has no effect")
    options = parser.parse_args(argv[1:] if optimize else argv)
    options.optimize, options.a = optimize, OLDER.get(options.a, options.a)
    for refused, message in RULES:
        if refused(options):
            raise Refused(message)
    options.p = options.p[0]
    return options


def pieces(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """(part, rank, piece) of the superstring that the options ask for; no k-mers in the input is an error."""
    if o.optimize:
        chunked = cut(superstrings.to_chunks(fasta.read_superstring(spark, o.p), o.k))
        again = masks.apply_mask(chunked, masks.optimize(chunked, o.k, o.c, o.a), o.k)
        return again.select(F.col("rec").alias("part"), F.col("off").alias("rank"), "piece")
    source = cut(superstrings.to_chunks(records.read_records(spark, o.p)[1], o.k))
    if extract.windows(source, o.k).isEmpty():
        raise Refused("The input has no k-mers.")
    if o.a == "streaming":
        return streaming_superstring(source, o.k, o.c).select(F.col("rec").alias("part"), F.col("pos").alias("rank"), "piece")
    if o.a in ("csac", "loac"):
        return bounded.bounded(source, o.k, o.c, o.run_penalty, o.a)
    if o.a in ("local", "localAC"):
        return superstrings.local_greedy(source, o.k, 5 if o.d is None else max(o.d, 1), o.c)
    return superstrings.global_greedy(source, o.k, o.c)


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        o = parse(argv)
        if o.l:
            source = superstrings.to_chunks(records.read_records(spark, o.p)[1], o.k)
            print(bound.lower_bound(cut(extract.kmers(source, o.k, o.c)), o.k, o.c).first()[0])
            return 0
        made = pieces(spark, o)
    except Refused as e:
        print(e, file=sys.stderr)
        return 1
    if o.o:
        fasta.write_superstring(made, o.k, o.o)
    else:
        made.orderBy("part", "rank").show(20, False)
    return 0
