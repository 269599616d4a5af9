"""Masked superstrings: constructors and their chunked storage form.

A constructor returns pieces (part LONG, rank LONG, piece STRING).  Concatenating the
pieces of a part by rank gives a masked superstring of its own (it ends with k-1 lower-case
letters), and concatenating parts in any order gives one for the whole set.  No step needs
the whole string in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.kmers import reverse_complement
from kmerloom.operators.extract import CHUNK
from kmerloom.operators.fragments import from_kmers, from_sequences
from kmerloom.operators.matching import Matcher
from kmerloom.plans.runtime import cut

_BLOCK = 4096  # pieces per block of the two-level running sum


def _render(layout: DataFrame, frags: DataFrame, k: int) -> DataFrame:
    body = F.when(F.col("flipped"), reverse_complement(F.col("body"))).otherwise(F.col("body"))
    t = layout.join(frags.select("fid", "body"), "fid").withColumn("body", body)
    ones = F.length("body") - (k - 1)
    gap = F.lit(k - 1) - F.coalesce("d", F.lit(0))
    piece = F.concat(
        F.substring("body", F.lit(1), ones), F.lower(F.substring("body", ones + 1, gap)), F.col("fill")
    )
    return t.select("part", "rank", piece.alias("piece"))


def _fragments(source: DataFrame, k: int, complements: bool) -> DataFrame:
    """Fragments of sequences or of a set of k-mers; those that are given, which several constructors can share."""
    if "body" in source.columns:
        return source
    if "seq" in source.columns or "piece" in source.columns:
        return from_sequences(source, k, complements)
    return from_kmers(source, k, complements)


def global_greedy(source: DataFrame, k: int, complements: bool = True) -> DataFrame:
    """Greedy over all overlaps k-1 .. 1; what is left unmatched is concatenated."""
    return _greedy(source, k, complements, 1)


def local_greedy(source: DataFrame, k: int, d_max: int = 5, complements: bool = True) -> DataFrame:
    """Paths that skip at most d_max letters per step, i.e. overlaps of at least k-d_max."""
    if d_max < 1:
        raise ValueError("d_max must be positive")
    return _greedy(source, k, complements, max(k - min(d_max, k - 1), 1))


def _greedy(source: DataFrame, k: int, complements: bool, least: int) -> DataFrame:
    frags = _fragments(source, k, complements)
    m = Matcher(k, complements).start(frags)
    m.levels(range(k - 1, least - 1, -1))
    return cut(_render(m.layout(frags), frags, k))


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Add ``start``, the 0-based offset of each piece in its part, by a two-level running sum."""
    p = pieces.withColumns({"len": F.length("piece").cast("long"), "block": F.expr(f"rank div {_BLOCK}")})
    blocks = p.groupBy("part", "block").agg(F.sum("len").alias("total"))
    before = F.sum("total").over(Window.partitionBy("part").orderBy("block")) - F.col("total")
    inner = F.sum("len").over(Window.partitionBy("part", "block").orderBy("rank")) - F.col("len")
    return (
        p.withColumn("inner", inner)
        .join(blocks.select("part", "block", before.alias("before")), ["part", "block"])
        .select("part", "rank", "piece", (F.col("before") + F.col("inner")).alias("start"))
    )


def to_chunks(pieces: DataFrame, k: int) -> DataFrame:
    """Chunked form (rec, off, piece): CHUNK window starts plus k-1 letters of context."""
    p = with_offsets(pieces).where(F.length("piece") > 0)
    last = F.col("start") + F.length("piece") - 1
    lo = F.greatest(F.floor((F.col("start") - (k - 1)) / CHUNK), F.lit(0))
    p = p.withColumn("chunk", F.explode(F.sequence(lo, F.floor(last / CHUNK))))
    off = F.col("chunk") * CHUNK
    skip = F.greatest(off - F.col("start"), F.lit(0)).cast("int")
    width = (off + CHUNK + k - 1 - F.greatest("start", off)).cast("int")
    p = p.select(F.col("part").alias("rec"), off.alias("off"), "start", F.substring("piece", skip + 1, width).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda s: s["piece"]), "")
    return p.groupBy("rec", "off").agg(joined.alias("piece"))


def stats(chunked: DataFrame, k: int) -> DataFrame:
    """One row: length, ones and runs over all parts concatenated."""
    own = F.substring("piece", 1, CHUNK)
    # a run starts at an upper-case letter after a lower-case one; each part starts anew,
    # and its lower-case tail separates it from the next
    t = chunked.select("rec", "off", own.alias("own"), F.substring("piece", CHUNK + 1, 1).alias("next"))
    starts = F.regexp_count(F.concat(F.when(F.col("off") == 0, F.lit("a")).otherwise(F.lit("")), F.col("own"), F.col("next")), F.lit("(?<=[acgt])[ACGT]"))
    t = t.select(F.length("own").alias("len"), F.regexp_count("own", F.lit("[ACGT]")).alias("ones"), starts.alias("runs"))
    return t.agg(F.sum("len").alias("length"), F.sum("ones").alias("ones"), F.sum("runs").alias("runs"))
