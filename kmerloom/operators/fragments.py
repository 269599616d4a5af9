"""Fragments: unmasked strings whose windows are distinct k-mers of the set.

Schema (fid LONG, head, tail, body STRING): ``head``/``tail`` are the first/last k-1
letters in codec form.  ``fid`` is the packed first k-mer (the smaller strand
with complements), so it does
not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.kmers import PACKED_MAX_K, codec, encode, place, unplace
from kmerloom.operators.extract import CHUNK, first_runs, from_words, in_bins, run_text, word_names, word_windows
from kmerloom.plans.runtime import cut


def first_occurrences(seqs: DataFrame, k: int, complements: bool) -> DataFrame:
    """(rec, pos, kmer) of the windows that show a k-mer for the first time; kmer as read."""
    w = word_windows(seqs, k, complements)
    first = w.groupBy(*word_names(k)).agg(F.min(place(F.col("rec"), F.col("pos"), F.col("rev"))).alias("o")).select(from_words(k).alias("kmer"), "o")
    rec, pos, back = unplace(F.col("o"))
    return first.select(rec.alias("rec"), pos.alias("pos"), F.when(back, codec(k).rc(F.col("kmer"), k)).otherwise(F.col("kmer")).alias("kmer"))


def _finish(frags: DataFrame, first, last, k: int, complements: bool) -> DataFrame:
    """Add fid, head and tail from the first and last k-mer of each fragment."""
    c = codec(k)
    frags = frags.withColumns(
        {"head": c.prefix(first, k, k - 1), "tail": c.suffix(last, k - 1), "key": F.least(first, c.rc(first, k)) if complements else first}
    )
    if k <= PACKED_MAX_K:
        fid = F.col("key")
    else:  # the rank-free unique id is fixed by the checkpoint that follows
        frags, fid = frags.orderBy("key"), F.monotonically_increasing_id()
    return cut(frags.select(fid.alias("fid"), "head", "tail", "body"))


def from_kmers(kmer_set: DataFrame, k: int, complements: bool) -> DataFrame:
    """Every k-mer is its own fragment (k-mer column as codec form, one per complement pair)."""
    x = F.col("kmer")
    return _finish(kmer_set.select("kmer", codec(k).to_text(x, k).alias("body")), x, x, k, complements)


def from_sequences(seqs: DataFrame, k: int, complements: bool) -> DataFrame:
    """Runs of neighbouring first occurrences.

    Neighbours overlap by k-1 letters, the most there is, so taking them as the first
    greedy choices is as good as any other choice and saves almost all of the matching.
    Runs are cut at chunk ends, which keeps every group bounded.
    """
    if in_bins(k):
        return _joined_runs(first_runs(seqs, k, complements), k, complements)
    c = codec(k)
    new = first_occurrences(seqs, k, complements).withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    w = Window.partitionBy("rec", "chunk").orderBy("pos")
    runs = new.withColumn("grp", F.col("pos") - F.row_number().over(w))
    last_base = F.right(c.to_text(F.col("kmer"), k), F.lit(1)) if k > PACKED_MAX_K else F.substring(
        F.lit("ACGT"), (c.suffix(F.col("kmer"), 1) + 1).cast("int"), F.lit(1)
    )
    runs = runs.groupBy("rec", "chunk", "grp").agg(
        F.min_by("kmer", "pos").alias("first"),
        F.max_by("kmer", "pos").alias("last"),
        F.array_sort(F.collect_list(F.struct("pos", last_base.alias("b")))).alias("bases"),
    )
    rest = F.array_join(F.transform(F.slice("bases", 2, CHUNK), lambda s: s["b"]), "")
    body = F.concat(c.to_text(F.col("first"), k), rest)
    return _finish(runs.select("first", "last", body.alias("body")), F.col("first"), F.col("last"), k, complements)


def _joined_runs(runs: DataFrame, k: int, complements: bool) -> DataFrame:
    """Fragments of runs that follow each other without a gap in one chunk."""
    near = Window.partitionBy("rec", "chunk").orderBy("pos")
    # spelled before the windows: what an aggregate collects is not compiled
    runs = runs.select("rec", "pos", "windows", run_text(k).alias("text")).withColumn("chunk", F.expr(f"(pos - 1) div {CHUNK}"))
    runs = runs.withColumn("new", F.coalesce(F.lag(F.col("pos") + F.col("windows")).over(near) != F.col("pos"), F.lit(True)))
    runs = runs.withColumn("grp", F.sum(F.col("new").cast("int")).over(near))
    runs = runs.select("rec", "chunk", "grp", F.struct("pos", "text").alias("run"))
    joined = runs.groupBy("rec", "chunk", "grp").agg(F.array_sort(F.collect_list("run")).alias("p"))
    rest = F.array_join(F.transform(F.slice("p", 2, CHUNK), lambda x: F.substring(x["text"], k, CHUNK)), "")
    frags = joined.select(F.concat(F.col("p")[0]["text"], rest).alias("body"))
    word = (lambda x: x) if k > PACKED_MAX_K else encode
    return _finish(frags, word(F.left("body", F.lit(k))), word(F.right("body", F.lit(k))), k, complements)
