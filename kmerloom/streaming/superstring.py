"""Streaming masked superstring: input order, a k-mer is a one at its first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerloom.functions.kmers import codec
from kmerloom.operators.extract import CHUNK, first_runs, in_bins, run_text, windows
from kmerloom.operators.fragments import first_occurrences
from kmerloom.plans.runtime import cut


def streaming_superstring(seqs: DataFrame, k: int, complements: bool = True) -> DataFrame:
    """(rec, pos, piece): concatenation in (rec, pos) order is the masked superstring.

    A position is emitted iff a first occurrence starts there or at most k-1 letters before
    it, so each first occurrence emits its own letters up to the next one.  Windows run per
    chunk; the first positions of a chunk are also shown, as ghosts, to the chunk before.
    """
    return render_first(first_occurrences(seqs, k, complements), k)


def render_first(new: DataFrame, k: int) -> DataFrame:
    """(rec, pos, kmer) of first occurrences -> (rec, pos, piece)."""
    chunk = F.expr(f"pos div {CHUNK}")
    near_start = F.expr(f"pos % {CHUNK} < {k} and pos >= {CHUNK}")
    spots = new.withColumn(
        "spot",
        F.explode(F.when(near_start, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))),
    )
    w = Window.partitionBy("rec", "spot").orderBy("pos")
    gap = F.least(F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(k)), F.lit(k)).cast("int")
    spots = spots.withColumn("gap", gap).where(F.col("spot") == chunk)
    text = codec(k).to_text(F.col("kmer"), k)
    spots = spots.select("rec", "pos", text.alias("text"), "gap")
    piece = F.concat(F.left("text", F.lit(1)), F.lower(F.substring("text", F.lit(2), F.col("gap") - 1)))
    return spots.select("rec", "pos", piece.alias("piece"))


def superstring_lines(seqs: DataFrame, k: int, complements: bool = True) -> DataFrame:
    """``streaming_superstring`` with one piece per chunk: (part, rank, piece), part being rec.

    Where k-mers go by bins, runs of neighbouring first occurrences come out of them whole, so no k-mer has a row of its own.
    """
    chunk = F.expr(f"(pos - 1) div {CHUNK}")
    if in_bins(k):
        near_start = F.expr(f"(pos - 1) % {CHUNK} < {k} and pos > {CHUNK}")
        # spelled before the window: what an aggregate collects is not compiled
        spots = first_runs(seqs, k, complements).select("rec", "pos", "windows", run_text(k).alias("text")).withColumn("spot", F.explode(F.when(near_start, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
        ahead = F.lead("pos").over(Window.partitionBy("rec", "spot").orderBy("pos")) - (F.col("pos") + F.col("windows") - 1)
        spots = spots.withColumn("gap", F.least(F.coalesce(ahead, F.lit(k)), F.lit(k)).cast("int")).where(F.col("spot") == chunk)
        ones = F.col("windows").cast("int")
        pieces = spots.select("rec", "pos", F.concat(F.left("text", ones), F.lower(F.substring("text", ones + 1, F.col("gap") - 1))).alias("piece"))
    else:
        pieces = streaming_superstring(seqs, k, complements)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(F.col("rec").alias("part"), chunk.alias("rank")).agg(joined.alias("piece"))


def write_stream(seqs: DataFrame, k: int, folder: str, complements: bool = True) -> StreamingQuery:
    """Streaming (rec, seq) -> the superstring of all records so far, in ``folder``, trigger by trigger.

    Every trigger takes the records that have arrived. A k-mer is a one where it is seen first: in an earlier trigger, or at
    the smallest (rec, pos) of its own. The k-mers seen so far are the state; they lie as one table per trigger under
    ``folder/seen``, and each trigger writes ``folder/pieces/trigger=<n>`` (rec, pos, piece). Both are overwritten
    if a trigger is run again after a failure, so nothing is counted twice. Concatenating the pieces by (trigger, rec, pos)
    gives the superstring; where records arrive in the order of rec, its rows are those of ``streaming_superstring``.
    """
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(first_occurrences(batch, k, complements))
        key = F.least(F.col("kmer"), codec(k).rc(F.col("kmer"), k)) if complements else F.col("kmer")
        new = new.withColumn("key", key)
        # triggers before this one only: a trigger that is run again does not meet its own k-mers
        if number:
            seen = spark.read.schema(new.select("key").schema).parquet(*[f"{folder}/seen/trigger={i}" for i in range(number)])
            new = cut(new.join(seen, "key", "left_anti"))
        new.select("key").write.mode("overwrite").parquet(f"{folder}/seen/trigger={number}")
        render_first(new.drop("key"), k).write.mode("overwrite").parquet(f"{folder}/pieces/trigger={number}")

    writer = seqs.select("rec", "seq").writeStream.foreachBatch(take).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{folder}/checkpoint").start()


def read_stream_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(trigger, rec, pos, piece) of all triggers so far."""
    return spark.read.schema("rec long, pos long, piece string, trigger long").parquet(f"{folder}/pieces")


def first_seen_stream(seqs: DataFrame, k: int, complements: bool = True) -> DataFrame:
    """Structured Streaming form of the scan: each k-mer once, with deduplication state.

    Works on a streaming (rec, seq) table; the state is keyed by k-mer and so spread over
    all executors.
    """
    return windows(seqs, k, complements).select("kmer").dropDuplicates(["kmer"])
