"""Joins on string overlaps of k-mers (suffix of one = prefix of another)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.kmers import codec
from kmerloom.operators.prefixes import longest_matches
from kmerloom.plans.runtime import cut


def overlap_pairs(kmer_set: DataFrame, k: int, d: int) -> DataFrame:
    """(src, dst, overlap): every ordered pair of different k-mers overlapping by d letters.

    Meant for d close to k, where a word has at most 4^(k-d) partners; matching at small d
    goes through the ranked matcher instead, which never lists all pairs.
    """
    c = codec(k)
    a = kmer_set.select(F.col("kmer").alias("src"), c.suffix(F.col("kmer"), d).alias("w"))
    b = kmer_set.select(F.col("kmer").alias("dst"), c.prefix(F.col("kmer"), k, d).alias("w"))
    return a.join(b, "w").where("src <> dst").select("src", "dst", F.lit(d).alias("overlap"))


def best_overlaps(kmer_set: DataFrame, k: int) -> DataFrame:
    """(src, dst, overlap): the longest overlap (1..k-1) of each k-mer with another one, the
    smallest partner on ties; k-mers without one are left out."""
    best = longest_matches(kmer_set, k, other=True).where("depth > 0")
    return best.select(F.col("kmer").alias("src"), F.col("first").alias("dst"), F.col("depth").alias("overlap"))


def failure_links(kmer_set: DataFrame, k: int) -> DataFrame:
    """(kmer, depth): longest proper suffix of the k-mer that is a prefix of any k-mer."""
    return longest_matches(kmer_set, k, other=False).select("kmer", "depth")


def prefix_ranges(probe: DataFrame, kmer_set: DataFrame, k: int, d: int) -> DataFrame:
    """(word, n, first, last): the k-mers of the set that start with each probed word of d letters."""
    c = codec(k)
    rows = kmer_set.groupBy(c.prefix(F.col("kmer"), k, d).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min("kmer").alias("first"), F.max("kmer").alias("last")
    )
    return rows.join(probe.select("word").distinct(), "word", "left_semi")


def extensions(kmer_set: DataFrame, k: int, d: int, side: str) -> DataFrame:
    """(kmer, target): smallest k-mer that extends each k-mer by d letters on the given side.

    Right: it starts with the last k-d letters; left: it ends with the first k-d letters.
    Among right (left) extensions the smallest added word is the smallest k-mer.
    """
    c = codec(k)
    x = F.col("kmer")
    tail, head = c.suffix(x, k - d), c.prefix(x, k, k - d)
    want, have = (tail, head) if side == "right" else (head, tail)
    best = kmer_set.groupBy(have.alias("w")).agg(F.min("kmer").alias("target"))
    return kmer_set.select("kmer", want.alias("w")).join(best, "w").select("kmer", "target")


def complement_pairs(kmer_set: DataFrame, k: int) -> DataFrame:
    """(kmer, rc): pairs of the set that are reverse complements, each once; palindromes with themselves."""
    r = kmer_set.select("kmer", codec(k).rc(F.col("kmer"), k).alias("rc")).where("kmer <= rc")
    return r.join(kmer_set.select(F.col("kmer").alias("rc")), "rc", "left_semi").select("kmer", "rc")


def presorted(indexed: DataFrame, k: int, index: str) -> DataFrame:
    """(kmer, bucket, place): the order by the first four letters only, stable in ``index``; place counts from 1 in each bucket.

    A bucket may hold any share of the set, so its places are counted in the parts of a range
    partitioning and shifted by what earlier parts hold of the bucket.
    """
    bucket = codec(k).prefix(F.col("kmer"), k, min(4, k))
    rows = indexed.select("kmer", bucket.alias("bucket"), F.col(index).alias("index"))
    rows = cut(rows.repartitionByRange("bucket", "index").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("index"))
    placed = rows.withColumn("own", own).join(sizes.select("bucket", "part", earlier.alias("earlier")), ["bucket", "part"])
    return placed.select("kmer", "bucket", (F.col("own") + F.col("earlier")).alias("place"))


def with_previous(kmer_set: DataFrame) -> DataFrame:
    """(kmer, previous): the sorted set, each k-mer with its predecessor; sorted in range partitions that are
    stitched with one row for each."""
    rows = cut(kmer_set.select("kmer").repartitionByRange("kmer").withColumn("part", F.spark_partition_id()))
    own = F.lag("kmer").over(Window.partitionBy("part").orderBy("kmer"))
    ends = rows.groupBy("part").agg(F.max("kmer").alias("last"))
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    return rows.withColumn("own", own).join(before, "part").select("kmer", F.coalesce("own", "before").alias("previous"))
