"""Prefix look-ups of any depth in a k-mer set by one merge of sorted words.

A word of d letters stands for a range of the sorted set. The word's lower end is sorted in between the k-mers, and the
nearest k-mer after it tells whether any starts with the word. So words of all depths are looked up together, and
one range-partitioned sort takes the place of a join per depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kmers import Packed, codec
from kmerloom.operators.ordered import running
from kmerloom.plans.runtime import cut, cut_counted

#: Depths that the first merge of a longest match looks at; most k-mers of a dense set are settled there.
FIRST_DEPTHS = 4


def _ends(word: Column, d: Column, k: int) -> tuple[Column, Column]:
    """Lower and upper end of the range of k-mers that start with a word of d letters."""
    if isinstance(codec(k), Packed):
        low = F.call_function("shiftleft", word, 2 * (F.lit(k) - d))
        return low, low + (F.call_function("shiftleft", F.lit(1).cast("long"), 2 * (F.lit(k) - d)) - 1)
    return word, F.concat(word, F.lit("~"))  # sorts behind all letters


def probe(words: DataFrame, kmer_set: DataFrame, k: int) -> DataFrame:
    """(word, d) with 1 <= d <= k -> (word, d, n, first, last) of the k-mers that start with the word, for words that any does."""
    low, high = _ends(F.col("word"), F.col("d"), k)
    asked = words.select("word", "d").distinct()
    kind = lambda n: F.lit(n).alias("kind")
    have = kmer_set.select(F.col("kmer").alias("value"), kind(1), F.lit(None).cast(asked.schema["word"].dataType).alias("word"), F.lit(None).cast("int").alias("d"))
    ends = [asked.select(v.alias("value"), kind(n), "word", F.col("d").cast("int").alias("d")) for v, n in ((low, 0), (high, 2))]
    rows = have.unionByName(ends[0]).unionByName(ends[1])
    own = F.when(F.col("kind") == 1, F.col("value"))
    met = cut(running(rows, [F.col("value"), F.col("kind")], {"upto": ("sum", (F.col("kind") == 1).cast("long")), "last": ("max", own)}).where("kind <> 1"))
    from_, until = (met.where(f"kind = {n}").select("word", "d", F.col("upto").alias(name), "last") for n, name in ((0, "low"), (2, "high")))
    found = cut(from_.drop("last").join(until, ["word", "d"]).where("high > low"))
    ranked = running(kmer_set.select("kmer"), [F.col("kmer")], {"rank": ("sum", F.lit(1).cast("long"))})
    first = ranked.select(F.col("rank").alias("at"), F.col("kmer").alias("first"))
    return found.withColumn("at", F.col("low") + 1).join(first, "at").select("word", "d", (F.col("high") - F.col("low")).alias("n"), "first", "last")


def _matches(open_: DataFrame, ranked: DataFrame, k: int, depths: range) -> DataFrame:
    """(kmer, d, first, second): every depth at which a suffix is a prefix of the set, with the smallest and the next k-mer there."""
    c, kind = codec(k), lambda n: F.lit(n).alias("kind")
    d = F.explode(F.sequence(F.lit(depths.start), F.lit(depths.stop - 1))).alias("d")
    asked = open_.select("kmer", d)
    low, high = _ends(c.suffix_at(F.col("kmer"), F.col("d")), F.col("d"), k)
    asked = asked.select(low.alias("value"), kind(0), "kmer", "d", high.alias("high"))
    same = asked.schema["kmer"].dataType
    have = ranked.select(F.col("kmer").alias("value"), kind(1), F.col("next").alias("kmer"), F.lit(None).cast("int").alias("d"), F.lit(None).cast(same).alias("high"))
    own = F.when(F.col("kind") == 1, F.struct(F.col("value").alias("first"), F.col("kmer").alias("second")))
    met = running(have.unionByName(asked), [F.col("value").desc(), F.col("kind").desc()], {"near": ("min", own)}).where("kind = 0 and near.first <= high")
    return met.select("kmer", "d", "near.first", F.when(F.col("near.second") <= F.col("high"), F.col("near.second")).alias("second"))


def longest_matches(kmer_set: DataFrame, k: int, other: bool) -> DataFrame:
    """(kmer, depth, first): the longest proper suffix of each k-mer that is a prefix of a k-mer of the set, and the smallest such
    k-mer, with ``other`` one that differs from the k-mer itself; depth 0 and null where there is none.

    One merge looks at the longest suffixes, a second one at all others of the k-mers left over.
    """
    ranked = cut(running(kmer_set.select("kmer"), [F.col("kmer").desc()], {"next": ("min", F.col("kmer"))}, before=True))
    open_, found = ranked.select("kmer"), None
    for depths in (range(max(k - FIRST_DEPTHS, 1), k), range(1, k - FIRST_DEPTHS)):
        if not len(depths):
            continue
        hits = _matches(open_, ranked, k, depths)
        if other:
            hits = hits.withColumn("first", F.when(F.col("first") != F.col("kmer"), F.col("first")).otherwise(F.col("second"))).where("first is not null")
        best = cut(hits.groupBy("kmer").agg(F.max("d").alias("depth"), F.max_by("first", "d").alias("first")))
        found = best if found is None else found.unionByName(best)
        open_, n = cut_counted(open_.join(best.select("kmer"), "kmer", "left_anti"))
        if n == 0:
            return found
    none = open_.select("kmer", F.lit(0).alias("depth"), F.lit(None).cast(open_.schema["kmer"].dataType).alias("first"))
    return none if found is None else found.unionByName(none)
