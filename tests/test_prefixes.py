import random

import pytest

from kmerloom.functions.kmers import codec
from kmerloom.operators import overlaps, prefixes
from kmerloom.operators.extract import decoded
from pyspark.sql import functions as F
from tests.test_extract import kset


def words_of(k, n, seed, letters="ACGT"):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(k)) for _ in range(n)})


@pytest.mark.parametrize("k,n,letters", [(2, 9, "ACGT"), (7, 60, "AC"), (31, 40, "AC"), (33, 30, "AC")])
def test_longest_matches_equal_a_plain_search(spark, k, n, letters):
    words = words_of(k, n, k, letters) + (["A" * k] if letters == "AC" else [])
    words = sorted(set(words))
    source = kset(spark, words, k)
    links = {r.kmer: r.depth for r in decoded(overlaps.failure_links(source, k), k).collect()}
    assert links == {w: next((d for d in range(k - 1, 0, -1) if any(x.startswith(w[-d:]) for x in words)), 0) for w in words}
    c = codec(k)
    best = overlaps.best_overlaps(source, k).select(c.to_text(F.col("src"), k).alias("src"), c.to_text(F.col("dst"), k).alias("dst"), "overlap").collect()
    want = set()
    for w in words:
        for d in range(k - 1, 0, -1):
            hits = [x for x in words if x != w and x.startswith(w[-d:])]
            if hits:
                want.add((w, min(hits), d))
                break
    assert {tuple(r) for r in best} == want and len(best) == len(want)


@pytest.mark.parametrize("k", [6, 34])
def test_probes_of_mixed_depths(spark, k):
    words, rnd = words_of(k, 80, 3, "ACT"), random.Random(4)
    asked = {(w[: (d := rnd.randint(1, k))], d) for w in words} | {("G" * d, d) for d in (1, 3, k)} | {("A", 1), ("T" * k, k), ("A" * k, k)}
    c = codec(k)
    frame = spark.createDataFrame([(w, d) for w, d in asked] * 2, "text string, d int")
    got = prefixes.probe(frame.select(c.from_text(F.col("text")).alias("word"), "d"), kset(spark, words, k), k)
    got = {(r.d, r.n, r.first, r.last) for r in got.select("d", "n", c.to_text(F.col("first"), k).alias("first"), c.to_text(F.col("last"), k).alias("last")).collect()}
    want = set()
    for w, d in asked:
        hits = [x for x in words if x.startswith(w)]
        if hits:
            want.add((d, len(hits), min(hits), max(hits)))
    assert got == want
