import random

import pytest

from kmerloom.operators import bound, convert, extract
from tests import brute


def texts(seed, n=30, letters="ACGTACGTACGTacgtN"):
    rnd = random.Random(seed)
    out = ["".join(rnd.choices(letters, weights=[9] * 12 + [3] * 4 + [1], k=rnd.randint(0, 400))) for _ in range(n)]
    return [*out, *out[:5], *(brute.rc(t.upper().replace("N", "A")) for t in out[5:9]), "ACGT" * 600, "ACGTTGC" * 300, "A" * 1500, ""]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "rec long, seq string")


def counted(seqs, k, c, cased):
    out = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if "N" not in w and (w[0].isupper() or not cased):
                w = brute.canon(w.upper()) if c else w.upper()
                out[w] = out.get(w, 0) + 1
    return out


@pytest.mark.parametrize("k", [23, 30, 31, 32, 41, 47])
@pytest.mark.parametrize("c", [True, False])
def test_stretches_count_every_window(spark, k, c):
    assert extract.in_bins(k)
    seqs = texts(k)
    for cased in (False, True):
        t = extract.kmer_counts(frame(spark, seqs), k, c, cased)
        got = {r["kmer"]: r["n"] for r in extract.decoded(t, k).collect()}
        assert got == counted(seqs, k, c, cased)


def test_few_rows_are_sent_and_counted_where_they_are(spark):
    rnd = random.Random(3)
    seqs = frame(spark, ["".join(rnd.choices("ACGT", k=3000)) for _ in range(20)])
    n = extract.stretches(seqs, 31, True).count()
    assert n < 20 * 2970 / 6
    plan = extract.kmer_counts(seqs, 31, True)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_sides_in_bins(spark):
    a, b = texts(1), texts(2) + texts(1)[:10]
    row = convert.compare_superstrings(frame(spark, a), frame(spark, b), 31, True).first()
    left, right = counted(a, 31, True, True), counted(b, 31, True, True)
    assert (row["only_left"], row["only_right"], row["in_both"]) == (len(left.keys() - right.keys()), len(right.keys() - left.keys()), len(left.keys() & right.keys()))
    assert row["repeated_left"] == sum(left.values()) - len(left)
    got = extract.same_kmers(frame(spark, a), frame(spark, [t.upper() for t in a]), 31, True).first()
    assert got["equal"] and got["n_union"] == len(counted(a, 31, True, False))


@pytest.mark.parametrize("c", [True, False])
def test_bound_from_bins_is_the_bound(spark, c):
    seqs = frame(spark, texts(7))
    plain = bound.lower_bound(extract.kmers(seqs, 31, c), 31, c).first()[0]
    binned = extract.binned_kmers(seqs, 31, c)
    assert "bin" in binned.columns
    assert bound.lower_bound(binned, 31, c).first()[0] == plain
