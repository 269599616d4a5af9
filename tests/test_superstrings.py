import itertools
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import convert, extract, masks, superstrings
from kmerloom.operators.bound import lower_bound
from kmerloom.operators.bounded import bounded
from kmerloom.operators.chains import resolve
from tests import brute
from tests.test_extract import kset, seqs


def text(pieces):
    return "".join(r.piece for r in pieces.orderBy("part", "rank").collect())


@pytest.mark.parametrize(
    "words,k,c,want",
    [
        (["CGT", "TAC", "ACG"], 3, False, "TACgt"),
        (["CGT", "TTT", "ACG"], 3, False, "ACgTtt"),
        (["TACT", "ACTT"], 4, False, "TActt"),
        (["TACT", "ACTT", "GGAC", "TAAG"], 4, False, "TActTaaGgac"),
        (["TTTCTTTTTTTTTTTTTTTTTTTTTTTTTTG", "TTCTTTTTTTTTTTTTTTTTTTTTTTTTTGA"], 31, False, "TTtcttttttttttttttttttttttttttga"),
    ],
)
def test_global_goldens(spark, words, k, c, want):
    got = text(superstrings.global_greedy(kset(spark, words, k), k, c))
    assert len(got) == len(want)
    assert brute.kmer_set([got], k, c, True) == set(words)


def test_local_golden(spark):
    assert text(superstrings.local_greedy(kset(spark, ["GCT", "TAA", "AAA"], 3), 3, 2, False)) == "GcTAaa"


def random_words(k, n, seed, c):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("ACGT" if k < 8 else "AC") for _ in range(k)) for _ in range(n)}
    return sorted({brute.canon(w) for w in words} if c else words)


@pytest.mark.parametrize("k,c", [(4, True), (5, False), (33, True)])
def test_constructors_keep_the_set(spark, k, c):
    words = random_words(k, 40, k + c, c)
    source = kset(spark, words, k).cache()
    low = lower_bound(source, k, c).first()[0]
    makers = {
        4: [lambda: superstrings.global_greedy(source, k, c)],
        5: [lambda: superstrings.local_greedy(source, k, 2, c), lambda: bounded(source, k, c, 3)],
        33: [lambda: superstrings.local_greedy(source, k, 2, c)],
    }
    for make in makers[k]:
        pieces = make()
        s = text(pieces)
        assert brute.kmer_set([s], k, c, True) == set(words)
        assert s[len(s) - k + 1 :].islower() and len(s) >= low
        stats = superstrings.stats(superstrings.to_chunks(pieces, k), k).first()
        assert stats.length == len(s) and stats.ones == sum(map(str.isupper, s))
        runs = sum(1 for i, ch in enumerate(s) if ch.isupper() and (i == 0 or s[i - 1].islower()))
        assert stats.runs == runs


def test_from_sequences_with_repeats(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ACGT" * 10 + "N") for _ in range(1500)) + "A" * 1200 for _ in range(2)]
    s = text(superstrings.global_greedy(seqs(spark, texts), 6, True))
    truth = brute.kmer_set(texts, 6, True)
    assert brute.kmer_set([s], 6, True, True) == truth
    assert sum(map(str.isupper, s)) == len(truth)


@pytest.mark.parametrize("parts", [1, 7])
def test_resolve_chains_and_cycles(spark, parts, monkeypatch):
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: f(self, parts, *a))
    rows = [(i, i + 1, i) for i in range(10, 40)] + [(101, 102, 7), (102, 103, 5), (103, 101, 9), (200, 200, 3)]
    out, n = resolve(spark.createDataFrame(rows, "id long, nxt long, low long"), len(rows))
    got = {r.id: r for r in out.collect()}
    assert all(got[i].root == 40 and got[i].hops == 40 - i and not got[i].cyclic for i in range(10, 40))
    assert n == 4 and {got[i].low for i in (101, 102, 103)} == {5} and got[200].cyclic


def mask_text(spark, s, k, ones):
    ms = seqs(spark, [s])
    return "".join(r.piece for r in masks.apply_mask(ms, ones(ms), k).orderBy("off").collect())


@pytest.mark.parametrize(
    "words,c,goal,want",
    [
        (["ACG", "CGT", "TAA"], False, "zeros", "ACgTaacgt"),
        (["ACG", "CGT", "TAA"], False, "ones", "ACgTaACgt"),
        (["ACG", "TAA"], True, "zeros", "AcgTaacgt"),
        (["ACG", "TAA"], True, "ones", "ACgTaACgt"),
    ],
)
def test_mask_ones(spark, words, c, goal, want):
    assert mask_text(spark, "ACGTAACGT", 3, lambda ms: masks.optimize(ms, 3, c, goal, kset(spark, words, 3))) == want


@pytest.mark.parametrize(
    "s,words,k,c,goal,want",
    [
        ("AcgCGTtacGtATt", ["AC", "CG", "GT", "TT", "AT"], 2, False, "runs", "acgcgttACGtATt"),
        ("AcgCGTtacGtATt", ["AC", "CG", "GT", "TT", "AT"], 2, False, "runsapprox", "ACgCGTtACGtATt"),
        ("ACtaGta", ["ACT", "CTA", "GTA"], 3, True, "runs", "ACTAGta"),
    ],
)
def test_mask_runs(spark, s, words, k, c, goal, want):
    words = [brute.canon(w) for w in words] if c else words
    assert mask_text(spark, s, k, lambda ms: masks.optimize(ms, k, c, goal, kset(spark, words, k))) == want


def test_min_runs_odd_cycle_keeps_cover(spark):
    pairs = [(1, 10), (1, 20), (2, 20), (2, 30), (3, 30), (3, 10)]
    inc = spark.createDataFrame([(k, (2**40, i)) for k, i in pairs], "kmer long, interval struct<rec:long,start:long>")
    assert masks.min_runs_intervals(inc).count() == 2


def test_intervals_span_chunks(spark):
    s = "A" * 3000 + "C" + "A" * 5
    ones = masks.max_ones(seqs(spark, [s]), 3, False, kset(spark, ["AAA"], 3))
    got = masks.with_intervals(ones).groupBy("interval").agg(F.count("*").alias("n")).orderBy("interval").collect()
    assert [(r.interval.rec, r.interval.start, r.n) for r in got] == [(0, 1, 2998), (0, 3002, 3)]


@pytest.mark.parametrize(
    "ms,k,want",
    [("ATttCgg", 3, ["ATTT", "CGG"]), ("ATtGCtCg", 2, ["ATT", "GCT", "CG"]), ("ATCGCTtGCTATACtcCACgttta", 6, ["ATCGCTTGCTA", "GCTATACTCCAC", "CACGTTTA"])],
)
def test_to_strings(spark, ms, k, want):
    assert [r.spell for r in convert.to_strings(seqs(spark, [ms]), k).orderBy("start").collect()] == want


@pytest.mark.parametrize("k", [21, 31, 33])
def test_constructor_masks_and_strings_form_one_chain(spark, k):
    """Record ids of constructed pieces are packed ends and exceed 2^32."""
    rnd = random.Random(k)
    texts = ["".join(rnd.choice("ACGT") for _ in range(120)) for _ in range(12)]
    texts += [t[20:90] for t in texts[:4]]
    truth = brute.kmer_set(texts, k, True)
    pieces = superstrings.to_chunks(superstrings.global_greedy(seqs(spark, texts), k, True), k)
    assert pieces.where("rec > 4294967296").count() > 0 or k > 31
    for goal in ("ones", "zeros", "runs", "runsapprox"):
        again = masks.apply_mask(pieces, masks.optimize(pieces, k, True, goal), k)
        joined = again.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("off", "piece"))).alias("p")).collect()
        got = ["".join(x.piece for x in r.p) for r in joined]
        assert brute.kmer_set(got, k, True, True) == truth
    spelled = [r.spell for r in convert.to_strings(pieces, k).collect()]
    assert brute.kmer_set(spelled, k, True) == truth


def test_records_far_apart_keep_their_intervals(spark):
    ids = [5, 2**32 + 5, 2**40 + 5, -3]
    ms = spark.createDataFrame([(i, "ACGTACgtAC" + "ACGT"[n] * 4) for n, i in enumerate(ids)], "rec long, seq string")
    got = masks.with_intervals(masks.max_ones(ms, 4, False)).select("rec", "interval.*").toDF("rec", "r", "s").collect()
    assert all(x.rec == x.r for x in got) and {x.r for x in got} == set(ids)
    assert {r.rec for r in convert.to_strings(ms, 4).collect()} == set(ids)
    first = {(r.rec, r.pos) for r in masks.min_ones(ms, 4, False).collect()}
    assert all(rec == -3 for rec, pos in first if pos == 1)


@pytest.mark.parametrize("partitions", [2, 5, 16])
def test_strings_do_not_depend_on_partitioning(spark, partitions):
    words = random_words(12, 60, 1, True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = text(superstrings.global_greedy(kset(spark, words, 12).repartition(partitions), 12, True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    seen = test_strings_do_not_depend_on_partitioning.__dict__.setdefault("seen", got)
    assert got == seen


def test_bounded_is_never_dearer_than_global(spark):
    rnd = random.Random(0)
    genome = "".join(rnd.choice("ACGT") for _ in range(200))
    texts = [genome[i : i + 40] for i in range(0, 160, 9)]
    source = seqs(spark, texts)

    def measured(pieces):
        r = superstrings.stats(superstrings.to_chunks(pieces, 6), 6).first()
        return r.length, r.runs

    plain = measured(superstrings.global_greedy(source, 6, True))
    for penalty in (0, 12):
        pieces = bounded(source, 6, True, penalty)
        length, runs = measured(pieces)
        assert length + penalty * runs <= plain[0] + penalty * plain[1]
        assert brute.kmer_set([text(pieces)], 6, True, True) == brute.kmer_set(texts, 6, True)


def cost(pieces, k, penalty):
    r = superstrings.stats(superstrings.to_chunks(pieces, k), k).first()
    return r.length + penalty * r.runs


def optimum(words, k, penalty):
    """Cheapest superstring that is a walk over the set: each hop costs the letters it adds, and a penalty where it starts a run."""
    n = len(words)
    overlap = lambda a, b: next(d for d in range(k - 1, -1, -1) if a[k - d :] == b[:d])
    hop = [[0 if i == j else k - overlap(a, b) + (penalty if overlap(a, b) < k - 1 else 0) for j, b in enumerate(words)] for i, a in enumerate(words)]
    for m in range(n):
        for i in range(n):
            for j in range(n):
                hop[i][j] = min(hop[i][j], hop[i][m] + hop[m][j])
    best = min(sum(hop[a][b] for a, b in zip(p, p[1:])) for p in itertools.permutations(range(n)))
    return best + k + penalty


def test_search_by_cost_against_the_optimum(spark):
    """Sets of up to seven k-mers: the set stays, and in most of them the cost is the least possible one."""
    rnd, best, least = random.Random(5), 0, 0
    for i in range(4):
        genome = "".join(rnd.choice("ACGT") for _ in range(9))
        words = sorted({genome[j : j + 4] for j in rnd.sample(range(6), rnd.randint(4, 6))} | {"".join(rnd.choice("AC") for _ in range(4))})
        penalty = rnd.choice([1, 2, 4])
        pieces = bounded(kset(spark, words, 4), 4, False, penalty, combined=True)
        assert brute.kmer_set([text(pieces)], 4, False, True) == set(words)
        low, got = optimum(words, 4, penalty), cost(pieces, 4, penalty)
        assert got >= low
        best, least = best + (got == low), least + (got <= low + penalty)
    assert best >= 2 and least >= 3


@pytest.mark.parametrize("c", [True, False])
def test_search_by_cost_is_not_dearer_than_walks_then_jumps(spark, c):
    words = random_words(7, 90, 1, c)
    source = kset(spark, words, 7).cache()
    both = [bounded(source, 7, c, 3, combined=x) for x in (True, False)]
    assert brute.kmer_set([text(both[0])], 7, c, True) == set(words)
    new, old = (cost(p, 7, 3) for p in both)
    assert new <= old


def test_ends_that_share_words_are_both_linked(spark):
    """Two ends walk through one word; the one that is not linked there goes on to its own start."""
    k = 5
    # two strings end in the same word CCGTA, from which a walk of the set leads to the starts of two others
    texts = ["AAACCGT", "GGACCGT", "CCGTACAG", "TACAGTT", "TACAGGG"]
    words = sorted({t[i : i + k] for t in texts for i in range(len(t) - k + 1)})
    pieces = bounded(kset(spark, words, k), k, False, 6, combined=True)
    assert brute.kmer_set([text(pieces)], k, False, True) == set(words)
    assert cost(pieces, k, 6) <= cost(superstrings.global_greedy(kset(spark, words, k), k, False), k, 6)
    assert superstrings.stats(superstrings.to_chunks(pieces, k), k).first().runs <= 2


@pytest.mark.parametrize("c,words,want", [(False, ["ACAA", "AACA"], {"AAcaa"}), (True, ["ACAA", "ATTT", "AACA"], {"AAcAaat", "AtTTgtt"})])
def test_local_goldens(spark, c, words, want):
    words = [brute.canon(w) for w in words] if c else words
    assert text(superstrings.local_greedy(kset(spark, words, 4), 4, 2, c)) in want
