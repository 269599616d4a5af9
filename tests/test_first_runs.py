import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.kmers import decode, encode
from kmerloom.operators import extract, fragments, matching, superstrings
from kmerloom.operators.extract import CHUNK
from kmerloom.streaming.superstring import streaming_superstring, superstring_lines


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def records(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(2600))
    out = [(7, base), (3, base[200:900] + "N" + rc(base[1000:1500])), (11, "A" * 200 + base[:80]), (5, "ACGT" * 40), (-2, "ACG")]
    return [*out, (9, "".join(rng.choice("AC") for _ in range(1300)) + rc(base))]


@pytest.mark.parametrize("k", [23, 31, 41, 47])
@pytest.mark.parametrize("both", [True, False])
def test_runs_are_the_first_places(spark, k, both):
    rows = records(k)
    want, seen = set(), set()
    for rec, seq in sorted(rows):
        for i in range(len(seq) - k + 1):
            w = seq[i : i + k]
            key = min(w, rc(w)) if both else w
            if "N" not in w and key not in seen:
                seen.add(key)
                want.add((rec, i + 1, w))
    df = spark.createDataFrame(rows, "rec long, seq string").repartition(3)
    got = extract.first_runs(df, k, both).select("rec", "pos", "windows", extract.run_text(k).alias("text")).collect()
    flat = [(r.rec, r.pos + i, r.text[i : i + k]) for r in got for i in range(r.windows)]
    assert len(flat) == len(want) and set(flat) == want
    assert all(len(r.text) == r.windows + k - 1 for r in got)
    bodies = [r.body for r in fragments.from_sequences(df, k, both).collect()]
    shown = [b[i : i + k] for b in bodies for i in range(len(b) - k + 1)]
    assert len(shown) == len(seen) and {min(w, rc(w)) if both else w for w in shown} == seen
    # neighbours of one chunk are in one fragment
    ends = {(rec, pos) for rec, pos, _ in want}
    assert len(bodies) == sum((rec, pos - 1) not in ends or (pos - 1) % CHUNK == 0 for rec, pos, _ in want)


def test_runs_move_little(spark):
    """Constructors send stretches to their bins, not a row for each window."""
    df = spark.createDataFrame(records(1), "rec long, seq string")
    sent = extract.stretches(df, 31, True, placed=True, once=True)
    assert sent.count() * 4 < extract.windows(df, 31, True).count()


@pytest.mark.parametrize("k", [11, 31, 41])
@pytest.mark.parametrize("both", [True, False])
def test_superstring_has_one_line_per_chunk(spark, k, both):
    """The lines spell what the pieces of single k-mers do; before, each k-mer was a line."""
    df = spark.createDataFrame(records(k), "rec long, seq string").repartition(3)
    want = {}
    for r in sorted(streaming_superstring(df, k, both).collect()):
        want[r.rec] = want.get(r.rec, "") + r.piece
    lines = sorted(superstring_lines(df, k, both).collect())
    got = {}
    for r in lines:
        got[r.part] = got.get(r.part, "") + r.piece
    assert got == want
    assert len(lines) <= sum(len(seq) // CHUNK + 1 for _, seq in records(k))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 24, 31])
def test_packed_words_are_spelled_as_they_were_packed(spark, n):
    words = {"".join(random.Random(i).choices("ACGT", k=n)) for i in range(200)} | {"A" * n, "T" * n}
    t = spark.createDataFrame([(w,) for w in words], "w string").withColumn("x", encode(F.col("w")))
    assert t.where(decode(F.col("x"), n) != F.col("w")).count() == 0


def test_levels_rank_small_words_at_once(spark, monkeypatch):
    """Whether ranks are taken in parts goes by the counted ends of a word; before, all overlaps below k - 8 were. The result is the same."""
    df = spark.createDataFrame(records(5), "rec long, seq string")
    frags = fragments.from_sequences(df, 31, True)
    m = matching.Matcher(31, True).start(frags)
    assert not m._small(22)
    m.level(30)
    overlap, most = m.largest
    assert overlap == 30 and 0 < most <= 4  # a word and its complement start and end four k-mers each
    assert m._small(22) and not m._small(2)
    got = sorted(superstrings.local_greedy(df, 31, 9).collect())
    monkeypatch.setattr(matching, "UNSALTED_ENDS", -1)
    assert got == sorted(superstrings.local_greedy(df, 31, 9).collect())
