import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.functions import text as T
from kmerloom.operators import extract, overlaps
from kmerloom.operators.bound import lower_bound
from kmerloom.streaming.superstring import read_stream_pieces, streaming_superstring, write_stream
from tests import brute

RECORDS = ["ACCCGAAC", "CGTANATGC", "AcCCGTTTAACG", "A"]


def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "rec long, seq string")


def kset(spark, words, k):
    return spark.createDataFrame([(w,) for w in words], "s string").select(K.codec(k).from_text(F.col("s")).alias("kmer"))


@pytest.mark.parametrize(
    "k,c,case,n", [(10, True, False, 3), (10, True, True, 2), (5, True, False, 11), (5, False, False, 11), (2, True, False, 9), (2, False, False, 11)]
)
def test_distinct_counts(spark, k, c, case, n):
    assert extract.kmers(seqs(spark, RECORDS), k, c, case).count() == n


@pytest.mark.parametrize("k", [1, 2, 3, 8, 31, 32, 63, 127])
def test_kmers_match_brute_force(spark, k):
    long = ("ACGTTGCANGGATTACAacgtTTGACCA" * 150)[: 1024 * 3 + k]
    texts = [*RECORDS, long, "NNNN", ""]
    for c in (True, False):
        got = {r.kmer for r in extract.decoded(extract.kmers(seqs(spark, texts), k, c), k).collect()}
        assert got == brute.kmer_set(texts, k, c)


@pytest.mark.parametrize("k,c,want", [(3, True, "ACCCGAacCGtaATgcTTta"), (2, True, "ACcCGAaTaATGc"), (1, True, "AC"), (1, False, "ACGT")])
def test_streaming_goldens(spark, k, c, want):
    rows = streaming_superstring(seqs(spark, RECORDS), k, c).orderBy("rec", "pos").collect()
    assert "".join(r.piece for r in rows) == want


def test_streaming_crosses_chunks(spark):
    import random

    random.seed(3)
    texts = ["".join(random.choice("ACGT" * 8 + "N") for _ in range(2500)) for _ in range(2)]
    for k in (4, 6, 33):
        rows = streaming_superstring(seqs(spark, texts), k, True).orderBy("rec", "pos").collect()
        assert "".join(r.piece for r in rows) == brute.streaming(texts, k, True)


@pytest.mark.parametrize(
    "words,k,c,want",
    [(["ACG", "CGT", "TAA"], 3, False, 5), (["AC", "GG"], 2, True, 3), (["AAACCC", "CCCAAA", "TGGGGT"], 6, False, 11), (["AT"], 2, True, 2)],
)
def test_lower_bound(spark, words, k, c, want):
    assert lower_bound(kset(spark, words, k), k, c).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([("ATT", "ATttCgga"), ("CAC", "ATC"), ("CG", "Aaaaaa")], "s string, ms string")
    got = df.select(K.reverse_complement(F.col("s")), T.infer_k(F.col("ms")), K.decode(K.codec(3).rc(K.encode(F.col("s")), 3), 3)).collect()
    assert [r[0] for r in got] == ["AAT", "GTG", "CG"]
    assert [r[1] for r in got] == [4, 1, 6]
    assert [r[2] for r in got][:2] == ["AAT", "GTG"]
    row = df.limit(1).select(
        K.encode(F.lit("AGT")), K.base_code(F.lit("B")), K.max_overlap(F.lit("ACGT"), F.lit("GTAC"), 4), K.drop_overlap(F.lit("ACGT"), 1), T.mask_bits(F.lit("ACgt"))
    ).first()
    assert list(row) == [0b001011, -1, 2, "CGT", "1100"]


@pytest.mark.parametrize(
    "words,kmer,d,side,want",
    [
        (["TCC", "CTA", "ACT", "CCT"], "ACT", 1, "right", "CTA"),
        (["TTT", "TCC", "ACT", "CCT"], "TTT", 2, "right", "TCC"),
        (["TCC", "ACT", "CCT"], "ACT", 1, "right", None),
        (["TCC", "CTA", "ACT", "TAC"], "TAC", 1, "left", "CTA"),
    ],
)
def test_extensions(spark, words, kmer, d, side, want):
    r = overlaps.extensions(kset(spark, words, 3), 3, d, side)
    got = [x.t for x in r.where(K.decode(F.col("kmer"), 3) == kmer).select(K.decode(F.col("target"), 3).alias("t")).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("k", [5, 31, 32, 63, 64, 127])
@pytest.mark.parametrize("c", [True, False])
def test_packed_words_of_any_length(spark, k, c):
    rnd = random.Random(k)
    texts = ["".join(rnd.choice("ACGTACGTacgtN" if rnd.random() < 0.02 else "ACGTacgt") for _ in range(400)) for _ in range(3)] + ["ACGT" * 60, "T" * 140]
    counts = {}
    for t in texts:
        for i in range(len(t) - k + 1):
            w = t[i : i + k].upper()
            if set(w) <= set("ACGT"):
                w = brute.canon(w) if c else w
                counts[w] = counts.get(w, 0) + 1
    got = extract.decoded(extract.kmer_counts(seqs(spark, texts), k, c), k).collect()
    assert {r.kmer: r.n for r in got} == counts
    rows = extract.decoded(extract.windows(seqs(spark, texts), k, c), k).collect()
    assert len(rows) == sum(counts.values())
    for r in rows:
        raw = texts[r.rec][r.pos - 1 : r.pos - 1 + k]
        assert r.kmer == (brute.canon(raw.upper()) if c else raw.upper()) and r.rev == (r.kmer != raw.upper()) and r.up == raw[0].isupper()
    ordered = extract.word_windows(seqs(spark, texts), k, c).select(*extract.word_names(k), extract.from_words(k).alias("kmer")).orderBy(*extract.word_names(k)).collect()
    words = [r.kmer for r in ordered]
    assert words == sorted(words)


def plain_bound(words, k, c):
    """Overlaps taken from long to short wherever ends fit, without the cycle test; both strands count each merge twice."""
    every = list(words) + [brute.canon(w) if brute.canon(w) != w else w[::-1].translate(str.maketrans("ACGT", "TGCA")) for w in words] if c else list(words)
    tails, heads, saved = dict.fromkeys(range(len(every))), dict.fromkeys(range(len(every))), 0
    for d in range(k - 1, 0, -1):
        starts = {}
        for i in heads:
            starts.setdefault(every[i][:d], []).append(i)
        for i in list(tails):
            fits = starts.get(every[i][k - d :])
            if fits:
                heads.pop(fits.pop())
                tails.pop(i)
                saved += d
    total = len(every) * k - saved
    return total // 2 if c else total


@pytest.mark.parametrize("k,n,c", [(4, 30, False), (9, 60, False), (31, 40, False), (33, 20, False)])
def test_lower_bound_equals_a_plain_count(spark, k, n, c):
    rnd = random.Random(n)
    genome = "".join(rnd.choice("ACGT") for _ in range(3 * n))
    words = sorted({genome[i : i + k] for i in rnd.sample(range(len(genome) - k), n)} | {"A" * k, "T" * k})
    assert lower_bound(kset(spark, words, k), k, c).first()[0] == plain_bound(words, k, c)


def test_stream_over_files_in_three_batches(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ACGTACGTN") for _ in range(rnd.randint(0, 1500))) for _ in range(12)] + ["ACGT" * 300] * 2
    whole = seqs(spark, texts)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        whole.where(f"rec div 5 = {i}").repartition(2).write.mode("append").parquet(source)
        write_stream(spark.readStream.schema("rec long, seq string").parquet(source), 7, folder).awaitTermination()
    got = read_stream_pieces(spark, folder)
    assert got.select("trigger").distinct().count() == 3
    assert sorted(map(tuple, got.select("rec", "pos", "piece").collect())) == sorted(map(tuple, streaming_superstring(whole, 7).collect()))
    write_stream(spark.readStream.schema("rec long, seq string").parquet(source), 7, folder).awaitTermination()
    assert read_stream_pieces(spark, folder).count() == got.count()
