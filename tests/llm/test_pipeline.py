import itertools
import os
import random
import string
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import decontaminate, near, simhash, toxicity
from kmerloom.plans import runtime
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic, copied, leaked and odd documents, and what is planted in it."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(3, 7))) for _ in range(500)]
    clean = [" ".join(rnd.choices(words, k=rnd.randint(40, 120))) for _ in range(260)]
    items = [(i, " ".join(rnd.choices(words, k=30))) for i in range(8)]
    rows, labels = [], []
    for i, text in enumerate(clean):
        if i % 5 == 0:
            text = text + " zornwicht " + rnd.choice(words)
        rows.append((i, text, "en", f"s{i % 3 if i % 4 else 0}", len(text)))
        labels.append((i, 0, int(i % 5 == 0)))
    rows += [(1000 + i, clean[i * 5 + 1], "en", "s1", 0) for i in range(10)]
    rows += [(2000 + i, clean[i * 7 + 2] + " " + items[i][1] + " " + clean[i * 7 + 3], "en", "s2", 0) for i in range(8)]
    rows += [(3000, "", "en", None, 0), (3001, None, None, "s0", None), (None, "a text without a number", "en", "s1", 23)]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), items


def test_every_stage_does_its_own_work(spark, folder):
    root, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    kept = stages[0](spark, docs, root).cache()
    assert kept.columns == columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.query(docs, spark.read.parquet(f"{root}/labels.parquet")).collect()}
    assert sorted(map(str, scores)) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in scores.items() if not p}
    assert not [r for r in kept.collect() if "zornwicht" in (r["text"] or "")]

    single = stages[1](spark, kept, root).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = brute.classes([(i, brute.simhash(t)) for i, t in rows])
    assert single.columns == columns
    assert {r["doc_id"] for r in single.collect()} == {i for (i, _), g in zip(rows, groups) if i is None or i == g}

    groups = brute.near_classes(rows)
    assert {r["doc_id"] for r in single.collect()} == {i for (i, _), g in zip(rows, groups) if i is None or i == g}

    clean = stages[2](spark, single, root).cache()
    assert clean.columns == columns
    items = [decontaminate.words_of(t) for _, t in items]

    def leaks(text):
        have = decontaminate.words_of(text or "")
        return any(have[s : s + len(i)] == i for i in items for s in range(len(have) - len(i) + 1))

    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not leaks(r["text"])}

    mixed = stages[3](spark, clean, root).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in clean.collect()}

    placed = stages[4](spark, mixed, root)
    want = brute.shards([(r["doc_id"], r["text"]) for r in mixed.collect()])
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in placed.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, root).collect()]
    assert sorted(whole, key=str) == sorted(got, key=str)


def test_stages_take_an_empty_table(spark, folder):
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        assert out.count() == 0


def test_near_copies_from_a_similarity_of_four_fifths_go(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]

    def grams(text):
        have = text.split()
        return {tuple(have[i : i + 5]) for i in range(len(have) - 4)}

    rows, alike = [], {}
    for i in range(120):
        base = rnd.choices(words, k=200)
        copy = list(base)
        # 5 to 60 % of the grams differ: similarity 0.4 to 0.95
        for at in rnd.sample(range(200), 1 + i % 12):
            copy[at] = copy[at] + "x"
        a, b = " ".join(base), " ".join(copy)
        rows += [(2 * i, a, "en", "s", 0), (2 * i + 1, b, "en", "s", 0)]
        alike[2 * i + 1] = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert kept == set(range(0, 240, 2)) | {i for i, s in alike.items() if s < 0.8}
    assert sum(0.8 <= s <= 0.9 for s in alike.values()) > 10 and min(alike.values()) < 0.6


def test_near_dedup_starts_from_the_anchors(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(900)]
    texts = [" ".join(rnd.choices(words, k=150)) for _ in range(30)]
    texts += [t + " end" for t in texts[:10]] + ["one two", "", "One  two"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pairs, real = [], simhash.met

    def seen(marked, threshold):
        out = real(marked, threshold)
        pairs.extend(out.collect())
        return out

    monkeypatch.setattr(simhash, "met", seen)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    prints = [(i, brute.simhash(t)) for i, t in enumerate(texts)]
    close = sum(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for (i, a), (j, b) in itertools.combinations(prints, 2) if texts[i].lower().split() != texts[j].lower().split())
    assert len(pairs) == close >= 3
    groups = brute.near_classes([(i, t) for i, t, *_ in rows])
    assert kept == {i for (i, *_), g in zip(rows, groups) if i == g}


ODD = "doc_id long, text string, node string, keys string, sig int, u string, root int"


def near_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "x", 1, "x", 2) for i, t in rows], ODD)
    return sorted(((r["doc_id"], r["component_id"]) for r in near.near_duplicates(docs).collect()), key=str)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "One"), (6, "one two three four"), (7, "one  two\tthree four"), (None, "one"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "x " * 4000)]
    assert near_of(spark, rows) == sorted(zip([i for i, _ in rows], brute.near_classes(rows)), key=str)
    assert near_of(spark, rows[:3]) == [(1, 1), (2, 1), (3, 1)] and near_of(spark, []) == []


def drifted(rnd, words, n, length=120):
    """A text and copies of it with more and more words changed, also copies of copies."""
    base = rnd.choices(words, k=length)
    group = [base]
    for i in range(n - 1):
        copy = list(rnd.choice(group[: 1 + i // 4]))
        for at in rnd.sample(range(length), rnd.randint(0, 9)):
            copy[at] = rnd.choice(words)
        group.append(copy)
    return [" ".join(g) for g in group]


def test_drifting_groups_equal_all_pairs_and_do_not_grow_squarely(spark, monkeypatch):
    rnd = random.Random(21)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    pairs, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda found, *a: pairs.append(found.count()) or verified(found, *a))
    made = []
    for n in (150, 300):
        rows = list(enumerate(drifted(rnd, words, n) + drifted(rnd, words, 20)))
        pairs.clear()
        got = near_of(spark, rows)
        want = sorted(zip([i for i, _ in rows], brute.near_classes(rows)), key=str)
        assert sum(a != b for a, b in zip(got, want)) <= len(rows) // 100
        made.append(sum(pairs))
    assert made[0] < 150 * 149 / 4 and made[1] < 3 * made[0]


def test_recall_by_similarity(spark):
    """Pairs of one text and a changed copy: nearly all from 0.8 on are linked, none below."""
    rnd = random.Random(22)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(5000)]
    rows, want = [], {}
    for i in range(400):
        base = rnd.choices(words, k=150)
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randint(1, 6)):
            copy[at] = copy[at] + "x"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want[2 * i + 1] = brute.alike(brute.word_shingles(rows[-1][1]), brute.word_shingles(rows[-2][1]))
    linked = {i for i, c in near_of(spark, rows) if i % 2 and i != c}
    assert not [i for i in linked if want[i] < 0.8]
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        here = [i for i, s in want.items() if low <= s < high]
        print(f"similarity {low} to {high}: {sum(i in linked for i in here)} of {len(here)} linked")
        assert len(here) > 20 and sum(i in linked for i in here) >= 0.98 * len(here)


def test_members_of_buckets_move_once(spark):
    """Buckets with several roots are found where their members are sent, without a second table of the buckets to join."""
    rows = [(1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 12, 6), (3, 13, 7), (4, 14, 8), (4, 15, 9), (4, 16, 8)]
    out = near._apart(spark.createDataFrame(rows, "key long, node long, root long"))
    assert sorted(tuple(r) for r in out.collect()) == [r for r in rows if r[0] in (2, 4)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_cut_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, held = files(), spark.conf.get(runtime._CLEANUP)
    pairs = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out, n = runtime.cut_counted(pairs.join(spark.range(100).repartition(2, "id"), F.col("k") == F.col("id")))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(runtime._CLEANUP) == held
    assert n == out.count() == 100


def test_near_dedup_deletes_what_it_has_read(spark, tmp_path, monkeypatch):
    rnd = random.Random(23)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    rows = [(i, t, "x", "x", 1, "x", 2) for i, t in enumerate(drifted(rnd, words, 60) + drifted(rnd, words, 20))]
    monkeypatch.setattr(runtime, "scratch_folder", lambda _: str(tmp_path))
    out = near.near_duplicates(spark.createDataFrame(rows, ODD), candidates=simhash.met)
    left = [spark.read.parquet(str(t)).columns for t in (tmp_path / "kmerloom-tables").iterdir()]
    # rows, smallest ids, fingerprints, and links of pairs and of components
    assert not [c for c in left if {"text", "sig", "keys", "key", "sketch"} & set(c)] and len(left) <= 12
    got = sorted((r["doc_id"], r["component_id"]) for r in out.collect())
    assert sum(a != b for a, b in zip(got, enumerate(brute.near_classes([r[:2] for r in rows])))) <= 1
