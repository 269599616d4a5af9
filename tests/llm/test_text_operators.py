import hashlib
import math
import random
import string

import pytest

from kmerloom.llm import decontaminate, mixing, pii, repeats, sharding, simhash, winnow
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, k1 string, row int, doc string"
ODD = [
    "", None, "a", "one two", "  spaces\tand\nlines  ", "é𝄞 Mixed CASE case", "word " * 3000, "x" * 30000, "1" * 5000, "1.1.1.1" * 50,
    "mail a@b.c_d@e.f x@y.zz. and 4111 1111-1111 1111 or +49 89 1234567", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.255.0", "aa@@bb.cc @ a@b .x@y.z..w", "+1 (234) 567-8901 +12345678901234567890",
]


def rows_of(texts, start=0):
    return [(i + start, t, None if i % 7 == 3 else f"s{i % 3}", "clash", i, "clash") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choices(words, k=90))
    texts = [" ".join(rnd.choices(words, k=rnd.randint(5, 250))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5]]
    texts += [t[:100] + passage + t[100:] for t in texts[10:16]]
    near = texts[20].split()
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), texts[20] + " tail", (passage + " ") * 3, passage[7:], passage[:-9]]
    return ODD + texts


def test_base_spans_match_plain_regular_expressions(spark, corpus):
    got = {r["doc_id"]: r for r in pii.query(frame(spark, rows_of(corpus))).collect()}
    for i, text in enumerate(corpus):
        want = brute.base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert got[i]["spans"].split(",")[: len(want)] == (want or [""])[: len(want)]
        assert [got[i][f"n_{k}"] for k in brute.FORMS] == [sum(w.startswith(k + ":") for w in want) for k in brute.FORMS]


def test_telling_terms_are_removed_and_common_ones_stay(spark):
    entity = "write to ann@corp.example about"
    texts = [f"the day {i} was long. {entity} zanzibar the plan {w}" for i, w in enumerate("red blue green black white".split())]
    texts += [f"the day {i} was short and the plan about it was good {i * 7}" for i in range(40)]
    found = pii.spans(frame(spark, rows_of(texts)))
    rows = {r["doc_id"]: r for r in found.collect()}
    told = {texts[i][s["start"] : s["end"]] for i in range(5) for s in rows[i]["terms"]}
    assert "zanzibar" in told and "the" not in told
    assert all(not rows[i]["terms"] for i in range(5, 45))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows_of(texts))).collect()}
    assert "zanzibar" not in clean[0] and "[email]" in clean[0] and clean[20] == texts[20]


def test_terms_far_from_their_entity_are_found(spark):
    filler = " ".join(f"plain words of every day {'ab'[i % 2]}" for i in range(120))
    texts = [f"zanzibar zanzibar {filler} ann@corp.example {i} {filler} quokka" for i in range(4)]
    texts += [f"a text {filler} {i}" for i in range(40)]
    rows = {r["doc_id"]: r for r in pii.spans(frame(spark, rows_of(texts))).collect()}
    for i in range(4):
        told = sorted((s["start"], s["end"]) for s in rows[i]["terms"])
        at = texts[i].index("quokka")
        assert told == [(0, 8), (9, 17), (at, at + 6)]
    assert all(not rows[i]["terms"] for i in range(4, 44))


def test_fingerprints_and_edits(spark, corpus):
    got = {r["doc_id"]: r for r in winnow.query(frame(spark, rows_of(corpus))).collect()}
    ids = sorted(got, reverse=True)
    for at, i in enumerate(ids):
        text, following = corpus[i] or "", corpus[ids[(at + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert got[len(ODD) + 3]["fingerprint"] == got[len(ODD) + 40]["fingerprint"] != ""


def test_next_rows_agree_over_many_buckets(spark, corpus, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 400)
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(frame(spark, rows_of(corpus))).collect()}
    ids = sorted(got, reverse=True)
    assert [got[i] for i in ids] == [corpus[ids[(at + 1) % len(ids)]] or "" for at in range(len(ids))]


def test_winnowing_picks_the_rightmost_smallest(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choices(["a", "b", "c"], k=200))
    row = spark.createDataFrame([(text,)], "text string").select(winnow.winnowed(winnow.F.col("text"), 3, 5).alias("p")).first()["p"]
    grams = brute.winnow(text, 3, 5)
    named = {g: h for p in row for g, h in [(grams[p["position"]], p["hash"])]}
    every = spark.createDataFrame([(list(g),) for g in set(grams)], "w array<string>")
    hashes = {tuple(r["w"]): r["h"] for r in every.selectExpr("w", "xxhash64(xxhash64(w[0]), xxhash64(w[1]), xxhash64(w[2])) as h").collect()}
    assert all(hashes[g] == h for g, h in named.items())
    rank = [(hashes[g] & (1 << 64) - 1) >> 33 for g in grams]
    want = sorted({max(range(i, i + 5), key=lambda j: (-rank[j], j)) for i in range(len(grams) - 4)})
    assert [p["position"] for p in row] == want


@pytest.mark.parametrize("depth", [48, 120, 400])
def test_repeats_match_the_plain_count(spark, corpus, depth):
    texts = [t if t is None or len(t) < 6000 else t[:1500] for t in corpus]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.without_repeats(frame(spark, rows_of(texts)), depth).collect()}
    assert [got[i] for i in range(len(texts))] == brute.without_repeats(texts, depth)


def test_repeated_rows_and_missing_ids(spark, corpus):
    text = corpus[len(ODD) + 1] * 4
    rows = [(1, text, None, "", 0, ""), (1, text, None, "", 0, ""), (None, text[50:], None, "", 0, ""), (None, None, None, None, None, None)]
    got = sorted(tuple(r)[1:] for r in repeats.without_repeats(frame(spark, rows), 100).collect())
    assert got == sorted(brute.without_repeats([r[1] for r in rows], 100))
    prints = [(r[0], brute.simhash(r[1])) for r in rows]
    near = sorted((r["fingerprint"], str(r["component_id"])) for r in simhash.query(frame(spark, rows)).collect())
    assert near == sorted((f"{p:016x}", str(c)) for (_, p), c in zip(prints, brute.classes(prints)))
    assert sharding.query(frame(spark, rows)).count() == 4
    assert winnow.query(frame(spark, rows)).count() == 4
    assert pii.query(frame(spark, rows)).count() == 4


def test_simhash_components(spark, corpus):
    prints = [(i, brute.simhash(t)) for i, t in enumerate(corpus)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(frame(spark, rows_of(corpus))).collect()}
    assert [got[i] for i, _ in prints] == [(f"{p:016x}", c) for (_, p), c in zip(prints, brute.classes(prints))]
    kept = simhash.keep_one(frame(spark, rows_of(corpus)))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute.classes(prints)))


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_anchors_lose_no_link(spark, threshold):
    rnd = random.Random(threshold)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    prints = set(seeds) | {s ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(1, 5))}) for s in seeds for _ in range(12)} | {0, (1 << 64) - 1}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), threshold).collect()}
    want = {(signed[a], signed[b]) for a in prints for b in prints if signed[a] < signed[b] and (a ^ b).bit_count() <= threshold}
    assert got == want


def test_shards_are_contiguous_and_even(spark, corpus):
    rows = [(i, t) for i, t in enumerate(corpus)]
    got = sorted(tuple(r) for r in sharding.shards(frame(spark, rows_of(corpus)).repartition(5)).collect())
    assert got == sorted(brute.shards(rows))
    assert {r["law"] for r in sharding.query(frame(spark, rows_of(corpus))).collect()} == {"bytes"}


def test_leaks_are_found_with_their_distance(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=4)) for _ in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(12, 50)))) for i in range(40)]
    hosts, want = [], set()
    for i, text in items:
        parts = text.split()
        for _ in range(rnd.randint(0, int(0.12 * len(parts)))):
            parts[rnd.randrange(len(parts))] = "edited"
        host = rnd.choices(words, k=rnd.randint(0, 80))
        at = rnd.randint(0, len(host))
        hosts.append(" ".join(host[:at]) + ", " + " ".join(parts).upper() + "! " + " ".join(host[at:]))
        want.add((i, i))
    hosts += [" ".join(rnd.choices(words, k=60)) for _ in range(40)]
    docs = frame(spark, rows_of(hosts + ODD))
    bench = spark.createDataFrame([*items, (98, ""), (99, None), (97, "too short")], "item_id long, text string")
    rows = decontaminate.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found <= want and len(found) >= 0.95 * len(want)
    for r in rows:
        span = decontaminate.words_of(hosts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        assert brute.edit_distance(decontaminate.words_of(items[r["item_id"]][1]), span) == r["distance"] <= 0.2 * len(items[r["item_id"]][1].split())
    # each block draws its own walks
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, block_bytes=3000).collect()}
    assert blocks <= want and len(blocks) >= 0.95 * len(want)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in found})


def test_mixing_meets_its_limits(spark):
    rnd = random.Random(2)
    sizes = {"a": 120, "b": 30, "c": 10, None: 5}
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, "w " * rnd.randint(1, 30), source, "", n, ""))
            n += 1
    rows += [(n, None, "a", "", 0, ""), (n + 1, "", "zero", "", 0, "")]
    docs = frame(spark, rows)
    held = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sizes}
    out = mixing.mixed(docs).select("_doc.doc_id", "_doc.source", "tokens", "pass", "weight").collect()
    used = {s: sum(r["tokens"] for r in out if r["source"] == s) for s in sizes}
    assert {r["doc_id"] for r in out} == set(range(n + 2))
    for s in sizes:
        assert used[s] / held[s] <= 2 + 30 / held[s]
    assert used["a"] == held["a"] and max(used[s] / held[s] for s in sizes) >= 1.9
    assert all(1 <= sum(r["doc_id"] == d for r in out) <= 3 for d in range(n))
    weights = {r["source"]: r["weight"] for r in out if r["tokens"]}
    assert abs(sum(weights.values()) - 1) < 1e-9
    again = mixing.mixed(docs.repartition(7)).select("_doc.doc_id", "pass").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["pass"]) for r in out)

    totals = spark.createDataFrame([(s, t) for s, t in held.items()], "source string, tokens long")
    a = mixing.exponent(totals, entropy=1.2)
    z = {s: (t / sum(held.values())) ** a for s, t in held.items()}
    assert abs(-sum(x / sum(z.values()) * math.log(x / sum(z.values())) for x in z.values()) - 1.2) < 1e-6
    small = mixing.mixed(docs, budget=500, entropy=1.2).select("_doc.source", "tokens").collect()
    assert 500 <= sum(r["tokens"] for r in small) <= 500 + 4 * 30
    assert mixing.mix(docs).columns == docs.columns


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for fn in (pii.query, winnow.query, repeats.query, simhash.query, sharding.query, mixing.query, simhash.keep_one, pii.sanitise):
        assert fn(none).count() == 0
    assert decontaminate.query(none, bench).count() == 0
    assert decontaminate.query(frame(spark, rows_of(ODD)), bench).count() == 0
