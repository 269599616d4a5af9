import base64
import gzip
import hashlib
import random
import re

import pandas as pd
import pytest

from kmerloom.llm import toxicity, urlfilter, warc

PAGES = "page_id long, url string, html string, h string, id long, k string"


def pages_of(rows):
    return [(i, f"http://h{i}.example.com/a b", html, "clash", 7, "clash") for i, html in rows]


def test_archives_round_trip(spark):
    rows = [(i, f"<p>{i % 9}</p>é" * (i % 5)) for i in range(60)] + [(60, None), (61, ""), (62, "y" * (17 << 20)), (63, "z" * (17 << 20)), (64, "\r\n\r\nWARC/1.1\r\n\x00")]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.query(spark.createDataFrame(pages_of(rows), PAGES)).collect()}
    top = {}
    for i, html in rows:
        top[html or ""] = max(i, top.get(html or "", -1))
    for i, html in rows:
        data, first = (html or "").encode(), top[html or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
        assert got[i] == want
    twice = spark.createDataFrame(pages_of([(1, "a"), (1, "a"), (None, "a"), (None, None)]), PAGES)
    assert sorted(r["record_type"] for r in warc.query(twice).collect()) == ["response"] * 4
    assert warc.query(spark.createDataFrame([], PAGES)).count() == 0


def test_written_files_are_plain_gzip(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(pages_of([(1, "one"), (2, "two"), (3, "one")]), PAGES), folder)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("archives/part-*"))
    assert text.count(b"WARC/1.1\r\n") == 3 and b"one" in text and b"two" in text
    read = warc.read_archives(spark, folder).where("kind = 'record'").collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in read} == {(1, b""), (2, b"two"), (3, b"one")}


def ids_and_gaps(data):
    rows = list(warc.salvage(data))
    return [warc._id(r["head"][b"warc-record-id"]) for k, _, _, r in rows if k == "record"], [(o, n, t) for k, o, n, t in rows if k == "gap"]


def test_salvage_inside_members():
    records = [warc.encode(i, f"http://x/{i}", random.Random(i).randbytes(400), None) for i in range(6)]
    plain = bytearray(b"".join(records))
    plain[sum(map(len, records[:2])) + len(records[2]) - 50] ^= 1  # a body that does not fit its digest
    ids, gaps = ids_and_gaps(gzip.compress(bytes(plain), mtime=0))
    assert ids == [0, 1, 3, 4, 5] and [t for *_, t in gaps] == [{"place": sum(map(len, records[:2])), "length": len(records[2])}]
    member = gzip.compress(b"".join(records), mtime=0)
    later = gzip.compress(warc.encode(9, None, b"later", None), mtime=0)
    # cut 40 bytes early: all records that are there as a whole
    ids, gaps = ids_and_gaps(member[:-40])
    assert ids == [0, 1, 2, 3, 4] and gaps == [(0, len(member) - 40, None)]
    ids, gaps = ids_and_gaps(member[:-40] + later)
    assert ids == [0, 1, 2, 3, 4, 9] and gaps == [(0, len(member) - 40, None)]
    # the checksum at the end is wrong: the records' own digests still agree, but nothing follows the last one
    ids, gaps = ids_and_gaps(member[:-8] + b"\1\2\3\4" + member[-4:] + later)
    assert ids == [0, 1, 2, 3, 4, 9] and gaps == [(0, len(member), None)]
    # without a digest nothing of a damaged member is trusted
    bare = b"".join(re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", r) for r in records)
    packed = gzip.compress(bare, mtime=0)
    assert ids_and_gaps(packed)[0] == [0, 1, 2, 3, 4, 5] and ids_and_gaps(packed[:-40])[0] == []


@pytest.mark.parametrize("name,spell", [("sha256", "hex"), ("sha1", "hex"), ("md5", "hex"), ("sha256", "base32"), ("sha1", "lower"), ("sha512", "hex"), ("blake9", "hex"), ("sha1", "odd")])
def test_digests_of_other_forms(name, spell):
    body = b"some body"
    raw = hashlib.new(name if name in hashlib.algorithms_available else "sha1", body).digest()
    value = {"hex": raw.hex(), "base32": base64.b32encode(raw).decode(), "lower": base64.b32encode(raw).decode().lower(), "odd": "xyz"}[spell]
    record = re.sub(rb"WARC-Block-Digest: [^\r]*", f"WARC-Block-Digest: {name}:{value}".encode(), warc.encode(1, None, body, None))
    assert ids_and_gaps(record)[0] == [1]
    wrong = record.replace(b"some body", b"other one")
    known = name != "blake9" and spell != "odd"
    assert ids_and_gaps(wrong)[0] == ([] if known else [1])


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    records = [warc.encode(i, f"http://x/{i}", b"payload %d " % i * (i + 1), None) for i in range(6)]
    parts = [gzip.compress(r, mtime=0) if packed else r for r in records]
    data = bytearray(b"".join(parts))
    clean = list(warc.salvage(bytes(data)))
    assert [k for k, *_ in clean] == ["record"] * 6
    at = len(parts[0]) + len(parts[1]) - 8
    data[at] ^= 0x55
    broken = bytes(data[:-7]) + b""
    got = list(warc.salvage(broken))
    ids = [warc._id(r["head"][b"warc-record-id"]) for k, _, _, r in got if k == "record"]
    assert ids == [0, 2, 3, 4]
    gaps = [(o, n) for k, o, n, _ in got if k == "gap"]
    assert gaps == [(len(parts[0]), len(parts[1])), (sum(map(len, parts[:5])), len(parts[5]) - 7)]
    assert sum(n for _, _, n, _ in {(k, o, n, None) for k, o, n, _ in got}) == len(broken)
    noise = random.Random(1).randbytes(500)
    assert [k for k, *_ in warc.salvage(noise)] == ["gap"] and not list(warc.salvage(b""))
    mixed = noise + parts[3] + b"\0" + parts[4] + noise
    assert [k for k, *_ in warc.salvage(mixed)] == ["gap", "record", "record", "gap"]


def test_url_lists_as_of_the_fetch(spark):
    rnd = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "example.com", "other.org", "com"]
    entries = [(rnd.choice([*hosts, "a.example.com/x", "a.example.com/x/y"]), rnd.randrange(0, 10**8), rnd.random() < 0.6) for _ in range(60)]
    entries += [("a.example.com", 50, True), ("a.example.com", 50, False), (None, 1, True), ("com", None, True), ("com", 5, None)]
    urls = ["http://a.example.com/x/y?q", "https://u:p@B.example.com.:80/", "http://other.org", "ftp://none.net/x", "no url", "", None, "http://A.example.com/x", "http:///p"]
    captures = [(i, rnd.choice(urls), rnd.randrange(0, 10**8)) for i in range(300)] + [(None, None, None), (1, "http://other.org", None)]
    got = urlfilter.judged(spark.createDataFrame([(*c, "clash") for c in captures], "id long, url string, at long, key string"), spark.createDataFrame(entries, "key string, since long, blocked boolean"))
    rows = sorted((tuple(r) for r in got.collect()), key=str)

    def keys(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(/[^?#]*)?", url or "")
        host = m[1].lower().rstrip(".") if m else ""
        if not host:
            return []
        labels, parts = host.split("."), [p for p in (m[2] or "").split("/") if p]
        return [".".join(labels[-i:]) for i in range(1, min(8, len(labels)) + 1)] + [host + "/" + "/".join(parts[:i]) for i in range(1, min(3, len(parts)) + 1)]

    want = []
    for i, url, at in captures:
        key, since, blocked = None, None, False
        for k in keys(url) if at is not None else []:
            past = [(s, b) for e, s, b in entries if e == k and s is not None and b is not None and s <= at]
            if past:
                key, since, blocked = k, *max(past)
        want.append((i, url, at, key, since, blocked))
    assert rows == sorted(want, key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.query(empty).count() == 0


def test_automata_agree_with_edit_distance():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "moron": 3.0, "scum": 1.0, "vequ*": 4.0})

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        edits = {b[:i] + b[i + 1 :] for i in range(len(b))} | {b[:i] + c + b[i:] for i in range(len(b) + 1) for c in set(a)}
        edits |= {b[:i] + c + b[i + 1 :] for i in range(len(b)) for c in set(a)}
        return a in edits

    rnd = random.Random(8)
    for base in ("stupid", "moron", "scum", "plain"):
        for _ in range(300):
            word = list(base)
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(word) + 1)
                word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "o", "m"])
            word = "".join(word)
            exact = word in ("stupid", "moron", "scum") or word.startswith("vequ")
            close = not exact and any(near(word, w) for w in ("stupid", "moron"))
            got = lexicon.match(word)
            assert (got is not None and got[1] == 0) == exact, word
            assert (got is not None and got[1] == 1) == close, word
    assert lexicon.match("vequable") == (4.0, 0) and lexicon.match("stupdi") is None or lexicon.match("stupdi")[1] == 1
    said = toxicity.features('he said "you moron" to me', lexicon)
    abuse = toxicity.features("you moron leave me", lexicon)
    assert said[3] > 0 and said[1] == 0 and abuse[1] > 0 and abuse[3] == 0 and abuse[5] > 0
    assert toxicity.features("such a morom", lexicon)[4] > 0 and toxicity.features("", lexicon)[1:] == [0.0] * (toxicity.FEATURES - 1)


def test_toxicity_is_learned_and_held_out(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(600):
        text = rnd.choices(words, k=rnd.randint(5, 60))
        bad = i % 6 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(["wretchword", "zonkstem" + rnd.choice("abc")]))
        rows.append((i, " ".join(text), "clash", 1.0))
        marks.append((i, 0, int(bad)))
    rows += [(600, "", "", 0.0), (601, None, None, None), (None, "wretchword", "", 0.0), (5, rows[5][1], "", 0.0)]
    marks += [(None, 0, 1), (7, None, None), (0, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.query(docs.drop("score"), labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    truth = pd.DataFrame(marks[:600], columns=["doc_id", "quality", "bad"])
    both = got.dropna(subset=["doc_id"]).merge(truth, on="doc_id")
    assert (both["predicted"] == both["bad"]).mean() > 0.98
    import zlib

    assert all(h == (zlib.crc32(str(int(d)).encode()) % 5 == 0) for d, h in zip(both["doc_id"], both["held_out"]))
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("text like '%wretchword%'").count() == 0
    bare = toxicity.query(docs, labels.where("false"))
    assert bare.where("predicted = 1").count() == 0 and bare.count() == len(rows)
    assert toxicity.query(docs.where("false"), labels).count() == 0


def test_learned_words_under_a_stem_match_with_one_error(spark):
    rnd = random.Random(4)
    plain = ["".join(rnd.choices("bcdfghklmnprtvw", k=6)) for _ in range(400)]
    bad = ["idiot", "stupid", "trashes", "pathetic", "worthless"]
    rows = [(i, int(i % 2), " ".join(rnd.choices(plain, k=30) + ([bad[i // 2 % 5]] if i % 2 else []))) for i in range(400)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    assert any(e.endswith("*") for e in lexicon.entries)
    for word in bad:
        assert lexicon.match(word)[1] == 0
        wrong = {word[:i] + "z" + word[i + 1 :] for i in range(len(word))}
        wrong |= {word[:i] + word[i + 1 :] for i in range(len(word))}
        wrong |= {word[:i] + "z" + word[i:] for i in range(len(word) + 1)}
        wrong |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if i != len(word) // 2 - 1}
        assert [w for w in wrong if lexicon.match(w) is None] == []


def test_long_hosts_and_paths_match_their_entries(spark):
    deep, far = ".".join("abcdefghi") + ".example.com", "example.org/1/2/3/4/5"
    captures = [(1, f"http://x.{deep}/", 10), (2, f"http://{far}/6?q", 10), (3, "http://example.org/1/2", 10), (4, "http://i.example.com/", 10)]
    entries = [(deep, 0, True), ("example.com", 0, False), (far, 0, True), ("example.org/1", 0, False)]
    out = urlfilter.judged(spark.createDataFrame(captures, "id long, url string, at long"), spark.createDataFrame(entries, "key string, since long, blocked boolean"))
    got = {r["id"]: (r["key"], r["blocked"]) for r in out.collect()}
    assert got == {1: (deep, True), 2: (far, True), 3: ("example.org/1", False), 4: ("example.com", False)}
