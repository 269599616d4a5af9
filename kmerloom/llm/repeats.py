"""Removal of repeated byte strings: depth-limited most-significant-digit sorting of suffixes.

Asked for: every byte covered by a ``depth``-byte string that starts at two places or more. Suffixes
are told apart only down to ``depth`` bytes, in passes from coarse to fine digits; a group that has
one member after a pass is dropped, and equal groups after the last pass are exactly the repeated
windows. Digits are bytes named by hashes: 64 bits where a pass only excludes, 128 where it decides.

1. Anchors stand in for suffixes. Each window start is served by the smallest gram hash among the
   next ``SPREAD`` starts, a choice that depends on the window's own bytes, so equal windows have
   anchors at equal offsets. First digit: the ``depth - SPREAD`` bytes after the anchor, which lie
   in every window served by it. Anchors of a surviving group whose bytes are equal over *all*
   windows they serve are repeated as a whole; of each such class one member goes on with the rest.
2. The starts served by an anchor that goes on are cut in blocks of ``STEP``. Second digit: the bytes
   common to all windows of a block; classes of blocks are settled in the same way.
3. Third digit: the whole windows that start in the remaining blocks, one by one.

Work follows the bytes in the first pass and the ends of repeated stretches in the others. Texts are named by a 128-bit key, so rows with equal texts are one text that
occurs more than once, whatever their doc_ids are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tables import text_key, whole
from kmerloom.plans.runtime import cut

#: Window starts served by one anchor at most, starts per block, bytes of a gram.
SPREAD, STEP, GRAM = 256, 32, 24
#: Bytes of a text that one numpy step looks at.
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = None, None


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A mixed 40-bit rank of the gram at every position."""
    global _UP, _DOWN
    if _UP is None or len(_UP) < len(data):
        _UP, _DOWN = _powers(max(1 << 16, 1 << (len(data) - 1).bit_length()))
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    rolled = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled >> np.uint64(24)


def anchors(data: bytes, depth: int) -> np.ndarray:
    """Rows (anchor, first start, last start) that split all window starts of a text, ascending."""
    starts, out = len(data) - depth + 1, []
    spread = _spread(depth)
    for at in range(0, max(starts, 0), SLICE):
        part = np.frombuffer(data, dtype=np.uint8, count=min(SLICE, starts - at) + spread + GRAM - 2, offset=at)
        # the leftmost smallest gram: its rank above, its place below
        key = (_gram_order(part) << np.uint64(24)) | np.arange(len(part) - GRAM + 1, dtype=np.uint64)
        width = 1
        while 2 * width <= spread:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < spread:
            key = np.minimum(key[: len(key) - (spread - width)], key[spread - width :])
        place = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        out.append(np.stack((place[first], first, last), axis=1) + at)
    return np.concatenate(out) if out else np.empty((0, 3), dtype=np.int64)


def _spread(depth: int) -> int:
    return min(SPREAD, depth // 2)


def _rows(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(k1, k2, bytes of the text, packed numbers of each further column), one row in Python at a time."""
    for batch in batches:
        k1s, k2s, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("k1", "k2", "text"))
        lists = [batch.column(batch.schema.get_field_index(n)) for n in more]
        for i in range(batch.num_rows):
            numbers = [c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.empty(0, np.int64) for c in lists]
            yield (k1s[i].as_py(), k2s[i].as_py(), texts[i].as_buffer().to_pybytes(), *numbers)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n in ("at", "low", "high") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _first_digits(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    own, digest, wide = depth - _spread(depth), xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    held, size = [], 0

    def frame() -> pa.RecordBatch:
        spots = np.concatenate([spot for *_, spot in held]).astype(np.int32)
        halves = np.frombuffer(b"".join([b for _, names, *_ in held for b in names]), dtype="<i8").reshape(-1, 2)
        sizes = [len(spot) for *_, spot in held]
        keys = [np.repeat(np.array([one[n] for one in held], dtype=np.int64), sizes) for n in (2, 3)]
        columns = [_signed([d for digits, *_ in held for d in digits]), halves[:, 0], halves[:, 1], *keys, *spots.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["digit", "o1", "o2", "k1", "k2", "at", "low", "high"])

    for k1, k2, data in _rows(batches):
        spots = anchors(data, depth)
        digits, names = [], []
        for p, low, high in spots.tolist():
            digits.append(digest(data[p : p + own]))
            names.append(wide(b"%d,%d;" % (p - low, p - high) + data[low : high + depth]))
        held.append((digits, names, k1, k2, spots))
        size += len(digits)
        if size > 100_000:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def _blocks(place: int, first: int, last: int, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, start, first start, last start) of the blocks of the starts that the anchor at ``place`` serves."""
    spread = _spread(depth)
    for j in range(-(-spread // STEP)):
        a = place - spread + 1 + j * STEP
        low, high = max(a, first), min(a + STEP - 1, last)
        if low <= high:
            yield j, a, low, high


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _second_digits(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    names, rows = ["core", "o1", "o2", "k1", "k2", "low", "high"], []
    for k1, k2, data, spots in _rows(batches, "open"):
        for packed in spots.tolist():
            p = packed >> 16
            for j, a, low, high in _blocks(p, p - (packed >> 8 & 255), p - (packed & 255), depth):
                last = min(a + STEP - 1, p)
                core = xxhash.xxh3_64_intdigest(data[last : a + depth], j)
                outer = xxhash.xxh3_128_digest(b"%d,%d,%d;" % (j, low - a, high - a) + data[low : high + depth])
                rows.append((core - (1 << 64) if core >> 63 else core, *_halves(outer), k1, k2, low, high))
        if len(rows) > 50_000:
            yield _table(rows, names)
            rows = []
    if rows:
        yield _table(rows, names)


def _third_digits(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    names, rows = ["d1", "d2", "k1", "k2", "low"], []
    for k1, k2, data, blocks in _rows(batches, "blocks"):
        done = -1
        for packed in sorted(blocks.tolist()):
            low, high = packed >> 32, packed & 0xFFFFFFFF
            for s in range(max(low, done + 1), high + 1):
                rows.append((*_halves(xxhash.xxh3_128_digest(data[s : s + depth])), k1, k2, s))
            done = max(done, high)
        if len(rows) > 50_000:
            yield _table(rows, names)
            rows = []
    if rows:
        yield _table(rows, names)


def _kept(data: bytes, runs: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal stretches removed, and what is left."""
    kept, spans, removed, end = [], 0, 0, 0
    at = -1
    for packed in sorted(runs):
        low, high = packed >> 32, packed & 0xFFFFFFFF
        if low > at:
            kept.append(data[end:low])
            spans += 1
            removed += high - low
            at = end = high
        elif high > at:
            removed += high - at
            at = end = high
    kept.append(data[end:])
    return removed, spans, b"".join(kept)


def _without(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    names, rows, size = ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"], [], 0
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]

    def frame() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for k1, k2, data, runs in _rows(batches, "runs"):
        removed, spans, rest = _kept(data, runs.tolist())
        rows.append((k1, k2, removed, spans, hashlib.sha256(rest).hexdigest(), rest if texts else None))
        size += len(rest) if texts else 0
        if len(rows) >= 10_000 or size > 8 << 20:
            yield frame()
            rows, size = [], 0
    if rows:
        yield frame()


def runs(docs: DataFrame, depth: int = 400) -> tuple[DataFrame, DataFrame]:
    """``(k1, k2, text, runs)`` with the repeated stretches of texts that occur once, and ``(k1, k2, id, copies)`` of all texts.

    A text that occurs more than once and has ``depth`` bytes is repeated as a whole and not listed.
    """
    texts = docs.select("doc_id", whole("text").alias("text")).select("doc_id", "text", *text_key(), F.octet_length("text").alias("n"))
    known = cut(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))

    long = texts.where(F.col("n") >= depth).select("k1", "k2", "text")
    first = cut(long.mapInArrow(lambda it: _first_digits(it, depth), "digit long, o1 long, o2 long, k1 long, k2 long, at int, low int, high int"))
    # two names of places stand for all places of a group: it has one place only if they are equal
    place = F.xxhash64("k1", "k2", "at")
    again = first.groupBy("digit").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("digit")
    marked = _settled(cut(first.join(again, "digit")), "digit", place, ["at", "low", "high"])
    spot = F.expr("shiftleft(bigint(at), 16) | shiftleft(bigint(at - low), 8) | bigint(at - high)")
    lists = marked.groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("whole"), _stretch("low", f"high + {depth}"))).alias("sure"), F.collect_set(F.when(F.col("goes"), spot)).alias("open")
    )

    # one row of each text goes on: the one with the smallest doc_id
    wanted = lists.join(known.select("k1", "k2", "id"), ["k1", "k2"])
    t, w = texts.select("doc_id", "text", "k1", "k2").alias("t"), wanted.alias("w")
    meet = (F.col("t.k1") == F.col("w.k1")) & (F.col("t.k2") == F.col("w.k2")) & F.col("t.doc_id").eqNullSafe(F.col("w.id"))
    held = cut(t.join(w, meet).select("t.k1", "t.k2", "t.text", "w.sure", "w.open"))

    second = cut(held.where(F.size("open") > 0).select("k1", "k2", "text", "open").mapInArrow(lambda it: _second_digits(it, depth), "core long, o1 long, o2 long, k1 long, k2 long, low int, high int"))
    parts = cut(_settled(second, "core", F.xxhash64("k1", "k2", "low"), ["low", "high"]))
    blocks = parts.where("goes").groupBy("k1", "k2").agg(F.collect_set(_stretch("low", "high")).alias("blocks"))
    third = cut(held.select("k1", "k2", "text").join(blocks, ["k1", "k2"]).mapInArrow(lambda it: _third_digits(it, depth), "d1 long, d2 long, k1 long, k2 long, low int"))
    start = F.xxhash64("k1", "k2", "low")
    same = third.groupBy("d1", "d2").agg(F.min(start).alias("a"), F.max(start).alias("z")).where("a <> z").select("d1", "d2")
    single = third.join(same, ["d1", "d2"]).select("k1", "k2", _stretch("low", f"low + {depth}").alias("run"))
    more = parts.where("whole").select("k1", "k2", _stretch("low", f"high + {depth}").alias("run")).union(single)
    listed = more.groupBy("k1", "k2").agg(F.collect_set("run").alias("more"))
    once = known.where("copies = 1").select("k1", "k2")
    found = held.select("k1", "k2", "text", "sure").join(listed, ["k1", "k2"], "left").join(once, ["k1", "k2"], "left_semi")
    every = F.concat("sure", F.coalesce("more", F.array().cast("array<bigint>")))
    return found.select("k1", "k2", "text", every.alias("runs")).where(F.size("runs") > 0), known


def _stretch(low: str, stop: str):
    """Two places of a text in one LONG."""
    return F.expr(f"shiftleft(bigint({low}), 32) | bigint({stop})")


def _settled(rows: DataFrame, group: str, place, kept: list[str]) -> DataFrame:
    """Of each group with several places: ``whole`` members, whose class (o1, o2) repeats, and one of each class that ``goes`` on."""
    names = [group, "o1", "o2"]
    classes = rows.groupBy(*names).agg(F.min(place).alias("a"), F.max(place).alias("z"))
    groups = classes.groupBy(group).agg(F.count(F.lit(1)).alias("n_classes"))
    judged = classes.join(groups, group).where("n_classes > 1 or a <> z")
    goes = (F.col("n_classes") > 1) & (place == F.col("a"))
    out = rows.join(judged, names).select("k1", "k2", *kept, (F.col("a") != F.col("z")).alias("whole"), goes.alias("goes"))
    return out.where("whole or goes")


def without_repeats(docs: DataFrame, depth: int = 400) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    Null texts are empty, texts shorter than ``depth`` bytes lose nothing, offsets are bytes, and a cut may
    fall inside a character. Rows with equal texts (also with equal or null doc_ids) are different
    places, so both lose all bytes. Other columns are not looked at; no rows give no rows.
    """
    if depth < 2 * GRAM:
        raise ValueError(f"depth must be at least {2 * GRAM} bytes")
    open_texts, known = runs(docs, depth)
    cuts = open_texts.mapInArrow(lambda it: _without(it, False), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary").drop("kept")
    told = known.select("k1", "k2", "copies").join(cuts, ["k1", "k2"], "left")
    data = whole("text").cast("binary")
    plain = docs.select("doc_id", *text_key(), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    return plain.join(told, ["k1", "k2"]).select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs)
