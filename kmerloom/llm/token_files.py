"""Token ids of a corpus in files of fixed-width bit-packed ids.

A file holds the ids of neighbouring documents, one stream in ascending doc_id order. Ids take the
fewest bits that the vocabulary needs. Layout, all numbers little-endian:

1. ``MAGIC``;
2. blocks of ``BLOCK`` ids each (the last may be shorter), packed with the lowest bit first and filled up to a byte;
3. the index: byte offset of each block (u64), then per document its id (i64), 1 if it has none (u8) and its number of ids (u64);
4. the trailer ``_TRAILER``: number of the file, blocks, documents, ids (u64 each), bits and ids per block (u32 each), ``MAGIC``.

Every segment (1, each block, 3 with 4) ends with one zero byte, which Spark's text writer puts there as its
row separator; so the files can lie on any file system that Spark writes. Eight ids fill as many bytes
as an id has bits, so any range of ids is unpacked from its own bytes alone, found by the block offsets.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm import vocab
from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut, scratch_folder

MAGIC = b"TOKBITS1"
#: Ids per block; a multiple of eight.
BLOCK = 1 << 16
#: Bytes of text whose words are looked up at once.
TOGETHER = 1 << 23
#: Parts of words of a generation that a worker keeps.
HELD = 300_000
#: Words whose ids are put together at once.
WORDS = 1 << 20
#: UTF-8 bytes of text that a file stands for on average.
FILE_TEXT = 32 << 20
_TRAILER = struct.Struct("<QQQQII8s")
#: The letters that a byte-level vocabulary writes for bytes.
_LETTERS = {b: letter for letter, b in vocab.byte_level().items()}


def bits_of(size: int) -> int:
    """Fewest bits for ids below ``size``."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first, filled up to a byte with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(single.ravel(), bitorder="little").tobytes()


def unpack(data, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    single = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), dtype=np.uint8)
    full[:, :bits] = single
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class TokenFile:
    """A file's bytes with random access by place and by document."""

    def __init__(self, data):
        self.data, end = memoryview(data), len(data) - 1
        self.number, blocks, docs, self.n_ids, self.bits, self.block, magic = _TRAILER.unpack_from(self.data, end - _TRAILER.size)
        if magic != MAGIC or bytes(self.data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        at = end - _TRAILER.size - 8 * blocks - 17 * docs
        self.offsets = np.frombuffer(self.data, dtype="<u8", count=blocks, offset=at).astype(np.int64)
        self.doc_ids = np.frombuffer(self.data, dtype="<i8", count=docs, offset=at + 8 * blocks)
        self.unnamed = np.frombuffer(self.data, dtype=np.uint8, count=docs, offset=at + 8 * (blocks + docs)).astype(bool)
        self.counts = np.frombuffer(self.data, dtype="<u8", count=docs, offset=at + 8 * blocks + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of the file on."""
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise IndexError("outside the file")
        parts, stop = [], start + count
        while start < stop:
            block, inner = divmod(start, self.block)
            take = min(stop, (block + 1) * self.block) - start
            first = inner // 8
            size = min(self.block, self.n_ids - block * self.block)
            low = int(self.offsets[block]) + first * self.bits
            high = int(self.offsets[block]) + -(-min(-(-(inner + take) // 8) * 8, size) * self.bits // 8)
            parts.append(unpack(self.data[low:high], inner - first * 8 + take, self.bits)[inner - first * 8 :])
            start += take
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.starts[row]), int(self.counts[row]))


class Encoder:
    """Ids of whole texts from a tokenizer file, without special tokens around them.

    Its pieces never cross white space, so a text's words are encoded alone. Words are told apart at
    ASCII white space only; names of special tokens inside texts are special tokens, as the tokenizer does by itself. A word
    of printable Latin letters is cut by the tokenizer's own pattern and its parts, which many words share, go to the model;
    other words, and all words of a tokenizer without such a pattern, go through the whole tokenizer. Each distinct word of a group of
    texts is cut up once, and a bounded memory keeps the ids of parts.
    """

    def __init__(self, place: str):
        self.tokenizer = vocab.tokenizer(place, plain_specials=False)
        self.bits = bits_of(self.tokenizer.get_vocab_size())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.model = _word_pattern(place), self.tokenizer.model
        # whether Latin letters are only lowered, and a word of letters alone is one part
        latin = [c for c in map(chr, range(ord(vocab.LATIN_END))) if not vocab.BEYOND_LATIN.search(c)]
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.lowers = all(normal(f"a{c}a") == f"a{c}a".lower() for c in latin if c != " ")
        every = "".join(filter(str.isalpha, latin))
        self.letters_stay = self.pattern is not None and self.pattern.findall(every) == [every]
        self.odd, self.parts = vocab.Memory(self._whole), vocab.Memory(self._parts, HELD)

    def _parts(self, parts: list[str]) -> list[bytes]:
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in parts]
        return [array("I", [t.id for t in self.model.tokenize(p)]).tobytes() for p in spelled]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        odd, joined = vocab.BEYOND_LATIN.search, " ".join(words)
        if self.pattern is None or not self.lowers:
            plain = np.zeros(len(words), dtype=bool)
        elif odd(joined) or any(n in joined for n in self.added):
            plain = np.array([(t.isascii() and t.isprintable() or not odd(t)) and not any(n in t for n in self.added) for t in words], dtype=bool)
        else:
            plain = np.ones(len(words), dtype=bool)
        # parts of plain words; any other word is the only part of itself
        sizes = np.ones(len(words), dtype=np.int64)
        normal = (joined if plain.all() else " ".join(compress(words, plain))).lower().split(" ") if plain.any() else []
        alone = self.letters_stay
        cut_up = [[t] if alone and t.isalpha() else self.pattern.findall(t) for t in normal]
        sizes[plain] = list(map(len, cut_up))
        told = pa.array(chain.from_iterable(cut_up), pa.string()).dictionary_encode()
        known = self.parts.of(told.dictionary.to_pylist())
        units = np.empty(sizes.sum(), dtype=np.int64)
        of_plain = np.repeat(plain, sizes)
        units[of_plain] = told.indices.to_numpy()
        units[~of_plain] = np.arange(len(words) - len(normal)) + len(known)
        known += self.odd.of(list(compress(words, ~plain)))
        ids, starts, lengths = _listed(known)
        n = np.concatenate(([0], np.cumsum(lengths[units])))
        ends = np.cumsum(sizes)
        return np.frombuffer(_gathered(ids, starts, lengths, units), dtype="<u4"), n[ends] - n[ends - sizes]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as u32. Arrow tells words and their parts apart, so that each distinct one is looked up once."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        told = words.values.dictionary_encode()
        distinct = told.dictionary
        if not len(distinct):
            return [b""] * len(texts)
        # words hold no space; an empty one, next to white space at the ends, has no ids
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_buffer().to_pybytes()
        ids, sizes = self._of_words(line.decode("utf-8", "replace").split(" "))
        starts = np.cumsum(sizes) - sizes
        places, bounds = told.indices.to_numpy(), words.offsets.to_numpy()
        return [_gathered(ids, starts, sizes, places[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _listed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids one after the other, where those of each entry start, and how many they are."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes, sizes


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> bytes:
    """The ids of the entries at these places of a list."""
    out = []
    for at in range(0, len(places), WORDS):
        part = places[at : at + WORDS]
        n = sizes[part]
        ends = np.cumsum(n)
        out.append(ids[np.repeat(starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def _word_pattern(place: str):
    """The pattern by which a byte-level tokenizer cuts words, if that is all it does before its model; else None."""
    with open(place, encoding="utf-8") as f:
        steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [x["type"] for x in steps]
    if kinds != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    return regex.compile(steps[0]["pattern"]["Regex"])


def _groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """Neighbouring texts, some ``TOGETHER`` bytes at a time or one longer text."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_buffer().to_pybytes())
        size += len(group[-1])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def _files(batches: Iterator[pa.RecordBatch], place: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The segments of this partition's file, documents in the order they come."""
    encoder = vocab.once(("words", place), lambda: Encoder(place))
    bits, end = encoder.bits, np.array([end_id], dtype="<u4").tobytes()
    names, counts, offsets, held, at = [], [], [], b"", 0

    def segment(data: bytes) -> pa.RecordBatch:
        nonlocal at
        at += len(data) + 1
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    for batch in batches:
        names += batch.column(0).to_pylist()
        for texts in _groups(batch.column(1)):
            if not at:
                yield segment(MAGIC)
            with vocab.no_cycle_search():
                found = encoder.ids(texts)
            counts += [len(ids) // 4 + 1 for ids in found]
            held += b"".join([ids + end for ids in found])
            whole_blocks = len(held) // (4 * BLOCK)
            for b in range(whole_blocks):
                offsets.append(at)
                yield segment(pack(np.frombuffer(held, dtype="<u4", count=BLOCK, offset=4 * BLOCK * b), bits))
            if whole_blocks:
                held = held[4 * BLOCK * whole_blocks :]
    if not names:
        return
    if held:
        offsets.append(at)
        yield segment(pack(np.frombuffer(held, dtype="<u4"), bits))
    index = [np.array(offsets, dtype="<u8"), np.array([n or 0 for n in names], dtype="<i8"), np.array([n is None for n in names], dtype=np.uint8), np.array(counts, dtype="<u8")]
    trailer = _TRAILER.pack(TaskContext.get().partitionId(), len(offsets), len(names), sum(counts), bits, BLOCK, MAGIC)
    yield segment(b"".join(x.tobytes() for x in index) + trailer)


def write(docs: DataFrame, folder: str, place: str, end_id: int = 1, file_text: int = FILE_TEXT) -> None:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each document and write the files of a new folder.

    Documents are dealt once, by ranges of doc_id; a document is encoded where its range is written. Null texts
    are empty and have the end id alone. Null doc_ids come first; rows with one doc_id are in the order of the text's hash,
    so that many of them spread over files, and repeated rows are written as often as they occur. Texts are
    encoded whole, of any length that Spark holds in a row. An empty table gives no file. Other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = texts.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    ranged = keyed.repartitionByRange(1 + size // file_text, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    segments = ranged.select("doc_id", "text").mapInArrow(lambda it: _files(it, place, end_id), "value binary")
    segments.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 0).text(folder)


def _documents(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            if not content.as_py():
                continue
            held = TokenFile(content.as_buffer())
            for low in range(0, len(held.counts), 4096):
                rows = range(low, min(low + 4096, len(held.counts)))
                found = [held.document(r).astype("<u4").tobytes() for r in rows]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, held.number, dtype=np.int64)), pa.array(held.doc_ids[low : low + n], mask=held.unnamed[low : low + n]),
                        pa.array(held.starts[low : low + n]), pa.array(held.counts[low : low + n]), pa.array([zlib.crc32(f) for f in found], pa.int64()),
                        pa.array(found if ids else [None] * n, pa.binary()),
                    ],
                    ["number", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"],
                )


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of all files of a folder.

    start counts the ids of all documents before, over all files; ids are little-endian u32 (null with
    ``ids=False``). Each file is opened by one task; starts come from one row per file.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = files.mapInArrow(lambda it: _documents(it, ids), "number long, doc_id long, inner long, n_tokens long, ids_crc32 long, ids binary")
    rows = cut(rows)
    totals = rows.groupBy("number").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("number", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("before"))
    return rows.join(before, "number").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark).rstrip('/')}/kmerloom-tokens/{uuid.uuid4().hex}"
    write(docs, folder, vocab.path("word_bpe_49k.json"))
    return read(spark, folder, ids=False).drop("ids")
