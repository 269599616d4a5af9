"""Alignment of two tokenizers over the bytes of each text, by interval coalescing.

Tokens of A and B are intervals of bytes. All intervals are sorted by start (``lexsort``), ends are
accumulated to a running maximum, and a group breaks where a start reaches it; that is where tokens of both end.
Inside a group, tokens of A and B whose intervals overlap are linked.

Both tokenizers cut at a single space between two other characters, so a text is aligned as a sequence of
stretches between such gaps. Each distinct stretch of a batch is aligned once, many in one numpy step,
and a bounded memory per worker keeps them. How often two ids are linked in the whole corpus is counted by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import vocab
from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut, cut_counted

#: Id pairs up to which their counts are sent to all executors (some 60 MB); beyond, rows are joined by salted keys.
BROADCAST_PAIRS, SALTS = 1_000_000, 16
#: Letters of text whose stretches are looked up at once.
TOGETHER = 1 << 19


def coalesce(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two tilings of the same bytes, given by the lengths of their tokens.

    Returns the number of each A token's group, of each B token's group, and the A and B tokens of every link.
    """
    ends = [np.cumsum(lens) for lens in (a_lens, b_lens)]
    begins = [end - lens for end, lens in zip(ends, (a_lens, b_lens), strict=True)]
    start, end = np.concatenate(begins), np.concatenate(ends)
    kind = np.repeat((0, 1), (len(a_lens), len(b_lens)))
    order = np.lexsort((kind, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    # the B tokens that overlap an A token are neighbours: from the one under its first byte to the one under its last
    low = np.searchsorted(ends[1], begins[0], side="right")
    high = np.searchsorted(begins[1], ends[0], side="left")
    many = high - low
    a = np.repeat(np.arange(len(a_lens)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return group[: len(a_lens)], group[len(a_lens) :], a, b


class Aligner:
    """Stretches of text under a byte-level tokenizer A and a sentence-piece tokenizer B."""

    def __init__(self, a_place: str, b_place: str):
        self.a, self.b = vocab.tokenizer(a_place, plain_specials=True), vocab.sentence_pieces(b_place)
        letters = vocab.byte_level()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(size))]
        self.a_lens, self.b_lens = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: the next token of its side, the other side, the next group
        self.a_text, self.b_text = (np.array([f"{i}{c}" for c in cs for i in range(len(table))], dtype=object) for cs, table in ((",|", self.a_bytes), (",;", self.b_bytes)))
        self.latin = vocab.rank_encoding(a_place)
        self.memory = vocab.Memory(self._fresh)

    def _ours(self, spaced: list[str]) -> list[list[int]]:
        """A's ids; of Latin stretches by its merges as ranks, where the file allows that."""
        if self.latin is None:
            return [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        simple = [not vocab.BEYOND_LATIN.search(s) for s in spaced]
        rest = [s for s, plain in zip(spaced, simple, strict=True) if not plain]
        others = iter(self.a.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [self.latin.encode_ordinary(s) if plain else next(others).ids for s, plain in zip(spaced, simple, strict=True)]

    def _fresh(self, stretches: list[str]) -> list[tuple]:
        """Per stretch (numbers of A and B tokens, groups, groups as text, links as packed ids); () where a side's bytes differ."""
        spaced = [" " + s for s in stretches]
        ours = self._ours(spaced)
        theirs = self.b.encode(stretches, num_threads=1)
        sides = []
        for text, x, y in zip(spaced, ours, theirs, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            sides.append(b"".join([self.a_bytes[i] for i in x]) == data == b"".join([self.b_bytes[i] for i in y]))
        good = [i for i, fine in enumerate(sides) if fine]
        out: list[tuple] = [()] * len(stretches)
        if not good:
            return out
        a, b = (np.concatenate([np.array(side[i], dtype=np.int64) for i in good]) for side in (ours, theirs))
        a_group, b_group, la, lb = coalesce(self.a_lens[a], self.b_lens[b])
        # in each group first A's ids, then B's
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        text = np.concatenate((self.a_text[a + n_a * a_last], self.b_text[b + n_b * b_last]))
        side = np.repeat((0, 1), (len(a), len(b)))
        text = text[np.lexsort((np.arange(len(side)), side, np.concatenate((a_group, b_group))))].tolist()
        pairs = (a[la] * n_b + b[lb]).astype("<i8")
        a_stop, b_stop = (np.cumsum([len(s[i]) for i in good]) for s in (ours, theirs))
        a_group_stop, link_stop = a_group[a_stop - 1] + 1, np.searchsorted(la, a_stop, side="left")
        x = y = g = k = 0
        for i, xs, ys, gs, ks in zip(good, a_stop.tolist(), b_stop.tolist(), a_group_stop.tolist(), link_stop.tolist(), strict=True):
            out[i] = (xs - x, ys - y, gs - g, "".join(text[x + y : xs + ys]), pairs[k:ks].tobytes())
            x, y, g, k = xs, ys, gs, ks
        return out

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(A tokens, B tokens, groups, groups as text, packed ids of every link) of each text; zeros where there are no tokens."""
        stretches = [vocab.GAP.split(t) if t else [] for t in texts]
        found, out, at = self.memory.of([s for own in stretches for s in own]), [], 0
        for own in stretches:
            parts = found[at : at + len(own)]
            at += len(own)
            if not parts or () in parts:
                out.append((0, 0, 0, "", np.empty(0, dtype=np.int64)))
                continue
            a, b, groups, told, links = zip(*parts, strict=True)
            out.append((sum(a), sum(b), sum(groups), "".join(told)[:-1], np.frombuffer(b"".join(links), dtype="<i8")))
        return out


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{0}>, times array<int>"


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Neighbouring texts, some ``TOGETHER`` letters at a time or one longer text."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def _aligned(batches: Iterator[pa.RecordBatch], a_place: str, b_place: str, narrow: bool) -> Iterator[pa.RecordBatch]:
    aligner = vocab.once(("align", a_place, b_place), lambda: Aligner(a_place, b_place))
    kind = np.int32 if narrow else np.int64
    for batch in batches:
        low = 0
        for texts in _groups(batch.column(1)):
            ids = batch.column(0).slice(low, len(texts))
            low += len(texts)
            rows, pairs, times, sizes = [], [], [], [0]
            with vocab.no_cycle_search():
                found = aligner.texts(texts)
            for n_a, n_b, groups, told, links in found:
                pair, often = np.unique(links, return_counts=True)
                rows.append((n_a, n_b, groups, len(links), hashlib.sha256(told.encode()).hexdigest() if n_a else ""))
                pairs.append(pair.astype(kind))
                times.append(often.astype(np.int32))
                sizes.append(sizes[-1] + len(pair))
            stops = pa.array(sizes, pa.int32())
            counts = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
            lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate(c))) for c in (pairs, times)]
            yield pa.RecordBatch.from_arrays([ids, *counts, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def align(docs: DataFrame, a_place: str, b_place: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``, one row per input row.

    A encodes space and text, B the text, both without special tokens (their names inside texts are text).
    pairs are the distinct linked ids of the text as A id times B's vocabulary plus B id, times how often each is linked. Null
    and empty texts and texts whose tokens do not spell space and text on either side have zeros and ''. Texts
    are aligned whole. Repeated rows are aligned each; null doc_ids stay null; other columns are not looked at.
    """
    sizes = vocab.tokenizer(a_place, True).get_vocab_size(), vocab.sentence_pieces(b_place).get_piece_size()
    narrow = sizes[0] * sizes[1] < 1 << 31
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return texts.mapInArrow(lambda it: _aligned(it, a_place, b_place, narrow), _ROWS.format("int" if narrow else "bigint"))


def _linked(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).select("row", F.col("pairs").alias("pair"), "times")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n, best)``: corpus-wide links of two ids, and whether no A id is linked more often to the B id."""
    counts = cut(_linked(rows).groupBy("pair").agg(F.sum("times").alias("n")))
    most = counts.groupBy(F.expr(f"pair % {n_b}").alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.expr(f"pair % {n_b}")).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """``(row, n_best, count_sum)`` of rows with links; ``few`` sends the counts to all executors."""
    linked = _linked(rows)
    if few:
        met = linked.join(F.broadcast(counts), "pair")
    else:
        # a pair that most texts have is met by SALTS tasks
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = linked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def query(docs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    a_place, b_place = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")
    rows = cut(align(docs, a_place, b_place).withColumn("row", F.monotonically_increasing_id()))
    counts, n = cut_counted(pair_counts(rows, vocab.sentence_pieces(b_place).get_piece_size()))
    sums = with_counts(rows, counts, n <= broadcast_pairs)
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
