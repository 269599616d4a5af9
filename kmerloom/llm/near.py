"""Near-duplicates by word shingles: MinHash buckets name the candidates, exact set similarity decides.

A document is the set of its shingles, signed by ``MINIMA`` minima. ``BANDS`` buckets take ``ROWS`` of the minima each, so
two documents of similarity (Jaccard) 0.8 share one with probability 0.9995 at least. Every link is verified on the
whole texts, so nothing below the threshold is ever linked.

Only components are asked for, so a bucket is not paired. In rounds its members are compared with one of them: first
with the one that meets most others in all its buckets, which in a group of near copies is the one closest to their common
origin, then with others as long as that joins components. What is still apart is looked at in buckets of ``NARROW_ROWS``
minima, where texts well below the threshold hardly meet, and there members outside the largest component are compared with all others.
Pairs whose signatures agree too little are left out before texts move (``least_equal``), those of narrow buckets
whose sketches of one bit per minimum do not fit are not even made (``most_unequal``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.components import components
from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut, cut_counted, drop

#: Minima of a signature; buckets and minima of each, wide and narrow.
MINIMA = 200
BANDS, ROWS = 50, 8
NARROW_BANDS, NARROW_ROWS = 360, 20
#: LONGs of a sketch, which holds one bit of each of the first minima.
SKETCH = MINIMA // 64
#: Rounds of comparisons with single members at most, and the share of open members that a round has to join for another one.
ROUNDS, WORTH = 5, 0.02
#: Standard deviations that the share of equal minima may lie below the threshold.
DEVIATIONS = 4.5
_RANDOM = np.random.default_rng(42)
_SEEDS = _RANDOM.integers(0, 1 << 63, size=(2, MINIMA), dtype=np.uint64)
_TIMES, _PLUS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def _bands(count: int, rows: int) -> np.ndarray:
    """Which minima each bucket takes: cuts of random orders, so that all minima serve alike."""
    each = MINIMA // rows
    return np.concatenate([_RANDOM.permutation(MINIMA)[: each * rows].reshape(each, rows) for _ in range(-(-count // each))])[:count]


_WIDE, _NARROW = _bands(BANDS, ROWS), _bands(NARROW_BANDS, NARROW_ROWS)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def signature(items: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of a set; empty for an empty set."""
    if not len(items):
        return np.zeros(0, dtype="<u2")
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 512):
        part = items[None, at : at + 512] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    # the high bits of a minimum are mostly zeros, the low ones of a product with an odd number are not mixed
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype("<u2")


def buckets(signed: np.ndarray, bands: np.ndarray = _WIDE) -> list[int]:
    """Signed names of the buckets of a signature, none for an empty one."""
    if not len(signed):
        return []
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(signed[bands])]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, text, node, sig, keys)``; node names the sequence of lower-cased words."""

    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            signed = signature(shingles(words, width))
            rows.append((xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63), signed.tobytes(), buckets(signed)))
        return pd.DataFrame(rows, columns=["node", "sig", "keys"])

    marked = F.pandas_udf(sign, "node long, sig binary, keys array<long>")
    return docs.select("doc_id", whole("text").alias("text"), marked(whole("text")).alias("s")).select("doc_id", "text", "s.*")


def least_equal(least: float) -> int:
    """Equal minima that two sets of similarity ``least`` have, but for one pair in some 100,000."""
    return max(0, int(MINIMA * least - DEVIATIONS * (MINIMA * least * (1 - least)) ** 0.5))


def most_unequal(least: float) -> int:
    """Bits of a sketch in which two sets of similarity ``least`` differ at most, but for one pair in some 100,000."""
    share = (1 - least) / 2
    return int(64 * SKETCH * share + DEVIATIONS * (64 * SKETCH * share * (1 - share)) ** 0.5) + 1


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Add ``column`` of both nodes as u_column and v_column."""
    for side in ("u", "v"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{side}_{column}")), side)
    return pairs


def _verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs ``(u, v)`` whose texts are at least ``least`` similar; texts move only where the signatures allow it."""
    enough = least_equal(least)

    def may(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(x), dtype="<u2").reshape(-1, MINIMA) for x in (a, b))
        return pd.Series((one == two).sum(axis=1) >= enough)

    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        held: dict[str, np.ndarray] = {}

        def items(text: str) -> np.ndarray:
            if text not in held:
                if len(held) >= 64:
                    held.clear()
                held[text] = shingles(words_of(text), width)
            return held[text]

        return pd.Series([similarity(items(x), items(y)) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    likely = cut(_both(pairs, signs, "sig").where(F.pandas_udf(may, "boolean")("u_sig", "v_sig")).select("u", "v"))
    out = cut(_both(likely, texts, "text").where(F.pandas_udf(close, "boolean")("u_text", "v_text")).select("u", "v"))
    drop(likely)
    return out


def _rooted(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Add ``root``, the root of the node's component."""
    if found is None:
        return members.withColumn("root", F.col("node"))
    roots = components(found)
    out = cut(members.join(roots.select("node", F.col("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r"))
    drop(roots)
    return out


def _several(members: DataFrame, of: str) -> DataFrame:
    """The members of buckets that hold more than one value of a column. Members move once, and without a second table of the buckets."""
    bucket = Window.partitionBy("key")
    return members.withColumns({"least": F.min(of).over(bucket), "most": F.max(of).over(bucket)}).where("least < most").drop("least", "most")


def _apart(rooted: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    return _several(rooted, "root")


def _fresh(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")


def _plus(table: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if table is None else table.unionByName(more)


def _narrow(nodes: DataFrame, signs: DataFrame) -> DataFrame:
    """``(key, node)`` of the narrow buckets with several nodes."""
    name = F.pandas_udf(lambda sigs: pd.Series([buckets(np.frombuffer(x, dtype="<u2"), _NARROW) for x in sigs]), "array<long>")
    return cut(_several(signs.join(nodes, "node", "left_semi").select(F.explode(name("sig")).alias("key"), "node"), "node"))


def _sketches(nodes: DataFrame, signs: DataFrame) -> DataFrame:
    """``(node, sketch)``: the lowest bits of the minima, packed in LONGs."""

    def pack(sigs: pd.Series) -> pd.Series:
        bits = (np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, MINIMA) & 1).astype(np.uint8)[:, : 64 * SKETCH]
        return pd.Series(list(np.packbits(bits, axis=1, bitorder="little").view("<i8")))

    return signs.join(nodes, "node", "left_semi").select("node", F.pandas_udf(pack, "array<long>")("sig").alias("sketch"))


def links(marked: DataFrame, width: int, least: float, first_pairs: DataFrame | None = None) -> DataFrame | None:
    """``marked(node, text, sig, keys)`` -> links ``(u, v)``, u < v, whose components are those of all pairs that are similar enough.

    ``first_pairs(u, v)`` are checked before any others. Rows of one node are copies. Only texts that share a bucket with another one move.
    The tables of this search are deleted as soon as nothing reads them any more, ``marked`` among them if it is a ``cut``.
    """
    known, n, done = None, 0, []
    if first_pairs is not None:
        first_pairs, n = cut_counted(first_pairs)
        done.append(first_pairs)
    if n:
        named = first_pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        there = cut(marked.select("node", "text", "sig").join(named, "node", "left_semi").dropDuplicates(["node"]))
        known = _verified(first_pairs, there.select("node", "sig"), there.select("node", "text"), width, least)
        drop(there)
    members = cut(_several(marked.select(F.explode("keys").alias("key"), "node").distinct(), "node"))
    held = cut(marked.select("node", "text", "sig").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    drop(marked)
    done.append(held)
    texts, signs = held.select("node", "text"), held.select("node", "sig")
    # how many others a node meets in all its buckets
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    meets = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("meets"))
    plain, members = members, cut(members.join(meets, "node"))
    drop(plain)
    held_members, found, tried, before = members, known, first_pairs if n else None, None
    for turn in range(ROUNDS):
        every = _rooted(members, found)
        rooted, n = cut_counted(_apart(every))
        drop(every)
        drop(held_members)
        members, held_members = rooted.drop("root"), rooted
        if n == 0:
            done.append(rooted)
            return _without(done, found)
        if before is not None and n > (1 - WORTH) * before:
            break
        before = n
        # the first leader is the best met member, later ones are any
        first = F.col("meets") if turn == 0 else F.lit(0).cast("long")
        order = F.struct(first.alias("first"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "root")
        leader = rooted.groupBy("key").agg(F.max(order).alias("l")).select("key", F.col("l.node").alias("u"), F.col("l.root").alias("lead_root"))
        pairs = rooted.select("key", F.col("node").alias("v"), "root").join(leader, "key").where("root <> lead_root")
        pairs, n = cut_counted(_fresh(pairs, tried))
        if n:
            tried = _plus(tried, pairs)
            done.append(pairs)
            found = _plus(found, _verified(pairs, signs, texts, width, least))
    narrow = _narrow(members.select("node").distinct(), signs)
    drop(held_members)
    every = _rooted(narrow, found)
    open_, n = cut_counted(_apart(every))
    drop(every)
    drop(narrow)
    if n:
        # every pair of two components has one member outside the bucket's largest component
        sizes = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
        sketches = cut(_sketches(open_.select("node").distinct(), signs))
        told = open_.join(sketches, "node")
        few = told.join(largest, "key").where("root <> largest").select("key", F.col("node").alias("u"), F.col("root").alias("u_root"), F.col("sketch").alias("u_sketch"), "largest")
        every = told.select("key", F.col("node").alias("v"), F.col("root").alias("v_root"), F.col("sketch").alias("v_sketch"))
        unequal = sum((F.bit_count(F.col("u_sketch")[i].bitwiseXOR(F.col("v_sketch")[i])) for i in range(1, SKETCH)), F.bit_count(F.col("u_sketch")[0].bitwiseXOR(F.col("v_sketch")[0])))
        few, every = few.alias("few"), every.alias("every")
        meet = (F.col("few.key") == F.col("every.key")) & F.expr("u_root <> v_root and (u < v or v_root = largest)") & (unequal <= most_unequal(least))
        pairs, n = cut_counted(_fresh(few.join(every, meet).select("u", "v"), tried))
        drop(sketches)
        done.append(pairs)
        if n:
            found = _plus(found, _verified(pairs, signs, texts, width, least))
    done.append(open_)
    return _without(done, found)


def _without(done: list[DataFrame], found: DataFrame | None) -> DataFrame | None:
    """The links, with the tables that led to them deleted."""
    for table in done:
        drop(table)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, component_id)``, one row per input row.

    component_id is the smallest doc_id that chains of links reach. Texts of equal words are one node, so
    copies are never paired; null and empty texts are copies of each other. Rows without doc_id keep a
    null doc_id and count only as members. ``candidates`` names pairs of nodes of (node, text) to be checked first.
    """
    marked = cut(_signed(docs.select("doc_id", "text"), width))
    rows = cut(marked.select("doc_id", "node"))
    named = cut(rows.groupBy("node").agg(F.min("doc_id").alias("low")))
    found = links(marked, width, least, candidates(marked) if candidates else None)
    if found is None:
        return rows.join(named, "node").select("doc_id", F.col("low").alias("component_id"))
    named = named.join(components(found), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.select("node", "root").join(low, "root"), "node").select("doc_id", "component_id")
