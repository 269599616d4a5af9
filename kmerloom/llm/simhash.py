"""SimHash near-duplicates: fingerprints compared at the anchors of a covering code.

Anchors are the words of the perfect Hamming code on 31 bits: every 31-bit block lies within one
flip of exactly one of 2^26 anchors (covering radius 1). A fingerprint has two such blocks. If two
fingerprints differ in at most t <= 3 bits, one of the blocks differs in at most t // 2, hence the
home anchor of one block lies within 1 + t // 2 flips of the other. Each fingerprint is therefore
sent home once per block and replicated to all anchors within covering radius plus that block
threshold (at most 16), and only fingerprints that meet at an anchor are compared, exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kmerloom.llm import near
from kmerloom.llm.components import components
from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut

#: Width of a block and the bits of its positions' numbers 1..31.
BLOCK, PARITIES = 31, 5


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of word shingles, repeats included; signed. Empty texts: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    return docs.withColumn(name, _fingerprints(whole("text")))


def _syndrome(block: Column) -> Column:
    """Number of the position to flip to reach the nearest anchor; 0 at an anchor."""
    parts = []
    for j in range(PARITIES):
        mask = sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> j & 1)
        parts.append((F.bit_count(block.bitwiseAND(F.lit(mask))) % 2) * (1 << j))
    return sum(parts[1:], parts[0]).cast("int")


def _flip(block: Column, position: Column) -> Column:
    """The block with the bit of a position 1..31 flipped; position 0 changes nothing."""
    return block.bitwiseXOR(F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)).otherwise(F.lit(0).cast("long")))


def _blocks(prints: DataFrame) -> DataFrame:
    mask = F.lit((1 << BLOCK) - 1)
    parts = F.array(*[
        F.struct(F.lit(b).cast("byte").alias("block"), F.shiftrightunsigned("fp", b * BLOCK).bitwiseAND(mask).alias("x")) for b in (0, 1)
    ])
    blocks = prints.select("fp", F.inline(parts))
    return blocks.select("fp", "block", "x", _syndrome(F.col("x")).alias("s"))


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> pairs ``(u, v)``, u < v, at most ``threshold`` bits apart; each pair once."""
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    blocks = _blocks(prints)
    home = blocks.select("block", _flip(F.col("x"), F.col("s")).alias("anchor"), F.col("fp").alias("u"))
    anchors = F.array(_flip(F.col("x"), F.col("s")))
    if threshold >= 2:
        # two flips a and b end at an anchor where the positions' numbers add up (xor) to the syndrome
        near = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)), lambda a: a.bitwiseXOR(F.col("s")) > a)
        near = F.when(F.col("s") > 0, near).otherwise(F.array().cast("array<int>"))
        anchors = F.concat(anchors, F.transform(near, lambda a: _flip(_flip(F.col("x"), a), a.bitwiseXOR(F.col("s")))))
    sent = blocks.select("block", F.explode(anchors).alias("anchor"), F.col("fp").alias("v"))
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    met = home.alias("h").join(sent.alias("s"), (F.col("h.block") == F.col("s.block")) & (F.col("h.anchor") == F.col("s.anchor")) & close)
    return met.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, one row per input row.

    component_id is the smallest doc_id that chains of links reach. Equal fingerprints link, so copies
    share one node and are never paired. Null and empty texts have fingerprint 0 and link like any
    other; rows without doc_id keep a null doc_id and count only as members. Empty input gives no rows.
    """
    marked = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(prints, threshold))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(named.select("fp", "root").join(low, "root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays.

    Documents link by ``threshold`` bits of the fingerprint, whose shingles have three words, found at the anchors. With
    ``similarity`` what meets there is checked exactly, by the share of common shingles of ``width`` words, and texts that share as
    much but have other fingerprints (64 majority bits can't tell 0.8, some ten bits) are linked after that. Rows without doc_id
    stay. Repeated rows of the kept doc_id collapse to one.
    """
    if similarity is None:
        groups = near_duplicates(docs, threshold)
    else:
        groups = near.near_duplicates(docs, width, similarity, lambda marked: met(marked, threshold))
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return first.unionByName(docs.where("doc_id is null"))


def met(marked: DataFrame, threshold: int = 2) -> DataFrame:
    """``marked(node, text)`` -> pairs ``(u, v)``, u < v, of texts whose fingerprints meet at an anchor.

    Texts of one fingerprint are paired with one of them, which alone is paired with those of other fingerprints.
    """
    prints = cut(with_fingerprint(marked.select("node", "text")).select("node", "fp").distinct())
    leaders = cut(prints.groupBy("fp").agg(F.min("node").alias("leader")))
    same = prints.join(leaders, "fp").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    one, two = (leaders.select(F.col("fp").alias(c), F.col("leader").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    other = links(leaders.select("fp"), threshold).join(one, "u").join(two, "v").select("a", "b")
    return same.unionByName(other).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
