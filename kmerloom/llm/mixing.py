"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations.

Weights are ``share ** exponent`` normalised; an exponent of 1 keeps the corpus, 0 makes all sources
equal. The exponent is found by bisection so that a wanted entropy or a limit of repetitions is
met. The budget is then filled source by source: whole passes over the source, each in its own
permutation, and a last pass that stops at the budget. A permutation orders blocks of documents by a
hash and documents within a block, so running sums need no task that holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut

#: Tokens in a block on average; bits of the hash that number blocks at most; exponents tried in one bisection job.
BLOCK_TOKENS, BLOCK_BITS, TRIED = 1 << 16, 24, 16


def tokens(column: str = "text") -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(whole(column), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def totals(marked: DataFrame) -> DataFrame:
    """``(source, tokens)``; a null source is a source of its own, sources without tokens are left out."""
    return marked.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def _measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most repetitions when no source is cut) for each exponent, in one job."""
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow(F.col("share"), F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * a * F.log("share")).alias(f"e{i}"), F.max(F.pow("share", F.lit(a - 1.0))).alias(f"h{i}"), F.min(F.pow("share", F.lit(a - 1.0))).alias(f"l{i}")]
    r = shares.agg(*columns).first()
    return [(math.log(r[f"z{i}"]) - r[f"e{i}"] / r[f"z{i}"], r[f"h{i}"] / r[f"l{i}"]) for i in range(len(exponents))]


def exponent(source_tokens: DataFrame, entropy: float | None = None, repetition: float | None = None, rounds: int = 8) -> float:
    """The exponent in [0, 1] nearest to 1 whose mix has at least the entropy (nats), or nearest to 0 whose mix repeats no source more often.

    Both measures fall as the exponent grows. Every round splits the interval in ``TRIED`` parts, so the
    result is exact to ``TRIED ** -rounds``. Sources stay in Spark; each round returns a few sums.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give an entropy or a repetition limit")
    total = source_tokens.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = source_tokens.select((F.col("tokens") / F.lit(float(total))).alias("share"))
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / TRIED
        tried = [low + i * step for i in range(TRIED + 1)]
        found = _measures(shares, tried)
        if entropy is not None:
            good = [a for a, (h, _) in zip(tried, found, strict=True) if h >= entropy - 1e-12]
            if not good:
                return 0.0
            low = good[-1]
        else:
            good = [a for a, (_, most) in zip(tried, found, strict=True) if most <= repetition * (1 + 1e-12)]
            if not good:
                return 1.0
            low = max(0.0, good[0] - step)
        high = min(1.0, low + step)
        if low == high:
            break
    return low if entropy is not None else high


def plan(source_tokens: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = 2.0) -> DataFrame:
    """``(source, tokens, weight, budget)``. Without a total budget the source that shrinks most keeps exactly one pass, so no document is lost."""
    a = exponent(source_tokens, entropy, None if entropy is not None else repetition)
    total = source_tokens.agg(F.sum("tokens")).first()[0] or 1
    powered = source_tokens.withColumn("power", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)))
    sums = powered.agg(F.sum("power").alias("z"), F.max(F.col("tokens") / F.col("power")).alias("fill")).first()
    z = sums["z"] or 1.0
    given = F.round(F.col("power") / z * F.lit(float(budget))) if budget is not None else F.greatest(F.round(F.col("power") * F.lit(sums["fill"] or 1.0)), F.col("tokens"))
    return powered.select("source", "tokens", (F.col("power") / z).alias("weight"), given.cast("long").alias("budget"))


def _order(pass_number: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), pass_number, "row_key")


def mixed(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = 2.0, seed: int = 11) -> DataFrame:
    """``(_doc, tokens, weight, pass, row_key)``: every row of ``docs``, as a struct, as often as its source's budget takes it.

    A document is taken in a pass if the pass reaches it before the budget is full, so a source goes over its
    budget by less than one document. Documents without tokens (null and empty texts) are taken once,
    in pass 0: they cost nothing. Null sources mix
    like any other. Repeated rows have equal keys and stand together in a permutation. Empty input gives no rows.
    """
    key = F.xxhash64(F.col("doc_id"), whole("text"))
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", tokens().alias("tokens"), key.alias("row_key"))
    light = cut(marked.select("source", "tokens", "row_key"))
    rows = light.where("tokens > 0").groupBy("source", "row_key").agg(F.sum("tokens").alias("tokens"))
    shares = cut(plan(cut(totals(light)), budget, entropy, repetition))
    # few passes are whole; the last one ends inside the source
    shares = shares.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("left", F.col("budget") - F.col("passes") * F.col("tokens"))
    bits = F.least(F.lit(BLOCK_BITS), F.ceil(F.log2(F.col("tokens") / BLOCK_TOKENS + 1)).cast("int"))
    ruled = shares.withColumn("bits", bits).select(F.col("source").alias("s"), "weight", "passes", "left", "bits")

    last = rows.join(ruled, rows.source.eqNullSafe(ruled.s)).where("left > 0")
    hashed = _order(F.col("passes"), seed)
    block = F.call_function("shiftrightunsigned", hashed, F.lit(64) - F.col("bits")).cast("long")
    last = cut(last.select("s", "row_key", "tokens", "left", hashed.alias("place"), F.when(F.col("bits") > 0, block).otherwise(0).alias("block")))
    sums = last.groupBy("s", "block").agg(F.sum("tokens").alias("block_tokens"))
    ahead = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("s").alias("b_s"), F.col("block").alias("b_block"), F.coalesce(F.sum("block_tokens").over(ahead), F.lit(0)).alias("before"), "block_tokens")
    spread = last.join(sums, last.s.eqNullSafe(sums.b_s) & (last.block == sums.b_block)).where("before < left")
    sure = spread.where("before + block_tokens <= left").select("s", "row_key")
    inside = Window.partitionBy("s", "block").orderBy("place", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = spread.where("before + block_tokens > left").withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    partly = sure.union(edge.where("upto < left").select("s", "row_key")).withColumn("more", F.lit(1))

    r = rows.select("source", "row_key").join(ruled, rows.source.eqNullSafe(ruled.s)).select(F.col("source"), "row_key", "weight", "passes")
    p = partly.select(F.col("s").alias("p_s"), F.col("row_key").alias("p_key"), "more")
    taken = r.join(p, r.source.eqNullSafe(p.p_s) & (r.row_key == p.p_key), "left").select(F.col("source").alias("t_s"), F.col("row_key").alias("t_key"), "weight", (F.col("passes") + F.coalesce("more", F.lit(0))).alias("times"))
    joined = marked.join(taken, marked.source.eqNullSafe(taken.t_s) & (marked.row_key == taken.t_key), "left")
    times = F.when(F.col("tokens") > 0, F.coalesce("times", F.lit(0))).otherwise(1)
    return joined.where(times > 0).select("_doc", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.explode(F.sequence(F.lit(0), times - 1)).alias("pass"), "row_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as its source's budget asks; columns as they were."""
    return mixed(docs, **options).select("_doc.*")


def query(docs: DataFrame, seed: int = 11) -> DataFrame:
    """One row for each time a document is used, with the key that orders the pass."""
    out = mixed(docs.select("doc_id", "text", "source"), seed=seed)
    return out.select("_doc.doc_id", "_doc.source", "tokens", F.round("weight", 9).alias("weight"), F.col("pass").cast("int").alias("pass"), _order(F.col("pass"), seed).alias("place"))
