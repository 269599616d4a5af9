"""Document fingerprints by winnowing, on DataFrame functions only.

A fingerprint keeps the smallest k-gram hash of every window of ``span`` neighbouring k-grams, the
rightmost of equal ones, with its position. Any passage of at least ``k + span - 1`` words that two
texts share leaves at least one common hash. Grams are over lower-cased words between white space;
a text of fewer than k words is one gram, a text without words has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import bound_to, text_key, whole

LOW = (1 << 32) - 1
#: Bytes of text a bucket of neighbouring documents should hold, and how many buckets there are at most.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 10_000


def winnowed(text: Column, k: int = 5, span: int = 8) -> Column:
    """Array of (position, hash) in order of position; positions count words from 0."""

    def grams(words: Column) -> Column:
        def of(i: Column) -> Column:
            return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), of)

    def keys(hashes: Column) -> Column:
        # 31 bits of the hash above, the position counted down below: the minimum is the rightmost smallest
        return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(F.lit(LOW) - i))

    def picks(hashes: Column) -> Column:
        def smallest(key: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(key) - span + 1, F.lit(1)))
            return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(key, i, F.lit(span)))))

        def back(x: Column) -> Column:
            at = (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("int")
            return F.struct(at.alias("position"), F.get(hashes, at).alias("hash"))

        return F.transform(bound_to(keys(hashes), smallest), back)

    def words_of(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(t), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))

    none = F.array().cast("array<struct<position:int,hash:bigint>>")
    return bound_to(words_of(text), lambda words: F.when(F.size(words) > 0, bound_to(grams(words), picks)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of two hash arrays; 1 for two empty ones."""
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(common / every)


def printed(hashes: Column) -> Column:
    """The lower halves of the hashes as 8 hexadecimal digits each, comma-joined in order of position."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.substring(F.hex(F.lit(1 << 32) + h.bitwiseAND(F.lit(LOW))), 2, 8))), ",")


def with_next(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``next_text`` (and ``next_<name>`` of each extra) of the next row in descending order of doc_id; the last row's next is the first.

    Rows without doc_id come last, equal doc_ids in the order of their texts' names. Texts move once:
    rows are dealt to buckets of doc_id quantiles and each bucket also gets a copy of the first row of the
    bucket below, so that no window reaches over more than one bucket of bounded size.
    """
    extra = extra or {}
    rows = docs.select("doc_id", whole("text").alias("text"), *text_key())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MOST_BUCKETS, size // BUCKET_BYTES + 1))
    if n > 1:
        at = [i / n for i in range(1, n)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * n)).alias("q")).first()["q"] or []))
    else:
        bounds = []
    cuts = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    # buckets count up while doc_ids go down; the last one also holds the rows without doc_id
    bucket = F.lit(len(bounds)) - F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col("doc_id"))), F.lit(0)) if len(bounds) <= 32 else _searched(cuts, len(bounds))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("down", F.bitwise_not("doc_id"))
    order = ["down", "k1", "k2"]
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("down").isNull().alias("none"), *order)).alias("first"))
    held = {r["bucket"]: r["first"] for r in firsts.collect()}  # one small row for each bucket
    filled = sorted(held)
    sent = [(b, held[b]["down"], held[b]["k1"], held[b]["k2"], filled[i - 1]) for i, b in enumerate(filled)]
    guests = docs.sparkSession.createDataFrame(sent, "g_bucket int, g_down long, g_k1 long, g_k2 long, host int")
    same = (F.col("bucket") == F.col("g_bucket")) & F.col("down").eqNullSafe(F.col("g_down")) & (F.col("k1") == F.col("g_k1")) & (F.col("k2") == F.col("g_k2"))
    marked = rows.join(F.broadcast(guests), same, "left")
    stays = F.struct(F.col("bucket").alias("place"), F.lit(False).alias("guest"))
    goes = F.struct(F.col("host").alias("place"), F.lit(True).alias("guest"))
    dealt = marked.select("doc_id", "text", *order, F.explode(F.when(F.col("host").isNull(), F.array(stays)).otherwise(F.array(stays, goes))).alias("at"))
    placed = dealt.select("doc_id", "text", *order, "at.place", "at.guest").repartition("place")
    placed = placed.select("*", *[c.alias(name) for name, c in extra.items()])
    near = Window.partitionBy("place").orderBy("guest", F.col("down").asc_nulls_last(), "k1", "k2")
    named = ["text", *extra]
    out = placed.select("doc_id", "text", *extra, "guest", *[F.lead(c).over(near).alias(f"next_{c}") for c in named])
    return out.where("not guest").drop("guest")


def _searched(cuts: Column, n: int) -> Column:
    """Bucket by bisection of the sorted bounds."""
    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce(F.get(cuts, middle) < F.col("doc_id"), F.lit(False))
        go = s["low"] < s["high"]
        return F.struct(F.when(go & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(go & ~below, middle).otherwise(s["high"]).alias("high"))

    return F.lit(n) - F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), half)["low"]


def query(docs: DataFrame) -> DataFrame:
    hashes = F.transform(winnowed(F.col("text")), lambda p: p["hash"])
    near = with_next(docs, {"marks": hashes})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    edited = edited.withColumn("edited_marks", F.transform(winnowed(F.col("edited")), lambda p: p["hash"]))
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"),
        printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
