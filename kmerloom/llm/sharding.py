"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import cut


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``before`` (bytes of all earlier rows) and ``row`` (number of earlier rows) in the given global order.

    Rows are range-partitioned once and written with the number of their partition. Each partition's
    total is one row; earlier totals are added up over these rows alone (as many as partitions),
    then every partition runs its own sums from its offset. No task sees more than its partition.
    """
    spread = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    fixed = cut(spread)
    totals = fixed.groupBy("part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("row_offset"),
    )
    own = Window.partitionBy("part").orderBy(*order)
    running = fixed.withColumn("row", F.row_number().over(own)).withColumn("upto", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = running.join(offsets, "part")
    return out.select(
        *rows.columns,
        (F.col("byte_offset") + F.col("upto") - F.col(size)).alias("before"),
        (F.col("row_offset") + F.col("row") - 1).cast("long").alias("row"),
    )


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, shard, slot)``, contiguous in doc_id order.

    A row belongs to the shard in which the middle of its bytes lies when all bytes are cut at
    ``count`` equal targets, so a shard is off its target by half a row at each end. size is the UTF-8
    length plus 1; a null text has size 1 and the checksum of no bytes. Null doc_ids come first;
    rows with equal doc_id are ordered by checksum and size, equal rows keep one slot each. A
    row longer than a target may leave a shard empty. Slots are gapless from 0 in each shard.
    """
    data = whole("text").cast("binary")
    sized = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = cut(prefix_sums(sized, ["doc_id", "text_crc32", "size"], "size"))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    ruled = placed.withColumn("shard", F.least(F.lit(count - 1), F.expr(f"(2 * before + size) * {count} div {2 * total}L")).cast("int"))
    first = ruled.groupBy("shard").agg(F.min("row").alias("first"))
    return ruled.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    out = shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
