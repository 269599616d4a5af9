"""Input tables and small column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The whole text; null reads as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> list[Column]:
    """A 128-bit name of the text as two LONG columns, k1 and k2."""
    text = whole(column)
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with value computed once per row, also inside the lambdas that ``use`` builds."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step: int = 256) -> Column:
    """Exclusive running sums of an array<long>, in two levels so that long arrays cost step per entry."""
    empty = F.array().cast("array<long>")

    def sums(items: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), empty.alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def two_levels(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(step))
        chunks = F.transform(starts, lambda c: F.slice(v, c, F.lit(step)))

        def join(chunked: Column) -> Column:
            totals = F.transform(chunked, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
            return F.flatten(F.zip_with(chunked, sums(totals, F.lit(0)), sums))

        return F.when(F.size(v) > 0, bound_to(chunks, join)).otherwise(empty)

    return bound_to(values, two_levels)
