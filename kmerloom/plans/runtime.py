"""Lineage cuts and row counts shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of this machine only where none is named and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kmerloom-"))
        chosen = context._jsc.sc().getCheckpointDir()
    return chosen.get()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{scratch_folder(spark).rstrip('/')}/kmerloom-tables/{uuid.uuid4().hex}"


#: Spark's setting to delete the shuffle files of a query as soon as it ends (Spark 4.1 on; others ignore it).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    A table rather than ``checkpoint()``: its file sizes tell the planner when a side is small
    enough to broadcast, and it does not carry over the constraints of the plan behind it,
    which pile up in iterative jobs until the optimizer stalls. Shuffle files behind it are deleted
    with the write, as they would lie there until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if held is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a ``cut`` that nothing will read any more; other tables are left alone."""
    path = getattr(df, "_kmerloom_path", None)
    if path is not None:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch file or folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_observed(df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """``cut`` plus named aggregates of the rows, observed in the same job."""
    seen = Observation()
    out = cut(df.observe(seen, *figures))
    return out, seen.get


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` plus the row count, observed in the same job."""
    out, seen = cut_observed(df, F.count(F.lit(1)).alias("n"))
    return out, int(seen["n"])


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of other hosts this package, once per session."""
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_kmerloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="kmerloom-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "kmerloom"), "zip", root, "kmerloom"))
    sc._kmerloom_shipped = True
