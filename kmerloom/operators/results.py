"""Analytics on logs of constructor runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.text import implied_penalty, objective
from kmerloom.plans.runtime import cut

MEASURES = ["length", "runs", "time_s", "mem_kib", "gzip", "bzip2", "xz", "zpaq", "zstd"]


def parse_log(lines: DataFrame, k: int | None = None, complements: bool | None = None) -> DataFrame:
    """Lines ``ts <tab> arguments <tab> := measures`` to typed rows.  Missing trailing
    measures count as 1 and fractions are cut, except for the run time.  With ``k`` or ``complements``
    lines that can't have them are left out before they are parsed; others may stay."""
    v = F.col("value")
    if k is not None:
        lines = lines.where(v.contains(f"-k {k}"))
    if complements:
        lines = lines.where(v.contains("-c"))
    args = F.regexp_extract(v, r"^[^\t]*\t(.*?)\s*:=", 1)
    nums = F.split(F.trim(F.regexp_extract(v, r":=\s*(.*)$", 1)), r"\s+")

    def option(pattern):
        found = F.regexp_extract("args", pattern, 1)
        return F.when(found != "", found)

    t = lines.where(v.contains(":=")).select(F.split(v, "\t")[0].alias("ts"), args.alias("args"), nums.alias("nums"))
    out = t.select(
        "ts",
        option(r"-p (\S+)").alias("path"),
        option(r"-k (\d+)").cast("int").alias("k"),
        option(r"-a (\S+)").alias("algorithm"),
        F.col("args").rlike(r"(^|\s)-c(\s|$)").alias("complements"),
        option(r"(?:--run-penalty|-x) (\d+)").cast("int").alias("run_penalty"),
        *[F.coalesce(F.try_element_at("nums", F.lit(i + 1)), F.lit("1")).alias(m) for i, m in enumerate(MEASURES)],
    )
    whole = {m: F.substring_index(m, ".", 1).cast("long") for m in MEASURES if m != "time_s"}
    return out.withColumns({**whole, "time_s": F.col("time_s").cast("double")})


def with_objective(results: DataFrame) -> DataFrame:
    return results.withColumn("objective", objective(F.col("length"), F.col("runs")))


def relative(results: DataFrame, baseline: str = "global") -> DataFrame:
    """Objective and compressed size relative to the baseline algorithm on the same input,
    k and model. The log is parsed once, and the written size of the baselines chooses the join."""
    keys = ["path", "k", "complements"]
    r = cut(with_objective(results))
    base = r.where(F.col("algorithm") == baseline).groupBy(*keys).agg(
        F.min("objective").alias("base_objective"), F.min("xz").alias("base_xz")
    )
    return r.join(cut(base), keys, "left").withColumns(
        {
            "relative_objective": F.col("objective") / F.col("base_objective"),
            "relative_xz": F.col("xz") / F.col("base_xz"),
        }
    )


def best_penalty(results: DataFrame) -> DataFrame:
    """Run penalty with the least objective (smallest on ties) per input, k and strand model."""
    r = with_objective(results).where(F.col("run_penalty").isNotNull())
    return r.groupBy("path", "k", "complements").agg(
        F.min_by("run_penalty", F.struct("objective", "run_penalty")).alias("best_penalty"),
        F.min("objective").alias("best_objective"),
    )


def implied_penalties(results: DataFrame) -> DataFrame:
    return results.withColumn("implied_penalty", implied_penalty(F.col("length"), F.col("runs")))


def missing(configurations: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations (path, k, algorithm, complements, run_penalty) without a result; no penalty equals no penalty."""
    keys = ["path", "k", "algorithm", "complements", "run_penalty"]
    c, r = configurations.alias("c"), results.select(*keys).distinct().alias("r")
    same = [F.col(f"c.{key}").eqNullSafe(F.col(f"r.{key}")) for key in keys]
    return c.join(r, same, "left_anti")


def read_inputs(lines: DataFrame) -> DataFrame:
    """Lines ``file k_limit run_penalty label flag`` to typed rows; comments and empty lines are left out.

    The limit is 128 where none is given, the other fields are null; underscores in labels stand for blanks.
    """
    line = F.trim("value")
    part = F.split(line, r"\s+")

    def field(i: int):
        return F.try_element_at(part, F.lit(i))

    t = lines.where((line != "") & ~line.startswith("#"))
    return t.select(
        field(1).alias("file"), F.coalesce(field(2).cast("int"), F.lit(128)).alias("k_limit"), field(3).cast("int").alias("run_penalty"),
        F.replace(field(4), F.lit("_"), F.lit(" ")).alias("label"), field(5).alias("flag"),
    )


def configurations(inputs: DataFrame, algorithms: list[str], ks: list[int], plain: tuple[str, ...] = ("global",)) -> DataFrame:
    """(path, k, algorithm, complements, run_penalty) to run: every k below an input's limit; ``plain`` algorithms take no penalty."""
    every = inputs.select("file", "k_limit", "run_penalty", F.explode(F.array(*map(F.lit, algorithms))).alias("algorithm"))
    every = every.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("k < k_limit")
    penalty = F.when(~F.col("algorithm").isin(*plain), F.col("run_penalty"))
    return every.select(F.col("file").alias("path"), "k", "algorithm", F.lit(True).alias("complements"), penalty.alias("run_penalty"))


def log_lines(results: DataFrame) -> DataFrame:
    """Typed rows as log lines ``value``; what ``parse_log`` reads back."""
    words = F.concat_ws(
        " ", F.concat(F.lit("-p "), "path"), F.concat(F.lit("-k "), F.col("k").cast("string")), F.concat(F.lit("-a "), "algorithm"),
        F.when(F.col("complements"), "-c"), F.concat(F.lit("--run-penalty "), F.col("run_penalty").cast("string")),
    )
    numbers = F.concat_ws(" ", *[F.col(m).cast("string") for m in MEASURES])
    return results.select(F.concat("ts", F.lit("\t"), words, F.lit("\t:= "), numbers).alias("value"))


def append_log(results: DataFrame, path: str) -> None:
    log_lines(results).write.mode("append").text(path)


def table_rows(results: DataFrame, inputs: DataFrame, k: int, complements: bool = True, resources: bool = False, baseline: str = "global", other: str = "loac") -> DataFrame:
    """Rows of the result tables: length and runs, or time and memory, of the baseline and of ``other`` at each input's penalty.

    Of several runs of a configuration the last counts; inputs labelled ``-`` are left out.
    """
    last = with_objective(results.where((F.col("k") == k) & (F.col("complements") == complements)))
    # nothing else is shown; the log is parsed once and the last runs are written
    last = last.where(((F.col("algorithm") == baseline) & F.col("run_penalty").isNull()) | (F.col("algorithm") == other))
    last = cut(last.groupBy("path", "algorithm", "run_penalty").agg(F.max_by(F.struct("length", "runs", "objective", "xz", "time_s", "mem_kib"), "ts").alias("r")))
    named = inputs.where("label is not null and label <> '-'").select("file", "label", F.col("run_penalty").alias("penalty"))
    base = last.where((F.col("algorithm") == baseline) & F.col("run_penalty").isNull()).select(F.col("path").alias("file"), F.col("r").alias("b"))
    more = last.where(F.col("algorithm") == other).select(F.col("path").alias("file"), F.col("run_penalty").alias("penalty"), F.col("r").alias("o"))
    both = named.join(base, "file").join(more, ["file", "penalty"], "left")

    def ratio(name: str):
        return F.col("r")[name] / F.col("b")[name]

    first = F.struct(F.lit("GGMO").alias("method"), F.col("b").alias("r"), F.lit(False).alias("told"))
    second = F.struct(F.concat(F.lit("LOAC ("), F.col("penalty").cast("string"), F.lit(")")).alias("method"), F.col("o").alias("r"), F.lit(True).alias("told"))
    t = both.select(F.col("label").alias("dataset"), "b", F.inline(F.when(F.col("o").isNull(), F.array(first)).otherwise(F.array(first, second))))
    pairs = (("time_s", "time", "relativetime"), ("mem_kib", "memory", "relativememory")) if resources else (("objective", "objective", "relative"), ("xz", "compressed", "relativecompressed"))
    plain = [] if resources else [F.col("r.length").alias("length"), F.col("r.runs").alias("runs")]
    return t.select("dataset", "method", *plain, *[c for m, n, r in pairs for c in (F.col("r")[m].alias(n), F.when(F.col("told"), ratio(m)).alias(r))])


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
