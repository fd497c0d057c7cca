"""Execution profiles as text logs: parsing, writing, and the text sources around them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Beginnings of lines that are no data. Fixed values.
NOISE = ["#", "[inst]", "step", "c ", "SA ", "Warning", "unstrat", "nohup"]

SUMMARY = {"n": r"\bn=\s*(\d+)", "pw": r"\bpw=\s*(\d+)", "ord_time_s": r"\bord=\s*([\d.]+)s", "dp_time_s": r"\bdp=\s*([\d.]+)s", "ham_paths": r"\bham_paths=\s*(\d+)"}


def read_texts(spark: SparkSession, paths: str | list[str], pattern: str = "profile_*.txt") -> DataFrame:
    """(name, text) of whole files; ``pattern`` applies to folders. Empty files are dropped."""
    files = spark.read.option("pathGlobFilter", pattern).text(paths, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text")).where("trim(text) <> ''")


def parse_steps(texts: DataFrame) -> DataFrame:
    """Step rows of (name, text): eight fields, or nine with ``e_bag``, then an optional bag and a tag.

    Of several rows of a step the last wins. ``n`` comes from the summary line, or from ``_<n>`` in the name.
    """
    lines = texts.select("name", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    data = lines.where(F.col("line").rlike(r"^\d")).where(~F.col("line").rlike("^(" + "|".join(p.replace("[", r"\[").replace("]", r"\]") for p in NOISE) + ")"))
    plain = F.regexp_replace("line", r"\{[^}]*\}|\[[^\]]*\]", "")
    cells = data.select("name", "line_no", F.split(F.trim(plain), r"\s+").alias("f"), F.regexp_extract("line", r"\[(sm|ext|eh)\]", 1).alias("tag"))
    cells = cells.where("size(f) in (8, 9)").withColumn("new", F.size("f") == 9)
    number = lambda i, kind: F.expr(f"try_cast(f[{i}] as {kind})")
    late = lambda i, kind: F.when(F.col("new"), F.expr(f"try_cast(get(f, {i + 1}) as {kind})")).otherwise(F.expr(f"try_cast(get(f, {i}) as {kind})"))
    rows = cells.select(
        "name", "line_no", number(0, "int").alias("step"), number(1, "int").alias("vertex"), number(2, "int").alias("fs"), number(3, "int").alias("n_back"),
        F.when(F.col("new"), number(4, "int")).alias("e_bag"), late(4, "bigint").alias("states_in"), late(5, "bigint").alias("states_out"), late(6, "double").alias("step_ms"), late(7, "double").alias("cumul_ms"),
        F.nullif("tag", F.lit("")).alias("backend"),
    ).where("step is not null and states_out is not null")
    last = rows.groupBy("name", "step").agg(F.max_by(F.struct("vertex", "fs", "n_back", "e_bag", "states_in", "states_out", "step_ms", "cumul_ms", "backend"), "line_no").alias("r")).select("name", "step", "r.*")
    return last.join(parse_summaries(texts), "name", "left")


def parse_summaries(texts: DataFrame) -> DataFrame:
    """(name, n, pw, ord_time_s, dp_time_s, ham_paths), null where a text does not say."""
    found = {k: F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for k, p in SUMMARY.items()}
    return texts.select(
        "name", F.coalesce(found["n"], F.nullif(F.regexp_extract("name", r"_(\d+)", 1), F.lit(""))).cast("int").alias("n"), found["pw"].cast("int").alias("pw"),
        found["ord_time_s"].cast("double").alias("ord_time_s"), found["dp_time_s"].cast("double").alias("dp_time_s"), found["ham_paths"].cast("decimal(38,0)").alias("ham_paths"),
    )


def best_per_n(profiles: DataFrame) -> DataFrame:
    """Of (n, name, complete, has_e_bag) one row an n: complete first, then with ``e_bag``, then the shorter name."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("complete"), F.desc("has_e_bag"), F.length("name"), "name"))
    return profiles.withColumn("rank", rank).where("rank = 1").drop("rank")


def profile_lines(steps: DataFrame) -> DataFrame:
    """(step, line) in the nine-field form, with the vertices of ``bag`` where the steps have it."""
    bag = F.concat(F.lit("{"), F.array_join("bag", ","), F.lit("}")) if "bag" in steps.columns else F.lit("{}")
    backend = F.coalesce("backend", F.lit("sm")) if "backend" in steps.columns else F.lit("sm")
    cells = ["step", "vertex", "fs", "n_back", F.coalesce("e_bag", F.lit(0)), "states_in", "states_out", F.format_string("%.3f", "step_ms"), F.format_string("%.3f", "cumul_ms")]
    return steps.select("step", F.concat(F.concat_ws(" ", *cells, bag), F.lit(" ["), backend, F.lit("]")).alias("line"))


def write_profile(steps: DataFrame, path: str) -> None:
    profile_lines(steps).orderBy("step").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``ordering(pos, v)`` from comma-separated integers."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", ",")).alias("pos", "v")).select("pos", F.trim("v").cast("int").alias("v"))


def write_orders(orders: dict[str, list[int]], folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for label, order in orders.items():
        with open(os.path.join(folder, f"order_{label}.txt"), "w") as f:
            f.write(",".join(map(str, order)))


def read_model(path: str) -> dict:
    """A model file by name: as given, beside this package, or in the working folder."""
    for folder in ("", os.path.dirname(__file__), os.getcwd()):
        file = os.path.join(folder, path)
        if os.path.isfile(file):
            with open(file) as f:
                return json.load(f)
    raise FileNotFoundError(path)


def write_model(model: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(model, f)


def read_settings(path: str) -> dict[str, str]:
    """``key: value`` lines with ``-`` as ``_`` in keys; later files of a search are the caller's to try."""
    with open(path) as f:
        pairs = [line.split("#")[0].split(":", 1) for line in f]
    return {k.strip().replace("-", "_"): v.strip() for k, v in (p for p in pairs if len(p) == 2)}


def solver_counts(texts: DataFrame) -> DataFrame:
    """(name, status, count) from a model counter's output; an unsatisfiable formula has 0."""
    count = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^c s exact arb int (\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"(?m)^s (?:mc|pmc) (\d+)", 1), F.lit("")))
    status = F.when(F.col("text").rlike(r"(?m)^s UNSATISFIABLE"), "UNSAT").when(F.col("text").rlike(r"(?m)^s SATISFIABLE") | count.isNotNull(), "SAT").otherwise("UNKNOWN")
    return texts.select("name", status.alias("status"), F.when(status == "UNSAT", F.lit("0")).otherwise(count).cast("decimal(38,0)").alias("count"))
