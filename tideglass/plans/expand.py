"""Experiment plans as tables of runs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with(df: DataFrame, name: str, values: list, kind: str = "string") -> DataFrame:
    """df with every value: an explode of literals, so a plan of any size is made from one row."""
    return df.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))


def exp_id(extra: str = "extra"):
    tail = F.when(F.col(extra) != "", F.concat(F.lit("_"), F.translate(extra, ";=", "_-"))).otherwise(F.lit(""))
    return F.concat(F.col("dataset"), F.lit("_"), F.col("config"), F.lit("_"), F.col("algo"), F.lit("_p"), F.col("parallelism").cast("string"), F.lit("_r"), F.col("run").cast("string"), tail)


def expand_plan(spark: SparkSession, plan: dict) -> DataFrame:
    """plan: datasets, configs, algos, parallelism, repeats, and either `sensitivity` ({parameter: values}: one parameter at a time) or
    `configurations` (a list of parameter dicts). Rows: dataset, config, algo, parallelism, run, extra, exp_id."""
    if "sensitivity" in plan:
        extras = [f"{k}={v}" for k, vs in plan["sensitivity"].items() for v in vs]
    elif "configurations" in plan:
        extras = [";".join(f"{k}={v}" for k, v in c.items()) for c in plan["configurations"]]
    else:
        extras = [""]
    rows = spark.range(1).select()
    for name, values, kind in (("dataset", plan["datasets"], "string"), ("config", plan["configs"], "string"), ("algo", plan["algos"], "string"), ("parallelism", plan["parallelism"], "int"), ("run", list(range(1, plan["repeats"] + 1)), "int"), ("extra", extras, "string")):
        rows = _with(rows, name, values, kind)
    return rows.withColumn("exp_id", exp_id())


def run_batch(ids: list[str], run: Callable[[str], int], result_path: Callable[[str], str], log: Callable[[str], None] = print) -> dict[str, int]:
    """Runs what has no result yet. Codes: 0 done, 1 failed, 2 incomplete, 3 skipped."""
    out = {}
    for i in ids:
        if os.path.exists(result_path(i)):
            out[i] = 3
        else:
            try:
                out[i] = run(i)
            except Exception as e:
                log(f"{i}: {e}")
                out[i] = 1
        log(f"{i}: {out[i]}")
    return out


def incomplete(runs: DataFrame, results: DataFrame) -> DataFrame:
    """runs: exp_id, n_samples; results: exp_id, one row per score. exp_id, n, state of runs that are missing, or have too few rows."""
    n = results.groupBy("exp_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("n_samples"), "short")
    return runs.join(n, "exp_id", "left").select("exp_id", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state")).filter("state is not null")
