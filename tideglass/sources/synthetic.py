"""Streams with drift, the same for the same seed on any number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.scalar import uniform

#: Parameters of the two generators.
V1 = {"n": 50_000, "dim": 5, "before": 0.0, "after": 3.0, "sigma": 1.0, "anomaly_mean": 8.0, "anomaly_sigma": 2.0, "ratio": 0.05}
V2 = {"n": 100_000, "dim": 5, "before": 0.0, "after": 8.0, "sigma": 1.0, "anomaly_mean": 4.0, "anomaly_sigma": 1.5, "ratio": 0.05}


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number by Box and Muller from two uniforms."""
    u, v = uniform(F.lit(seed), F.lit("u"), *parts), uniform(F.lit(seed), F.lit("v"), *parts)
    return F.sqrt(F.lit(-2.0) * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2.0 * math.pi) * v)


def share_after(kind: str, seq: Column, n: int) -> Column:
    """How far the drift has come at a row, from 0 to 1 (reoccurring: whole, and back, at every three tenths)."""
    if kind == "abrupt":
        return F.when(seq >= n // 2, 1.0).otherwise(0.0)
    lo, hi = {"gradual": (2 * n // 5, 3 * n // 5), "incremental": (n // 5, 4 * n // 5)}.get(kind, (0, 0))
    if hi:
        return F.least(F.greatest((seq - lo) / float(hi - lo), F.lit(0.0)), F.lit(1.0))
    if kind == "reoccurring":
        return (F.least(F.floor(seq / float(3 * n // 10)), F.lit(3)) % 2).cast("double")
    raise ValueError(f"unknown drift {kind!r}")


def stream(spark: SparkSession, kind: str, seed: int = 42, version: int = 2, **over) -> DataFrame:
    """id, f0..., label. Version 1 moves the mean with the drift; in version 2 a gradual drift mixes the two distributions, row by row, in growing
    shares. Values are rounded to 6 decimals."""
    p = {**(V1 if version == 1 else V2), **over}
    rows = spark.range(p["n"]).withColumn("_s", share_after(kind, F.col("id"), p["n"]))
    if kind == "gradual" and version == 2:
        rows = rows.withColumn("_s", F.when(uniform(F.lit(seed), F.lit("mix"), F.col("id")) < F.col("_s"), 1.0).otherwise(0.0))
    label = F.when(uniform(F.lit(seed), F.lit("label"), F.col("id")) < p["ratio"], 1).otherwise(0)
    mean = F.lit(p["before"]) + F.col("_s") * (p["after"] - p["before"])
    rows = rows.withColumns({"label": label, "_m": mean})
    value = lambda d: F.round(F.when(F.col("label") == 1, p["anomaly_mean"] + p["anomaly_sigma"] * normal(seed, F.lit(d), F.col("id"))).otherwise(F.col("_m") + p["sigma"] * normal(seed, F.lit(d), F.col("id"))), 6)
    return rows.select("id", *(value(d).alias(f"f{d}") for d in range(p["dim"])), "label")


def spec(kind: str, n: int) -> list[tuple[str, int, int]]:
    """The drifts of a stream: type, start line, end line."""
    return {"abrupt": [("abrupt", n // 2, n // 2 + 1)], "gradual": [("gradual", 2 * n // 5, 3 * n // 5)], "incremental": [("incremental", n // 5, 4 * n // 5)], "reoccurring": [("reoccurring", k * (3 * n // 10), k * (3 * n // 10) + 1) for k in (1, 2, 3)]}[kind]
