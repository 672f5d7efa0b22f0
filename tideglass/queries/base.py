"""The driver's tables in the forms that the operators read, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(df: DataFrame, column: str = "ts"):
    """Milliseconds since 1970 of a time column, read as UTC if it has no zone."""
    c = F.col(column)
    return F.unix_millis(F.concat(c.cast("string"), F.lit("Z")).cast("timestamp") if dict(df.dtypes)[column] == "timestamp_ntz" else c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_round(c, digits: int = 6):
    """A double rounded as the oracle's SQL does it: times 10^digits, halves of that product away from zero, divided again; what overflows stays as
    it is. Spark's round goes by the shortest decimal form instead, which at halves and in large numbers gives another last digit, and drops the sign of -0."""
    scale = 10.0**digits
    y = F.abs(c) * scale
    below = F.floor(y).cast("double")
    # From 2^52 on doubles are whole.
    r = F.when(y < 2.0**52, F.when(y - below >= 0.5, below + 1.0).otherwise(below)).otherwise(y) / scale
    return F.when(y == float("inf"), c).otherwise(r * F.signum(c))


#: Added to means before they are rounded: values have two decimals, so a mean can lie halfway between two rounded numbers, where the last
#: bit decides.
OFF = 3.1e-8


class Registry:
    """query = registry(name, sql)(function)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


#: Text that is the same expression in both dialects.
_H = "(event_id * 7919) % 10007"
_LABEL = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"
_SCORE = f"floor((CAST({_H} AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.7 AS DOUBLE) + CAST(({_LABEL}) * (CASE WHEN event_id * 10 >= 4 * n AND event_id * 10 < 7 * n THEN 0 ELSE 1 END) AS DOUBLE) * CAST(0.3 AS DOUBLE)) * 1000) / CAST(1000 AS DOUBLE)"
_SCORES = {
    "seq": "event_id",
    "label": _LABEL,
    "score": _SCORE,
    "forest_version": "1 + CAST(floor(event_id * 4 / CAST(n AS DOUBLE)) AS BIGINT)",
    "run": "user_id % 5",
    "p": "CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 6 END",
    "ingestion_time": "CASE WHEN event_id % 50 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1600000000000 + event_id * 3 AS BIGINT) END",
    "score_time": f"CAST(1600000000020 + event_id * 3 + {_H} % 80 + (CASE WHEN user_id % 5 = 3 THEN event_id * 5 % 900 ELSE 0 END) AS BIGINT)",
    "phase": "CASE WHEN event_id * 10 < n THEN 'A' ELSE 'C' END",
}
#: CTE `s`: scored rows made from events; the middle of the stream scores without its labels, so versions differ.
S = "s AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SCORES.items()) + " FROM events, (SELECT count(*) AS n FROM events))"
#: CTE `pt`: events as rows with features.
PT = "pt AS (SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS timestamp, [value, CAST(hour(ts) AS DOUBLE), CAST(user_id AS DOUBLE), CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE)] AS features, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"
#: CTE `fv`: a row per feature of each event.
FV = f"{PT}, fv AS (SELECT CAST(d AS INTEGER) AS feature_id, features[d + 1] AS value, seq FROM pt, range(4) t(d))"
#: CTE `o`: onsets made from events.
O = "o AS (SELECT CAST((event_id * 31) % 97 % 5 AS INTEGER) AS feature_id, event_id AS seq, event_id + 40 AS emit_seq FROM events WHERE (event_id * 31) % 97 < 3)"
#: CTE `dr`: drifts at 3, 5 and 8 tenths of the events.
DR = "dr AS (SELECT CAST(k AS INTEGER) AS drift_idx, CAST(floor(n * t / CAST(10 AS DOUBLE)) AS BIGINT) AS drift_point FROM (SELECT count(*) AS n FROM events), (VALUES (0, 3), (1, 5), (2, 8)) v(k, t))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    return e.crossJoin(n).select(*(F.expr(x).alias(c) for c, x in _SCORES.items()))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), millis(e).alias("timestamp"), F.array(F.col("value"), F.hour("ts").cast("double"), F.col("user_id").cast("double"), k).alias("features"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.operators.routing import split_features

    return split_features(points(spark, sf_dir))


def shifted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values with a shift of the first feature, and half of it in the third, from the middle of the stream."""
    v = values(spark, sf_dir)
    n = F.broadcast(table(spark, sf_dir, "events").agg(F.count("*").alias("_n")))
    by = F.when(F.col("feature_id") == 0, 400.0).when(F.col("feature_id") == 2, 200.0).otherwise(0.0)
    return v.crossJoin(n).select("feature_id", (F.col("value") + F.when(F.col("seq") * 2 >= F.col("_n"), by).otherwise(0.0)).alias("value"), "seq")


#: CTE `sv`: the same shift.
SV = f"{FV}, sv AS (SELECT feature_id, value + CASE WHEN seq * 2 >= n THEN CASE feature_id WHEN 0 THEN CAST(400 AS DOUBLE) WHEN 2 THEN CAST(200 AS DOUBLE) ELSE 0 END ELSE 0 END AS value, seq FROM fv, (SELECT count(*) AS n FROM events))"


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("(event_id * 31) % 97 < 3")
    return e.select(F.expr("CAST((event_id * 31) % 97 % 5 AS INT)").alias("feature_id"), F.col("event_id").alias("seq"), (F.col("event_id") + 40).alias("emit_seq"))


def drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    marks = spark.createDataFrame([(0, 3), (1, 5), (2, 8)], "drift_idx int, t int")
    return marks.crossJoin(n).select("drift_idx", F.floor(F.col("n") * F.col("t") / 10.0).cast("long").alias("drift_point"))
