"""Sinks: JSON messages, dumps, reports, run gates, folder resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideglass.schemas import to_wire


def write_messages(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON text per line; a batch's files appear together or not at all."""
    to_wire(df).write.mode(mode).text(path)


def stream_messages(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_wire(df).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dump(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Writes all that a stream has now and ends."""
    q = stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def print_tap(stream: DataFrame, rows: int = 20) -> StreamingQuery:
    return stream.writeStream.format("console").option("numRows", rows).start()


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file: csv with a header, json, or markdown."""
    if kind == "markdown":
        rows = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in df.collect())]
        df.sparkSession.createDataFrame([(k, f"| {r} |") for k, r in enumerate(rows)], "k int, value string").orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)
    elif kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def with_summary(runs: DataFrame, metric: str, key: str = "run") -> DataFrame:
    """The rows of a report and, last, its summary: row_type (run or SUMMARY), key, metric (the mean), std."""
    rows = runs.select(F.lit("run").alias("row_type"), F.col(key).cast("string").alias("key"), F.col(metric).alias("metric"), F.lit(None).cast("double").alias("std"))
    return rows.unionByName(runs.agg(F.lit("SUMMARY").alias("row_type"), F.lit("").alias("key"), F.avg(metric).alias("metric"), F.stddev_samp(metric).alias("std")))


def reset(spark: SparkSession, *paths: str) -> None:
    """Deletes checkpoint and output folders before a new run."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def complete(counts: list[int], expected: int, polls: int = 12) -> bool:
    """Whether a run may end: the last count reaches what is expected, or the last `polls` counts are equal."""
    return bool(counts) and (counts[-1] >= expected or (len(counts) >= polls and len(set(counts[-polls:])) == 1))


def gate(polls: DataFrame, expected: int, still: int = 12) -> DataFrame:
    """polls: poll, n -> the first poll at which the run is complete, and why."""
    from pyspark.sql import Window

    w = Window.orderBy("poll").rowsBetween(-(still - 1), 0)
    p = polls.withColumns({"_lo": F.min("n").over(w), "_hi": F.max("n").over(w), "_c": F.count("*").over(w)})
    why = F.when(F.col("n") >= expected, "reached").when((F.col("_c") == still) & (F.col("_lo") == F.col("_hi")), "unchanged")
    return p.withColumn("reason", why).filter("reason is not null").agg(F.min("poll").alias("poll"), F.min_by("reason", "poll").alias("reason"))
