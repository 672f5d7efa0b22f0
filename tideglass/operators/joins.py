"""Interval, as-of and baseline joins. Their small sides are events (drifts, onsets, versions), not data.

Points meet intervals by equal buckets of the line, so joins have an equal key; an interval is copied for each bucket that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: Column, high: Column, buckets: int = 1024) -> DataFrame:
    """All columns of both, for every point (a whole number) in [low, high] of an interval. The span of all intervals is cut into `buckets` parts."""
    within = intervals.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low <= _high")
    start, end = within.agg(F.min("_low"), F.max("_high")).first()
    width = 1 if start is None else (end - start) // buckets + 1
    bucket = lambda c: F.floor((F.col(c) - F.lit(start or 0)) / width)
    placed = within.withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("_high"))))
    return points.withColumn("_bucket", bucket(point)).join(_small(placed), "_bucket").filter(F.col(point).between(F.col("_low"), F.col("_high"))).drop("_bucket", "_low", "_high")


def as_of_version(rows: DataFrame, versions: DataFrame, on: str = "seq", swap: str = "swap_seq", version: str = "version") -> DataFrame:
    """rows with the largest version whose swap_seq is at most the row's seq (null: none yet). Versions turn into disjoint ranges, so a row
    meets at most one; ranges have bounds that are as few as versions, and meet rows by the bucket of their seq."""
    best = versions.groupBy(swap).agg(F.max(version).alias(version))
    best = best.withColumn("_top", F.max(version).over(Window.orderBy(swap).rowsBetween(Window.unboundedPreceding, 0)))
    last = best.agg(F.max_by(F.struct(F.col(swap).alias("s"), F.col("_top").alias("v")), swap)).first()[0]
    spans = best.select(F.col(swap).alias("_from"), (F.lead(swap).over(Window.orderBy(swap)) - 1).alias("_to"), F.col("_top").alias("_version")).filter("_to IS NOT NULL")
    kind = dict(versions.dtypes)[version]
    if last is None:
        return rows.withColumn(version, F.lit(None).cast(kind))
    # A row before the last swap has one bucket, and a bucket the few spans that touch it.
    start = spans.agg(F.min("_from")).first()[0]
    if start is None:
        return rows.withColumn(version, F.when(F.col(on) >= last["s"], F.lit(last["v"])).cast(kind))
    width = (last["s"] - start) // 1024 + 1
    bucket = lambda c: F.floor((F.col(c) - F.lit(start)) / width)
    touched = spans.withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to")))).groupBy("_bucket").agg(F.collect_list(F.struct("_from", "_to", "_version")).alias("_spans"))
    found = F.get(F.filter("_spans", lambda x: (x["_from"] <= F.col(on)) & (F.col(on) <= x["_to"])), F.lit(0))["_version"]
    joined = rows.withColumn("_bucket", bucket(on)).join(_small(touched), "_bucket", "left")
    return joined.withColumn(version, F.when(F.col(on) >= last["s"], F.lit(last["v"])).otherwise(found).cast(kind)).drop("_bucket", "_spans")


def interval_hits(drifts: DataFrame, onsets: DataFrame, before: Column | int, after: Column | int) -> DataFrame:
    """drift columns and onset for every onset in [start - before, end + after]."""
    return interval_join(onsets.select(F.col("seq").alias("onset")), drifts, "onset", F.col("start") - before, F.col("end") + after).select(*drifts.columns, "onset")


def first_hits(drifts: DataFrame, onsets: DataFrame, tau: int) -> DataFrame:
    """Each drift with its first onset in [start - tau, end + tau] and the latency; null where there is none."""
    h = interval_hits(drifts, onsets, tau, tau).groupBy("drift_idx").agg(F.min("onset").alias("onset"))
    return drifts.join(h, "drift_idx", "left").withColumn("latency", F.col("onset") - F.col("start"))


def label_report(drifts: DataFrame, onsets: DataFrame, tau: int) -> DataFrame:
    """One row: recall, precision, median_latency, n_onsets, n_false."""
    first = first_hits(drifts, onsets, tau).agg(F.avg(F.when(F.col("onset").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.median("latency").alias("median_latency"))
    good = interval_hits(drifts, onsets, tau, tau).agg(F.count_distinct("onset").alias("_good"))
    n = onsets.agg(F.count_distinct("seq").alias("n_onsets"))
    return first.crossJoin(good).crossJoin(n).select("recall", (F.col("_good") / F.nullif(F.col("n_onsets").cast("double"), F.lit(0.0))).alias("precision"), "median_latency", "n_onsets", (F.col("n_onsets") - F.col("_good")).alias("n_false"))


def committed_near(drifts: DataFrame, commits: DataFrame, window: int) -> DataFrame:
    """drift_idx, start, hit: whether a commit lies in [start - window, start + 2 * window]."""
    near = interval_hits(drifts.withColumn("end", F.col("start")), commits, window, 2 * window).select("drift_idx").distinct().withColumn("hit", F.lit(True))
    return drifts.select("drift_idx", "start").join(near, "drift_idx", "left").select("drift_idx", "start", F.coalesce("hit", F.lit(False)).alias("hit"))


def missed_segments(segments: DataFrame, onsets: DataFrame, tau: int) -> DataFrame:
    """Segments without an onset in [seg_start - tau, seg_end + tau]."""
    hit = interval_join(onsets.select(F.col("seq").alias("_o")), segments.select("seg_start", "seg_end"), "_o", F.col("seg_start") - tau, F.col("seg_end") + tau)
    return segments.join(hit.select("seg_start", "seg_end").distinct(), ["seg_start", "seg_end"], "left_anti")


def features_near(onsets: DataFrame, anchor: int, window: int) -> DataFrame:
    """Features with an onset within `window` of the anchor."""
    return onsets.filter(F.col("seq").between(anchor - window, anchor + window)).select("feature_id").distinct()


def fires_after(events: DataFrame, fires: DataFrame, span: int) -> DataFrame:
    """event, feature_id, fire for fires in [event, event + span)."""
    return interval_join(fires, events, "fire", F.col("event"), F.col("event") + span - 1).select(*events.columns, *fires.columns)


def previous_row(points: DataFrame, rows: DataFrame) -> DataFrame:
    """points: point. new_line of the last row of (orig_line, new_line) with orig_line <= point; 1 where there is none."""
    # Rows between two neighbouring points count for the later one; what each point sees is the largest so far, over one row a point.
    least = points.agg(F.min("point")).first()[0]
    if least is None:
        return points.select("point", F.lit(1).cast("long").alias("new_line"))
    own = points.select("point").distinct().withColumn("_from", F.lag("point").over(Window.orderBy("point")) + 1)
    hit = interval_join(rows.select("orig_line", "new_line"), own.filter("_from IS NOT NULL"), "orig_line", F.col("_from"), F.col("point")).groupBy("point").agg(F.max("new_line").alias("_l"))
    head = rows.filter(F.col("orig_line") <= least).agg(F.max("new_line").alias("_l")).select(F.lit(least).alias("point"), "_l")
    so_far = own.select("point").join(hit.unionByName(head), "point", "left").withColumn("_l", F.max("_l").over(Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)))
    return points.join(so_far, "point", "left").select("point", F.coalesce("_l", F.lit(1).cast("long")).alias("new_line"))


def against_baseline(runs: DataFrame, key: list[str], p: str, metric: str) -> DataFrame:
    """runs with the metric's mean at p = 1 for the same key, and the difference from it."""
    base = runs.filter(F.col(p) == 1).groupBy(*key).agg(F.avg(metric).alias("base"))
    return runs.join(_small(base), key).withColumn("delta", F.col(metric) - F.col("base"))


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(_small(table), key, "left")
