"""Evaluation of scored rows: ROC AUC with tied ranks, rates at thresholds, thresholds, segments, windows, delays.

Rows are counted by distinct score first; what has to be accumulated over scores is accumulated over ranges of scores of about as many rows and then
inside each range, so no task sees all rows. Every function takes the columns to group by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.running import value_ranges

RANGES = 1024


def score_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg (rows with this score), n_pos, n_neg (of the group), neg_below and pos_below (rows with lower scores)."""
    is_pos = F.col("label") == 1
    counts = df.groupBy(*by, "score").agg(F.sum(F.when(is_pos, 1).otherwise(0)).alias("pos"), F.sum(F.when(is_pos, 0).otherwise(1)).alias("neg"))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    rows = value_ranges(counts.join(totals, by) if by else counts.crossJoin(totals), by, "score", RANGES)
    keys = [*by, "_range"]
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).select(*keys, F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_pb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"))
    inside = Window.partitionBy(*keys).orderBy("score")
    return rows.join(below, keys).withColumns({"pos_below": F.col("_pb") + F.sum("pos").over(inside) - F.col("pos"), "neg_below": F.col("_nb") + F.sum("neg").over(inside) - F.col("neg")}).drop("_range", "_pb", "_nb")


def roc_auc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, n, auc: the share of (positive, negative) pairs in the right order, ties half; null with a class missing or under two rows."""
    by = list(by)
    c = score_counts(df, by)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.first("n_pos").cast("double") * F.first("n_neg")
    return c.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.when(pairs > 0, wins / pairs).alias("auc"))


def confusion(df: DataFrame, t: float | Column, by: list[str] = ()) -> DataFrame:
    """by, n, tp, fp, fn, tn, fpr, fnr, precision, recall with score >= t called positive; null over an empty denominator."""
    hot, pos = F.col("score") >= (F.lit(t) if isinstance(t, float) else t), F.col("label") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.groupBy(*by).agg(F.count("*").alias("n"), count(hot & pos).alias("tp"), count(hot & ~pos).alias("fp"), count(~hot & pos).alias("fn"), count(~hot & ~pos).alias("tn"))
    share = lambda a, b: F.col(a) / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))
    return c.withColumns({"fpr": share("fp", "tn"), "fnr": share("fn", "tp"), "precision": share("tp", "fp"), "recall": share("tp", "fn")})


def threshold_at_fpr(df: DataFrame, target: float, by: list[str] = ()) -> DataFrame:
    """by, threshold, fpr, fnr: going up the distinct scores to the first whose rate is at most `target`, the one that is nearest to it,
    the first of equals. Groups with one class are left out."""
    by = list(by)
    c = score_counts(df, by).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    c = c.withColumns({"fpr": (F.col("n_neg") - F.col("neg_below")) / F.col("n_neg").cast("double"), "fnr": F.col("pos_below") / F.col("n_pos").cast("double")})
    first = c.groupBy(*by).agg(F.min(F.when(F.col("fpr") <= target, F.col("score"))).alias("_first"))
    near = (c.join(first, by) if by else c.crossJoin(first)).filter(F.col("_first").isNull() | (F.col("score") <= F.col("_first")))
    best = F.min_by(F.struct("score", "fpr", "fnr"), F.struct(F.abs(F.col("fpr") - target), "score"))
    return near.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.score").alias("threshold"), "b.fpr", "b.fnr")


def youden(df: DataFrame, by: list[str] = (), points: int = 100) -> DataFrame:
    """by, threshold, fpr: of `points` equally spaced thresholds from the least to the largest score, the first with the largest
    recall - fpr. Each row is counted between two neighbouring thresholds, so the grid is never joined with rows."""
    by = list(by)
    is_pos = F.col("label") == 1
    span = df.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum(F.when(is_pos, 1).otherwise(0)).alias("_p"), F.sum(F.when(is_pos, 0).otherwise(1)).alias("_n")).filter("_p > 0 and _n > 0")
    at = lambda k: F.when(k == points - 1, F.col("_hi")).otherwise(F.col("_lo") + k * ((F.col("_hi") - F.col("_lo")) / float(points - 1)))
    # The number of thresholds that are at most the score: a guess, put right by one where rounding decides.
    guess = F.coalesce(F.floor((F.col("score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (points - 1)), F.lit(points - 1)).cast("int")
    joined = (df.join(F.broadcast(span), by) if by else df.crossJoin(F.broadcast(span))).withColumn("_g", guess)
    fixed = F.when(at(F.col("_g")) > F.col("score"), F.col("_g") - 1).when((F.col("_g") < points - 1) & (at(F.col("_g") + 1) <= F.col("score")), F.col("_g") + 1).otherwise(F.col("_g"))
    counts = joined.groupBy(*by, fixed.alias("_k")).agg(F.sum(F.when(is_pos, 1).otherwise(0)).alias("_pk"), F.sum(F.when(is_pos, 0).otherwise(1)).alias("_nk"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k")).join(counts, [*by, "_k"], "left")
    up = Window.partitionBy(*by).orderBy(F.desc("_k"))
    rates = grid.withColumns({"threshold": at(F.col("_k")), "fpr": F.sum(F.coalesce("_nk", F.lit(0))).over(up) / F.col("_n").cast("double"), "_tpr": F.sum(F.coalesce("_pk", F.lit(0))).over(up) / F.col("_p").cast("double")})
    return rates.groupBy(*by).agg(F.max_by(F.struct("threshold", "fpr"), F.struct(F.col("_tpr") - F.col("fpr"), -F.col("_k"))).alias("b")).select(*by, "b.threshold", "b.fpr")


def per_version(df: DataFrame, by: list[str] = (), t: float = 0.5) -> DataFrame:
    keys = [*by, "forest_version"]
    return confusion(df, t, keys).select(*keys, "n", "fpr", "fnr", "precision", "recall").join(roc_auc(df, keys).drop("n"), keys)


def segments(df: DataFrame, drift: int) -> DataFrame:
    """df with segment: pre_v1, post_v1 (first version before and from the drift), post_final (last version after it); other rows go. A
    row of a single version that is both first and last counts in both post segments."""
    last = F.broadcast(df.agg(F.max("forest_version").alias("_last")))
    post = F.col("seq") >= drift
    names = F.array_compact(F.array(F.when(~post & (F.col("forest_version") == 1), "pre_v1"), F.when(post & (F.col("forest_version") == 1), "post_v1"), F.when(post & (F.col("forest_version") == F.col("_last")), "post_final")))
    return df.crossJoin(last).select("*", F.explode(names).alias("segment")).drop("_last")


def segment_report(df: DataFrame, drift: int, t: float = 0.5) -> DataFrame:
    s = segments(df, drift)
    by = ["segment"]
    best = youden(s, by).select("segment", F.col("threshold").alias("best_threshold"), F.col("fpr").alias("best_fpr"))
    return confusion(s, t, by).select("segment", "n", "fpr", "fnr").join(roc_auc(s, by).drop("n"), by).join(best, by, "left")


def windows(df: DataFrame, size: int, step: int, first: int = 0, until: Column | None = None, least: int = 100, by: list[str] = ()) -> DataFrame:
    """df with win_start for every window [win_start, win_start + size) that holds the row; starts are first, first + step, ..., below
    `until` (null: the number of rows less size). Windows of fewer than `least` rows are dropped by window_metrics()."""
    rel = F.col("seq") - first
    lo = F.greatest(F.lit(0), F.floor((rel - size) / step) + 1)
    starts = F.when(rel >= 0, F.sequence(lo, F.floor(rel / step)))
    rows = df.select("*", F.explode(starts).alias("_k")).withColumn("win_start", (F.col("_k") * step + first).cast("long")).drop("_k")
    return rows.filter(F.col("win_start") < until) if until is not None else rows


def window_metrics(rows: DataFrame, t: float = 0.5, least: int = 100, by: list[str] = ()) -> DataFrame:
    """by, win_start, n, auc, fpr of windows of at least `least` rows. A window's rows are bounded by its size, so each is ranked in one place, by
    one exchange: AUC from the positives' mean ranks, ties sharing theirs."""
    keys = [*by, "win_start"]
    pos, hot = F.col("label") == 1, F.col("score") >= t
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("score")) + (F.count("*").over(Window.partitionBy(*keys, "score")) - 1) / 2.0
    sums = rows.select(*keys, "label", "score").withColumn("_rank", rank).groupBy(*keys).agg(F.count("*").alias("n"), count(pos).alias("_p"), F.sum(F.when(pos, F.col("_rank")).otherwise(0.0)).alias("_ranks"), count(hot & (F.col("label") == 0)).alias("_fp"), count(F.col("label") == 0).alias("_neg"))
    p = F.col("_p").cast("double")
    pairs = p * (F.col("n") - F.col("_p"))
    return sums.filter(F.col("n") >= least).select(*keys, "n", (F.col("_fp") / F.nullif(F.col("_neg").cast("double"), F.lit(0.0))).alias("fpr"), F.when(pairs > 0, (F.col("_ranks") - p * (p + 1) / 2.0) / pairs).alias("auc"))


def sliding_report(df: DataFrame, size: int = 2000, t: float = 0.5) -> DataFrame:
    """win_start, win_center, n, auc, fpr every size / 4 rows."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    rows = windows(df.crossJoin(n), size, size // 4, until=F.col("_n") - size).drop("_n")
    return window_metrics(rows, t).select("win_start", (F.col("win_start") + size // 2).alias("win_center"), "n", "auc", "fpr")


def drift_delays(df: DataFrame, drifts: DataFrame, t: float = 0.5, size: int = 1000, step: int = 100) -> DataFrame:
    """drifts: drift_idx, drift_point. For each drift, up to the next one (or the number of rows):

    new_version_delay: rows to the first version above any before the drift; recovery_delay: to the first window whose AUC is at least 95 % of
    the baseline's (version 1 before the first drift); stable_delay: to the first window with a false-positive rate of at most 0.1;
    peak_fpr: the largest rate of the windows up to and including it. Windows are `size` rows, every `step`, of at least 100 rows. A
    recovery at sequence number 0 counts as none. Drift points ascend with drift_idx. Rows find their drift in an array of all drifts, which
    are as few as a stream's changes; what follows holds a row for each version or window.
    """
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    spans = drifts.crossJoin(n).withColumn("upper", F.coalesce(F.lead("drift_point").over(Window.orderBy("drift_idx")), F.col("_n"))).drop("_n")
    first = F.broadcast(drifts.agg(F.min_by("drift_point", "drift_idx").alias("_first")))
    base_rows = df.crossJoin(first).filter((F.col("forest_version") == 1) & (F.col("seq") < F.col("_first")))
    base = F.broadcast(roc_auc(base_rows).select(F.col("auc").alias("baseline_auc")).crossJoin(confusion(base_rows, t).select(F.col("fpr").alias("_base_fpr"))))
    every = F.broadcast(spans.agg(F.array_sort(F.collect_list(F.struct("drift_point", "drift_idx", "upper"))).alias("_spans")))
    placed = df.crossJoin(every).withColumn("_span", F.try_element_at(F.filter("_spans", lambda x: x["drift_point"] <= F.col("seq")), F.lit(-1))).drop("_spans")
    placed = placed.select("seq", "label", "score", "forest_version", F.when(F.col("_span.upper") > F.col("seq"), F.col("_span.drift_idx")).alias("drift_idx"), F.col("_span.drift_point").alias("drift_point"), F.col("_span.upper").alias("upper"))
    # The least sequence number of each version in each span, and before the first (or past the last, which no drift counts).
    firsts = placed.groupBy(F.coalesce("drift_point", F.lit(-1)).alias("_at"), "drift_idx", "forest_version").agg(F.min("seq").alias("_seq"))
    before = spans.join(firsts.select("_at", "forest_version").distinct(), F.col("_at") < F.col("drift_point"), "left").groupBy("drift_idx").agg(F.coalesce(F.max("forest_version"), F.lit(1)).alias("_before"))
    newer = firsts.join(before, "drift_idx").filter(F.col("forest_version") > F.col("_before")).groupBy("drift_idx").agg(F.min("_seq").alias("_new"))
    inside = placed.filter(F.col("drift_idx").isNotNull())
    rel = F.col("seq") - F.col("drift_point")
    starts = F.sequence(F.greatest(F.lit(0), F.floor((rel - size) / step) + 1), F.floor(rel / step))
    rows = inside.select("drift_idx", "drift_point", "upper", "label", "score", F.explode(starts).alias("_k")).withColumn("win_start", F.col("drift_point") + F.col("_k") * step).filter(F.col("win_start") < F.col("upper") - size)
    found = window_metrics(rows, t, by=["drift_idx"]).crossJoin(base)
    hit = found.groupBy("drift_idx").agg(F.min(F.when((F.col("auc") > 0) & (F.col("auc") >= F.col("baseline_auc") * 0.95), F.col("win_start"))).alias("_rec"), F.min(F.when((F.col("fpr") <= 0.1) & F.col("_base_fpr").isNotNull(), F.col("win_start"))).alias("_stable"))
    peak = found.join(hit.select("drift_idx", "_stable"), "drift_idx").filter(F.col("_stable").isNull() | (F.col("win_start") <= F.col("_stable"))).groupBy("drift_idx").agg(F.max("fpr").alias("peak_fpr"))
    delay = lambda c: F.when(F.col(c) != 0, F.col(c) - F.col("drift_point"))
    out = spans.join(newer, "drift_idx", "left").join(hit, "drift_idx", "left").join(peak, "drift_idx", "left").crossJoin(base)
    return out.select("drift_idx", "drift_point", "upper", (F.col("_new") - F.col("drift_point")).alias("new_version_delay"), delay("_rec").alias("recovery_delay"), delay("_stable").alias("stable_delay"), F.coalesce("peak_fpr", F.lit(0.0)).alias("peak_fpr"), "baseline_auc")


def headline(df: DataFrame, drifts: DataFrame) -> DataFrame:
    """One row: n_retrains, post_v1_auc, post_final_auc, delta_post_auc, recovery_latency (of the first drift), recovered."""
    drift = drifts.agg(F.min_by("drift_point", "drift_idx")).first()[0]
    s = roc_auc(segments(df, drift), ["segment"])
    auc = lambda name: F.max(F.when(F.col("segment") == name, F.col("auc")))
    row = s.agg(auc("post_v1").alias("post_v1_auc"), auc("post_final").alias("post_final_auc"))
    first = drift_delays(df, drifts).orderBy("drift_idx").limit(1).select(F.col("recovery_delay").alias("recovery_latency"))
    versions = df.agg((F.max("forest_version") - 1).alias("n_retrains"))
    return versions.crossJoin(row).crossJoin(first).withColumns({"delta_post_auc": F.col("post_final_auc") - F.col("post_v1_auc"), "recovered": F.col("recovery_latency").isNotNull()})


def degradation(windows_: DataFrame, pre_end: int, delta: float, sustained: int) -> DataFrame:
    """windows_: center, auc (null: undefined). One row: baseline (mean auc of centers before pre_end) and onset (the first center after it
    from which `sustained` windows in a row are below baseline - delta). One row per window, not per data row."""
    base = windows_.agg(F.avg(F.when(F.col("center") < pre_end, F.col("auc"))).alias("baseline"))
    low = windows_.crossJoin(base).withColumn("_low", F.when((F.col("auc") < F.col("baseline") - delta) & (F.col("center") > pre_end), 1).otherwise(0))
    w = Window.orderBy("center").rowsBetween(0, sustained - 1)
    runs = low.withColumn("_run", F.sum("_low").over(w))
    return runs.agg(F.first("baseline").alias("baseline"), F.min(F.when(F.col("_run") >= sustained, F.col("center"))).alias("onset"))


def degradation_segments(windows_: DataFrame, baseline: Column, delta: float) -> DataFrame:
    """seg_start, seg_end: maximal runs of windows below baseline - delta."""
    w = Window.orderBy("center")
    low = windows_.withColumn("_low", F.coalesce(F.col("auc") < baseline - delta, F.lit(False))).withColumn("_island", F.row_number().over(w) - F.sum(F.when(F.col("_low"), 1).otherwise(0)).over(w))
    return low.filter("_low").groupBy("_island").agg(F.min("center").alias("seg_start"), F.max("center").alias("seg_end")).drop("_island")


# ---- latency, throughput, scalability ----------------------------------------------------------------------------------


def latency_ok(limit: int = 60000) -> Column:
    lat = F.col("score_time") - F.col("ingestion_time")
    return (lat >= 0) & (lat < limit)


def stamps_ok() -> Column:
    """Both stamps are times of this century and within ten minutes of each other; drained rows carry 0."""
    return (F.col("ingestion_time") >= 1577000000000) & (F.col("score_time") >= F.col("ingestion_time")) & (F.col("score_time") - F.col("ingestion_time") <= 600000)


def latency_stats(df: DataFrame, by: list[str] = ()) -> DataFrame:
    rows = df.filter(latency_ok()).withColumn("_lat", (F.col("score_time") - F.col("ingestion_time")).cast("double"))
    q = F.percentile("_lat", [0.5, 0.95, 0.99, 0.999])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_lat").alias("mean"), q.alias("_q"), F.max("_lat").alias("max")).select(*by, "n", "mean", *(F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("p50", "p95", "p99", "p999"))), "max")


def dirty_share(df: DataFrame, by: list[str], limit: float = 0.01) -> DataFrame:
    share = F.avg(F.when(stamps_ok(), 0.0).otherwise(1.0))
    return df.groupBy(*by).agg(share.alias("dirty_share"), (share > limit).alias("flagged"))


def throughput(df: DataFrame) -> DataFrame:
    """df: ts, subtask, value (rates). Rates above 0 are summed over subtasks for each time, then summarised."""
    sums = df.filter(F.col("value") > 0).groupBy("ts").agg(F.sum("value").alias("v"))
    return sums.agg(F.avg("v").alias("avg"), F.median("v").alias("median"), F.percentile("v", 0.95).alias("p95"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("ts") - F.min("ts")).alias("duration"))


def records_per_second(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") / F.nullif((F.max("score_time") - F.min("score_time")) / 1000.0, F.lit(0.0))).alias("rps"))


def scalability(runs: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """runs: key, p, metrics -> their means for each p, and each one's quotient by its mean at p = 1."""
    means = runs.groupBy(*key, "p").agg(*(F.avg(m).alias(m) for m in metrics))
    base = means.filter("p = 1").select(*key, *(F.col(m).alias(f"_{m}") for m in metrics))
    return means.join(base, key, "left").select(*key, "p", *metrics, *((F.col(m) / F.col(f"_{m}")).alias(f"{m}_speedup") for m in metrics))


def backlog(df: DataFrame, by: list[str], ratio: float = 2.0, start: float = 50.0) -> DataFrame:
    """Median latency of the second half of rows (by ingestion) against the first half's: backlogged if over `ratio` times, or if the first is
    0 and the second over `start`. The halves are told apart by counts of ingestion times, ties by sequence number."""
    good = df.filter(stamps_ok()).withColumn("_lat", (F.col("score_time") - F.col("ingestion_time")).cast("double"))
    half = Window.partitionBy(*by).orderBy("ingestion_time", "seq")
    n = good.groupBy(*by).agg(F.count("*").alias("_n"))
    marked = good.withColumn("_k", F.row_number().over(half)).join(F.broadcast(n), by)
    first = F.col("_k") <= F.expr("_n div 2")
    m = marked.groupBy(*by).agg(F.median(F.when(first, F.col("_lat"))).alias("first_half"), F.median(F.when(~first, F.col("_lat"))).alias("second_half"))
    return m.withColumn("backlogged", F.when(F.col("first_half") > 0, F.col("second_half") / F.col("first_half") > ratio).otherwise(F.col("second_half") > start))


# ---- many runs -------------------------------------------------------------------------------------------------------------


def run_summary(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.median(metric).alias("median"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def false_retrains(df: DataFrame, by: list[str]) -> DataFrame:
    """Of runs without drift: versions after the first, for each run and per 100,000 rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.count_distinct("forest_version") - 1).alias("false_retrains")).withColumn("per_100k", F.col("false_retrains") * 100000.0 / F.col("n"))


def round_summary(rounds: DataFrame, by: list[str], order: str, k: int = 2) -> DataFrame:
    """rounds: round_id, status, votes_yes, in the order of `order`. The last final status of each round counts: committed, aborted, and the
    share of rounds with fewer than k votes."""
    final = rounds.filter(F.col("status").isin("COMMITTED", "ABORTED")).groupBy(*by, "round_id").agg(F.max_by(F.struct("status", "votes_yes"), order).alias("r"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return final.groupBy(*by).agg(F.count("*").alias("rounds"), count(F.col("r.status") == "COMMITTED").alias("committed"), count(F.col("r.status") == "ABORTED").alias("aborted"), F.avg(F.when(F.col("r.votes_yes") < k, 1.0).otherwise(0.0)).alias("sub_quorum"))


def retrain_deltas(df: DataFrame, by: list[str]) -> DataFrame:
    """AUC of each version and of the next one of the same run: by, version, auc, next_auc, delta."""
    auc = roc_auc(df, [*by, "forest_version"])
    nxt = F.lead("auc").over(Window.partitionBy(*by).orderBy("forest_version"))
    return auc.withColumn("next_auc", nxt).filter(F.col("next_auc").isNotNull() & F.col("auc").isNotNull()).select(*by, "forest_version", "auc", "next_auc", (F.col("next_auc") - F.col("auc")).alias("delta"))


def retrain_summary(deltas: DataFrame, floor: float = -0.005) -> DataFrame:
    return deltas.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("std"), F.avg(F.when(F.col("delta") >= floor, 1.0).otherwise(0.0)).alias("share_kept"), F.avg("auc").alias("pre"), F.avg("next_auc").alias("post"))


# ---- data audits -----------------------------------------------------------------------------------------------------------


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """label, n, ratio, rank (1: most frequent; ties by label). One row per class reaches the window."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return c.withColumns({"ratio": F.col("n") / F.sum("n").over(Window.partitionBy()), "rank": F.row_number().over(Window.orderBy(F.desc("n"), "label"))})


def relabel(df: DataFrame, label: str, normal: int = 2) -> DataFrame:
    """Rows of the `normal` most frequent classes with label 0 and of the rarest with label 1; others go."""
    f = class_frequency(df, label)
    last = f.agg(F.max("rank").alias("_last"))
    map_ = f.crossJoin(last).select(F.col("label").alias("_l"), F.when(F.col("rank") <= normal, 0).when(F.col("rank") == F.col("_last"), 1).alias("new_label")).filter("new_label is not null")
    return df.join(F.broadcast(map_), df[label] == F.col("_l")).drop("_l")


def feature_audit(values: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """feature_id, value -> min, max, mean, population std, near_constant, scale_ratio (largest absolute value to the median one over all
    features), and with signals (feature_id, signal) the saturation rate; flags joined by |."""
    a = values.groupBy("feature_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    a = a.withColumns({"near_constant": F.col("std") < 1e-6, "_size": F.greatest(F.abs("min"), F.abs("max"))})
    a = a.crossJoin(F.broadcast(a.agg(F.median("_size").alias("_mid")))).withColumn("scale_ratio", F.col("_size") / F.nullif(F.col("_mid"), F.lit(0.0))).drop("_size", "_mid")
    if signals is not None:
        a = a.join(signals.groupBy("feature_id").agg(F.avg(F.when(F.col("signal") >= 1.0, 1.0).otherwise(0.0)).alias("saturation")), "feature_id", "left")
    else:
        a = a.withColumn("saturation", F.lit(None).cast("double"))
    verdict = F.concat_ws("|", F.when(F.col("near_constant"), "near_constant"), F.when(F.col("scale_ratio") > 100, "large_scale"), F.when(F.col("saturation") > 0.5, "saturated"))
    return a.withColumn("verdict", F.when(verdict == "", "ok").otherwise(verdict))


def lift(signal: DataFrame, event: int, span: int) -> DataFrame:
    """feature_id, pre and post means of the signal in `span` rows before and after the event, lift, post peak; null signals are left out."""
    pre, post = F.col("seq").between(event - span, event - 1), F.col("seq").between(event, event + span - 1)
    a = signal.groupBy("feature_id").agg(F.avg(F.when(pre, F.col("signal"))).alias("pre"), F.avg(F.when(post, F.col("signal"))).alias("post"), F.max(F.when(post, F.col("signal"))).alias("post_peak"))
    return a.withColumn("lift", F.col("post") - F.col("pre"))


def verdict(recall: Column, max_recall: Column) -> Column:
    return F.when(recall >= 1.0 - 1e-9, "proxy_holds(change-detection)").when(max_recall < 1.0 - 1e-9, "mode2_or_undertuned").otherwise("indeterminate")


def alignment_verdict(onset: Column, latency: Column, fp: Column, fn: Column) -> Column:
    """The verdicts' names."""
    none = F.when(fp == 0, "no_GT_signal+no_FP").otherwise("no_GT_signal+spurious_fires(mode1?)")
    return F.when(onset.isNull(), none).when(latency.isNotNull() & (fp == 0) & (fn == 0), "proxy_holds").when(fn > 0, "mode2_miss").when(fp > 0, "mode1_false_fire").otherwise("indeterminate")
