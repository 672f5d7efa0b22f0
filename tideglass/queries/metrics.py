"""Evaluation queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import joins, metrics
from tideglass.queries.base import DR, S, Registry, drifts, millis, rounded, scores, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS rk FROM {src})"
_AUC = "CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) END"


def auc_cte(name: str, src: str, by: str) -> str:
    """CTEs `name`(by, n, auc) over src."""
    return f"{_RANKED.format(by=by, src=src).replace('r AS', f'{name}_r AS', 1)}, {name} AS (SELECT {by}, count(*) AS n, {_AUC} AS auc FROM {name}_r GROUP BY {by})"


def conf(t: str = "0.5", by: str = "") -> str:
    tp, fp = f"count(*) FILTER (score >= {t} AND label = 1)", f"count(*) FILTER (score >= {t} AND label = 0)"
    fn, tn = f"count(*) FILTER (score < {t} AND label = 1)", f"count(*) FILTER (score < {t} AND label = 0)"
    d = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({a} + {b}, 0)"
    return f"{by}count(*) AS n, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, round({d(fp, tn)}, 6) AS fpr, round({d(fn, tp)}, 6) AS fnr, round({d(tp, fp)}, 6) AS precision, round({d(tp, fn)}, 6) AS recall"


@register("AGG4_roc_auc", f"WITH {S}, {auc_cte('a', 's', 'run')} SELECT run, n, round(auc, 6) AS auc FROM a")
def agg4(spark, sf):
    return rounded(metrics.roc_auc(scores(spark, sf), ["run"]))


@register("AGG4b_auc_wins", f"WITH {S}, c AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY score), w AS (SELECT sum(p * (below + q / 2.0::DOUBLE)) AS w, sum(p) AS np, sum(q) AS nq FROM (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)) SELECT CAST(np + nq AS BIGINT) AS n, round(w / (CAST(np AS DOUBLE) * nq), 6) AS auc FROM w")
def agg4b(spark, sf):
    return rounded(metrics.roc_auc(scores(spark, sf)))


@register("AGG5_fpr_fnr", f"WITH {S} SELECT run, fpr, fnr FROM (SELECT {conf(by='run, ')} FROM s GROUP BY run)")
def agg5(spark, sf):
    return rounded(metrics.confusion(scores(spark, sf), 0.5, ["run"]).select("run", "fpr", "fnr"))


@register("AGG6_precision_recall", f"WITH {S} SELECT run, precision, recall FROM (SELECT {conf(by='run, ')} FROM s GROUP BY run)")
def agg6(spark, sf):
    return rounded(metrics.confusion(scores(spark, sf), 0.5, ["run"]).select("run", "precision", "recall"))


_AT_FPR = f"""WITH {S}, c AS (SELECT run, score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY run, score),
f AS (SELECT run, score, (sum(q) OVER (PARTITION BY run) - sum(q) OVER (PARTITION BY run ORDER BY score) + q) / CAST(sum(q) OVER (PARTITION BY run) AS DOUBLE) AS fpr,
  (sum(p) OVER (PARTITION BY run ORDER BY score) - p) / CAST(sum(p) OVER (PARTITION BY run) AS DOUBLE) AS fnr FROM c),
m AS (SELECT run, min(score) FILTER (fpr <= 0.05) AS first FROM f GROUP BY run),
k AS (SELECT f.*, row_number() OVER (PARTITION BY f.run ORDER BY abs(fpr - 0.05::DOUBLE), score) AS k FROM f JOIN m ON f.run = m.run AND (first IS NULL OR score <= first))
SELECT run, round(score, 6) AS threshold, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM k WHERE k = 1"""


@register("AGG7_threshold_at_fpr", _AT_FPR)
def agg7(spark, sf):
    return rounded(metrics.threshold_at_fpr(scores(spark, sf), 0.05, ["run"]))


def youden_cte(src: str, by: str) -> str:
    return f"""b AS (SELECT {by}, min(score) AS lo, max(score) AS hi, sum(label) AS np, sum(1 - label) AS nq FROM {src} GROUP BY {by} HAVING sum(label) > 0 AND sum(1 - label) > 0),
g AS (SELECT *, CASE WHEN k = 99 THEN hi ELSE lo + k * ((hi - lo) / 99.0::DOUBLE) END AS t FROM b, range(100) r(k)),
y AS (SELECT g.{by}, k, t, count(*) FILTER (label = 0 AND score >= t) / CAST(any_value(nq) AS DOUBLE) AS fpr, count(*) FILTER (label = 1 AND score >= t) / CAST(any_value(np) AS DOUBLE) AS tpr FROM g JOIN {src} x ON x.{by} = g.{by} GROUP BY g.{by}, k, t),
yd AS (SELECT {by}, arg_max(t, (tpr - fpr, -k)) AS threshold, arg_max(fpr, (tpr - fpr, -k)) AS fpr FROM y GROUP BY {by})"""


@register("AGG8_youden", f"WITH {S}, {youden_cte('s', 'run')} SELECT run, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr FROM yd")
def agg8(spark, sf):
    return rounded(metrics.youden(scores(spark, sf), ["run"]))


@register("AGG9_per_version", f"WITH {S}, {auc_cte('a', 's', 'forest_version')}, c AS (SELECT {conf(by='forest_version, ')} FROM s GROUP BY forest_version) SELECT c.forest_version, c.n, fpr, fnr, precision, recall, round(auc, 6) AS auc FROM c JOIN a USING (forest_version)")
def agg9(spark, sf):
    return rounded(metrics.per_version(scores(spark, sf)))


_SEG = f"""{S}, {DR}, d0 AS (SELECT drift_point AS dp FROM dr WHERE drift_idx = 0), mv AS (SELECT max(forest_version) AS mv FROM s),
sg AS (SELECT s.*, 'pre_v1' AS segment FROM s, d0 WHERE seq < dp AND forest_version = 1 UNION ALL SELECT s.*, 'post_v1' FROM s, d0 WHERE seq >= dp AND forest_version = 1
  UNION ALL SELECT s.*, 'post_final' FROM s, d0, mv WHERE seq >= dp AND forest_version = mv)"""


@register("AGG10_segments", f"WITH {_SEG}, {auc_cte('a', 'sg', 'segment')}, c AS (SELECT {conf(by='segment, ')} FROM sg GROUP BY segment), {youden_cte('sg', 'segment')} SELECT c.segment, c.n, c.fpr, c.fnr, round(auc, 6) AS auc, round(yd.threshold, 6) AS best_threshold, round(yd.fpr, 6) AS best_fpr FROM c JOIN a USING (segment) LEFT JOIN yd USING (segment)")
def agg10(spark, sf):
    drift = drifts(spark, sf).filter("drift_idx = 0").first()["drift_point"]
    return rounded(metrics.segment_report(scores(spark, sf), drift))


_DELAYS = f"""{S}, {DR}, nn AS (SELECT count(*) AS n FROM s), sp AS (SELECT dr.*, coalesce(lead(drift_point) OVER (ORDER BY drift_idx), n) AS upper FROM dr, nn),
d0 AS (SELECT drift_point AS dp FROM dr WHERE drift_idx = 0), bs AS (SELECT 0 AS one, s.* FROM s, d0 WHERE forest_version = 1 AND seq < dp), {auc_cte('ba', 'bs', 'one')},
bf AS (SELECT count(*) FILTER (score >= 0.5 AND label = 0) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE) AS f FROM bs),
vb AS (SELECT drift_idx, coalesce(max(forest_version), 1) AS vb FROM sp LEFT JOIN s ON seq < drift_point GROUP BY drift_idx),
nv AS (SELECT drift_idx, min(seq) AS first_new FROM sp JOIN vb USING (drift_idx) JOIN s ON seq >= drift_point AND seq < upper AND forest_version > vb GROUP BY drift_idx),
w AS (SELECT drift_idx, drift_point, upper, drift_point + 100 * k AS ws FROM sp, range(0, 20000) r(k) WHERE drift_point + 100 * k < upper - 1000),
wr AS (SELECT drift_idx * 10000000 + ws AS wid, drift_idx, ws, label, score FROM w JOIN s ON seq >= ws AND seq < ws + 1000), {auc_cte('wa', 'wr', 'wid')},
wf AS (SELECT wid, any_value(drift_idx) AS drift_idx, any_value(ws) AS ws, count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 0) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE) AS fpr FROM wr GROUP BY wid HAVING count(*) >= 100),
wm AS (SELECT wf.*, wa.auc, ba.auc AS b FROM wf JOIN wa USING (wid), ba),
ht AS (SELECT drift_idx, min(ws) FILTER (auc > 0 AND auc >= b * 0.95::DOUBLE) AS rec, min(ws) FILTER (fpr <= 0.1::DOUBLE) AS stable FROM wm GROUP BY drift_idx),
pk AS (SELECT wm.drift_idx, max(fpr) AS peak FROM wm JOIN ht USING (drift_idx) WHERE stable IS NULL OR ws <= stable GROUP BY wm.drift_idx),
dl AS (SELECT sp.drift_idx, drift_point, upper, first_new - drift_point AS new_version_delay, CASE WHEN rec <> 0 THEN rec - drift_point END AS recovery_delay, CASE WHEN stable <> 0 THEN stable - drift_point END AS stable_delay, round(coalesce(peak, 0.0), 6) AS peak_fpr, round(ba.auc, 6) AS baseline_auc
  FROM sp LEFT JOIN nv USING (drift_idx) LEFT JOIN ht USING (drift_idx) LEFT JOIN pk USING (drift_idx), ba)"""


@register("WIN14_drift_delays", f"WITH {_DELAYS} SELECT * FROM dl")
def win14(spark, sf):
    return rounded(metrics.drift_delays(scores(spark, sf), drifts(spark, sf)))


_HEAD = f"""WITH {_DELAYS}, sg AS (SELECT s.*, 'post_v1' AS segment FROM s, d0 WHERE seq >= dp AND forest_version = 1 UNION ALL SELECT s.*, 'post_final' FROM s, d0, (SELECT max(forest_version) AS mv FROM s) WHERE seq >= dp AND forest_version = mv),
{auc_cte('sa', 'sg', 'segment')}, h AS (SELECT (SELECT max(forest_version) - 1 FROM s) AS n_retrains, (SELECT auc FROM sa WHERE segment = 'post_v1') AS v1, (SELECT auc FROM sa WHERE segment = 'post_final') AS vf, (SELECT recovery_delay FROM dl WHERE drift_idx = 0) AS recovery_latency)
SELECT n_retrains, round(v1, 6) AS post_v1_auc, round(vf, 6) AS post_final_auc, recovery_latency, round(vf - v1, 6) AS delta_post_auc, recovery_latency IS NOT NULL AS recovered FROM h"""


@register("AGG11_headline", _HEAD)
def agg11(spark, sf):
    return rounded(metrics.headline(scores(spark, sf), drifts(spark, sf)))


_RUNS = f"{S}, {auc_cte('ra', 's', 'run')}"


def run_aucs(spark, sf):
    return metrics.roc_auc(scores(spark, sf), ["run"])


@register("AGG12_run_summary", f"WITH {_RUNS} SELECT 'all' AS dataset, count(*) AS n_runs, round(median(auc), 6) AS median, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS std, round(min(auc), 6) AS min, round(max(auc), 6) AS max FROM ra")
def agg12(spark, sf):
    return rounded(metrics.run_summary(run_aucs(spark, sf).withColumn("dataset", F.lit("all")), ["dataset"], "auc"))


_LAT = f"WITH {S}, l AS (SELECT p, CAST(score_time - ingestion_time AS DOUBLE) AS lat FROM s WHERE score_time - ingestion_time >= 0 AND score_time - ingestion_time < 60000) SELECT p, count(*) AS n, round(avg(lat), 6) AS mean, " + ", ".join(f"round(quantile_cont(lat, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + ", max(lat) AS max FROM l GROUP BY p"


@register("AGG13_latency", _LAT)
def agg13(spark, sf):
    return rounded(metrics.latency_stats(scores(spark, sf), ["p"]))


_RATES = "t AS (SELECT epoch_us(ts) // 60000000 AS ts, user_id % 3 AS subtask, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) / 60.0::DOUBLE AS value FROM events GROUP BY 1, 2)"


def rates(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.floor(millis(e) / 60000).alias("ts"), (F.col("user_id") % 3).alias("subtask")).agg((F.sum(F.when(F.col("event_type") == "view", 0).otherwise(1)) / 60.0).alias("value"))


@register("AGG14_throughput", f"WITH {_RATES}, u AS (SELECT ts, sum(value) AS v FROM t WHERE value > 0 GROUP BY ts) SELECT round(avg(v), 6) AS avg, round(median(v), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, round(min(v), 6) AS min, round(max(v), 6) AS max, max(ts) - min(ts) AS duration FROM u")
def agg14(spark, sf):
    return rounded(metrics.throughput(rates(spark, sf)))


@register("PRJ11_nonzero_rates", f"WITH {_RATES} SELECT ts, subtask, round(value, 6) AS value FROM t WHERE value > 0")
def prj11(spark, sf):
    return rounded(rates(spark, sf).filter("value > 0"))


@register("SRC11_progress_rates", f"WITH {_RATES} SELECT subtask, count(*) AS points, round(sum(value), 6) AS total FROM t GROUP BY subtask")
def src11(spark, sf):
    """Rates by time and subtask as a table (a metrics server is not read): from rows, or from the progress of streaming queries."""
    return rounded(rates(spark, sf).groupBy("subtask").agg(F.count("*").alias("points"), F.sum("value").alias("total")))


_RPS = "rp AS (SELECT p, run, count(*) AS n, count(*) / nullif((max(score_time) - min(score_time)) / 1000.0::DOUBLE, 0) AS rps FROM s GROUP BY p, run)"


def rps(spark, sf):
    return metrics.records_per_second(scores(spark, sf), ["p", "run"])


@register("AGG15_records_per_second", f"WITH {S}, {_RPS} SELECT p, run, n, round(rps, 6) AS rps FROM rp")
def agg15(spark, sf):
    return rounded(rps(spark, sf))


@register("AGG16_scalability", f"WITH {S}, {_RPS}, m AS (SELECT p, avg(rps) AS rps FROM rp GROUP BY p) SELECT 'all' AS dataset, p, round(rps, 6) AS rps, round(rps / (SELECT rps FROM m WHERE p = 1), 6) AS rps_speedup FROM m")
def agg16(spark, sf):
    return rounded(metrics.scalability(rps(spark, sf).withColumn("dataset", F.lit("all")), ["dataset"], ["rps"]))


@register("JN7_baseline_join", f"WITH {S}, {_RPS}, b AS (SELECT run, avg(rps) AS base FROM rp WHERE p = 1 GROUP BY run) SELECT run, p, round(rps, 6) AS rps, round(base, 6) AS base, round(rps - base, 6) AS delta FROM rp JOIN b USING (run)")
def jn7(spark, sf):
    return rounded(joins.against_baseline(rps(spark, sf).select("run", "p", "rps"), ["run"], "p", "rps"))


_OK = "(ingestion_time >= 1577000000000 AND score_time >= ingestion_time AND score_time - ingestion_time <= 600000)"


@register("AGG17_backlog", f"WITH {S}, g AS (SELECT run, CAST(score_time - ingestion_time AS DOUBLE) AS lat, row_number() OVER (PARTITION BY run ORDER BY ingestion_time, seq) AS k, count(*) OVER (PARTITION BY run) AS n FROM s WHERE {_OK}), m AS (SELECT run, median(lat) FILTER (k <= n // 2) AS a, median(lat) FILTER (k > n // 2) AS b FROM g GROUP BY run) SELECT run, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN a > 0 THEN b / a > 2 ELSE b > 50 END AS backlogged FROM m")
def agg17(spark, sf):
    return rounded(metrics.backlog(scores(spark, sf), ["run"]))


@register("AGG18_false_retrains", f"WITH {S} SELECT run, count(*) AS n, count(DISTINCT forest_version) - 1 AS false_retrains, round((count(DISTINCT forest_version) - 1) * 100000.0::DOUBLE / count(*), 6) AS per_100k FROM s GROUP BY run")
def agg18(spark, sf):
    return rounded(metrics.false_retrains(scores(spark, sf), ["run"]))


_ROUNDS = "ro AS (SELECT user_id % 4 AS run, event_id % 50 AS round_id, CASE event_type WHEN 'error' THEN 'ABORTED' WHEN 'view' THEN 'VOTING' ELSE 'COMMITTED' END AS status, CAST(1 + event_id % 4 AS INTEGER) AS votes_yes, CAST(event_id % 3 AS INTEGER) AS votes_no, event_id AS pos FROM events)"


def rounds(spark, sf):
    status = F.when(F.col("event_type") == "error", "ABORTED").when(F.col("event_type") == "view", "VOTING").otherwise("COMMITTED")
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("run"), (F.col("event_id") % 50).alias("round_id"), status.alias("status"), (1 + F.col("event_id") % 4).cast("int").alias("votes_yes"), (F.col("event_id") % 3).cast("int").alias("votes_no"), F.col("event_id").alias("pos"))


@register("AGG19_round_summary", f"WITH {_ROUNDS}, f AS (SELECT run, round_id, arg_max(status, pos) AS status, arg_max(votes_yes, pos) AS votes FROM ro WHERE status IN ('COMMITTED', 'ABORTED') GROUP BY run, round_id) SELECT run, count(*) AS rounds, count(*) FILTER (status = 'COMMITTED') AS committed, count(*) FILTER (status = 'ABORTED') AS aborted, round(avg(CASE WHEN votes < 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sub_quorum FROM f GROUP BY run")
def agg19(spark, sf):
    return rounded(metrics.round_summary(rounds(spark, sf), ["run"], "pos"))


@register("AGG20_round_histogram", f"WITH {_ROUNDS} SELECT votes_yes, votes_no, status, count(*) AS n FROM ro GROUP BY ALL")
def agg20(spark, sf):
    return rounds(spark, sf).groupBy("votes_yes", "votes_no", "status").agg(F.count("*").alias("n"))


_PRUN = f"{S}, pr AS (SELECT run * 10 + p AS pr, s.* FROM s), {auc_cte('pa', 'pr', 'pr')}, pk AS (SELECT pr // 10 AS run, pr % 10 AS p, auc FROM pa)"


def aucs(spark, sf):
    return metrics.roc_auc(scores(spark, sf), ["run", "p"]).select("run", "p", "auc")


@register("AGG21_dilution", f"WITH {_PRUN} SELECT CASE WHEN run < 2 THEN 'a' ELSE 'b' END AS arm, p, count(*) AS runs, round(median(auc), 6) AS median_auc, round(stddev_samp(auc), 6) AS std_auc, round(avg(CASE WHEN auc >= 0.6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recovered FROM pk GROUP BY ALL")
def agg21(spark, sf):
    arm = F.when(F.col("run") < 2, "a").otherwise("b")
    return rounded(aucs(spark, sf).withColumn("arm", arm).groupBy("arm", F.col("p").cast("long").alias("p")).agg(F.count("*").alias("runs"), F.median("auc").alias("median_auc"), F.stddev_samp("auc").alias("std_auc"), F.avg(F.when(F.col("auc") >= 0.6, 1.0).otherwise(0.0)).alias("recovered")))


@register("AGG22_auc_by_p", f"WITH {_PRUN} SELECT run, " + ", ".join(f"round(avg(auc) FILTER (p = {p}), 6) AS p{p}" for p in (1, 2, 4, 6)) + " FROM pk GROUP BY run")
def agg22(spark, sf):
    wide = aucs(spark, sf).groupBy("run").pivot("p", [1, 2, 4, 6]).agg(F.avg("auc"))
    return rounded(wide.select("run", *(F.col(f"`{p}`").alias(f"p{p}") for p in (1, 2, 4, 6))))


_DELTA = f"{S}, rv AS (SELECT run * 100 + forest_version AS rv, s.* FROM s), {auc_cte('va', 'rv', 'rv')}, vv AS (SELECT rv // 100 AS run, rv % 100 AS forest_version, auc, lead(auc) OVER (PARTITION BY rv // 100 ORDER BY rv) AS next_auc FROM va), vd AS (SELECT *, next_auc - auc AS delta FROM vv WHERE next_auc IS NOT NULL AND auc IS NOT NULL)"


@register("JN9_version_deltas", f"WITH {_DELTA} SELECT run, forest_version, round(auc, 6) AS auc, round(next_auc, 6) AS next_auc, round(delta, 6) AS delta FROM vd")
def jn9(spark, sf):
    return rounded(metrics.retrain_deltas(scores(spark, sf), ["run"]))


@register("AGG23_retrain_summary", f"WITH {_DELTA} SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(avg(CASE WHEN delta >= -0.005 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_kept, round(avg(auc), 6) AS pre, round(avg(next_auc), 6) AS post FROM vd")
def agg23(spark, sf):
    return rounded(metrics.retrain_summary(metrics.retrain_deltas(scores(spark, sf), ["run"])))


@register("AGG24_accuracy_kept", f"WITH {_PRUN}, m AS (SELECT p, avg(auc) AS auc FROM pk GROUP BY p) SELECT bool_and(abs(auc - (SELECT auc FROM m WHERE p = 1)) < 0.02) AS kept FROM m WHERE p > 1")
def agg24(spark, sf):
    means = aucs(spark, sf).groupBy("p").agg(F.avg("auc").alias("auc")).withColumn("one", F.lit(1))
    return joins.against_baseline(means, ["one"], "p", "auc").filter("p > 1").agg(F.bool_and(F.abs("delta") < 0.02).alias("kept"))


#: Published AUCs of five detectors.
LITERATURE = (("donors", 0.795, 0.769, 0.715, 0.637, 0.554), ("forestcover", 0.887, 0.861, 0.722, 0.917, 0.5), ("fraud", 0.936, 0.946, 0.91, 0.951, 0.722))
_LIT = "(VALUES " + ", ".join(f"('{r[0]}', " + ", ".join(f"{v}::DOUBLE" for v in r[1:]) + ")" for r in LITERATURE) + ") l(dataset, oifor, asdifor, hst, rrcf, loda)"


@register("JN8_literature", f"WITH {_RUNS}, d AS (SELECT CASE run % 3 WHEN 0 THEN 'donors' WHEN 1 THEN 'forestcover' ELSE 'fraud' END AS dataset, avg(auc) AS auc FROM ra GROUP BY 1) SELECT dataset, round(auc, 6) AS auc, oifor, asdifor, hst, rrcf, loda, auc BETWEEN least(oifor, asdifor, hst, rrcf, loda) AND greatest(oifor, asdifor, hst, rrcf, loda) AS in_range FROM d LEFT JOIN {_LIT} USING (dataset)")
def jn8(spark, sf):
    names = F.when(F.col("run") % 3 == 0, "donors").when(F.col("run") % 3 == 1, "forestcover").otherwise("fraud")
    ours = run_aucs(spark, sf).groupBy(names.alias("dataset")).agg(F.avg("auc").alias("auc"))
    cols = ("oifor", "asdifor", "hst", "rrcf", "loda")
    lit = spark.createDataFrame(LITERATURE, "dataset string, " + ", ".join(f"{c} double" for c in cols))
    return rounded(joins.lookup(ours, lit, "dataset").withColumn("in_range", F.col("auc").between(F.least(*cols), F.greatest(*cols))))


@register("AGG36_dirty_share", f"WITH {S} SELECT run, round(avg(CASE WHEN {_OK} THEN 0.0::DOUBLE ELSE 1 END), 6) AS dirty_share, avg(CASE WHEN {_OK} THEN 0.0::DOUBLE ELSE 1 END) > 0.01 AS flagged FROM s GROUP BY run")
def agg36(spark, sf):
    return rounded(metrics.dirty_share(scores(spark, sf), ["run"]))


@register("PRJ8_latency_filters", f"WITH {S} SELECT run, count(*) FILTER (score_time - ingestion_time >= 0 AND score_time - ingestion_time < 60000) AS fast, count(*) FILTER ({_OK}) AS clean FROM s GROUP BY run")
def prj8(spark, sf):
    return scores(spark, sf).groupBy("run").agg(F.count_if(metrics.latency_ok()).alias("fast"), F.count_if(metrics.stamps_ok()).alias("clean"))


@register("WIN21_score_gaps", f"WITH {S}, g AS (SELECT run, score_time - lag(score_time) OVER (PARTITION BY run, seq // 65536 ORDER BY score_time, seq) AS gap FROM s) SELECT run, count(gap) AS n, round(avg(gap), 6) AS mean, round(median(gap), 6) AS median, max(gap) AS max FROM g GROUP BY run")
def win21(spark, sf):
    """Gaps between neighbouring score times, inside blocks of 65,536 rows of a run."""
    from pyspark.sql import Window

    w = Window.partitionBy("run", F.expr("seq div 65536")).orderBy("score_time", "seq")
    g = scores(spark, sf).withColumn("gap", F.col("score_time") - F.lag("score_time").over(w))
    return rounded(g.groupBy("run").agg(F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.max("gap").alias("max")))


@register("WIN22_tied_ranks", f"WITH {S} SELECT run, score, count(*) AS ties, round(any_value(rk), 6) AS mid_rank FROM (SELECT run, score, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0::DOUBLE AS rk FROM s) GROUP BY run, score")
def win22(spark, sf):
    c = metrics.score_counts(scores(spark, sf), ["run"])
    ties = F.col("pos") + F.col("neg")
    return rounded(c.select("run", "score", ties.alias("ties"), (F.col("pos_below") + F.col("neg_below") + (ties + 1) / 2.0).alias("mid_rank")))


@register("SC10_null_guards", f"WITH {S} SELECT run, seq // 1000 AS block, round(count(*) FILTER (label = 1 AND score >= 0.99) / CAST(nullif(count(*) FILTER (score >= 0.99), 0) AS DOUBLE), 6) AS precision, coalesce(round(count(*) FILTER (label = 1 AND score >= 0.99) / CAST(nullif(count(*) FILTER (score >= 0.99), 0) AS DOUBLE), 6), -1) AS filled FROM s GROUP BY ALL")
def sc10(spark, sf):
    s = scores(spark, sf).withColumn("block", F.expr("seq div 1000"))
    out = rounded(metrics.confusion(s, 0.99, ["run", "block"]).select("run", "block", "precision"))
    return out.withColumn("filled", F.coalesce("precision", F.lit(-1.0)))


@register("SRT1_sort", f"WITH {S} SELECT run, seq, score FROM s WHERE score >= 0.9 ORDER BY run, score DESC, seq")
def srt1(spark, sf):
    return scores(spark, sf).filter("score >= 0.9").select("run", "seq", "score").orderBy("run", F.desc("score"), "seq")


@register("SET3_distinct_versions", f"WITH {S} SELECT DISTINCT run, forest_version FROM s")
def set3(spark, sf):
    return scores(spark, sf).select("run", "forest_version").distinct()


@register("SET4_decisions_once", f"WITH {_ROUNDS} SELECT run, round_id, min(pos) AS first_pos FROM ro WHERE status = 'COMMITTED' GROUP BY run, round_id")
def set4(spark, sf):
    """A decision is taken up once: at its round's first commit."""
    return rounds(spark, sf).filter("status = 'COMMITTED'").groupBy("run", "round_id").agg(F.min("pos").alias("first_pos"))
