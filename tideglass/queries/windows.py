"""Window, sequence, interval-join and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import detectors, joins, metrics, quorum, routing
from tideglass.operators.running import running, sliding
from tideglass.queries.base import DR, FV, OFF, PT, S, SV, O, Registry, drifts, onsets, points, rounded, scores, shifted_values, table, values
from tideglass.queries.metrics import auc_cte

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
TAU = 200


@register("WIN1_ring", f"WITH {PT}, z AS (SELECT seq, CAST(seq % 4 AS INTEGER) AS shard, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq DESC) AS r FROM pt) SELECT shard, seq FROM z WHERE r <= 100")
def win1(spark, sf):
    p = points(spark, sf).select("seq", (F.col("seq") % 4).cast("int").alias("shard"))
    return routing.last_of_each(p, "shard", "seq", 100).select("shard", "seq")


@register("WIN3_cumulative_mean", f"WITH {FV} SELECT feature_id, seq, round(avg(value) OVER (PARTITION BY feature_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + {OFF}, 6) AS mean FROM fv")
def win3(spark, sf):
    r = running(values(spark, sf), ["feature_id"], "seq", {"t": ("sum", F.col("value")), "n": ("count", F.lit(1))})
    return rounded(r.select("feature_id", "seq", (F.col("t") / F.col("n") + OFF).alias("mean")))


@register("WIN4_sliding_mean", f"WITH {FV} SELECT feature_id, seq, round(avg(value) OVER (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) + {OFF}, 6) AS mean FROM fv")
def win4(spark, sf):
    return rounded(sliding(values(spark, sf), ["feature_id"], "seq", 199, {"mean": F.avg("value")}).select("feature_id", "seq", (F.col("mean") + OFF).alias("mean")))


_A = f"{SV}, a0 AS (SELECT feature_id, seq, row_number() OVER w AS n, avg(value) OVER w / 490.0::DOUBLE AS mean FROM sv WINDOW w AS (PARTITION BY feature_id ORDER BY seq ROWS UNBOUNDED PRECEDING)), a1 AS (SELECT *, sqrt(ln(1000.0::DOUBLE) / (2 * n)) AS eps FROM a0)"
_BEST = "min(ROW(mean + eps, n, mean, eps)) OVER (PARTITION BY feature_id ORDER BY n ROWS UNBOUNDED PRECEDING)"


def unit_values(spark, sf):
    return shifted_values(spark, sf).withColumn("value", F.col("value") / 490.0)


@register("WIN5_running_best", f"WITH {_A}, b AS (SELECT feature_id, seq, {_BEST} AS b FROM a1) SELECT feature_id, seq, round(b[3] + {OFF}, 6) AS best_mean, round(b[4], 6) AS best_eps FROM b")
def win5(spark, sf):
    return rounded(detectors.hddm_a(unit_values(spark, sf)).select("feature_id", "seq", (F.col("best_mean") + OFF).alias("best_mean"), "best_eps"))


_RATIO = "sqrt(ln(1000.0::DOUBLE) / ln(200.0::DOUBLE))"
_STATUS = f"CASE WHEN mean - eps > b[3] + b[4] * {_RATIO} THEN 'DRIFT' WHEN mean - eps > b[3] + b[4] / {_RATIO} THEN 'WARN' ELSE 'STABLE' END"


@register("DET2_hddm_a", f"WITH {_A}, b AS (SELECT *, {_BEST} AS b FROM a1) SELECT feature_id, seq, {_STATUS} AS status FROM b")
def det2(spark, sf):
    return detectors.hddm_a(unit_values(spark, sf)).select("feature_id", "seq", "status")


_AW = f"{SV}, a0 AS (SELECT feature_id, seq, row_number() OVER (PARTITION BY feature_id ORDER BY seq) AS n, avg(value) OVER w / 490.0::DOUBLE AS mean, count(*) OVER w AS k FROM sv WINDOW w AS (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)), a1 AS (SELECT *, sqrt(ln(1000.0::DOUBLE) / (2 * k)) AS eps FROM a0)"


@register("DET3_hddm_a_windowed", f"WITH {_AW}, b AS (SELECT *, {_BEST} AS b FROM a1) SELECT feature_id, seq, {_STATUS} AS status FROM b")
def det3(spark, sf):
    from tideglass.config import HddmConfig

    return detectors.hddm_a_windowed(unit_values(spark, sf), HddmConfig(window=500)).select("feature_id", "seq", "status")


@register("WIN6_warn_runs", f"WITH {_AW}, b AS (SELECT *, {_BEST} AS b FROM a1), t AS (SELECT *, {_STATUS} AS status FROM b), i AS (SELECT *, n - row_number() OVER (PARTITION BY feature_id ORDER BY n) AS g FROM t WHERE status = 'WARN') SELECT feature_id, min(n) AS run_start, count(*) AS length, count(*) > 20 AS timed_out FROM i GROUP BY feature_id, g")
def win6(spark, sf):
    from tideglass.config import HddmConfig

    judged = detectors.hddm_a_windowed(unit_values(spark, sf), HddmConfig(window=500))
    return detectors.warn_runs(judged, 20)


_KS = f"WITH {FV}, c AS (SELECT feature_id, value, sum(CASE WHEN seq * 2 >= n THEN 1 ELSE -1 END) AS d FROM fv, (SELECT count(*) // 2 * 2 AS n FROM events) WHERE seq < n GROUP BY feature_id, value), g AS (SELECT feature_id, sum(d) OVER (PARTITION BY feature_id ORDER BY value) AS g FROM c)"


def halves(spark, sf):
    n = F.broadcast(table(spark, sf, "events").agg(F.expr("count(*) div 2 * 2").alias("_n")))
    return values(spark, sf).crossJoin(n).filter(F.col("seq") < F.col("_n")).withColumn("late", F.col("seq") * 2 >= F.col("_n"))


@register("AGG28_ks", f"{_KS} SELECT feature_id, round(max(abs(g)) / (SELECT (count(*) // 2) FROM events)::DOUBLE, 6) AS ks FROM g GROUP BY feature_id")
def agg28(spark, sf):
    return rounded(detectors.two_sample(halves(spark, sf), ["feature_id"], "value", "late").select("feature_id", "ks"))


@register("AGG29_kuiper", f"{_KS} SELECT feature_id, round((greatest(max(g), 0) - least(min(g), 0)) / (SELECT (count(*) // 2) FROM events)::DOUBLE, 6) AS kuiper FROM g GROUP BY feature_id")
def agg29(spark, sf):
    return rounded(detectors.two_sample(halves(spark, sf), ["feature_id"], "value", "late").select("feature_id", "kuiper"))


_WARM = f"{FV}, w AS (SELECT feature_id, seq, value, abs(value - avg(value) OVER (PARTITION BY feature_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS dev, row_number() OVER (PARTITION BY feature_id ORDER BY seq) AS n FROM fv), wd AS (SELECT * FROM w WHERE n <= 500)"


@register("AGG30_warmup_scale", f"WITH {_WARM} SELECT feature_id, round(avg(value), 6) AS reference, round(greatest(list_sort(list(dev))[CAST(ceil(0.99 * count(*)) AS BIGINT)], 1e-12), 6) AS p99, round(greatest(max(dev), 1e-12), 6) AS maxdev FROM wd GROUP BY feature_id")
def agg30(spark, sf):
    return rounded(detectors.warmup_scale(values(spark, sf), 500))


_SIG = f"{_WARM}, m AS (SELECT feature_id, avg(value) AS ref, greatest(list_sort(list(dev))[CAST(ceil(0.99 * count(*)) AS BIGINT)], 1e-12) AS scale FROM wd GROUP BY feature_id), sg AS (SELECT feature_id, seq, least(abs(value - ref) / scale, 1.0::DOUBLE) AS signal FROM w JOIN m USING (feature_id) WHERE n > 500)"


def signal(spark, sf):
    from tideglass.functions import deviation_signal

    v = values(spark, sf)
    m = F.broadcast(detectors.warmup_scale(v, 500).select("feature_id", "reference", "p99"))
    return detectors.numbered(v).filter("n > 500").join(m, "feature_id").select("feature_id", "seq", deviation_signal(F.col("value"), F.col("reference"), F.col("p99")).alias("signal"))


@register("PRJ7_deviation_signal", f"WITH {_SIG} SELECT feature_id, seq, round(signal, 6) AS signal FROM sg")
def prj7(spark, sf):
    return rounded(signal(spark, sf))


@register("WIN18_moving_mean", f"WITH {_SIG}, x AS (SELECT feature_id, seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE signal END AS s FROM sg) SELECT feature_id, seq, round(avg(s) OVER (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS mean FROM x")
def win18(spark, sf):
    x = signal(spark, sf).withColumn("s", F.when(F.col("seq") % 7 != 0, F.col("signal")))
    return rounded(sliding(x, ["feature_id"], "seq", 49, {"mean": F.avg("s")}).select("feature_id", "seq", "mean"))


_LIFT = f"{_SIG}, e AS (SELECT drift_point AS ep FROM dr WHERE drift_idx = 1), lf AS (SELECT feature_id, avg(signal) FILTER (seq BETWEEN ep - 300 AND ep - 1) AS pre, avg(signal) FILTER (seq BETWEEN ep AND ep + 299) AS post, max(signal) FILTER (seq BETWEEN ep AND ep + 299) AS post_peak FROM sg, e GROUP BY feature_id)"
_LIFTS = f"WITH {DR}, {_LIFT}"


def middle(spark, sf):
    return drifts(spark, sf).filter("drift_idx = 1").first()["drift_point"]


@register("WIN19_event_lift", f"{_LIFTS} SELECT feature_id, round(pre, 6) AS pre, round(post, 6) AS post, round(post_peak, 6) AS post_peak, round(post - pre, 6) AS lift FROM lf")
def win19(spark, sf):
    return rounded(metrics.lift(signal(spark, sf), middle(spark, sf), 300))


@register("WIN20_lift_ranking", f"{_LIFTS} SELECT feature_id, CAST(dense_rank() OVER (ORDER BY round(post - pre, 6) DESC) AS INTEGER) AS rank FROM lf")
def win20(spark, sf):
    from pyspark.sql import Window

    l = rounded(metrics.lift(signal(spark, sf), middle(spark, sf), 300))
    return l.select("feature_id", F.dense_rank().over(Window.orderBy(F.desc("lift"))).alias("rank"))


@register("SRT2_top_features", f"{_LIFTS} SELECT feature_id, round(post - pre, 6) AS lift FROM lf ORDER BY 2 DESC, 1 LIMIT 2")
def srt2(spark, sf):
    return rounded(metrics.lift(signal(spark, sf), middle(spark, sf), 300)).select("feature_id", "lift").orderBy(F.desc("lift"), "feature_id").limit(2)


@register("AGG26_feature_audit", f"WITH {_SIG}, a AS (SELECT feature_id, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, greatest(abs(min(value)), abs(max(value))) AS size FROM fv GROUP BY feature_id), t AS (SELECT feature_id, avg(CASE WHEN signal >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS sat FROM sg GROUP BY feature_id), j AS (SELECT a.feature_id, min, max, mean, std, std < 1e-6 AS nc, size / nullif((SELECT median(size) FROM a), 0) AS sr, sat FROM a LEFT JOIN t USING (feature_id)), v AS (SELECT *, concat_ws('|', CASE WHEN nc THEN 'near_constant' END, CASE WHEN sr > 100 THEN 'large_scale' END, CASE WHEN sat > 0.5 THEN 'saturated' END) AS v FROM j) SELECT feature_id, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, nc AS near_constant, round(sr, 6) AS scale_ratio, round(sat, 6) AS saturation, CASE WHEN v = '' THEN 'ok' ELSE v END AS verdict FROM v")
def agg26(spark, sf):
    return rounded(metrics.feature_audit(values(spark, sf), signal(spark, sf)))


@register("AGG31_welford", f"WITH {S}, x AS (SELECT run, seq, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS std FROM s WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT run, seq, round(mean + {OFF}, 6) AS mean, round(std + {OFF}, 5) AS std FROM x")
def agg31(spark, sf):
    """Running mean and sample deviation from running sums; the shift by 0.5 keeps the squares small."""
    d = F.col("score") - 0.5
    r = running(scores(spark, sf), ["run"], "seq", {"a": ("sum", d), "b": ("sum", d * d), "n": ("count", F.lit(1))})
    var = (F.col("b") - F.col("a") * F.col("a") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return r.select("run", "seq", F.round(F.col("a") / F.col("n") + 0.5 + OFF, 6).alias("mean"), F.round(F.when(var >= 0, F.sqrt(var)).when(var < 0, F.lit(0.0)) + OFF, 5).alias("std"))


_WINS = f"{S}, nn AS (SELECT count(*) AS n FROM s), w AS (SELECT k * 500 AS ws FROM range(0, 20000) r(k), nn WHERE k * 500 < n - 2000), wr AS (SELECT ws, label, score FROM w JOIN s ON seq >= ws AND seq < ws + 2000), {auc_cte('wa', 'wr', 'ws')}, wm AS (SELECT ws, wa.n, wa.auc, f FROM wa JOIN (SELECT ws, count(*) FILTER (score >= 0.5 AND label = 0) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE) AS f FROM wr GROUP BY ws) USING (ws) WHERE wa.n >= 100)"


@register("WIN13_sliding_metrics", f"WITH {_WINS} SELECT ws AS win_start, ws + 1000 AS win_center, n, round(auc, 6) AS auc, round(f, 6) AS fpr FROM wm")
def win13(spark, sf):
    return rounded(metrics.sliding_report(scores(spark, sf), 2000))


@register("PRJ12_small_windows", f"WITH {S}, b AS (SELECT run, seq // 450 AS win, count(*) AS n FROM s GROUP BY ALL) SELECT run, win, n FROM b WHERE n >= 100")
def prj12(spark, sf):
    b = scores(spark, sf).groupBy("run", F.expr("seq div 450").alias("win")).agg(F.count("*").alias("n"))
    return b.filter("n >= 100")


def auc_windows(spark, sf):
    return metrics.sliding_report(scores(spark, sf), 2000).select(F.col("win_center").alias("center"), "auc")


_GT = f"{DR}, {_WINS}, c AS (SELECT ws + 1000 AS center, auc FROM wm), e AS (SELECT drift_point AS pre FROM dr WHERE drift_idx = 0), bl AS (SELECT avg(auc) FILTER (center < pre) AS baseline FROM c, e), lo AS (SELECT center, CASE WHEN auc < baseline - 0.05::DOUBLE AND center > pre THEN 1 ELSE 0 END AS low, auc < baseline - 0.05::DOUBLE AS below, baseline FROM c, e, bl), rn AS (SELECT *, sum(low) OVER (ORDER BY center ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM lo)"


@register("WIN15_degradation_onset", f"WITH {_GT} SELECT round(any_value(baseline), 6) AS baseline, min(center) FILTER (r >= 3) AS onset FROM rn")
def win15(spark, sf):
    pre = drifts(spark, sf).filter("drift_idx = 0").first()["drift_point"]
    return rounded(metrics.degradation(auc_windows(spark, sf), pre, 0.05, 3))


_SEGS = f"{_GT}, ii AS (SELECT center, row_number() OVER (ORDER BY center) - sum(CASE WHEN below THEN 1 ELSE 0 END) OVER (ORDER BY center) AS g, below FROM rn), segs AS (SELECT min(center) AS seg_start, max(center) AS seg_end FROM ii WHERE below GROUP BY g)"


def degraded(spark, sf):
    w = auc_windows(spark, sf)
    pre = drifts(spark, sf).filter("drift_idx = 0").first()["drift_point"]
    base = metrics.degradation(w, pre, 0.05, 3).select("baseline").first()[0]
    return metrics.degradation_segments(w, F.lit(base), 0.05)


@register("WIN16_degradation_segments", f"WITH {_SEGS} SELECT * FROM segs")
def win16(spark, sf):
    return degraded(spark, sf)


@register("JN6_missed_segments", f"WITH {_SEGS}, {O}, late AS (SELECT seq FROM o, (SELECT count(*) AS n FROM events) WHERE seq * 25 >= n * 19) SELECT tau, segs.* FROM segs, (VALUES (CAST(50 AS BIGINT)), (1000)) t(tau) WHERE NOT EXISTS (SELECT 1 FROM late WHERE seq BETWEEN seg_start - tau AND seg_end + tau)")
def jn6(spark, sf):
    """Segments without an onset of the last six 25ths of the stream: some by a narrow margin are, by a wide one are not."""
    n = F.broadcast(table(spark, sf, "events").agg(F.count("*").alias("_n")))
    late, low, out = onsets(spark, sf).crossJoin(n).filter("seq * 25 >= _n * 19").drop("_n"), degraded(spark, sf), None
    for tau in (50, 1000):
        missed = joins.missed_segments(low, late, tau).select(F.lit(tau).cast("long").alias("tau"), "seg_start", "seg_end")
        out = missed if out is None else out.unionByName(missed)
    return out


# ---- onsets, rounds and their joins -----------------------------------------------------------------------------------------


@register("WIN17_rising_edges", f"WITH {_SIG}, x AS (SELECT feature_id, seq, signal > 0.9 AS up, lag(signal > 0.9, 1, false) OVER (PARTITION BY feature_id ORDER BY seq) AS was FROM sg) SELECT feature_id, seq FROM x WHERE up AND NOT was")
def win17(spark, sf):
    x = sliding(signal(spark, sf).withColumn("up", F.col("signal") > 0.9), ["feature_id"], "seq", 1, {"_pair": F.collect_list("up")})
    was = F.when(F.size("_pair") == 2, F.get("_pair", F.lit(0))).otherwise(F.lit(False))
    return x.filter(F.col("up") & ~was).select("feature_id", "seq")


@register("PRJ10_amplitude_filter", f"WITH {_SIG} SELECT feature_id, seq, round(signal, 6) AS signal FROM sg WHERE signal >= 0.95")
def prj10(spark, sf):
    return rounded(signal(spark, sf).filter("signal >= 0.95"))


@register("AGG2_features_in_window", f"WITH {O} SELECT a.seq, a.feature_id, CAST(count(DISTINCT b.feature_id) AS INTEGER) AS n_features FROM o a JOIN o b ON b.seq BETWEEN a.seq - 100 AND a.seq GROUP BY ALL")
def agg2(spark, sf):
    return quorum.distinct_in_window(onsets(spark, sf), 100)


_EVENTS = f"""{O}, ev AS (SELECT row_number() OVER (ORDER BY emit_seq, feature_id, seq) AS i, * FROM o)"""
_QUORUM = f"""WITH RECURSIVE {_EVENTS}, q(i, recent, last, rounds, fired, seq, votes) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(f INTEGER, s BIGINT)[]), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), 0
  UNION ALL
  SELECT i, CASE WHEN fire THEN CAST([] AS STRUCT(f INTEGER, s BIGINT)[]) ELSE kept END, CASE WHEN fire THEN seq ELSE last END, rounds + (CASE WHEN fire THEN 1 ELSE 0 END), fire, seq, CAST(len(kept) AS INTEGER)
  FROM (SELECT *, (last IS NULL OR seq - last >= 500) AND len(kept) >= 3 AS fire FROM (
    SELECT ev.i, q.last, q.rounds, ev.seq, list_filter(list_append(list_filter(q.recent, lambda x: x.f <> ev.feature_id), {{'f': ev.feature_id, 's': ev.seq}}), lambda x: x.s >= ev.seq - 120) AS kept FROM q JOIN ev ON ev.i = q.i + 1)))
SELECT rounds AS round_id, seq, 'COMMITTED' AS status, votes AS votes_yes FROM q WHERE fired"""


def committed(spark, sf):
    from tideglass.config import QuorumConfig

    return quorum.commit_rounds(onsets(spark, sf), QuorumConfig(3, 120, 500))


@register("DET7_quorum", _QUORUM)
def det7(spark, sf):
    return committed(spark, sf).drop("run")


@register("WIN9_quorum_window", _QUORUM)
def win9(spark, sf):
    return committed(spark, sf).drop("run")


@register("WIN10_armed_quorum", f"WITH {O}, e AS (SELECT row_number() OVER (ORDER BY seq, feature_id) AS i, seq, feature_id FROM o), c AS (SELECT a.i, a.seq, count(DISTINCT b.feature_id) >= 3 AS up FROM e a JOIN e b ON b.i <= a.i AND b.seq >= a.seq - 80 GROUP BY a.i, a.seq), l AS (SELECT seq, up, lag(up, 1, false) OVER (ORDER BY i) AS was FROM c) SELECT seq FROM l WHERE up AND NOT was")
def win10(spark, sf):
    return quorum.armed_quorum(onsets(spark, sf), 3, 80)


_EVQ = f"""WITH RECURSIVE {O}, e AS (SELECT row_number() OVER (ORDER BY seq, feature_id) AS i, seq FROM o), c AS (SELECT a.i, a.seq, count(*) AS n FROM e a JOIN e b ON b.i <= a.i AND b.seq >= a.seq - 80 GROUP BY a.i, a.seq),
r(i, last, fire, seq) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(0 AS BIGINT) UNION ALL SELECT c.i, CASE WHEN c.n >= 3 AND (last IS NULL OR c.seq - last > 300) THEN c.seq ELSE last END, c.n >= 3 AND (last IS NULL OR c.seq - last > 300), c.seq FROM r JOIN c ON c.i = r.i + 1) SELECT seq FROM r WHERE fire"""


def event_commits(spark, sf):
    return quorum.event_quorum(onsets(spark, sf), 3, 80, 300)


@register("WIN12_event_quorum", _EVQ)
def win12(spark, sf):
    return event_commits(spark, sf)


_ND = f"{DR}, {O}, dd AS (SELECT drift_idx, drift_point AS start, drift_point + 1 AS \"end\" FROM dr)"


def spans(spark, sf):
    return drifts(spark, sf).select("drift_idx", F.col("drift_point").alias("start"), (F.col("drift_point") + 1).alias("end"))


def some_onsets(spark, sf):
    return onsets(spark, sf).filter("feature_id = 1")


_HITS = f"{_ND}, fo AS (SELECT seq FROM o WHERE feature_id = 1), hh AS (SELECT drift_idx, start, seq FROM dd JOIN fo ON seq BETWEEN start - {TAU} AND \"end\" + {TAU})"


@register("JN4_first_hits", f"WITH {_HITS} SELECT dd.drift_idx, dd.start, dd.\"end\", min(seq) AS onset, min(seq) - dd.start AS latency FROM dd LEFT JOIN hh USING (drift_idx) GROUP BY dd.drift_idx, dd.start, dd.\"end\"")
def jn4(spark, sf):
    return joins.first_hits(spans(spark, sf), some_onsets(spark, sf), TAU)


@register("AGG33_label_metrics", f"WITH {_HITS}, f AS (SELECT drift_idx, min(seq) - any_value(start) AS lat FROM hh GROUP BY drift_idx) SELECT round((SELECT count(*) FROM f) / (SELECT count(*) FROM dd)::DOUBLE, 6) AS recall, round((SELECT count(DISTINCT seq) FROM hh) / (SELECT count(DISTINCT seq) FROM fo)::DOUBLE, 6) AS precision, (SELECT median(lat) FROM f)::DOUBLE AS median_latency, (SELECT count(DISTINCT seq) FROM fo) AS n_onsets, (SELECT count(DISTINCT seq) FROM fo) - (SELECT count(DISTINCT seq) FROM hh) AS n_false")
def agg33(spark, sf):
    return rounded(joins.label_report(spans(spark, sf), some_onsets(spark, sf), TAU))


@register("JN5_committed_near", _EVQ.replace("SELECT seq FROM r WHERE fire", "").rstrip() + f", {DR} SELECT drift_idx, drift_point AS start, EXISTS (SELECT 1 FROM r WHERE fire AND r.seq BETWEEN drift_point - 100 AND drift_point + 200) AS hit FROM dr")
def jn5(spark, sf):
    return joins.committed_near(spans(spark, sf), event_commits(spark, sf), 100)


@register("JN11_features_near", f"WITH {_ND} SELECT DISTINCT feature_id FROM o, (SELECT start AS a FROM dd WHERE drift_idx = 1) WHERE seq BETWEEN a - 150 AND a + 150")
def jn11(spark, sf):
    return joins.features_near(onsets(spark, sf), middle(spark, sf), 150)


_FIRES = f"{_ND}, fi AS (SELECT drift_idx, start AS event, feature_id, seq AS fire FROM dd JOIN o ON seq >= start AND seq < start + 400)"


def fires(spark, sf):
    events = drifts(spark, sf).select("drift_idx", F.col("drift_point").alias("event"))
    return joins.fires_after(events, onsets(spark, sf).select("feature_id", F.col("seq").alias("fire")), 400)


@register("JN12_fires_after", f"WITH {_FIRES} SELECT drift_idx, event, feature_id, fire FROM fi")
def jn12(spark, sf):
    return fires(spark, sf)


@register("AGG27_detector_matrix", f"WITH {_FIRES}, f0 AS (SELECT drift_idx, feature_id, min(fire - event) AS delay FROM fi GROUP BY ALL), a AS (SELECT feature_id, count(*) AS fires FROM o GROUP BY feature_id) SELECT a.feature_id, fires, round(count(delay) / 3.0::DOUBLE, 6) AS hit_rate, CAST(median(delay) AS DOUBLE) AS median_delay FROM a LEFT JOIN f0 USING (feature_id) GROUP BY a.feature_id, fires")
def agg27(spark, sf):
    first = fires(spark, sf).groupBy("drift_idx", "feature_id").agg(F.min(F.col("fire") - F.col("event")).alias("delay"))
    n = onsets(spark, sf).groupBy("feature_id").agg(F.count("*").alias("fires"))
    return rounded(n.join(first, "feature_id", "left").groupBy("feature_id", "fires").agg((F.count("delay") / 3.0).alias("hit_rate"), F.median("delay").alias("median_delay")))


_ALIGN = f"WITH {_SEGS}, {O}, fo AS (SELECT seq FROM o WHERE feature_id = 2), g AS (SELECT min(center) FILTER (r >= 3) AS onset FROM rn), al AS (SELECT (SELECT min(seq) FROM fo, e, g WHERE seq BETWEEN pre - {TAU} AND onset + {TAU}) - (SELECT onset FROM g) AS latency, (SELECT count(*) FROM fo, e WHERE seq < pre - {TAU}) AS fp, (SELECT count(*) FROM segs WHERE NOT EXISTS (SELECT 1 FROM fo WHERE seq BETWEEN seg_start - {TAU} AND seg_end + {TAU})) AS fn, (SELECT onset FROM g) AS onset)"


def alignment(spark, sf):
    pre = drifts(spark, sf).filter("drift_idx = 0").first()["drift_point"]
    gt = metrics.degradation(auc_windows(spark, sf), pre, 0.05, 3).select("onset")
    o = onsets(spark, sf).filter("feature_id = 2")
    missed = joins.missed_segments(degraded(spark, sf), o, TAU).agg(F.count("*").alias("fn"))
    found = o.crossJoin(F.broadcast(gt)).agg(F.min(F.when(F.col("seq").between(pre - TAU, F.col("onset") + TAU), F.col("seq"))).alias("_first"), F.count_if(F.col("seq") < pre - TAU).alias("fp"), F.first("onset").alias("onset"))
    return found.crossJoin(missed).select((F.col("_first") - F.col("onset")).alias("latency"), "fp", "fn", "onset")


@register("AGG38_alignment", f"{_ALIGN} SELECT latency, fp, fn FROM al")
def agg38(spark, sf):
    return alignment(spark, sf).drop("onset")


@register("AGG37_verdict", f"{_ALIGN} SELECT CASE WHEN onset IS NULL THEN CASE WHEN fp = 0 THEN 'no_GT_signal+no_FP' ELSE 'no_GT_signal+spurious_fires(mode1?)' END WHEN latency IS NOT NULL AND fp = 0 AND fn = 0 THEN 'proxy_holds' WHEN fn > 0 THEN 'mode2_miss' WHEN fp > 0 THEN 'mode1_false_fire' ELSE 'indeterminate' END AS verdict FROM al")
def agg37(spark, sf):
    return alignment(spark, sf).select(metrics.alignment_verdict(F.col("onset"), F.col("latency"), F.col("fp"), F.col("fn")).alias("verdict"))


_VER = "vs AS (SELECT * FROM (VALUES (1, 0), (2, 3), (3, 5), (4, 5), (5, 9)) v(version, t))"
_SWAP = f"{_VER}, sw AS (SELECT CAST(version AS BIGINT) AS version, CAST(floor(n * t / CAST(10 AS DOUBLE)) AS BIGINT) AS swap_seq FROM vs, (SELECT count(*) AS n FROM events))"


def versions(spark, sf):
    n = table(spark, sf, "events").agg(F.count("*").alias("n"))
    v = spark.createDataFrame([(1, 0), (2, 3), (3, 5), (4, 5), (5, 9)], "version long, t int")
    return v.crossJoin(n).select("version", F.floor(F.col("n") * F.col("t") / 10.0).cast("long").alias("swap_seq"))


@register("JN2_as_of_version", f"WITH {_SWAP} SELECT event_id AS seq, (SELECT max(version) FROM sw WHERE swap_seq <= event_id) AS version FROM events")
def jn2(spark, sf):
    return joins.as_of_version(points(spark, sf).select("seq"), versions(spark, sf))


_KEEP = "kp AS (SELECT event_id + 1 AS orig_line, row_number() OVER (ORDER BY event_id) AS new_line FROM events WHERE event_type <> 'error')"


def kept_rows(spark, sf):
    e = table(spark, sf, "events").filter("event_type <> 'error'").select("event_id", (F.col("event_id") + 1).alias("orig_line"))
    return routing.dense_numbers(e, "event_id", "new_line")


@register("PRJ6_renumber", f"WITH {_KEEP} SELECT orig_line, new_line FROM kp")
def prj6(spark, sf):
    return kept_rows(spark, sf).select("orig_line", "new_line")


@register("JN10_previous_row", f"WITH {_KEEP}, {DR} SELECT drift_point AS point, coalesce((SELECT max(new_line) FROM kp WHERE orig_line <= drift_point), 1) AS new_line FROM dr")
def jn10(spark, sf):
    return joins.previous_row(drifts(spark, sf).select(F.col("drift_point").alias("point")), kept_rows(spark, sf))


@register("WIN23_stride", f"WITH {PT} SELECT seq FROM pt WHERE seq >= 500 AND (seq - 500) % 125 = 0")
def win23(spark, sf):
    return points(spark, sf).select("seq").filter("seq >= 500 AND (seq - 500) % 125 = 0")


# ---- classes -----------------------------------------------------------------------------------------------------------------

_CLS = "cf AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label)"


@register("AGG25_class_frequency", f"WITH {_CLS} SELECT label, n, round(n / (SELECT sum(n) FROM cf)::DOUBLE, 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM cf")
def agg25(spark, sf):
    return rounded(metrics.class_frequency(table(spark, sf, "embeddings"), "label"))


@register("PRJ5_relabel", f"WITH {_CLS} SELECT vec_id, CASE WHEN rank <= 2 THEN 0 ELSE 1 END AS new_label FROM embeddings JOIN cf USING (label) WHERE rank <= 2 OR rank = (SELECT max(rank) FROM cf)")
def prj5(spark, sf):
    return metrics.relabel(table(spark, sf, "embeddings").select("vec_id", "label"), "label").select("vec_id", "new_label")


@register("SET2_discarded_classes", f"WITH {_CLS} SELECT label FROM cf EXCEPT SELECT label FROM cf WHERE rank <= 2 OR rank = (SELECT max(rank) FROM cf)")
def set2(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return e.select("label").distinct().exceptAll(metrics.relabel(e, "label").select("label").distinct())


@register("AGG32_pool_diagnostics", f"WITH {PT}, z AS (SELECT label, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq DESC) AS r, CAST(seq % 4 AS INTEGER) AS shard FROM pt) SELECT shard, count(*) AS size, count(*) FILTER (label = 1) AS anomalies, round(count(*) FILTER (label = 1) / count(*)::DOUBLE, 6) AS fraction FROM z WHERE r <= 1000 GROUP BY shard")
def agg32(spark, sf):
    p = points(spark, sf).select("seq", "label", (F.col("seq") % 4).cast("int").alias("shard"))
    ring = routing.last_of_each(p, "shard", "seq", 1000)
    return rounded(ring.groupBy("shard").agg(F.count("*").alias("size"), F.count_if(F.col("label") == 1).alias("anomalies"), F.avg((F.col("label") == 1).cast("double")).alias("fraction")))
