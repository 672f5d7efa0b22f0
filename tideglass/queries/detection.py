"""Detectors that keep state, and what is computed from their onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.config import HddmConfig, IksConfig, PerFeatureHddmConfig
from tideglass.operators import detectors, metrics, quorum
from tideglass.operators.running import sliding
from tideglass.queries.base import OFF, SV, Registry, drifts, rounded, shifted_values, table
from tideglass.queries.windows import spans

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

IKS = IksConfig(window=400, confirm_window=400)
HDDM = PerFeatureHddmConfig(warmup=400, hddm=HddmConfig(lam=0.01))

_UNIT = f"{SV}, z AS (SELECT feature_id, seq, row_number() OVER (PARTITION BY feature_id ORDER BY seq) AS n, value / 490.0::DOUBLE AS x FROM sv)"


def unit(spark, sf):
    return shifted_values(spark, sf).withColumn("value", F.col("value") / 490.0)


# The fold e <- 0.99 e + 0.01 x, started at the first value, in closed form: a sum of the values over growing powers, taken block by block of
# 500 rows so that powers stay in range, is not exact enough; a recursion over rows is.
_EWMA = f"""WITH RECURSIVE {_UNIT}, w AS (SELECT n, list(x ORDER BY feature_id) AS xs, any_value(seq) AS seq FROM z GROUP BY n),
f(n, seq, es) AS (SELECT n, seq, xs FROM w WHERE n = 1 UNION ALL SELECT w.n, w.seq, list_transform(range(1, len(xs) + 1), lambda i: (1.0::DOUBLE - 0.01::DOUBLE) * es[i] + 0.01::DOUBLE * xs[i]) FROM f JOIN w ON w.n = f.n + 1),
e AS (SELECT CAST(i - 1 AS INTEGER) AS feature_id, n, seq, es[i] AS ewma FROM f, range(1, 5) r(i))"""
_EPS = "sqrt(0.01::DOUBLE * ln(1000.0::DOUBLE) / (2.0::DOUBLE * (2.0::DOUBLE - 0.01::DOUBLE)))"
_RATIO = "sqrt(ln(1000.0::DOUBLE) / ln(200.0::DOUBLE))"


@register("WIN2_ewma", f"{_EWMA} SELECT feature_id, seq, round(ewma + {OFF}, 6) AS ewma FROM e")
def win2(spark, sf):
    out = detectors.hddm_w(unit(spark, sf), HDDM.hddm)
    return out.select("feature_id", "seq", F.round(F.col("ewma") + OFF, 6).alias("ewma"))


@register("DET4_hddm_w", f"{_EWMA}, b AS (SELECT *, min(ewma) OVER (PARTITION BY feature_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS best FROM e) SELECT feature_id, seq, CASE WHEN ewma - {_EPS} > best + {_EPS} * {_RATIO} THEN 'DRIFT' WHEN ewma - {_EPS} > best + {_EPS} / {_RATIO} THEN 'WARN' ELSE 'STABLE' END AS status FROM b")
def det4(spark, sf):
    return detectors.hddm_w(unit(spark, sf), HDDM.hddm).select("feature_id", "seq", "status")


#: KS of the first 400 values against the 400 up to each row from the 400th: counted over the values of both.
_LOOKS = """lk AS (SELECT feature_id, n AS looked FROM z WHERE n >= 400),
vals AS (SELECT l.feature_id, l.looked, z.x, CASE WHEN z.n <= 400 THEN -1 ELSE 0 END + CASE WHEN z.n > l.looked - 400 THEN 1 ELSE 0 END AS d FROM lk l JOIN z ON z.feature_id = l.feature_id AND (z.n <= 400 OR (z.n > l.looked - 400 AND z.n <= l.looked))),
g AS (SELECT feature_id, looked, x, sum(sum(d)) OVER (PARTITION BY feature_id, looked ORDER BY x) AS g FROM vals GROUP BY feature_id, looked, x), ks AS (SELECT feature_id, looked, max(abs(g)) / 400.0::DOUBLE AS ks FROM g GROUP BY feature_id, looked)"""


class _FixedKs:
    def __init__(self, w: int):
        self.w, self.n, self.warm, self.win = w, 0, [], None

    def step(self, v: float) -> float | None:
        self.n += 1
        if self.win is None:
            self.warm.append(v)
            if len(self.warm) < self.w:
                return None
            self.win = detectors.KsWindow(self.warm)
        else:
            self.win.slide(v)
        return self.win.ks()


@register("WIN7_reference_ks", f"WITH {_UNIT}, {_LOOKS} SELECT feature_id, looked, round(ks, 6) AS ks FROM ks")
def win7(spark, sf):
    """The statistic of a fixed reference against a sliding window, at every row from the 400th."""
    step = lambda s, g, v: [(g, s.n, ks)] if (ks := s.step(v)) is not None else []
    return rounded(detectors.sequential(unit(spark, sf), "feature_id", ["seq"], ["value"], lambda: _FixedKs(400), step, "feature_id int, looked bigint, ks double"))


@register("DET1_iks", f"WITH {_UNIT}, {_LOOKS} SELECT z.feature_id, z.seq, CASE WHEN ks > sqrt(-0.5::DOUBLE * ln(0.001::DOUBLE)) * sqrt(2.0::DOUBLE / 400) THEN 'DRIFT' ELSE 'STABLE' END AS status FROM z LEFT JOIN ks ON ks.feature_id = z.feature_id AND ks.looked = z.n")
def det1(spark, sf):
    """The status of the sliding test at every row, those of the warm-up included."""
    return detectors.statuses(unit(spark, sf), lambda: detectors.Iks(IKS))


@register("DET1a_value_slots", f"WITH {_UNIT}, {_LOOKS} SELECT feature_id, round(max(ks), 6) AS max_ks, count(*) AS looks FROM ks GROUP BY feature_id")
def det1a(spark, sf):
    """What an ordered map of counts does elsewhere is done by slots of the reference's values: the largest statistic of each feature
    over all rows from the 400th."""
    step = lambda s, g, v: [(g, ks)] if (ks := s.step(v)) is not None else []
    ks = detectors.sequential(unit(spark, sf), "feature_id", ["seq"], ["value"], lambda: _FixedKs(400), step, "feature_id int, ks double")
    return rounded(ks.groupBy("feature_id").agg(F.max("ks").alias("max_ks"), F.count("*").alias("looks")))


@register("DET1b_excess_counts", f"WITH {_UNIT}, {_LOOKS} SELECT feature_id, looked, CAST(max(g) AS BIGINT) AS max_excess, CAST(min(g) AS BIGINT) AS min_excess FROM g GROUP BY feature_id, looked")
def det1b(spark, sf):
    """Largest and smallest excess of current over reference values below a value, at every row from the 400th."""
    import numpy as np

    def step(s, g, v):
        if s.step(v) is None:
            return []
        held = s.win.excess != 0
        held[1::2] = True  # the reference's values; of the slots between them, those that hold current values
        points = np.cumsum(s.win.excess)[held]
        return [(g, s.n, int(points.max()), int(points.min()))]

    out = detectors.sequential(unit(spark, sf), "feature_id", ["seq"], ["value"], lambda: _FixedKs(400), step, "feature_id int, looked bigint, max_excess bigint, min_excess bigint")
    return out


@register("DET1c_rebase")
def det1c(spark, sf):
    """Onsets with the two ways of rebasing: warm up again, or take the current window as the reference."""
    out = None
    for way in ("reset", "slide"):
        o = detectors.onsets(shifted_values(spark, sf), "iks", IksConfig(window=400, confirm_window=400, rebase=way)).withColumn("rebase", F.lit(way))
        out = o if out is None else out.unionByName(o)
    return rounded(out)


#: Onsets as segments, each with the reference from row r0: in steps of 1,000 looks after row pos, the first above the threshold opens the gate, the
#: 400th row after it closes it with the peak, and the next reference begins.
_IKS_ONSETS = f"""WITH RECURSIVE {_UNIT}, top AS (SELECT feature_id, max(n) AS n_rows FROM z GROUP BY feature_id),
ik(feature_id, r0, pos, s, peak) AS (SELECT feature_id, CAST(1 AS BIGINT), CAST(400 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM top UNION ALL (
WITH cur AS (SELECT ik.feature_id, r0, pos, n_rows FROM ik JOIN top USING (feature_id) WHERE pos < n_rows),
lk AS (SELECT c.feature_id, r0, pos, z.n AS looked FROM cur c JOIN z ON z.feature_id = c.feature_id AND z.n > pos AND z.n <= pos + 1500),
vals AS (SELECT l.feature_id, l.looked, z.x, CASE WHEN z.n BETWEEN r0 AND r0 + 399 THEN -1 ELSE 0 END + CASE WHEN z.n > l.looked - 400 AND z.n <= l.looked THEN 1 ELSE 0 END AS d FROM lk l JOIN z ON z.feature_id = l.feature_id AND z.n >= r0 AND z.n <= l.looked AND (z.n < r0 + 400 OR z.n > l.looked - 400)),
g AS (SELECT feature_id, looked, sum(sum(d)) OVER (PARTITION BY feature_id, looked ORDER BY x) AS g FROM vals GROUP BY feature_id, looked, x),
ks AS (SELECT feature_id, looked, max(abs(g)) / 400.0::DOUBLE AS ks FROM g GROUP BY feature_id, looked),
fs AS (SELECT c.feature_id, r0, pos, n_rows, (SELECT min(looked) FROM ks WHERE ks.feature_id = c.feature_id AND looked <= pos + 1000 AND ks.ks > sqrt(-0.5::DOUBLE * ln(0.001::DOUBLE)) * sqrt(2.0::DOUBLE / 400)) AS s FROM cur c)
SELECT feature_id, CASE WHEN s IS NULL THEN r0 ELSE s + 401 END, CASE WHEN s IS NULL THEN pos + 1000 ELSE s + 800 END, CASE WHEN s + 400 <= n_rows THEN s END, (SELECT max(ks.ks) FROM ks WHERE ks.feature_id = fs.feature_id AND looked BETWEEN fs.s AND fs.s + 400) FROM fs)),
on_ AS (SELECT feature_id, s - 1 AS seq, round(peak, 6) AS ks, s + 399 AS emit_seq FROM ik WHERE s IS NOT NULL)"""


@register("DET5_feature_iks", f"{_IKS_ONSETS} SELECT * FROM on_")
def det5(spark, sf):
    return rounded(detectors.onsets(shifted_values(spark, sf), "iks", IKS))


@register("WIN8_confirm_gate", f"{_IKS_ONSETS} SELECT feature_id, count(*) AS n, max(ks) AS peak, min(emit_seq - seq) AS least_wait FROM on_ GROUP BY feature_id")
def win8(spark, sf):
    """Peaks that the confirm gate reports, by feature."""
    o = detectors.onsets(shifted_values(spark, sf), "iks", IKS)
    return rounded(o.groupBy("feature_id").agg(F.count("*").alias("n"), F.max("ks").alias("peak"), F.min(F.col("emit_seq") - F.col("seq")).alias("least_wait")))


def _hddm_sql() -> str:
    """The warm-up and the EWMA detector of each feature as a fold over its values, whose state is that of the machine."""
    signal = "least(abs(v.x - a.ref) / a.scale, 1.0::DOUBLE)"
    e = f"(CASE WHEN a.e IS NULL THEN {signal} ELSE (1.0::DOUBLE - 0.01::DOUBLE) * a.e + 0.01::DOUBLE * {signal} END)"
    best = f"least(coalesce(a.b, {e}), {e})"
    fires = f"{e} - {_EPS} > {best} + {_EPS} * {_RATIO}"
    total, dev = "(a.total + v.x)", "abs(v.x - (a.total + v.x) / (a.n + 1))"
    warm = "a.ref IS NULL"

    def state(x="v.x", seq="v.seq", n="0", total="0.0::DOUBLE", devs="[]::DOUBLE[]", ref="NULL::DOUBLE", scale="NULL::DOUBLE", e="NULL::DOUBLE", b="NULL::DOUBLE", found="[]::STRUCT(seq BIGINT, ks DOUBLE)[]"):
        return f"{{'x': {x}, 'seq': {seq}, 'n': CAST({n} AS BIGINT), 'total': {total}, 'devs': {devs}, 'ref': {ref}, 'scale': {scale}, 'e': {e}, 'b': {b}, 'found': {found}}}"

    step = f"""CASE WHEN {warm} AND a.n + 1 < 400 THEN {state(n="a.n + 1", total=total, devs=f"list_append(a.devs, {dev})", found="a.found")}
WHEN {warm} THEN {state(ref=f"{total} / (a.n + 1)", scale=f"greatest(list_sort(list_append(a.devs, {dev}))[396], 1e-12::DOUBLE)", found="a.found")}
WHEN {fires} THEN {state(found=f"list_append(a.found, {{'seq': v.seq, 'ks': {signal}}})")}
ELSE {state(ref="a.ref", scale="a.scale", e=e, b=best, found="a.found")} END"""
    return f"WITH {SV}, l AS (SELECT feature_id, list({state(x='value', seq='seq')} ORDER BY seq) AS l FROM sv GROUP BY feature_id), r AS (SELECT feature_id, list_reduce(list_prepend({state(x='0.0::DOUBLE', seq='CAST(-1 AS BIGINT)')}, l), lambda a, v: {step}).found AS found FROM l), u AS (SELECT feature_id, unnest(found) AS f FROM r) SELECT feature_id, f.seq AS seq, round(f.ks, 6) AS ks, f.seq AS emit_seq FROM u"


@register("DET6_feature_hddm", _hddm_sql())
def det6(spark, sf):
    return rounded(detectors.onsets(shifted_values(spark, sf), "hddm_w", hddm=HDDM))


_CHECKS = {
    "confidences": (7, "{} < 1 OR {} >= 5"),
    "k": (5, "{} < 1"),
    "lambda": (30, "{} < 1 OR {} > 20"),
    "p_value": (13, "{} < 1 OR {} > 9"),
    "timeout": (4, "{} < 1"),
    "window": (6, "{} < 1"),
}


@register("DET8_config_checks", "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS parameter, CAST(user_id % {m} AS INTEGER) AS step, {c.format(f'user_id % {m}', f'user_id % {m}')} AS rejected FROM events" for p, (m, c) in _CHECKS.items()) + ")")
def det8(spark, sf):
    """Which values, made from those of a table, a configuration rejects: confidences k / 1000 against 5 / 1000, lambda k / 20, p-values k / 10."""
    from tideglass.config import QuorumConfig

    def rejects(make, k: int) -> bool:
        try:
            make(k)
        except ValueError:
            return True
        return False

    cases = {"confidences": lambda k: HddmConfig(drift_confidence=k / 1000, warn_confidence=5 / 1000), "lambda": lambda k: HddmConfig(lam=k / 20), "timeout": lambda k: HddmConfig(warn_timeout=k), "window": lambda k: IksConfig(window=k), "p_value": lambda k: IksConfig(p_value=k / 10), "k": lambda k: QuorumConfig(k=k)}
    users = [r["user_id"] for r in table(spark, sf, "events").select("user_id").distinct().collect()]
    rows = {(p, int(u % m), rejects(cases[p], int(u % m))) for p, (m, _) in _CHECKS.items() for u in users}
    return spark.createDataFrame(sorted(rows), "parameter string, step int, rejected boolean")


@register("DET10_offline_iks")
def det10(spark, sf):
    return rounded(detectors.offline_iks(shifted_values(spark, sf), 400, 0.001, stride=25, confirm=8).filter("kind <> 'look'"))


_SIGNAL = f"{SV}, nn AS (SELECT feature_id, seq, value, row_number() OVER (PARTITION BY feature_id ORDER BY seq) AS n FROM sv), rf AS (SELECT feature_id, avg(value) AS ref FROM nn WHERE n <= 400 GROUP BY feature_id), sc AS (SELECT feature_id, any_value(ref) AS ref, greatest(quantile_cont(abs(value - ref), 0.99), 1e-12) AS scale FROM nn JOIN rf USING (feature_id) WHERE n <= 400 GROUP BY feature_id), sn AS (SELECT feature_id, seq, n, CASE WHEN n > 400 THEN least(abs(value - ref) / scale, 1.0::DOUBLE) END AS signal FROM nn JOIN sc USING (feature_id))"


@register("DET11_offline_signal", f"WITH {_SIGNAL} SELECT feature_id, seq, round(signal, 6) AS signal FROM sn")
def det11(spark, sf):
    return rounded(detectors.offline_signal(shifted_values(spark, sf), 400).select("feature_id", "seq", "signal"))


def _offline_sql() -> str:
    """The EWMA detector over each feature's signal as a fold; a fire resets it and skips 400 rows."""
    e = "(CASE WHEN a.e IS NULL THEN v.x ELSE (1.0::DOUBLE - 0.01::DOUBLE) * a.e + 0.01::DOUBLE * v.x END)"
    best = f"least(coalesce(a.b, {e}), {e})"

    def state(x="v.x", n="v.n", e="NULL::DOUBLE", b="NULL::DOUBLE", skip="0", found="a.found"):
        return f"{{'x': {x}, 'n': {n}, 'e': {e}, 'b': {b}, 'skip': CAST({skip} AS BIGINT), 'found': {found}}}"

    step = f"CASE WHEN a.skip > 0 THEN {state(skip='a.skip - 1')} WHEN {e} - {_EPS} > {best} + {_EPS} * {_RATIO} THEN {state(skip='400', found='list_append(a.found, v.n - 1)')} ELSE {state(e=e, b=best)} END"
    start, row = state(x="0.0::DOUBLE", n="CAST(0 AS BIGINT)", found="[]::BIGINT[]"), state(x="signal", n="n", found="[]::BIGINT[]")
    return f"WITH {_SIGNAL}, l AS (SELECT feature_id, list({row} ORDER BY n) AS l FROM sn WHERE signal IS NOT NULL GROUP BY feature_id) SELECT feature_id, unnest(list_reduce(list_prepend({start}, l), lambda a, v: {step}).found) AS fire FROM l"


@register("DET11_offline_hddm", _offline_sql())
def det11_fires(spark, sf):
    return detectors.offline_hddm(detectors.offline_signal(shifted_values(spark, sf), 400), 400, HDDM.hddm)


@register("DET12_sliding_test", f"WITH {_UNIT}, {_LOOKS} SELECT feature_id, looked, round(max(abs(g)) / 400.0::DOUBLE, 6) AS ks, round((greatest(max(g), 0) - least(min(g), 0)) / 400.0::DOUBLE, 6) AS kuiper, max(abs(g)) / 400.0::DOUBLE > 1.95::DOUBLE * sqrt(2.0::DOUBLE / 400) AS fires FROM g GROUP BY feature_id, looked")
def det12(spark, sf):
    """The stand-alone object: increment, then ks, kuiper and test(1.95) at every row from the 400th."""

    class State:
        def __init__(self):
            self.n, self.warm, self.sw = 0, [], None

    def step(s, g, v):
        s.n += 1
        if s.sw is None:
            s.warm.append(v)
            if len(s.warm) == 400:
                s.sw = detectors.IksSw(s.warm)
        else:
            s.sw.increment(v)
        return [(g, s.n, s.sw.ks(), s.sw.kuiper(), s.sw.test(1.95))] if s.sw else []

    return rounded(detectors.sequential(unit(spark, sf), "feature_id", ["seq"], ["value"], State, step, "feature_id int, looked bigint, ks double, kuiper double, fires boolean"))


# ---- sweeps ----------------------------------------------------------------------------------------------------------------------


def _drift_list(spark, sf):
    return [(r["start"], r["end"]) for r in spans(spark, sf).orderBy("drift_idx").collect()]


def _replay(spark, sf, confirm: int):
    return detectors.offline_iks(shifted_values(spark, sf), 400, 0.001, stride=25, confirm=confirm)


def _sweep(spark, sf):
    grid = spark.createDataFrame([(k, m, p, r) for k in (1, 2, 3) for m in (0.0, 0.1, 0.2) for p in (1, 3) for r in (0, 400)], "k int, ks_min double, persist int, refractory int").coalesce(1)
    return quorum.sweep(_replay(spark, sf, 0), _drift_list(spark, sf), grid, 1.8584610944 * (2 / 400) ** 0.5, 400, 400)


@register("AGG35_precision_sweep")
def agg35(spark, sf):
    return rounded(_sweep(spark, sf))


@register("WIN11_persistent_quorum")
def win11(spark, sf):
    """The sweep's cells that need three looks in a row."""
    return rounded(_sweep(spark, sf).filter("persist = 3"))


def _calibration(spark, sf):
    grid = spark.createDataFrame([(2, round(0.01 * i, 3), 400) for i in range(26)], "k int, ks_confirm double, refractory int").coalesce(1)
    return quorum.confirm_sweep(_replay(spark, sf, 8), _drift_list(spark, sf), grid, 400, 400)


@register("DET9_confirm_calibration")
def det9(spark, sf):
    return rounded(_calibration(spark, sf))


@register("SRT3_operating_point")
def srt3(spark, sf):
    """Best cells: of the sweep, the most precise among those with the highest recall, then the least latency; of the calibration, the fewest
    onsets, then the highest threshold."""
    s = _sweep(spark, sf)
    top = s.crossJoin(F.broadcast(s.agg(F.max("recall").alias("_top")))).filter("recall = _top").drop("_top")
    key = F.struct(-F.coalesce("precision", F.lit(0.0)), F.coalesce(F.abs("median_latency"), F.lit(1e9)), F.col("k"), F.col("ks_min"), F.col("refractory"), F.col("persist"))
    point = top.agg(F.min_by(F.struct(*top.columns), key).alias("b")).select(F.lit("sweep").alias("of"), "b.*")
    c = _calibration(spark, sf)
    best = c.crossJoin(F.broadcast(c.agg(F.max("recall").alias("_top")))).filter("recall = _top").drop("_top")
    pick = best.agg(F.min_by(F.struct(*best.columns), F.struct(F.col("n_onsets"), -F.col("ks_min"))).alias("b")).select(F.lit("calibration").alias("of"), "b.*")
    return rounded(point.unionByName(pick))


@register("AGG37_sweep_verdict")
def agg37_sweep(spark, sf):
    s = _sweep(spark, sf)
    return s.agg(F.max("recall").alias("r")).select(metrics.verdict(F.col("r"), F.col("r")).alias("verdict"))


@register("PRJ13_morphology", "SELECT DISTINCT user_id % 4 AS k, CASE WHEN user_id % 4 = 0 THEN 'registered' WHEN user_id % 4 = 1 THEN 'abrupt' WHEN user_id % 4 = 2 THEN 'gradual' ELSE 'unknown' END AS morphology FROM events")
def prj13(spark, sf):
    """The drift's kind: the registry's word, else what the dataset's name says, else unknown."""
    k = (F.col("user_id") % 4).alias("k")
    d = table(spark, sf, "events").select(k).distinct().withColumns({"drift_type": F.when(F.col("k") == 0, "registered"), "name": F.element_at(F.array(F.lit("x"), F.lit("set_abrupt"), F.lit("set_gradual_2"), F.lit("other")), (F.col("k") + 1).cast("int"))})
    named = F.coalesce(*(F.when(F.col("name").contains(m), m) for m in ("abrupt", "gradual", "incremental", "reoccurring")))
    return d.select("k", F.coalesce("drift_type", named, F.lit("unknown")).alias("morphology"))


@register("drift_smoothing", f"WITH {_SIGNAL} SELECT feature_id, seq, round(avg(signal) OVER (PARTITION BY feature_id ORDER BY n ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean FROM sn")
def smoothing(spark, sf):
    s = detectors.offline_signal(shifted_values(spark, sf), 400)
    return rounded(sliding(s, ["feature_id"], "n", 99, {"mean": F.avg("signal")}).select("feature_id", "seq", "mean"))


@register("drift_points")
def points_of(spark, sf):
    return drifts(spark, sf)


ORACLES["drift_points"] = "SELECT CAST(k AS INTEGER) AS drift_idx, CAST(floor(n * t / CAST(10 AS DOUBLE)) AS BIGINT) AS drift_point FROM (SELECT count(*) AS n FROM events), (VALUES (0, 3), (1, 5), (2, 8)) v(k, t)"
