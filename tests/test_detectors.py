import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.config import DriftStatus, HddmConfig, IksConfig, PerFeatureHddmConfig, QuorumConfig
from tideglass.operators import detectors, quorum


def gauss(n: int, mu: float, sigma: float, seed: int) -> list[float]:
    r = random.Random(seed)
    return [r.gauss(mu, sigma) for _ in range(n)]


def clamp(xs):
    return [min(1.0, max(0.0, x)) for x in xs]


def first_drift(d, xs):
    return next((i for i, x in enumerate(xs) if d.update(x) is DriftStatus.DRIFT), None)


def test_hddm_w_abrupt():
    d = detectors.HddmW()
    assert first_drift(d, clamp(gauss(2000, 0.05, 0.02, 1))) is None
    at = first_drift(d, clamp(gauss(2000, 0.95, 0.02, 2)))
    assert at is not None and at < 1000


def test_hddm_a():
    d = detectors.HddmA()
    assert first_drift(d, clamp(gauss(5000, 0.5, 0.1, 3))) is None
    assert first_drift(d, clamp(gauss(5000, 0.7, 0.1, 4))) is not None
    d.reset()
    assert d.sample_count == 0
    assert first_drift(detectors.HddmA(), clamp(gauss(5000, 0.5, 0.1, 5))) is None


def test_smaller_windows_fire_first():
    xs = clamp(gauss(3000, 0.3, 0.05, 6)) + clamp(gauss(3000, 0.8, 0.05, 7))
    at = [first_drift(detectors.HddmAWindowed(HddmConfig(window=w)), xs) for w in (500, 2000)]
    assert at[0] is not None and (at[1] is None or at[0] < at[1])


def test_warn_timeout():
    d = detectors.HddmA(HddmConfig(warn_timeout=5))
    d.n, d.warn_from = 20, 15
    assert d.warn_timed_out()
    d.warn_from = 16
    assert not d.warn_timed_out()


def brute_ks(a, b):
    points = sorted({*a, *b})
    return max(abs(sum(x <= p for x in a) - sum(x <= p for x in b)) for p in points) / len(a)


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_ks_window_with_ties(digits):
    r = random.Random(digits)
    ref = [round(r.random() * 5, digits) for _ in range(30)]
    w, cur = detectors.KsWindow(ref), list(ref)
    for _ in range(80):
        v = round(r.random() * 6, digits)
        w.slide(v)
        cur = cur[1:] + [v]
        assert w.ks() == pytest.approx(brute_ks(ref, cur))
        points = sorted({*ref, *cur})
        g = [sum(x <= p for x in cur) - sum(x <= p for x in ref) for p in points]
        assert w.kuiper() == pytest.approx((max(*g, 0) - min(*g, 0)) / 30)


def test_iks_disjoint():
    r = random.Random(1)
    d = detectors.Iks(IksConfig(window=100))
    assert first_drift(d, [r.random() / 2 for _ in range(100)]) is None
    seen = [d.update(0.5 + r.random() / 2) for _ in range(100)]
    assert DriftStatus.DRIFT in seen and d.last_ks == 1.0
    d.rebase()
    assert d.sample_count == 0
    s = detectors.IksSw([0.0] * 50)
    s.increment(1.0)
    assert s.ks() == pytest.approx(0.02) and not s.test()
    s.update()
    assert s.ks() == 0


def feature(spark, xs, f=0):
    return spark.createDataFrame([(f, float(x), i) for i, x in enumerate(xs)], "feature_id int, value double, seq long")


def test_confirm_gate(spark):
    cfg = IksConfig(window=200, confirm_window=200)
    moved = feature(spark, gauss(400, 0, 1, 1) + gauss(400, 10, 1, 2))
    still = feature(spark, gauss(800, 0, 1, 3), 1)
    rows = detectors.onsets(moved.unionByName(still), "iks", cfg).collect()
    assert rows and {r["feature_id"] for r in rows} == {0}
    assert all(r["seq"] >= 200 and r["ks"] > 0 and r["emit_seq"] - r["seq"] >= 200 for r in rows)
    high = IksConfig(window=200, confirm_window=200, ks_confirm=1.1)
    assert detectors.onsets(moved, "iks", high).count() == 0


@pytest.mark.parametrize("mode", ["p99", "maxdev"])
def test_feature_hddm(spark, mode):
    cfg = PerFeatureHddmConfig(warmup=200, scale_mode=mode)
    rows = detectors.onsets(feature(spark, gauss(400, 0, 1, 4) + gauss(800, 20, 1, 5)), "hddm_w", hddm=cfg).collect()
    assert rows and all(r["seq"] >= 200 for r in rows)


def test_windows_equal_objects(spark):
    xs = clamp(gauss(700, 0.3, 0.1, 8) + gauss(700, 0.6, 0.1, 9))
    df = feature(spark, xs)
    for frame, make in ((detectors.hddm_a(df), detectors.HddmA), (detectors.hddm_a_windowed(df, HddmConfig(window=100)), lambda: detectors.HddmAWindowed(HddmConfig(window=100)))):
        d = make()
        want = [d.update(x).value for x in xs]
        assert [r["status"] for r in frame.orderBy("seq").collect()] == want


def test_running_over_blocks(spark, monkeypatch):
    from tideglass.operators import running

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 3).alias("n"), F.sin(F.col("id")).alias("x"))
    got = running.running(df, ["g"], "n", {"s": ("sum", F.col("x")), "m": ("min", F.col("x")), "c": ("count", F.lit(1)), "top": ("max", F.col("x"))}, F.floor(F.col("n") / 17))
    slid = running.sliding(df, ["g"], "n", 9, {"a": F.sum("x")}, block=17)
    x = {(r["g"], r["n"]): r["x"] for r in df.collect()}
    for r in got.collect():
        own = [x[r["g"], k] for k in range(r["n"] + 1)]
        assert r["s"] == pytest.approx(sum(own), abs=1e-9) and (r["m"], r["top"], r["c"]) == (min(own), max(own), len(own))
    fast = {(r["g"], r["n"]): (r["m"], r["k"]) for r in running.sliding_mean(df, ["g"], "n", 10, "x", "m", "k", block=17).collect()}
    rows = slid.collect()
    assert len(rows) == 1000
    for r in rows:
        own = [x[r["g"], k] for k in range(max(0, r["n"] - 9), r["n"] + 1)]
        assert fast[r["g"], r["n"]] == (pytest.approx(sum(own) / len(own), abs=1e-9), len(own))
        assert r["a"] == pytest.approx(sum(x[r["g"], k] for k in range(max(0, r["n"] - 9), r["n"] + 1)), abs=1e-9)


@pytest.mark.parametrize("events,refractory,rounds", [([(3, 100), (3, 200), (3, 300)], 0, []), ([(0, 100), (1, 500)], 0, [(1, 500, 2)]), ([(0, 100), (1, 200), (2, 300), (3, 400)], 10000, [(1, 200, 2)]), ([(0, 100), (1, 200), (2, 1000), (3, 1100)], 500, [(1, 200, 2), (2, 1100, 2)])])
def test_quorum(spark, events, refractory, rounds):
    q = quorum.Quorum(QuorumConfig(2, 1000, refractory))
    assert [(r[0], r[1], r[3]) for f, s in events if (r := q.step(f, s))] == rounds
    df = spark.createDataFrame([(f, s, s) for f, s in events], "feature_id int, seq long, emit_seq long")
    got = quorum.commit_rounds(df, QuorumConfig(2, 1000, refractory)).orderBy("round_id").collect()
    assert [(r["round_id"], r["seq"], r["votes_yes"]) for r in got] == rounds


def test_grid_quorum_and_metrics():
    edges = [(0, 10), (1, 12), (0, 50), (1, 51), (2, 52)]
    assert quorum.grid_quorum(edges, list(range(0, 100, 5)), 2, 1, 0, 5) == [15, 55]
    assert quorum.grid_quorum(edges, list(range(0, 100, 5)), 2, 1, 100, 5) == [15]
    m = quorum.label_metrics([(10, 11), (80, 81)], [15, 55], 10)
    assert (m["recall"], m["precision"], m["median_latency"], m["n_false"]) == (0.5, 0.5, 5.0, 1)
    assert quorum.label_metrics([], [1], 5)["recall"] is None


def test_offline_replay_counts():
    o = detectors.OfflineIks(100, 0.001, stride=10, confirm=3)
    xs = np.concatenate([np.random.default_rng(1).random(300), 2 + np.random.default_rng(2).random(300)])
    events = [e for x in xs for e in o.step(float(x))]
    kinds = [k for _, k, _ in events]
    assert kinds.count("look") == 50 and kinds.count("crossing") >= 1
    crossing = next(e for e in events if e[1] == "crossing")
    assert crossing[0] in [e[0] for e in events if e[1] == "onset"] and crossing[2] > 0.2


@pytest.mark.parametrize("make", [detectors.HddmA, detectors.HddmAWindowed, detectors.HddmW])
def test_warn_timer_ends_at_a_drift(make):
    """WARN, DRIFT, WARN: the time of a warning counts from the last row that was not one, in the object as in the window form."""
    d = make(HddmConfig(warn_timeout=50, window=60, lam=0.05))
    rnd = np.random.default_rng(3)
    values = [*(0.1 + 0.02 * rnd.random(300)), *np.linspace(0.1, 0.9, 300), *([0.9] * 100), *np.linspace(0.9, 0.2, 300), *([0.2] * 100)]
    since, seen = None, set()
    for n, v in enumerate(values, 1):
        status = d.update(float(v))
        since = (since or n) if status is detectors.WARN else None
        seen.add(status)
        assert d.warn_from == since and d.warn_timed_out() == (since is not None and n - since >= 50)
    assert {detectors.WARN, detectors.DRIFT} <= seen
