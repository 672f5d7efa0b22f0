"""Rounds: when enough features report an onset close together."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.config import QuorumConfig
from tideglass.operators.detectors import sequential


class Quorum:
    """Keeps each feature's last onset; those within `window` before the latest count. Onsets during the refractory time are kept but
    commit nothing. A commit clears them."""

    def __init__(self, config: QuorumConfig):
        self.config, self.recent, self.rounds, self.last = config, {}, 0, None

    def step(self, feature: int, seq: int) -> tuple[int, int, str, int] | None:
        """(round, seq, status, yes votes) if this onset commits a round."""
        self.recent[feature] = seq
        self.recent = {f: s for f, s in self.recent.items() if s >= seq - self.config.window}
        if self.last is not None and seq - self.last < self.config.refractory:
            return None
        if len(self.recent) < self.config.k:
            return None
        votes, self.recent, self.last, self.rounds = len(self.recent), {}, seq, self.rounds + 1
        return self.rounds, seq, "COMMITTED", votes


ROUNDS = "run string, round_id bigint, seq bigint, status string, votes_yes int"


def commit_rounds(onsets: DataFrame, config: QuorumConfig | None = None, run: str | None = None) -> DataFrame:
    """onsets: feature_id, seq, emit_seq (and a run column) -> committed rounds. Onsets are taken in the order in which they were
    reported; there are few, one stream of them per run."""
    config = config or QuorumConfig()
    rows = onsets.withColumn("_run", F.col(run).cast("string") if run else F.lit(""))
    step = lambda s, g, f, seq: [(g, *r)] if (r := s.step(f, seq)) else []
    return sequential(rows, "_run", ["emit_seq", "feature_id", "seq"], ["feature_id", "seq"], lambda: Quorum(config), step, ROUNDS)


def distinct_in_window(onsets: DataFrame, window: int) -> DataFrame:
    """seq, feature_id, n_features: how many features have an onset in [seq - window, seq]."""
    near = Window.orderBy("seq").rangeBetween(-window, 0)
    return onsets.select("seq", "feature_id", F.size(F.collect_set("feature_id").over(near)).alias("n_features"))


def armed_quorum(onsets: DataFrame, k: int, window: int) -> DataFrame:
    """seq of onsets where at least k features are in the window and were not at the onset before (in the order of seq, feature)."""

    class State:
        def __init__(self):
            self.events, self.armed = deque(), False

    def step(s: State, g, f, seq):
        s.events.append((seq, f))
        while s.events[0][0] < seq - window:
            s.events.popleft()
        full = len({x for _, x in s.events}) >= k
        out = [(seq,)] if full and not s.armed else []
        s.armed = full
        return out

    return sequential(onsets.withColumn("_g", F.lit(0)), "_g", ["seq", "feature_id"], ["feature_id", "seq"], State, step, "seq bigint")


def grid_quorum(edges: list[tuple[int, int]], grid: list[int], k: int, persist: int, refractory: int, window: int) -> list[int]:
    """edges: (feature, seq). Grid points where at least k features have an edge in [point - window, point], for `persist` points in
    a row, `refractory` or more after the last such onset."""
    edges, at, streak, last, out = sorted(edges, key=lambda e: e[1]), 0, 0, None, []
    inside: deque = deque()
    for p in grid:
        while at < len(edges) and edges[at][1] <= p:
            inside.append(edges[at])
            at += 1
        while inside and inside[0][1] < p - window:
            inside.popleft()
        streak = streak + 1 if len({f for f, _ in inside}) >= k else 0
        if streak >= persist and (last is None or p >= last + refractory):
            out.append(p)
            last = p
    return out


def event_quorum(onsets: DataFrame, k: int, window: int, refractory: int) -> DataFrame:
    """seq of commits where k or more onsets (not features) lie in the window, more than `refractory` after the last commit."""

    class State:
        def __init__(self):
            self.events, self.last = deque(), None

    def step(s: State, g, seq):
        s.events.append(seq)
        while s.events[0] < seq - window:
            s.events.popleft()
        if len(s.events) >= k and (s.last is None or seq - s.last > refractory):
            s.last = seq
            return [(seq,)]
        return []

    return sequential(onsets.withColumn("_g", F.lit(0)), "_g", ["seq", "feature_id"], ["seq"], State, step, "seq bigint")


def label_metrics(drifts: list[tuple[int, int]], found: list[int], tau: int) -> dict:
    """recall, precision, median latency and false onsets of onsets against drifts (start, end): a drift is hit by an onset in [start -
    tau, end + tau]; its latency is that of the first."""
    if not drifts:
        return {"recall": None, "precision": None, "median_latency": None, "n_onsets": len(found), "n_false": len(found)}
    hits, latencies = set(), []
    for a, b in drifts:
        near = [i for i, o in enumerate(found) if a - tau <= o <= b + tau]
        hits.update(near)
        if near:
            latencies.append(found[near[0]] - a)
    latencies.sort()
    m = len(latencies)
    median = None if not m else (latencies[(m - 1) // 2] + latencies[m // 2]) / 2.0
    return {"recall": m / len(drifts), "precision": len(hits) / len(found) if found else None, "median_latency": median, "n_onsets": len(found), "n_false": len(found) - len(hits)}


SWEEP = "k int, ks_min double, persist int, refractory int, recall double, precision double, median_latency double, n_onsets int, n_false int"


def _cells(edges: DataFrame, looks: DataFrame, cells: list[tuple[int, float, int, int]], drifts: list[tuple[int, int]], window: int, tau: int) -> DataFrame:
    """edges: low, feature_id, pos; cells: (k, low, persist, refractory), the parameters of a report. A group holds one low's edges and the positions of
    looks, whatever the number of features, and judges all cells that share it."""
    lows = sorted({c[1] for c in cells})
    points = looks.select("pos").distinct().select(F.explode(F.array(*(F.lit(float(x)) for x in lows))).alias("low"), F.lit(None).cast("int").alias("feature_id"), "pos")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, edge = float(pdf["low"].iloc[0]), pdf["feature_id"].notna()
        own = list(zip(pdf["feature_id"][edge].astype(int).tolist(), pdf["pos"][edge].tolist()))
        at = sorted(pdf["pos"][~edge].tolist())
        return pd.DataFrame([{"k": k, "ks_min": low, "persist": persist, "refractory": refractory, **label_metrics(drifts, grid_quorum(own, at, k, persist, refractory, window), tau)} for k, x, persist, refractory in cells if x == low])

    return edges.select("low", "feature_id", "pos").unionByName(points).groupBy("low").applyInPandas(run, SWEEP)


def sweep(events: DataFrame, drifts: list[tuple[int, int]], grid: DataFrame, threshold: float, window: int, tau: int) -> DataFrame:
    """events: offline replays (feature_id, pos, kind, ks); grid: k, ks_min, persist, refractory. A row per grid cell with the label
    metrics of its quorum. ks_min up to the threshold keeps the replay's onsets, above it crossings of ks_min are taken from the looks."""
    cells = [(r["k"], float(r["ks_min"]), r["persist"], r["refractory"]) for r in grid.select("k", "ks_min", "persist", "refractory").collect()]
    lows = sorted({c[1] for c in cells})
    looks = events.filter("kind = 'look'")
    edges = events.filter("kind = 'onset'").select(F.explode(F.array(*(F.lit(x) for x in lows if x <= threshold)).cast("array<double>")).alias("low"), "feature_id", "pos")
    if above := [x for x in lows if x > threshold]:
        before = F.lag("ks").over(Window.partitionBy("feature_id").orderBy("pos"))
        seen = looks.withColumn("_before", before).select(F.explode(F.array(*map(F.lit, above))).alias("low"), "feature_id", "pos", "ks", "_before")
        edges = edges.unionByName(seen.filter((F.col("ks") > F.col("low")) & ~F.coalesce(F.col("_before") > F.col("low"), F.lit(False))).select("low", "feature_id", "pos"))
    return _cells(edges, looks, cells, drifts, window, tau)


def confirm_sweep(events: DataFrame, drifts: list[tuple[int, int]], grid: DataFrame, window: int, tau: int) -> DataFrame:
    """grid: k, ks_confirm, refractory; crossings with a peak of at least ks_confirm are edges. A row per cell, as in sweep()."""
    cells = [(r["k"], float(r["ks_confirm"]), 1, r["refractory"]) for r in grid.select("k", "ks_confirm", "refractory").collect()]
    lows = F.array(*(F.lit(x) for x in sorted({c[1] for c in cells})))
    edges = events.filter("kind = 'crossing'").select(F.explode(F.filter(lows, lambda x: x <= F.col("ks"))).alias("low"), "feature_id", "pos")
    return _cells(edges, events.filter("kind = 'look'"), cells, drifts, window, tau)
