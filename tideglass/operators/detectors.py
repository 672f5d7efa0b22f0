"""Drift detectors.

Those that never reset themselves are windows over a feature's sequence; the others are state machines, fed from sorted Arrow batches, so
that a feature's stream never has to fit in memory.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.config import DriftStatus, HddmConfig, IksConfig, PerFeatureHddmConfig
from tideglass.functions.scalar import ewma_bound, hoeffding_bound, ks_confirm_threshold
from tideglass.operators.running import running, sliding_mean, value_ranges

STABLE, WARN, DRIFT = DriftStatus.STABLE, DriftStatus.WARN, DriftStatus.DRIFT


# ---- objects -------------------------------------------------------------------------------------------------------------


class DriftDetector(ABC):
    """One stream's detector: update() takes the next value; only the caller resets."""

    @abstractmethod
    def update(self, value: float) -> DriftStatus: ...

    @abstractmethod
    def reset(self) -> None: ...

    @property
    @abstractmethod
    def sample_count(self) -> int: ...

    def warn_timed_out(self) -> bool:
        return False


class _Hddm(DriftDetector):
    """Compares the current mean, less its bound, with the best (least) mean plus bound so far."""

    def __init__(self, config: HddmConfig | None = None):
        self.config = config or HddmConfig()
        self.reset()

    def reset(self) -> None:
        self.n, self.best, self.warn_from = 0, None, None

    @property
    def sample_count(self) -> int:
        return self.n

    def _judge(self, mean: float, eps: float) -> DriftStatus:
        if self.best is None or mean + eps < self.best[0] + self.best[1]:
            self.best = (mean, eps)
        low, (m, e) = mean - eps, self.best
        if low > m + e * self.config.drift_ratio:
            self.warn_from = None
            return DRIFT
        warn = low > m + e * self.config.warn_ratio
        self.warn_from = (self.warn_from or self.n) if warn else None
        return WARN if warn else STABLE

    def warn_timed_out(self) -> bool:
        return self.warn_from is not None and self.n - self.warn_from >= self.config.warn_timeout


class HddmA(_Hddm):
    def reset(self) -> None:
        super().reset()
        self.total = 0.0

    def update(self, value: float) -> DriftStatus:
        self.n += 1
        self.total += value
        return self._judge(self.total / self.n, math.sqrt(math.log(1.0 / self.config.drift_confidence) / (2.0 * self.n)))


class HddmAWindowed(_Hddm):
    def reset(self) -> None:
        super().reset()
        self.window, self.total = deque(), 0.0

    def update(self, value: float) -> DriftStatus:
        self.n += 1
        self.window.append(value)
        self.total += value
        if len(self.window) > self.config.window:
            self.total -= self.window.popleft()
        k = len(self.window)
        return self._judge(self.total / k, math.sqrt(math.log(1.0 / self.config.drift_confidence) / (2.0 * k)))


class HddmW(_Hddm):
    def reset(self) -> None:
        super().reset()
        self.ewma = 0.0

    def update(self, value: float) -> DriftStatus:
        self.n += 1
        self.ewma = value if self.n == 1 else (1.0 - self.config.lam) * self.ewma + self.config.lam * value
        return self._judge(self.ewma, ewma_bound(self.config.lam, self.config.drift_confidence))


class KsWindow:
    """Values of a fixed reference window against a sliding one of the same size, compared by value (ties count as equal).

    The line is cut at the reference's distinct values into slots; each slot holds how many more current than reference values fall in
    it, so a step changes two slots and the statistic is the largest absolute prefix sum.
    """

    def __init__(self, reference: list[float], current: list[float] | None = None):
        self.w, self.current = len(reference), deque(reference if current is None else current)
        values, counts = np.unique(np.array(reference, dtype=float), return_counts=True)
        self.values, self.excess = values.tolist(), np.zeros(2 * len(values) + 1, dtype=np.int64)
        self.excess[1::2] -= counts
        for v in self.current:
            self.excess[self._slot(v)] += 1

    def _slot(self, v: float) -> int:
        i = bisect_left(self.values, v)
        return 2 * i + (i < len(self.values) and self.values[i] == v)

    def slide(self, v: float) -> None:
        self.excess[self._slot(self.current.popleft())] -= 1
        self.current.append(v)
        self.excess[self._slot(v)] += 1

    def ks(self) -> float:
        return float(np.abs(np.cumsum(self.excess)).max()) / self.w

    def kuiper(self) -> float:
        g = np.cumsum(self.excess)
        return float(max(g.max(), 0) - min(g.min(), 0)) / self.w


class Iks(DriftDetector):
    """The first W values are the reference; from then on DRIFT while the statistic exceeds its threshold."""

    def __init__(self, config: IksConfig | None = None):
        self.config = config or IksConfig()
        self.reset()

    def reset(self) -> None:
        self.n, self.warm, self.window, self.last_ks = 0, [], None, 0.0

    @property
    def sample_count(self) -> int:
        return self.n

    def update(self, value: float) -> DriftStatus:
        self.n += 1
        if self.window is None:
            self.warm.append(value)
            if len(self.warm) == self.config.window:
                self.window, self.warm = KsWindow(self.warm), []
            return STABLE
        self.window.slide(value)
        self.last_ks = self.window.ks()
        return DRIFT if self.last_ks > self.config.threshold else STABLE

    @property
    def ready(self) -> bool:
        return self.window is not None

    def rebase(self) -> None:
        """reset: forget all and warm up again; slide: the current window becomes the reference."""
        if self.config.rebase == "reset":
            self.reset()
        else:
            self.window = KsWindow(list(self.window.current))


class IksSw:
    """The stand-alone sliding-window test: increment, ks, kuiper, test, update."""

    def __init__(self, values: list[float]):
        self.window = KsWindow(list(map(float, values)))

    def increment(self, v: float) -> None:
        self.window.slide(float(v))

    def ks(self) -> float:
        return self.window.ks()

    def kuiper(self) -> float:
        return self.window.kuiper()

    def test(self, ca: float = 1.95) -> bool:
        return self.ks() > ca * math.sqrt(2.0 / self.window.w)

    def update(self) -> None:
        self.window = KsWindow(list(self.window.current))

    ca_for_p_value = staticmethod(ks_confirm_threshold)


# ---- per-feature state machines ------------------------------------------------------------------------------------------


class FeatureIks:
    """Confirms an onset: the first row above the threshold opens a gate that follows the statistic's peak; the row that is `confirm`
    or more sequence numbers later closes it, and an onset is reported if the peak reaches `peak`. Only a report rebases."""

    def __init__(self, config: IksConfig):
        self.config, self.iks, self.start, self.top = config, Iks(config), None, 0.0

    def step(self, seq: int, value: float) -> list[tuple[int, float, int]]:
        status = self.iks.update(value)
        if not self.iks.ready:
            return []
        ks = self.iks.last_ks
        if self.start is None:
            if status is DRIFT:
                self.start, self.top = seq, ks
            return []
        self.top = max(self.top, ks)
        if seq - self.start < self.config.confirm:
            return []
        out = [(self.start, self.top, seq)] if self.top >= self.config.peak else []
        self.start, self.top = None, 0.0
        if out:
            self.iks.rebase()
        return out


def nearest_rank(values: list[float], q: float = 0.99) -> float:
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


class FeatureHddm:
    """Warm-up estimates a reference mean and a scale of deviations from the running mean; later values are turned into deviations
    in [0, 1] for an EWMA detector. DRIFT is reported and clears everything."""

    def __init__(self, config: PerFeatureHddmConfig):
        self.config = config
        self.clear()

    def clear(self) -> None:
        self.count, self.total, self.deviations, self.reference, self.scale, self.detector = 0, 0.0, [], None, None, HddmW(self.config.hddm)

    def step(self, seq: int, value: float) -> list[tuple[int, float, int]]:
        if self.reference is None:
            self.count += 1
            self.total += value
            self.deviations.append(abs(value - self.total / self.count))
            if self.count == self.config.warmup:
                self.reference = self.total / self.count
                self.scale = max(nearest_rank(self.deviations) if self.config.scale_mode == "p99" else max(self.deviations), 1e-12)
                self.deviations = []
            return []
        signal = min(abs(value - self.reference) / self.scale, 1.0)
        if self.detector.update(signal) is DRIFT:
            self.clear()
            return [(seq, signal, seq)]
        return []


DETECTORS: dict[str, Callable] = {"iks": lambda iks, hddm: FeatureIks(iks), "hddm_w": lambda iks, hddm: FeatureHddm(hddm)}


def make_detector(name: str, iks: IksConfig | None = None, hddm: PerFeatureHddmConfig | None = None):
    """By name, whatever its case; an unknown name is an error."""
    if name.lower() not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}")
    return DETECTORS[name.lower()](iks or IksConfig(), hddm or PerFeatureHddmConfig())


def sequential(df: DataFrame, by: str, order: list[str], value: list[str], make: Callable, step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """Feeds each group's rows, in order, to step(state, group, *values) -> rows; state = make() at a group's first row, and end(state, group)
    may add rows after its last. Groups are dealt by hash and sorted; a task holds one batch and one state."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            out = []
            keys = pdf["_by"].tolist()
            for g, *v in zip(keys, *(pdf[c].tolist() for c in value)):
                if state is None or g != group:
                    if state is not None and end:
                        out += end(state, group)
                    group, state = g, make()
                out += step(state, g, *v)
            yield pd.DataFrame(out, columns=names)
        if state is not None and end:
            yield pd.DataFrame(end(state, group), columns=names)

    rows = df.select(F.col(by).alias("_by"), *dict.fromkeys([*order, *value]))
    return rows.repartition("_by").sortWithinPartitions("_by", *order).mapInPandas(run, schema)


ONSETS = "feature_id int, seq bigint, ks double, emit_seq bigint"


def onsets(values: DataFrame, detector: str = "iks", iks: IksConfig | None = None, hddm: PerFeatureHddmConfig | None = None) -> DataFrame:
    """feature_id, value, seq -> confirmed onsets: seq where it began, ks (peak, or the signal), emit_seq where it was reported."""
    make_detector(detector, iks, hddm)
    return sequential(values, "feature_id", ["seq"], ["seq", "value"], lambda: make_detector(detector, iks, hddm), lambda s, g, seq, v: [(g, *x) for x in s.step(seq, v)], ONSETS)


def statuses(values: DataFrame, make: Callable[[], DriftDetector]) -> DataFrame:
    """feature_id, seq, status of any detector object over each feature."""
    return sequential(values, "feature_id", ["seq"], ["seq", "value"], make, lambda s, g, seq, v: [(g, seq, s.update(v).value)], "feature_id int, seq bigint, status string")


# ---- window forms --------------------------------------------------------------------------------------------------------


def _judged(df: DataFrame, config: HddmConfig) -> DataFrame:
    """feature_id, seq, n, mean, eps -> the same with best_mean, best_eps, status: the best is the first least mean + eps so far."""
    best = running(df, ["feature_id"], "n", {"_best": ("min", F.struct((F.col("mean") + F.col("eps")).alias("s"), F.col("n"), F.col("mean"), F.col("eps")))})
    low = F.col("mean") - F.col("eps")
    limit = lambda ratio: F.col("_best.mean") + F.col("_best.eps") * F.lit(ratio)
    status = F.when(low > limit(config.drift_ratio), "DRIFT").when(low > limit(config.warn_ratio), "WARN").otherwise("STABLE")
    return best.select("feature_id", "seq", "n", "mean", "eps", F.col("_best.mean").alias("best_mean"), F.col("_best.eps").alias("best_eps"), status.alias("status"))


def numbered(values: DataFrame) -> DataFrame:
    """With n, the row's number in its feature, from 1."""
    return running(values, ["feature_id"], "seq", {"n": ("count", F.lit(1))})


def hddm_a(values: DataFrame, config: HddmConfig | None = None) -> DataFrame:
    config = config or HddmConfig()
    sums = running(values, ["feature_id"], "seq", {"n": ("count", F.lit(1)), "_total": ("sum", F.col("value"))})
    return _judged(sums.withColumns({"mean": F.col("_total") / F.col("n"), "eps": hoeffding_bound(F.col("n").cast("double"), config.drift_confidence)}), config)


def hddm_a_windowed(values: DataFrame, config: HddmConfig | None = None) -> DataFrame:
    config = config or HddmConfig()
    means = sliding_mean(numbered(values), ["feature_id"], "n", config.window, "value", "mean", "_k")
    return _judged(means.withColumn("eps", hoeffding_bound(F.col("_k").cast("double"), config.drift_confidence)), config)


def hddm_w(values: DataFrame, config: HddmConfig | None = None) -> DataFrame:
    """feature_id, seq, ewma, status; never reset."""
    config = config or HddmConfig()

    def step(s: HddmW, g, seq, v):
        status = s.update(v)
        return [(g, seq, s.ewma, status.value)]

    return sequential(values, "feature_id", ["seq"], ["seq", "value"], lambda: HddmW(config), step, "feature_id int, seq bigint, ewma double, status string")


def warn_runs(judged: DataFrame, timeout: int) -> DataFrame:
    """Runs of WARN: feature_id, run_start, length, timed_out (the run reached `timeout` rows after its start)."""
    # A row's island is the number of rows of its feature that are not WARN before it.
    islands = running(judged, ["feature_id"], "n", {"_island": ("sum", F.when(F.col("status") != "WARN", 1).otherwise(0))}).filter("status = 'WARN'")
    return islands.groupBy("feature_id", "_island").agg(F.min("n").alias("run_start"), F.count("*").alias("length")).select("feature_id", "run_start", "length", (F.col("length") > timeout).alias("timed_out"))


def two_sample(df: DataFrame, by: list[str], value: str, current: str, buckets: int = 1024) -> DataFrame:
    """KS and Kuiper statistics of the rows with and without the Boolean `current`, which are equally many in each group.

    Values are counted first and accumulated in two steps: over ranges of values, then inside each range.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(F.when(F.col(current), 1).otherwise(-1)).alias("_d"), F.count("*").alias("_n"))
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = value_ranges(counts.join(whole, by) if by else counts.crossJoin(whole), by, "_v", buckets).withColumnRenamed("_range", "_b")
    keys = [*by, "_b"]
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys).agg(F.sum("_d").alias("_s")).select(*keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    g = F.col("_off") + F.sum("_d").over(Window.partitionBy(*keys).orderBy("_v"))
    grid = placed.join(offsets, keys).withColumn("_g", g)
    half = F.first("_all") / 2.0
    return grid.groupBy(*by).agg((F.max(F.abs("_g")) / half).alias("ks"), ((F.greatest(F.max("_g"), F.lit(0)) - F.least(F.min("_g"), F.lit(0))) / half).alias("kuiper"))


def warmup_scale(values: DataFrame, warmup: int) -> DataFrame:
    """Of each feature's first `warmup` rows: reference (their mean), p99 (nearest rank) and maxdev of the deviations from the
    running mean, neither under 1e-12."""
    first = running(values, ["feature_id"], "seq", {"n": ("count", F.lit(1)), "_total": ("sum", F.col("value"))}).filter(F.col("n") <= warmup)
    dev = first.withColumn("_dev", F.abs(F.col("value") - F.col("_total") / F.col("n")))
    ranked = F.sort_array(F.collect_list("_dev"))
    return dev.groupBy("feature_id").agg(F.avg("value").alias("reference"), F.greatest(F.element_at(ranked, F.ceil(F.lit(0.99) * F.count("*")).cast("int")), F.lit(1e-12)).alias("p99"), F.greatest(F.max("_dev"), F.lit(1e-12)).alias("maxdev"))


# ---- offline replays ----------------------------------------------------------------------------------------------------


class OfflineIks:
    """Replay on a grid of positions: warm up on W rows, slide by every row, look every `stride` rows. confirm 0: a rising edge is an
    onset and rebases at once; else the peak of the next `confirm` looks is kept with the crossing, which rebases then."""

    def __init__(self, window: int, p: float, stride: int = 1, confirm: int = 0):
        self.w, self.threshold, self.stride, self.confirm = window, ks_confirm_threshold(p) * math.sqrt(2.0 / window), stride, confirm
        self.warm, self.win, self.i, self.fired, self.open, self.top, self.left = [], None, 0, False, None, 0.0, 0

    def step(self, value: float) -> list[tuple[int, str, float]]:
        """Events (position, kind, ks): look for every look, onset, crossing."""
        i, self.i = self.i, self.i + 1
        if self.win is None:
            self.warm.append(value)
            if len(self.warm) == self.w:
                self.win = KsWindow(self.warm)
            return []
        self.win.slide(value)
        if (i - self.w) % self.stride:
            return []
        ks = self.win.ks()
        out = [(i, "look", ks)]
        above = ks > self.threshold
        if not self.confirm:
            if above and not self.fired:
                out.append((i, "onset", ks))
                self.win = KsWindow(list(self.win.current))
                above = False
            self.fired = above
        elif self.open is None:
            if above:
                out.append((i, "onset", ks))
                self.open, self.top, self.left = i, ks, self.confirm
        else:
            self.top = max(self.top, ks)
            self.left -= 1
            if self.left <= 0:
                out.append((self.open, "crossing", self.top))
                self.win, self.open = KsWindow(list(self.win.current)), None
        return out


def offline_iks(values: DataFrame, window: int, p: float, stride: int = 1, confirm: int = 0) -> DataFrame:
    """feature_id, pos, kind (look, onset, crossing), ks."""
    return sequential(values, "feature_id", ["seq"], ["value"], lambda: OfflineIks(window, p, stride, confirm), lambda s, g, v: [(g, *e) for e in s.step(v)], "feature_id int, pos bigint, kind string, ks double")


def offline_signal(values: DataFrame, warmup: int, scale_mode: str = "p99") -> DataFrame:
    """feature_id, seq, n, signal: deviations from the warm-up's final mean over its interpolated 99 % (or largest) deviation, at most
    1; null in the warm-up."""
    rows = numbered(values)
    mean = rows.filter(F.col("n") <= warmup).groupBy("feature_id").agg(F.avg("value").alias("_ref"))
    dev = rows.filter(F.col("n") <= warmup).join(mean, "feature_id").withColumn("_d", F.abs(F.col("value") - F.col("_ref")))
    scale = F.expr("percentile(_d, 0.99)") if scale_mode == "p99" else F.max("_d")
    model = dev.groupBy("feature_id").agg(F.first("_ref").alias("_ref"), F.greatest(scale, F.lit(1e-12)).alias("_scale"))
    return rows.join(model, "feature_id").select("feature_id", "seq", "n", F.when(F.col("n") > warmup, F.least(F.abs(F.col("value") - F.col("_ref")) / F.col("_scale"), F.lit(1.0))).alias("signal"))


def offline_hddm(signal: DataFrame, warmup: int, config: HddmConfig) -> DataFrame:
    """feature_id, fire (row number from 0): the EWMA detector on the signal; a fire resets it and skips `warmup` rows."""

    class State:
        def __init__(self):
            self.d, self.skip = HddmW(config), 0

    def step(s: State, g, n, x):
        if x is None or x != x:
            return []
        if s.skip:
            s.skip -= 1
            return []
        if s.d.update(x) is DRIFT:
            s.d.reset()
            s.skip = warmup
            return [(g, n - 1)]
        return []

    return sequential(signal, "feature_id", ["n"], ["n", "signal"], State, step, "feature_id int, fire bigint")
