"""Parameters of the jobs, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

from tideglass.functions.scalar import ks_threshold


class DriftStatus(str, Enum):
    STABLE, WARN, DRIFT = "STABLE", "WARN", "DRIFT"


class SubState(str, Enum):
    STABLE, COOLDOWN, WAITING = "STABLE", "COOLDOWN", "WAITING"


class PauseMode(str, Enum):
    USE_OLD_FOREST, BACKLOG_THEN_NEW_FOREST = "USE_OLD_FOREST", "BACKLOG_THEN_NEW_FOREST"


class RoundStatus(str, Enum):
    VOTING, COMMITTED, ABORTED = "VOTING", "COMMITTED", "ABORTED"


class SequenceSource(str, Enum):
    PARSE_ID, AUTO_INCREMENT, FROM_FIELD = "PARSE_ID", "AUTO_INCREMENT", "FROM_FIELD"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class HddmConfig:
    drift_confidence: float = 0.001
    warn_confidence: float = 0.005
    warn_timeout: int = 2000
    lam: float = 0.005
    window: int = 2000

    def __post_init__(self) -> None:
        _need(0.0 < self.drift_confidence < self.warn_confidence < 1.0, "0 < drift confidence < warn confidence < 1 is required")
        _need(self.warn_timeout > 0, "the warn timeout must be positive")
        _need(0.0 < self.lam <= 1.0, "lambda must be in (0, 1]")
        _need(self.window > 0, "the window must be positive")

    @property
    def drift_ratio(self) -> float:
        return math.sqrt(math.log(1.0 / self.drift_confidence) / math.log(1.0 / self.warn_confidence))

    @property
    def warn_ratio(self) -> float:
        return 1.0 / self.drift_ratio


@dataclass(frozen=True)
class IksConfig:
    window: int = 2000
    p_value: float = 0.001
    confirm_window: int | None = None
    ks_confirm: float | None = None
    rebase: str = "reset"

    def __post_init__(self) -> None:
        _need(self.window > 0, "the window must be positive")
        _need(0.0 < self.p_value < 1.0, "the p-value must be in (0, 1)")
        _need(self.confirm > 0, "the confirm window must be positive")
        _need(self.rebase in ("reset", "slide"), "rebase is reset or slide")

    @property
    def threshold(self) -> float:
        return ks_threshold(self.p_value, self.window)

    @property
    def confirm(self) -> int:
        return self.window if self.confirm_window is None else self.confirm_window

    @property
    def peak(self) -> float:
        return self.threshold if self.ks_confirm is None else self.ks_confirm


@dataclass(frozen=True)
class PerFeatureHddmConfig:
    warmup: int = 2000
    scale_mode: str = "p99"
    hddm: HddmConfig = field(default_factory=HddmConfig)

    def __post_init__(self) -> None:
        _need(self.warmup > 0, "the warm-up must be positive")
        _need(self.scale_mode in ("p99", "maxdev"), "the scale mode is p99 or maxdev")


@dataclass(frozen=True)
class QuorumConfig:
    k: int = 2
    window: int = 2000
    refractory: int = 5000

    def __post_init__(self) -> None:
        _need(self.k > 0 and self.window > 0 and self.refractory >= 0, "k and window must be positive, refractory not negative")


@dataclass(frozen=True)
class ForestConfig:
    total_trees: int = 100
    subsample_size: int = 256
    parallelism: int = 4
    seed: int = 42

    def __post_init__(self) -> None:
        _need(min(self.total_trees, self.subsample_size, self.parallelism) > 0, "trees, subsample and parallelism must be positive")

    @property
    def trees_per_shard(self) -> int:
        return -(-self.total_trees // self.parallelism)

    @property
    def actual_trees(self) -> int:
        return self.parallelism * self.trees_per_shard


@dataclass(frozen=True)
class ProcessorConfig:
    forest: ForestConfig = field(default_factory=ForestConfig)
    ring_size: int = 1000
    cooldown_samples: int = 2000
    cooldown_policy: str = "d1a"
    d1a_fill: str = "cooldownsamples"
    cooldown_timeout: int | None = None
    z_threshold: float = 1.0
    pause_mode: PauseMode = PauseMode.USE_OLD_FOREST
    flush: str = "drop"

    def __post_init__(self) -> None:
        _need(self.ring_size > 0 and self.cooldown_samples > 0, "ring and cooldown must be positive")
        _need(self.cooldown_policy in ("d1a", "legacy"), "the cooldown policy is d1a or legacy")
        _need(self.d1a_fill in ("cooldownsamples", "ringfull"), "the fill is cooldownsamples or ringfull")
        _need(self.flush in ("drop", "old_forest"), "flush is drop or old_forest")


@dataclass(frozen=True)
class PipelineConfig:
    processor: ProcessorConfig = field(default_factory=ProcessorConfig)
    detector: str = "iks"
    iks: IksConfig = field(default_factory=IksConfig)
    hddm: PerFeatureHddmConfig = field(default_factory=PerFeatureHddmConfig)
    quorum: QuorumConfig = field(default_factory=QuorumConfig)

    def __post_init__(self) -> None:
        _need(self.detector.lower() in ("iks", "hddm_w"), f"unknown detector {self.detector!r}")
