"""The state machines of the closed loop, as plain objects that pickle.

A row is (seq, id, timestamp, features, label). A shard emits tagged tuples: ("score", row, score, version, phase, ingested) and ("tree",
tree_id, shard, slot, batch_id, last, tree).
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from tideglass.config import ForestConfig, PauseMode, ProcessorConfig, SubState
from tideglass.operators.forest import Scorer, build_from_pool


class Ring:
    """The last `size` items, the oldest overwritten first."""

    def __init__(self, size: int):
        if size <= 0:
            raise ValueError("a ring holds at least one item")
        self.size, self.items = size, deque(maxlen=size)

    def add(self, item) -> None:
        self.items.append(item)

    def full(self) -> bool:
        return len(self.items) == self.size

    def snapshot(self) -> list:
        return list(self.items)

    def oldest(self):
        return self.items[0] if self.items else None

    def __len__(self) -> int:
        return len(self.items)


@dataclass
class Control:
    """What every shard can see: the current forest and the latest commit alone."""

    version: int = 0
    scorer: Scorer | None = None
    round_id: int = 0


@dataclass
class Welford:
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0


@dataclass
class Shard:
    """One row shard: cold start, scoring, cooldown after a commit, waiting for the next version."""

    number: int
    config: ProcessorConfig
    ring: Ring = field(init=False)
    backlog: list = field(default_factory=list)
    made: int = 0
    state: SubState | None = None
    waiting_for: int | None = None
    seen_round: int = 0
    round_id: int = 0
    gate: Welford = field(default_factory=Welford)
    writes: int = 0
    started: int | None = None

    def __post_init__(self) -> None:
        self.ring = Ring(self.config.ring_size)

    def _tree(self, slot: int, round_: int) -> tuple:
        f = self.config.forest
        pool = np.array([r[3] for r in self.ring.snapshot()], dtype=float)
        tree = build_from_pool(pool, f.subsample_size, f.seed, self.number, slot, round_)
        return ("tree", f"{round_}-{self.number}-{slot}", self.number, slot, (self.number << 32) | round_, slot == f.trees_per_shard - 1, tree)

    def _drain(self, c: Control, phase: str) -> list[tuple]:
        rows, self.backlog = self.backlog, []
        if not rows:
            return []
        s = c.scorer(np.array([r[3] for r in rows], dtype=float))
        return [("score", r, float(x), c.version, phase, 0) for r, x in zip(rows, s)]

    def step(self, row: tuple, c: Control, score: float | None = None, ingested: int = 0) -> list[tuple]:
        """score: the row's score by the current forest, if it is known already."""
        f = self.config.forest
        if c.scorer is None:
            self.backlog.append(row)
            ready = self.ring.full()
            self.ring.add(row)
            if ready and self.made < f.trees_per_shard:
                self.made += 1
                return [self._tree(self.made - 1, 0)]
            return []
        out = self._drain(c, "A") if self.state in (None, SubState.STABLE) else []
        if c.round_id and c.round_id != self.seen_round:
            self.seen_round = self.round_id = c.round_id
            self.state, self.gate, self.writes, self.started = SubState.COOLDOWN, Welford(), 0, row[0]
            if self.config.cooldown_policy == "d1a":
                self.ring = Ring(self.config.ring_size)
        if score is None:
            score = float(c.scorer(np.array([row[3]], dtype=float))[0])
        state = self.state or SubState.STABLE
        if state is SubState.STABLE or self.config.pause_mode is PauseMode.USE_OLD_FOREST:
            out.append(("score", row, score, c.version, "C", ingested))
        else:
            self.backlog.append(row)
        if state is SubState.COOLDOWN:
            out += self._cooldown(row, score, c)
        elif state is SubState.WAITING and c.version > self.waiting_for:
            self.state = SubState.STABLE
            out += self._drain(c, "C")
        return out

    def _cooldown(self, row: tuple, score: float, c: Control) -> list[tuple]:
        cfg = self.config
        if cfg.cooldown_policy == "d1a":
            self.gate.n += 1
            take = True
        else:
            self.gate.add(score)
            take = self.gate.n < 50 or score < self.gate.mean + cfg.z_threshold * self.gate.std
        if take:
            self.ring.add(row)
            self.writes += 1
        full = self.writes >= cfg.ring_size
        if not (cfg.cooldown_policy == "d1a" and cfg.d1a_fill == "ringfull"):
            full = full and self.gate.n >= cfg.cooldown_samples
        if not full and self.gate.n < 2 * cfg.cooldown_samples:
            return []
        trees = [self._tree(k, self.round_id) for k in range(cfg.forest.trees_per_shard)] if len(self.ring) else []
        self.state, self.waiting_for, self.started = SubState.WAITING, c.version, None
        return trees

    def expire(self, now: int, c: Control) -> list[tuple]:
        """Gives up a cooldown that has taken too long: the old forest stays and scores what was held back."""
        limit = self.config.cooldown_timeout
        if limit is None or self.state is not SubState.COOLDOWN or self.started is None or now - self.started < limit:
            return []
        self.state, self.started = SubState.STABLE, None
        return self._drain(c, "C")

    def finish(self, c: Control) -> list[tuple]:
        """At the end of the stream rows that are held back are dropped, or scored by the forest there is."""
        return self._drain(c, "C") if self.config.flush == "old_forest" and c.scorer is not None else []


class Coordinator:
    """Makes a version when every (shard, slot) has a tree of one round and one subsample size; a tree that comes again makes another
    version."""

    def __init__(self, config: ForestConfig):
        self.config, self.trees, self.version = config, {}, 0

    def add(self, message: tuple) -> tuple[int, int, list[dict], int] | None:
        """(version, round, trees in order, subsample size) if the forest is whole."""
        _, _, shard, slot, batch, _, tree = message
        if not (0 <= shard < self.config.parallelism and 0 <= slot < self.config.trees_per_shard):
            return None
        self.trees[shard, slot] = (batch & 0xFFFFFFFF, tree)
        if len(self.trees) < self.config.actual_trees:
            return None
        if len({r for r, _ in self.trees.values()}) > 1 or len({t["subsample_size"] for _, t in self.trees.values()}) > 1:
            return None
        self.version += 1
        ordered = [self.trees[k] for k in sorted(self.trees)]
        return self.version, ordered[0][0], [t for _, t in ordered], ordered[0][1]["subsample_size"]
