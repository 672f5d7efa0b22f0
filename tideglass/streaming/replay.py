"""The whole loop over bounded rows: scores, trees, onsets, rounds and versions, the same for the same rows.

Rows go in the order of seq. Commits and versions take effect at the start of the next epoch of `epoch` sequence numbers, for all shards
at once. A run is one sequential computation, held by one task; runs are independent of each other and are dealt out. An endless stream goes through
streaming.stateful.EpochLoop instead. A row is scored once, by the version of its epoch. Rounds may be given instead of detected, to replay decisions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.config import PipelineConfig
from tideglass.functions.scalar import shard_of
from tideglass.operators.detectors import make_detector
from tideglass.operators.forest import Scorer
from tideglass.operators.quorum import Quorum
from tideglass.streaming.machines import Control, Coordinator, Shard

COLUMNS = "run string, kind string, seq bigint, id string, label int, score double, version bigint, phase string, ingestion_time bigint, feature_id int, ks double, emit_seq bigint, round_id bigint, votes int, shard int, slot int, n_nodes int"
_NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]


def run_loop(rows: list[tuple], shards: list[int], config: PipelineConfig, epoch: int = 1000, rounds: list[tuple[int, int]] | None = None) -> list[dict]:
    """rows: (seq, id, timestamp, features, label) by seq; shards: of each row. rounds: (round_id, seq), committed at the first row from seq on,
    instead of what detectors find."""
    p = config.processor
    machines = [Shard(k, p) for k in range(p.forest.parallelism)]
    coordinator, quorum, control = Coordinator(p.forest), Quorum(config.quorum), Control()
    x = np.array([r[3] for r in rows], dtype=float)
    detectors = [make_detector(config.detector, config.iks, config.hddm) for _ in range(x.shape[1] if len(rows) and rounds is None else 0)]
    given = sorted(rounds or [], key=lambda c: (c[1], c[0]))
    out: list[dict] = []
    pending_round, pending_model, scores, start_at, last = 0, None, None, 0, None

    def take(events: list[tuple], at: int) -> None:
        nonlocal pending_model
        for e in events:
            if e[0] == "score":
                _, r, s, v, phase, ingested = e
                out.append({"kind": "score", "seq": r[0], "id": r[1], "label": r[4], "score": s, "version": v, "phase": phase, "ingestion_time": ingested})
            else:
                out.append({"kind": "tree", "seq": at, "id": e[1], "shard": e[2], "slot": e[3], "round_id": e[4] & 0xFFFFFFFF, "n_nodes": len(e[6]["nodes"])})
                if (made := coordinator.add(e)) is not None:
                    pending_model = made
                    out.append({"kind": "model", "seq": at, "version": made[0], "round_id": made[1]})

    for i, r in enumerate(rows):
        now = r[0] // epoch
        if now != last:
            last = now
            control = Control(control.version, control.scorer, pending_round)
            if pending_model is not None:
                version, _, trees, size = pending_model
                control, pending_model = Control(version, Scorer(trees, size), pending_round), None
            if control.scorer is not None:
                end = next((j for j in range(i, len(rows)) if rows[j][0] // epoch != now), len(rows))
                scores, start_at = control.scorer(x[i:end]), i
        if p.cooldown_timeout is not None:  # between epochs too: a timer does not wait for one
            for m in machines:
                take(m.expire(r[0], control), r[0])
        while given and given[0][1] <= r[0]:
            pending_round = given.pop(0)[0]
            out.append({"kind": "round", "seq": r[0], "round_id": pending_round})
        for f, d in enumerate(detectors):
            for start, ks, emitted in d.step(r[0], float(x[i, f])):
                out.append({"kind": "onset", "seq": start, "feature_id": f, "ks": ks, "emit_seq": emitted})
                if (c := quorum.step(f, start)) is not None:
                    pending_round = c[0]
                    out.append({"kind": "round", "seq": c[1], "round_id": c[0], "votes": c[3], "emit_seq": emitted})
        take(machines[shards[i]].step(r, control, None if scores is None else float(scores[i - start_at]), r[2]), r[0])
    for m in machines:
        take(m.finish(control), rows[-1][0] if rows else 0)
    return out


def replay(df: DataFrame, config: PipelineConfig | None = None, epoch: int = 1000, run: str | None = None, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """df: seq, id, timestamp, features, label and, if named, a run column -> COLUMNS, a row for each score, tree, model, onset and round."""
    config = config or PipelineConfig()
    rows = df.select(F.col(run).cast("string").alias("run") if run else F.lit("").alias("run"), "seq", "id", "timestamp", "features", "label", shard_of(F.col("id"), config.processor.forest.parallelism).alias("_shard"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        found = run_loop(list(zip(pdf["seq"].tolist(), pdf["id"].tolist(), pdf["timestamp"].tolist(), pdf["features"].tolist(), pdf["label"].tolist())), pdf["_shard"].tolist(), config, epoch, rounds)
        return pd.DataFrame([{**dict.fromkeys(_NAMES), **f, "run": pdf["run"].iloc[0]} for f in found], columns=_NAMES).astype({n: "Int64" for n in ("seq", "label", "version", "ingestion_time", "feature_id", "emit_seq", "round_id", "votes", "shard", "slot", "n_nodes")} | {"score": "float64", "ks": "float64"})

    return rows.groupBy("run").applyInPandas(one, COLUMNS)
