import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.config import ForestConfig, HddmConfig, PauseMode, PerFeatureHddmConfig, PipelineConfig, ProcessorConfig, QuorumConfig, SubState
from tideglass.operators.forest import Scorer, build_from_pool
from tideglass.streaming.machines import Control, Ring, Shard
from tideglass.streaming.replay import replay, run_loop
from tideglass.streaming.stateful import EpochLoop, file_source


def row(i, x=0.0, label=0):
    r = np.random.default_rng(i)
    return (i, str(i), i, [float(x + r.normal()), float(r.normal())], label)


def scorer(seed=1):
    pool = np.random.default_rng(seed).normal(0, 1, (300, 2))
    return Scorer([build_from_pool(pool, 64, seed, k) for k in range(5)], 64)


def config(**over):
    return ProcessorConfig(**{"forest": ForestConfig(25, 64, 1), "ring_size": 200, "cooldown_samples": 300, **over})


def test_ring():
    r = Ring(3)
    for i in range(5):
        r.add(i)
    assert r.full() and r.snapshot() == [2, 3, 4] and r.oldest() == 2
    with pytest.raises(ValueError):
        Ring(0)


def test_cold_start():
    s = Shard(0, config(ring_size=1000))
    events = [e for i in range(1100) for e in s.step(row(i), Control())]
    assert [e[3] for e in events] == list(range(25)) and {e[4] for e in events} == {0}
    assert sum(e[5] for e in events) == 1 and len(s.backlog) == 1100
    out = s.step(row(1100), Control(1, scorer(), 0))
    assert len(out) == 1101 and {e[4] for e in out[:-1]} == {"A"} and out[-1][4] == "C"


@pytest.mark.parametrize("over,rows,trees", [({}, 299, 0), ({}, 300, 25), ({"d1a_fill": "ringfull"}, 199, 0), ({"d1a_fill": "ringfull"}, 200, 25), ({"cooldown_policy": "legacy", "z_threshold": 10.0}, 300, 25), ({"cooldown_policy": "legacy", "z_threshold": -10.0}, 599, 0), ({"cooldown_policy": "legacy", "z_threshold": -10.0}, 600, 25)])
def test_cooldown_ends(over, rows, trees):
    s, c = Shard(0, config(**over)), Control(1, scorer(), 7)
    events = [e for i in range(rows) for e in s.step(row(i), c)]
    made = [e for e in events if e[0] == "tree"]
    assert len(made) == trees and all(e[4] & 0xFFFFFFFF == 7 for e in made)
    assert s.state is (SubState.WAITING if trees else SubState.COOLDOWN)
    assert len([e for e in events if e[0] == "score"]) == rows


def test_waiting_is_released_by_a_newer_version():
    s, c = Shard(0, config(pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST)), Control(1, scorer(), 7)
    events = [e for i in range(310) for e in s.step(row(i), c)]
    assert not [e for e in events if e[0] == "score"] and s.state is SubState.WAITING
    out = s.step(row(310), Control(2, scorer(2), 7))
    assert len(out) == 311 and {e[3] for e in out} == {2} and [e[1][0] for e in out] == list(range(311)) and s.state is SubState.STABLE


def test_a_commit_enters_cooldown_from_any_state():
    s = Shard(0, config())
    for i in range(310):
        s.step(row(i), Control(1, scorer(), 7))
    assert s.state is SubState.WAITING
    s.step(row(310), Control(1, scorer(), 8))
    assert s.state is SubState.COOLDOWN and s.round_id == 8 and len(s.ring) == 1
    s.step(row(311), Control(1, scorer(), 8))
    assert len(s.ring) == 2


def test_abort_keeps_the_old_forest():
    s, c = Shard(0, config(pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST, cooldown_timeout=50)), Control(1, scorer(), 7)
    for i in range(40):
        s.step(row(i), c)
    assert s.expire(49, c) == []
    out = s.expire(50, c)
    assert len(out) == 40 and {e[3] for e in out} == {1} and s.state is SubState.STABLE
    assert [e[1][0] for e in s.step(row(51), c)] == [51]


def test_flush():
    for flush, n in (("drop", 0), ("old_forest", 10)):
        s, c = Shard(0, config(pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST, flush=flush)), Control(1, scorer(), 7)
        for i in range(10):
            s.step(row(i), c)
        assert len(s.finish(c)) == n


PIPE = PipelineConfig(processor=config(forest=ForestConfig(8, 64, 2)), detector="hddm_w", hddm=PerFeatureHddmConfig(warmup=200, hddm=HddmConfig(lam=0.02)), quorum=QuorumConfig(2, 1000, 2000))


def stream_rows(n=3000):
    out = []
    for i in range(n):
        r = np.random.default_rng(i)
        x = r.normal(0 if i < 1500 else 12, 1, 3)
        out.append((i, str(i), i, [float(v) for v in x], int(r.random() < 0.05)))
    return out


def test_loop_retrains_and_scores_every_row():
    rows = stream_rows()
    out = run_loop(rows, [r[0] % 2 for r in rows], PIPE, 100)
    kinds = {k: [e for e in out if e["kind"] == k] for k in ("score", "tree", "model", "round", "onset")}
    assert sorted(e["seq"] for e in kinds["score"]) == list(range(3000))
    assert [m["version"] for m in kinds["model"]][:2] == [1, 2] and len(kinds["round"]) >= 1
    assert kinds["round"][0]["seq"] >= 1500 and kinds["round"][0]["votes"] >= 2
    late = [e["score"] for e in kinds["score"] if 1520 <= e["seq"] < 1600]
    after = [e["score"] for e in kinds["score"] if e["version"] == 2]
    assert np.mean(late) > np.mean(after)


def test_detection_does_not_depend_on_shards():
    rows = stream_rows()
    seen = set()
    for n in (1, 2, 4):
        p = PipelineConfig(processor=config(forest=ForestConfig(8, 64, n)), detector="hddm_w", hddm=PIPE.hddm, quorum=PIPE.quorum)
        seen.add(str([(e["kind"], e["seq"]) for e in run_loop(rows, [r[0] % n for r in rows], p, 100) if e["kind"] in ("onset", "round")]))
    assert len(seen) == 1


SCHEMA = "seq long, id string, timestamp long, features array<double>, label int"


def test_epoch_loop_equals_itself_after_a_restart(spark, tmp_path):
    df = spark.createDataFrame(stream_rows(), SCHEMA)
    src = str(tmp_path / "src")
    loops = {}
    pipe = PipelineConfig(processor=config(forest=ForestConfig(8, 64, 2), cooldown_samples=200), detector="hddm_w", hddm=PIPE.hddm, quorum=PIPE.quorum)
    for name, stops in (("once", False), ("stops", True)):
        path = str(tmp_path / name)
        if name == "once":
            for k in range(6):
                df.filter(F.floor(F.col("seq") / 500) == k).coalesce(1).write.mode("append").parquet(src)
            EpochLoop(spark, path, pipe).start(file_source(spark, src, SCHEMA), f"{path}-progress").awaitTermination()
        else:
            for k in range(6):  # each batch by a loop of its own, one of them twice
                batch = df.filter(F.floor(F.col("seq") / 500) == k)
                EpochLoop(spark, path, pipe)(batch, k)
                EpochLoop(spark, path, pipe)(batch.limit(1), k)
        loops[name] = sorted((r["seq"], r["version"], round(r["score"], 9)) for r in EpochLoop(spark, path, pipe).scores().collect())
    assert loops["once"] == loops["stops"] and len(loops["once"]) == 3000
    assert max(v for _, v, _ in loops["once"]) >= 2


def test_replay_runs_are_independent(spark):
    df = spark.createDataFrame(stream_rows(1000), SCHEMA)
    two = df.withColumn("run", F.lit("a")).unionByName(df.withColumn("run", F.lit("b")))
    n = {(r["run"], r["kind"]): r["count"] for r in replay(two, PIPE, 100, "run").groupBy("run", "kind").count().collect()}
    assert {k: v for (r, k), v in n.items() if r == "a"} == {k: v for (r, k), v in n.items() if r == "b"} and n["a", "score"] == 1000


def test_abort_inside_an_epoch(spark, tmp_path):
    """A cooldown that would end before the next epoch is given up in time, whoever's row comes then."""
    p = config(forest=ForestConfig(8, 64, 2), ring_size=50, cooldown_samples=80, cooldown_timeout=100, pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST)
    pipe = PipelineConfig(processor=p, detector="hddm_w", hddm=PIPE.hddm, quorum=PIPE.quorum)
    out = run_loop(stream_rows(), [i % 2 for i in range(3000)], pipe, 1000, [(1, 900)])
    assert sorted(e["seq"] for e in out if e["kind"] == "score") == list(range(3000))
    assert {e["version"] for e in out if e["kind"] == "score"} == {1} and not [e for e in out if e["kind"] == "tree" and e["round_id"]]

    loop = EpochLoop(spark, str(tmp_path), pipe)
    df = spark.createDataFrame(stream_rows(), SCHEMA)
    loop(df.filter("seq < 1500"), 0)
    loop(df.filter("seq BETWEEN 1500 AND 1999"), 1)
    loop(df.filter("seq BETWEEN 2000 AND 2400"), 2)
    assert loop._control(1)["round_id"]
    assert {r["seq"] for r in loop.scores().select("seq").collect()} == set(range(2401)) and {r["version"] for r in loop.scores().collect()} == {1}
