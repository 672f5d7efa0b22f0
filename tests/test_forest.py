import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.config import ForestConfig
from tideglass.operators import forest
from tideglass.queries.models import literal_trees

TREE = {"nodes": [dict(zip(("id", "feature", "threshold", "left", "right", "size"), n)) for n in ((0, 0, 5.0, 1, 2, 10), (1, -1, 0.0, -1, -1, 3), (2, -1, 0.0, -1, -1, 7))], "subsample_size": 10, "depth_limit": 4, "dimension": 1}


def test_known_scores(spark):
    x = np.array([[3.0], [8.0], [5.0]])
    got = forest.Scorer([TREE], 10)(x)
    assert got[:2] == pytest.approx([0.6648893872, 0.4752314983], abs=1e-9) and got[2] == got[1]
    df = spark.createDataFrame([(i, [float(v[0])]) for i, v in enumerate(x)], "seq long, features array<double>")
    assert [r["score"] for r in forest.score(df, [TREE], 10).orderBy("seq").collect()] == pytest.approx(got.tolist())
    assert [r[0] for r in df.orderBy("seq").select(forest.score_native(F.col("features"), [TREE], 10)).collect()] == pytest.approx(got.tolist())


def test_one_row_forest_scores_zero():
    t = forest.as_tree(forest.build_tree(np.array([[1.0, 2.0]]), 1), 1, 2)
    assert len(t["nodes"]) == 1 and forest.Scorer([t], 1)(np.zeros((3, 2))).tolist() == [0, 0, 0]


def rows(n: int, seed: int = 1, dim: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).normal(5, 2, (n, dim))


def test_tree_invariants():
    t = forest.build_from_pool(rows(1000), 256, 7, 0)
    nodes = t["nodes"]
    assert (t["subsample_size"], t["dimension"], t["depth_limit"]) == (256, 9, 8)
    assert sum(n["size"] for n in nodes if n["feature"] < 0) == 256
    assert [n["id"] for n in nodes] == list(range(len(nodes)))
    depth = {0: 0}
    for n in nodes:
        if n["feature"] >= 0:
            assert n["left"] == n["id"] + 1 < n["right"] and nodes[n["left"]]["size"] + nodes[n["right"]]["size"] == n["size"]
            depth[n["left"]] = depth[n["right"]] = depth[n["id"]] + 1
    assert max(depth.values()) <= 8


def test_degenerate_trees():
    assert len(forest.build_from_pool(np.ones((10, 3)), 256, 1)["nodes"]) == 1
    assert forest.build_from_pool(np.ones((10, 3)), 256, 1)["nodes"][0]["size"] == 10
    with pytest.raises(ValueError):
        forest.build_from_pool(np.zeros((0, 3)), 256, 1)
    assert forest.build_from_pool(rows(50), 256, 3) == forest.build_from_pool(rows(50), 256, 3)


def test_outliers_score_high():
    trees = [forest.build_from_pool(rows(1000, dim=2), 256, 5, k) for k in range(50)]
    s = forest.Scorer(trees, 256)(np.array([[100.0, 100.0], [5.0, 5.0]]))
    assert s[0] > 0.7 and s[1] < 0.6


CONFIG = ForestConfig(total_trees=8, subsample_size=16, parallelism=4)


def messages(spark, shards=range(4), slots=range(2), round_=0, size=16):
    t = {**TREE, "subsample_size": size}
    data = [(f"{round_}-{s}-{k}", s, 0, k, (s << 32) | round_, False, json.dumps(t)) for s in shards for k in slots]
    df = spark.createDataFrame(data, "tree_id string, producer_subtask int, created_at long, slot_index int, batch_id long, batch_end boolean, tree string")
    return df.withColumn("tree", F.from_json("tree", forest.TREE_DDL))


def test_assembly(spark):
    count = lambda df: forest.assemble(df, CONFIG).count()
    whole = messages(spark)
    assert count(whole) == 1
    assert count(messages(spark, slots=[0])) == 0
    assert count(whole.unionByName(messages(spark, shards=[0], round_=1))) == 1
    assert count(whole.unionByName(messages(spark, round_=1))) == 2
    assert count(messages(spark, shards=range(3)).unionByName(messages(spark, shards=[3], size=8))) == 0
    assert count(messages(spark, shards=[0, 1, 2, 99])) == 0
    f = forest.assemble(whole.orderBy(F.rand(3)), CONFIG).select(F.explode("trees").alias("t")).select("t.producer_subtask", "t.slot_index").collect()
    assert [tuple(r) for r in f] == [(s, k) for s in range(4) for k in range(2)]


def test_coordinator():
    from tideglass.streaming.machines import Coordinator

    order = [(s, k) for s in range(4) for k in range(2)]
    random.Random(2).shuffle(order)
    c = Coordinator(CONFIG)
    add = lambda s, k, r=0: c.add(("tree", "x", s, k, (s << 32) | r, False, TREE))
    made = [add(s, k) for s, k in order]
    assert [m is not None for m in made] == [False] * 7 + [True] and made[-1][0] == 1
    assert add(0, 0)[0] == 2
    assert add(0, 0, 1) is None and add(99, 0) is None


def test_model_store(spark, tmp_path):
    store = forest.ModelStore(spark, str(tmp_path / "m"))
    assert store.current() is None
    store.append(1, literal_trees(), 10, swap_seq=5)
    store.append(2, literal_trees()[:1], 10)
    store.append(2, literal_trees(), 10)
    version, model = store.current()
    assert version == 2 and len(model["trees"]) == 1
