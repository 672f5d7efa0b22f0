"""Interval and as-of joins by buckets, and ranges of crowded values, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tideglass.operators import joins, metrics
from tideglass.operators.running import value_ranges


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_interval_join(spark, buckets):
    rnd = random.Random(buckets)
    points = [(i, rnd.randint(-50, 1200)) for i in range(200)]
    spans = [(k, a, a + rnd.choice([-1, 0, 3, 40, 900])) for k, a in enumerate(rnd.randint(0, 1000) for _ in range(40))]
    got = joins.interval_join(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "k long, a long, b long"), "at", F.col("a"), F.col("b"), buckets).select("p", "k").collect()
    assert sorted(map(tuple, got)) == sorted((p, k) for p, x in points for k, a, b in spans if a <= x <= b)
    none = spark.createDataFrame([], "k long, a long, b long")
    assert joins.interval_join(spark.createDataFrame(points, "p long, at long"), none, "at", F.col("a"), F.col("b")).count() == 0


def test_as_of_version(spark):
    rnd = random.Random(2)
    rows = [(i,) for i in range(-5, 300)]
    for n in (0, 1, 2, 30):
        versions = [(rnd.randint(1, 9), rnd.randint(0, 250)) for _ in range(n)]
        got = {r["seq"]: r["version"] for r in joins.as_of_version(spark.createDataFrame(rows, "seq long"), spark.createDataFrame(versions, "version long, swap_seq long")).collect()}
        assert got == {i: max((v for v, at in versions if at <= i), default=None) for (i,) in rows}


def test_no_nested_loops(spark):
    rows, few = spark.range(1000).select(F.col("id").alias("seq")), spark.createDataFrame([(1, 10), (2, 500), (3, 700)], "version long, swap_seq long")
    spans = few.select(F.col("version").alias("drift_idx"), F.col("swap_seq").alias("start"), (F.col("swap_seq") + 30).alias("end"))
    for df in (joins.as_of_version(rows, few), joins.interval_hits(spans, rows, 5, 5)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_previous_row(spark):
    rows = [(3, 1), (5, 2), (9, 3), (20, 4)]
    points = [(1,), (3,), (8,), (9,), (100,)]
    got = {r["point"]: r["new_line"] for r in joins.previous_row(spark.createDataFrame(points, "point long"), spark.createDataFrame(rows, "orig_line long, new_line long")).collect()}
    assert got == {1: 1, 3: 1, 8: 2, 9: 3, 100: 4}


def test_crowded_values_are_spread(spark):
    """Of values of which nearly all lie in a fiftieth of their span, as scores of forests do, no range holds many; ranges ascend with values."""
    rnd = random.Random(4)
    values = [(0.5 + rnd.random() / 50,) for _ in range(4000)] + [(rnd.random(),) for _ in range(96)] + [(None,)]
    out = value_ranges(spark.createDataFrame(values, "v double"), [], "v", 64).collect()
    held = {}
    for r in out:
        held.setdefault(r["_range"], []).append(r["v"])
    assert len(out) == len(values) and max(map(len, held.values())) <= 3 * 4097 / 64
    order = sorted((r["v"], r["_range"]) for r in out if r["v"] is not None)
    assert [x for _, x in order] == sorted(x for _, x in order)
    df = spark.createDataFrame([(v, int(rnd.random() < v)) for (v,) in values if v is not None], "score double, label int")
    rows = [(r["score"], r["label"]) for r in df.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
