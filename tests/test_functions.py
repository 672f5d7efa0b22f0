import math

import pytest
from pyspark.sql import functions as F

from tideglass import config, schemas
from tideglass.functions import average_path_length, java_hash, parse_exp_id, shard_of
from tideglass.functions.scalar import ewma_bound, ks_confirm_threshold, ks_threshold, path_constant


@pytest.mark.parametrize("n,want", [(0, 0), (1, 0), (2, 0.1544313298), (3, 1.2073923576), (10, 3.7488804845), (256, 10.2447709201)])
def test_path_constant(spark, n, want):
    assert path_constant(n) == pytest.approx(want, abs=1e-9)
    assert spark.range(1).select(average_path_length(F.lit(n))).first()[0] == pytest.approx(want, abs=1e-9)


def test_thresholds():
    assert ks_confirm_threshold(0.001) == pytest.approx(1.8584610944, abs=1e-9)
    assert [ks_threshold(0.001, w) for w in (2000, 200, 30)] == pytest.approx([0.0587697000, 0.1858461094, 0.4798525912], abs=1e-9)
    assert [ewma_bound(x, 0.001) for x in (0.002, 0.005, 0.01, 0.1)] == pytest.approx([0.0587991, 0.0930394, 0.1317428, 0.4263602], abs=1e-6)


def string_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_string_hash(spark):
    texts = ["", "a", "12345", "a long identifier with spaces", "zzzzzzzzzz", "é€"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", java_hash(F.col("t")).alias("h"), shard_of(F.col("t"), 4).alias("s"))
    for r in df.collect():
        h = string_hash(r["t"])
        assert r["h"] == h and r["s"] == abs(int(math.fmod(h, 4)))


def test_exp_ids(spark):
    df = spark.createDataFrame([("my_set_c1_iks_p4_r2_lam-0.1",), ("nothing",)], "e string")
    a, b = [r["x"] for r in df.select(parse_exp_id(F.col("e")).alias("x")).collect()]
    assert (a["dataset"], a["config"], a["algo"], a["parallelism"], a["run"], a["extra"]) == ("my_set", "c1", "iks", 4, 2, "lam-0.1")
    assert b["dataset"] is None


@pytest.mark.parametrize("make", [lambda: config.HddmConfig(drift_confidence=0.1, warn_confidence=0.01), lambda: config.HddmConfig(lam=1.5), lambda: config.HddmConfig(warn_timeout=0), lambda: config.IksConfig(window=0), lambda: config.IksConfig(p_value=0), lambda: config.IksConfig(confirm_window=0), lambda: config.QuorumConfig(k=0), lambda: config.PerFeatureHddmConfig(scale_mode="x"), lambda: config.PipelineConfig(detector="x"), lambda: config.ProcessorConfig(cooldown_policy="x"), lambda: config.ForestConfig(total_trees=0)])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_shares_of_trees():
    assert (config.ForestConfig(100, parallelism=6).trees_per_shard, config.ForestConfig(100, parallelism=6).actual_trees) == (17, 102)


def test_messages(spark):
    df = spark.createDataFrame([('{"round_id": 3, "status": "COMMITTED"}',), ("{",)], "value string")
    rows = schemas.parse_messages(df, schemas.DRIFT_ROUND).collect()
    assert [(r["round_id"], r["status"], r["votes_yes"], r["timestamp"]) for r in rows] == [(3, "COMMITTED", 0, 0)]
