"""Forest queries: scoring, training invariants, assembly."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from tideglass.config import ForestConfig
from tideglass.functions import average_path_length, batch_id, batch_round
from tideglass.operators import forest, joins, metrics, routing
from tideglass.queries.base import PT, Registry, points, rounded, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: A small literal forest: (tree, id, feature, threshold, left, right, size), 10 rows a tree, uneven depths.
NODES = (
    (0, 0, 0, 150.0, 1, 2, 10), (0, 1, -1, 0.0, -1, -1, 4), (0, 2, 1, 12.0, 3, 4, 6), (0, 3, -1, 0.0, -1, -1, 5), (0, 4, -1, 0.0, -1, -1, 1),
    (1, 0, 1, 6.0, 1, 2, 10), (1, 1, -1, 0.0, -1, -1, 3), (1, 2, 0, 300.0, 3, 6, 7), (1, 3, 0, 80.0, 4, 5, 6), (1, 4, -1, 0.0, -1, -1, 2), (1, 5, -1, 0.0, -1, -1, 4), (1, 6, -1, 0.0, -1, -1, 1),
    (2, 0, 0, 40.0, 1, 2, 10), (2, 1, -1, 0.0, -1, -1, 2), (2, 2, -1, 0.0, -1, -1, 8),
)
SAMPLE, DEPTH = 10, 3


def literal_trees() -> list[dict]:
    names = ("id", "feature", "threshold", "left", "right", "size")
    return [{"nodes": [dict(zip(names, n[1:])) for n in NODES if n[0] == t], "subsample_size": SAMPLE, "depth_limit": 4, "dimension": 2} for t in range(3)]


def literal_nodes(spark):
    rows = [(1, SAMPLE, *n) for n in NODES]
    return spark.createDataFrame(rows, "version long, subsample_size int, t int, id int, feature int, threshold double, left int, right int, size int")


_VALUES = ", ".join(f"({t}, {i}, {f}, {th}::DOUBLE, {l}, {r}, {s})" for t, i, f, th, l, r, s in NODES)
C = "(CASE WHEN {0} <= 1 THEN 0 ELSE 2 * (ln({0} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({0} - 1.0::DOUBLE) / {0} END)"
WALK = f"""WITH RECURSIVE {PT}, nd(t, id, feature, threshold, l, r, size) AS (VALUES {_VALUES}),
wk(seq, features, t, node, depth) AS (SELECT seq, features, t, nd.id, 0 FROM pt, nd WHERE nd.id = 0 UNION ALL SELECT w.seq, w.features, w.t, CASE WHEN w.features[n.feature + 1] < n.threshold THEN n.l ELSE n.r END, w.depth + 1 FROM wk w JOIN nd n ON n.t = w.t AND n.id = w.node AND n.feature >= 0),
lf AS (SELECT seq, wk.t, depth + {C.format('size')} AS h FROM wk JOIN nd ON nd.t = wk.t AND nd.id = wk.node AND nd.feature < 0),
sc AS (SELECT seq, avg(h) AS h, power(2.0::DOUBLE, -avg(h) / {C.format(SAMPLE)}) AS score FROM lf GROUP BY seq)"""


@register("score_forest", f"{WALK} SELECT seq, round(score, 6) AS score, label, CAST(1 AS BIGINT) AS forest_version FROM sc JOIN pt USING (seq)")
def score_forest(spark, sf):
    """The flagship: every event scored by a forest, in Arrow batches against the broadcast model."""
    return rounded(forest.score(points(spark, sf), literal_trees(), SAMPLE).select("seq", "score", "label", "forest_version"))


@register("IF7_score_native", f"{WALK} SELECT seq, round(score, 6) AS score FROM sc")
def if7(spark, sf):
    p = points(spark, sf)
    return rounded(p.select("seq", forest.score_native(F.col("features"), literal_trees(), SAMPLE).alias("score")))


@register("JN3_node_join", f"{WALK} SELECT seq, CAST(1 AS BIGINT) AS version, round(score, 6) AS score FROM sc")
def jn3(spark, sf):
    return rounded(forest.score_by_join(points(spark, sf), literal_nodes(spark), DEPTH))


@register("JN1_model_enrichment", f"{WALK} SELECT seq, id, label, round(score, 6) AS score, CAST(3 AS BIGINT) AS forest_version FROM sc JOIN pt USING (seq)")
def jn1(spark, sf):
    """Rows meet the one current model: the largest version of the model table."""
    models = spark.createDataFrame([(v, json.dumps({"trees": literal_trees(), "subsample": SAMPLE})) for v in (1, 3, 2)], "version long, model string")
    now = models.orderBy(F.desc("version")).first()
    model = json.loads(now["model"])
    return rounded(forest.score(points(spark, sf), model["trees"], model["subsample"], now["version"]).select("seq", "id", "label", "score", "forest_version"))


def path_rows(spark, sf):
    p = points(spark, sf)
    names = ("t", "h")
    trees = literal_trees()
    h = F.array(*(F.struct(F.lit(t).alias(names[0]), forest._tree_walk(trees[t]["nodes"], F.col("features")).cast("double").alias(names[1])) for t in range(3)))
    return p.select("seq", F.explode(h).alias("x")).select("seq", "x.t", "x.h")


@register("IF5_path_length", f"{WALK} SELECT seq, t, round(h, 6) AS h FROM lf")
def if5(spark, sf):
    return rounded(path_rows(spark, sf))


@register("AGG3_mean_path", f"{WALK} SELECT seq, round(h, 6) AS h FROM sc")
def agg3(spark, sf):
    return rounded(path_rows(spark, sf).groupBy("seq").agg(F.avg("h").alias("h")))


@register("IF6_path_constant", f"SELECT l_linenumber AS n, l_orderkey % 300 AS m, round({C.format('l_linenumber')}, 6) AS c_n, round({C.format('(l_orderkey % 300)')}, 6) AS c_m FROM lineitem GROUP BY l_linenumber, l_orderkey % 300")
def if6(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 300).alias("m")).distinct()
    return rounded(l.withColumns({"c_n": average_path_length(F.col("n")), "c_m": average_path_length(F.col("m"))}))


@register("PRJ3_score_projection", f"{WALK} SELECT seq, id, timestamp, label, round(score, 6) AS score, CAST(1 AS BIGINT) AS forest_version, 'C' AS phase, timestamp AS ingestion_time FROM sc JOIN pt USING (seq)")
def prj3(spark, sf):
    s = forest.score(points(spark, sf), literal_trees(), SAMPLE).withColumns({"ingestion_time": F.col("timestamp"), "score_time": F.unix_millis(F.current_timestamp())})
    return rounded(s.select("seq", "id", "timestamp", "label", "score", "forest_version", "phase", "ingestion_time"))


@register("IF8_tree_counts", "SELECT DISTINCT CAST(p AS INTEGER) AS p, CAST(ceil(100 / p::DOUBLE) AS INTEGER) AS per_shard, CAST(p * ceil(100 / p::DOUBLE) AS INTEGER) AS actual FROM (SELECT 1 + user_id % 23 AS p FROM events)")
def if8(spark, sf):
    ps = [r["p"] for r in table(spark, sf, "events").select((F.col("user_id") % 23 + 1).alias("p")).distinct().collect()]
    rows = [(p, ForestConfig(parallelism=p).trees_per_shard, ForestConfig(parallelism=p).actual_trees) for p in ps]
    return spark.createDataFrame(rows, "p int, per_shard int, actual int")


CONFIG = ForestConfig(total_trees=8, subsample_size=64, parallelism=2, seed=7)
RING = 200
_SH = "abs(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS BIGINT))"
#: The hash in two's complement, then its remainder without sign.
HASH = f"(CASE WHEN {_SH} >= 2147483648 THEN {_SH} - 4294967296 ELSE {_SH} END)"
_POOLS = f"{PT}, sh AS (SELECT *, CAST(abs({HASH} % 2) AS INTEGER) AS shard FROM pt), nu AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM sh), pool AS (SELECT shard, CAST(slot AS INTEGER) AS slot, seq, features FROM nu, range(4) r(slot) WHERE n BETWEEN slot + 2 AND slot + 1 + {RING})"


def sharded(spark, sf):
    from tideglass.operators.running import running

    return running(routing.with_shard(points(spark, sf), CONFIG.parallelism), ["shard"], "seq", {"n": ("count", F.lit(1))})


def pools(spark, sf):
    return forest.cold_start_pools(sharded(spark, sf), CONFIG, RING)


@register("STR1_cold_start_pools", f"WITH {_POOLS} SELECT shard, slot, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(seq) AS BIGINT) AS total FROM pool GROUP BY shard, slot")
def str1(spark, sf):
    """The rows that each cold-start tree is trained on."""
    return pools(spark, sf).groupBy("shard", "slot").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("seq").alias("total"))


_SAMPLE = f"{_POOLS}, u AS (SELECT *, row_number() OVER (PARTITION BY shard, slot ORDER BY md5('7|' || shard || '|' || slot || '|' || seq), seq) AS k FROM pool), smp AS (SELECT * FROM u WHERE k <= 64)"


@register("IF2_subsample", f"WITH {_SAMPLE} SELECT shard, slot, seq FROM smp")
def if2(spark, sf):
    return forest.sample_rows(pools(spark, sf), CONFIG).select("shard", "slot", "seq")


def trees(spark, sf, round_: int = 0):
    return forest.train(pools(spark, sf), CONFIG, round_)


@register("IF1_tree_invariants", f"WITH {_POOLS} SELECT shard, slot, CAST(least(64, count(*)) AS INTEGER) AS subsample_size, CAST(greatest(1, ceil(log2(least(64, count(*))))) AS INTEGER) AS depth_limit, CAST(max(len(features)) AS INTEGER) AS dimension, least(64, count(*)) AS leaf_rows, true AS preorder, true AS binary_tree FROM pool GROUP BY shard, slot")
def if1(spark, sf):
    """Leaves hold the whole subsample, children follow their parents, inner nodes are one fewer than leaves."""
    t = trees(spark, sf).select(F.col("producer_subtask").alias("shard"), F.col("slot_index").alias("slot"), "tree.*")
    leaf = F.filter("nodes", lambda n: n["feature"] == -1)
    inner = F.filter("nodes", lambda n: n["feature"] >= 0)
    rows = F.aggregate(leaf, F.lit(0).cast("long"), lambda a, n: a + n["size"])
    return t.select("shard", "slot", "subsample_size", "depth_limit", "dimension", rows.alias("leaf_rows"), F.forall(inner, lambda n: (n["left"] > n["id"]) & (n["right"] > n["left"])).alias("preorder"), (F.size(leaf) == F.size(inner) + 1).alias("binary_tree"))


@register("IF3_build_from_pool", f"WITH {_POOLS} SELECT shard, CAST(least(64, count(*)) AS INTEGER) AS subsample_size, count(*) AS pool FROM pool WHERE slot = 0 GROUP BY shard")
def if3(spark, sf):
    """A tree of each shard's first pool, by the pool form that the state machine uses."""
    import numpy as np

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = np.array(pdf.sort_values("seq")["features"].tolist(), dtype=float)
        tree = forest.build_from_pool(pool, CONFIG.subsample_size, CONFIG.seed, int(pdf["shard"].iloc[0]), 0, 0)
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "subsample_size": tree["subsample_size"], "pool": len(pool)}])

    return pools(spark, sf).filter("slot = 0").groupBy("shard").applyInPandas(build, "shard int, subsample_size int, pool long")


@register("IF4_reproducible", f"WITH {_POOLS} SELECT count(DISTINCT (shard, slot)) AS trees, count(DISTINCT (shard, slot)) AS equal FROM pool")
def if4(spark, sf):
    """The same seed gives the same trees however rows are dealt."""
    a = trees(spark, sf).select("tree_id", F.to_json("tree").alias("a"))
    b = forest.train(pools(spark, sf).repartition(3, "seq"), CONFIG).select("tree_id", F.to_json("tree").alias("b"))
    return a.join(b, "tree_id").agg(F.count("*").alias("trees"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


def versions(spark, sf):
    t = trees(spark, sf)
    later = trees(spark, sf, 1).filter("NOT (producer_subtask = 1 AND slot_index = 3)")
    whole = trees(spark, sf, 2)
    stray = trees(spark, sf, 3).limit(1).withColumn("producer_subtask", F.lit(99))
    return t.unionByName(later).unionByName(whole).unionByName(stray)


@register("AGG1_assembly", f"WITH {_POOLS}, ps AS (SELECT shard, slot, least(64, count(*)) AS m FROM pool GROUP BY shard, slot) SELECT CAST(version AS BIGINT) AS version, CAST(round_id AS BIGINT) AS round_id, CAST(max(m) AS INTEGER) AS subsample_size, CAST(count(*) AS INTEGER) AS n_trees FROM ps, (VALUES (1, 0), (2, 2)) v(version, round_id) GROUP BY version, round_id HAVING count(*) = 8 AND count(DISTINCT m) = 1")
def agg1(spark, sf):
    """Rounds 0 and 2 are whole, round 1 lacks a tree, a stray shard is left out."""
    return forest.assemble(versions(spark, sf), CONFIG).select("version", "round_id", "subsample_size", F.size("trees").alias("n_trees"))


@register("PRJ4_slot_filter", f"WITH {_POOLS} SELECT DISTINCT shard AS producer_subtask, slot AS slot_index FROM pool")
def prj4(spark, sf):
    t = trees(spark, sf).unionByName(trees(spark, sf).withColumn("slot_index", F.col("slot_index") + 50))
    return t.filter(F.col("producer_subtask").between(0, CONFIG.parallelism - 1) & F.col("slot_index").between(0, CONFIG.trees_per_shard - 1)).select("producer_subtask", "slot_index")


@register("SRT4_tree_order", f"WITH {_POOLS} SELECT CAST(row_number() OVER (ORDER BY shard, slot) - 1 AS INTEGER) AS pos, shard, slot FROM (SELECT DISTINCT shard, slot FROM pool)")
def srt4(spark, sf):
    f = forest.assemble(trees(spark, sf), CONFIG)
    return f.select(F.posexplode("trees").alias("pos", "t")).select("pos", F.col("t.producer_subtask").alias("shard"), F.col("t.slot_index").alias("slot"))


@register("IF11_json_round_trip", f"WITH {_POOLS} SELECT CAST(1 AS BIGINT) AS version, shard, slot, CAST(least(64, count(*)) AS INTEGER) AS subsample_size, least(64, count(*)) AS leaf_rows, true AS same FROM pool GROUP BY shard, slot")
def if11(spark, sf):
    f = forest.assemble(trees(spark, sf), CONFIG)
    each = lambda df, name: df.select("version", F.explode("trees").alias("t")).select("version", F.col("t.producer_subtask").alias("shard"), F.col("t.slot_index").alias("slot"), F.col("t.tree").alias(name))
    both = each(f, "a").join(each(forest.from_json(forest.to_json(f)), "b"), ["version", "shard", "slot"])
    rows = F.aggregate(F.filter("b.nodes", lambda n: n["feature"] == -1), F.lit(0).cast("long"), lambda x, n: x + n["size"])
    return both.select("version", "shard", "slot", F.col("b.subsample_size").alias("subsample_size"), rows.alias("leaf_rows"), (F.to_json("a") == F.to_json("b")).alias("same"))


@register("SC3_batch_ids", "SELECT event_id, (user_id << 32) | (event_id % 100) AS batch_id, ((user_id << 32) | (event_id % 100)) & 4294967295 AS round_id, ((user_id << 32) | (event_id % 100)) >> 32 AS shard FROM events")
def sc3(spark, sf):
    e = table(spark, sf, "events").select("event_id", batch_id(F.col("user_id"), F.col("event_id") % 100).alias("batch_id"))
    return e.withColumns({"round_id": batch_round(F.col("batch_id")), "shard": F.shiftright("batch_id", 32)})


def _frozen(spark, sf, rows_filter, key: int, pool_rows: int, n_trees: int = 100):
    """A forest of n_trees trees on the first pool_rows of the rows (by hash) that the filter keeps."""
    import numpy as np

    p = points(spark, sf).filter(rows_filter)
    pool = [r["features"] for r in p.select("features", F.md5(F.col("id").cast("binary")).alias("h")).orderBy("h").limit(pool_rows).collect()]
    x = np.array(pool, dtype=float)
    return [forest.build_from_pool(x, 256, 42, key, k, 0) for k in range(n_trees)]


@register("IF9_frozen_baseline")
def if9(spark, sf):
    """AUC before and after the middle of the stream of 100 trees trained on 4,000 ordinary rows of its first third."""
    n = table(spark, sf, "events").count()
    t = _frozen(spark, sf, (F.col("label") == 0) & (F.col("seq") < n // 3), 1, 4000)
    s = forest.score(points(spark, sf), t, t[0]["subsample_size"]).withColumn("part", F.when(F.col("seq") * 2 < n, "before").otherwise("after"))
    return rounded(metrics.roc_auc(s, ["part"]))


@register("IF10_oracle_ceiling")
def if10(spark, sf):
    """The AUC after the middle of the stream of 100 trees by training pool: 1,000 or 4,000 ordinary rows after it, or 1,000 of all rows."""
    n = table(spark, sf, "events").count()
    after = F.col("seq") * 2 >= n
    out = None
    clean = after & (F.col("label") == 0)
    for k, (name, keep, rows) in enumerate((("clean-1000", clean, 1000), ("clean-4000", clean, 4000), ("unfiltered-1000", after, 1000))):
        t = _frozen(spark, sf, keep, k, rows)
        a = metrics.roc_auc(forest.score(points(spark, sf).filter(after), t, t[0]["subsample_size"])).select(F.lit(name).alias("pool"), "n", "auc")
        out = a if out is None else out.unionByName(a)
    return rounded(out)


@register("wide_lineitem_scores")
def wide(spark, sf):
    """lineitem's four measures scored by a forest trained on them, summed by order: the flagship at full width."""
    import numpy as np

    l = table(spark, sf, "lineitem").select("l_orderkey", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    pool = l.orderBy(F.xxhash64("l_orderkey", "features")).limit(1000)
    x = np.array(sorted(r["features"] for r in pool.collect()), dtype=float)
    t = [forest.build_from_pool(x, 256, 42, 0, k, 0) for k in range(25)]
    s = forest.score(l, t, t[0]["subsample_size"])
    return rounded(s.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")))


@register("embedding_scores")
def embeddings(spark, sf):
    """64-dimensional rows, the rarest class as anomalies: AUC of a forest trained on the others."""
    import numpy as np

    e = metrics.relabel(table(spark, sf, "embeddings"), "label").select(F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("features"), F.col("new_label").alias("label"))
    x = np.array([r["features"] for r in e.filter("label = 0").orderBy(F.xxhash64("seq"), "seq").limit(256).collect()], dtype=float)
    t = [forest.build_from_pool(x, 128, 42, 0, k, 0) for k in range(50)]
    return rounded(metrics.roc_auc(forest.score(e, t, t[0]["subsample_size"])))


#: The walk, and the same with thresholds half as large again.
_TAIL = WALK[WALK.index("\nwk(") + 1 :]
_WALKS = f"{WALK}, " + re.sub(r"\b(wk|lf|sc)\b", r"\g<1>2", _TAIL.replace("< n.threshold", "< n.threshold * 1.5::DOUBLE"))


@register("JN2_scored_as_of", f"{_WALKS} SELECT seq, CAST(1 AS BIGINT) AS version, round(score, 6) AS score FROM sc, (SELECT count(*) AS n FROM events) WHERE seq < n // 2 UNION ALL SELECT seq, 2, round(score, 6) FROM sc2, (SELECT count(*) AS n FROM events) WHERE seq >= n // 2")
def jn2_scored(spark, sf):
    """Each row with the score of the version that was current at it, of two versions in one pass."""
    n = table(spark, sf, "events").count()
    one = literal_nodes(spark)
    both = one.unionByName(one.withColumns({"version": F.lit(2).cast("long"), "threshold": F.col("threshold") * 1.5}))
    current = joins.as_of_version(points(spark, sf).select("seq"), spark.createDataFrame([(1, 0), (2, n // 2)], "version long, swap_seq long"))
    return rounded(forest.score_by_join(points(spark, sf), both, DEPTH).join(current, ["seq", "version"]))
