"""Isolation forests: sampling and training by tree, assembly of versions, scoring, the model table.

All random choices are uniforms fixed by (seed, shard, slot, round, place in the tree), so a tree does not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.config import ForestConfig
from tideglass.functions.scalar import average_path_length, batch_id, batch_round, path_constant
from tideglass.schemas import FOREST_MESSAGE, TREE_DDL

Node = tuple[int, int, float, int, int, int]  # id, feature (-1: leaf), threshold, left, right, size


def uniform(*parts) -> float:
    """The same number as functions.scalar.uniform gives for the same parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def depth_limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(sample))) if sample > 1 else 1


def build_tree(rows: np.ndarray, *key) -> list[Node]:
    """Nodes in preorder, root first; a row goes left if its value is less than the threshold. A node is a leaf at the depth limit,
    with one row, or if the feature drawn does not divide it."""
    limit = depth_limit(len(rows))
    nodes: list[list] = []
    stack = [(rows, 0, -1, 0)]
    while stack:
        part, depth, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = here
        nodes.append([here, -1, 0.0, -1, -1, len(part)])
        if depth >= limit or len(part) <= 1:
            continue
        f = min(int(uniform(*key, here, "f") * part.shape[1]), part.shape[1] - 1)
        low, high = float(part[:, f].min()), float(part[:, f].max())
        if low == high:
            continue
        cut = low + (high - low) * uniform(*key, here, "t")
        left = part[:, f] < cut
        if left.all() or not left.any():
            continue
        nodes[here][1:3] = [f, cut]
        stack += [(part[~left], depth + 1, here, 1), (part[left], depth + 1, here, 0)]
    return [tuple(n) for n in nodes]


def as_tree(nodes: list[Node], sample: int, dimension: int) -> dict:
    names = ("id", "feature", "threshold", "left", "right", "size")
    return {"nodes": [dict(zip(names, n)) for n in nodes], "subsample_size": sample, "depth_limit": depth_limit(sample), "dimension": dimension}


def build_from_pool(pool: np.ndarray, subsample: int, *key) -> dict:
    """A tree of min(subsample, pool) rows drawn without replacement: the first by their uniforms."""
    if len(pool) == 0:
        raise ValueError("an empty pool has no tree")
    order = sorted(range(len(pool)), key=lambda i: (uniform(*key, i, "s"), i))[: min(subsample, len(pool))]
    return as_tree(build_tree(pool[sorted(order)], *key), len(order), pool.shape[1])


TREE_ROWS = f"tree_id string, producer_subtask int, created_at bigint, slot_index int, batch_id bigint, batch_end boolean, tree {TREE_DDL}"


def sample_rows(pools: DataFrame, config: ForestConfig) -> DataFrame:
    """pools: shard, slot, seq, features. The rows of each (shard, slot) that its tree is built from: the first subsample_size by
    a uniform of (seed, shard, slot, seq), as `u`."""
    u = F.md5(F.concat_ws("|", F.lit(config.seed), "shard", "slot", "seq").cast("binary"))
    return pools.withColumn("u", u).withColumn("_n", F.row_number().over(Window.partitionBy("shard", "slot").orderBy("u", "seq"))).filter(F.col("_n") <= config.subsample_size).drop("_n")


def train(pools: DataFrame, config: ForestConfig, round_: int = 0) -> DataFrame:
    """pools: shard, slot, seq, features -> tree rows. Work is dealt by tree; a group is one subsample."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "seq"])
        shard, slot = int(pdf["shard"].iloc[0]), int(pdf["slot"].iloc[0])
        rows = np.array(pdf["features"].tolist(), dtype=float)
        tree = as_tree(build_tree(rows, config.seed, shard, slot, round_), len(rows), rows.shape[1])
        return pd.DataFrame([{"tree_id": f"{round_}-{shard}-{slot}", "producer_subtask": shard, "created_at": 0, "slot_index": slot, "batch_id": (shard << 32) | round_, "batch_end": slot == config.trees_per_shard - 1, "tree": tree}])

    return sample_rows(pools, config).groupBy("shard", "slot").applyInPandas(build, TREE_ROWS)


def cold_start_pools(rows: DataFrame, config: ForestConfig, ring: int) -> DataFrame:
    """rows: shard, n (position in the shard from 1), seq, features. Tree k of a shard is trained by its row ring + 1 + k on the
    `ring` rows before and with it, so pools of successive trees are shifted by one row."""
    slots = F.sequence(F.greatest(F.lit(0), F.col("n") - ring - 1), F.least(F.lit(config.trees_per_shard - 1), F.col("n") - 2))
    usable = rows.filter((F.col("n") >= 2) & (F.col("n") <= ring + config.trees_per_shard))
    return usable.select("shard", F.explode(F.filter(slots, lambda k: (F.col("n") >= k + 2) & (F.col("n") <= k + 1 + ring))).alias("slot"), "seq", "features").withColumn("slot", F.col("slot").cast("int"))


def assemble(trees: DataFrame, config: ForestConfig) -> DataFrame:
    """Forests, one version per round that has every (shard, slot) of the configuration, with one subsample size: version (1, 2, ... in the
    order of rounds), round_id, subsample_size, trees ordered by (shard, slot). Trees out of range are left out; of repeated ones the
    last counts."""
    valid = trees.filter(F.col("producer_subtask").between(0, config.parallelism - 1) & F.col("slot_index").between(0, config.trees_per_shard - 1)).withColumn("round_id", batch_round(F.col("batch_id")))
    last = valid.groupBy("round_id", "producer_subtask", "slot_index").agg(F.max_by(F.struct("tree_id", "created_at", "batch_id", "batch_end", "tree"), F.struct("created_at", "tree_id")).alias("t"))
    rounds = last.groupBy("round_id").agg(F.count("*").alias("n"), F.count_distinct("t.tree.subsample_size").alias("sizes"), F.first("t.tree.subsample_size").alias("subsample_size"), F.array_sort(F.collect_list(F.struct("producer_subtask", "slot_index", "t"))).alias("trees"))
    whole = rounds.filter((F.col("n") == config.actual_trees) & (F.col("sizes") == 1))
    tree = lambda x: F.struct(x["t"]["tree_id"].alias("tree_id"), x["producer_subtask"].alias("producer_subtask"), x["t"]["created_at"].alias("created_at"), x["slot_index"].alias("slot_index"), x["t"]["batch_id"].alias("batch_id"), x["t"]["batch_end"].alias("batch_end"), x["t"]["tree"].alias("tree"))
    # One row per version: a version is a model, not data.
    return whole.select(F.row_number().over(Window.orderBy("round_id")).cast("long").alias("version"), "round_id", "subsample_size", F.transform("trees", tree).alias("trees"))


class Scorer:
    """A forest as flat arrays; scores many rows at once."""

    def __init__(self, trees: list[dict], subsample: int):
        self.subsample, self.constant, self.trees = subsample, path_constant(subsample), []
        for t in trees:
            n = t["nodes"]
            ints = lambda k: np.array([x[k] for x in n], dtype=np.int32)
            extra = np.array([path_constant(x["size"]) for x in n])
            self.trees.append((ints("feature"), np.array([x["threshold"] for x in n], dtype=float), ints("left"), ints("right"), extra))

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, extra in self.trees:
            at, depth = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                i = rows[inner]
                node = at[i]
                at[i] = np.where(x[i, feature[node]] < threshold[node], left[node], right[node])
                depth[i] += 1
            total += depth + extra[at]
        return total / max(1, len(self.trees))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / c(subsample)); 0 where c is 0."""
        if self.constant == 0 or not len(x):
            return np.zeros(len(x))
        return np.power(2.0, -self.path_lengths(x) / self.constant)


def model_size(trees: list[dict]) -> int:
    return sum(len(t["nodes"]) for t in trees) * 32


def score(df: DataFrame, trees: list[dict], subsample: int, version: int = 1, phase: str = "C") -> DataFrame:
    """df with score, forest_version and phase; Arrow batches against the broadcast forest (32 bytes a node)."""
    if model_size(trees) > 1 << 30:
        raise ValueError("a forest of over 1 GB is not broadcast")
    forest = df.sparkSession.sparkContext.broadcast(Scorer(trees, subsample))
    names = df.columns
    at = names.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(at)
            x = np.asarray(c.flatten(), dtype=float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value(x), pa.float64())], names=[*names, "score"])

    schema = df.select("*").schema.add("score", "double")
    return df.mapInArrow(run, schema).withColumns({"forest_version": F.lit(version).cast("long"), "phase": F.lit(phase)})


def _tree_walk(nodes: list[dict], features: Column) -> Column:
    """Depth of the leaf plus its constant, as nested CASE expressions: for small literal trees."""
    by_id = {n["id"]: n for n in nodes}

    def at(k: int, depth: int) -> Column:
        n = by_id[k]
        if n["feature"] < 0:
            return F.lit(depth + path_constant(n["size"]))
        return F.when(F.get(features, F.lit(n["feature"])) < n["threshold"], at(n["left"], depth + 1)).otherwise(at(n["right"], depth + 1))

    return at(0, 0)


def score_native(features: Column, trees: list[dict], subsample: int) -> Column:
    """The score as one expression, for forests of a few small trees."""
    mean = sum((_tree_walk(t["nodes"], features) for t in trees), F.lit(0.0)) / F.lit(float(len(trees)))
    c = path_constant(subsample)
    return F.lit(0.0) if c == 0 else F.pow(F.lit(2.0), -mean / F.lit(c))


def nodes_of(forest: DataFrame) -> DataFrame:
    """A row per node of each version: version, tree, id, feature, threshold, left, right, size."""
    trees = forest.select("version", "subsample_size", F.posexplode("trees").alias("t", "m"))
    return trees.select("version", "subsample_size", "t", F.explode("m.tree.nodes").alias("n")).select("version", "subsample_size", "t", "n.*")


def score_by_join(df: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """seq, version, score by joining rows with the nodes they reach, one level at a time: for forests in a table, of any number of
    versions; joins are on (version, tree, node), and Spark broadcasts the nodes where they are small. A row starts once for each tree."""
    n = nodes.select("version", "subsample_size", "t", "id", "feature", "threshold", "left", "right", "size")
    trees = n.filter("id = 0").agg(F.collect_set(F.struct("version", "subsample_size", "t")).alias("_trees"))  # one row, 16 bytes for each tree
    at = df.select("seq", "features").crossJoin(trees).select("seq", "features", F.explode("_trees").alias("_t")).select("seq", "features", "_t.*").withColumns({"node": F.lit(0), "h": F.lit(0.0)})
    for _ in range(depth):
        step = at.join(n.withColumnsRenamed({"version": "_v", "t": "_t", "subsample_size": "_s"}), (F.col("node") == F.col("id")) & (F.col("t") == F.col("_t")) & (F.col("version") == F.col("_v")))
        inner = F.col("feature") >= 0
        at = step.select("seq", "features", "version", "subsample_size", "t", F.when(inner, F.when(F.get("features", F.col("feature")) < F.col("threshold"), F.col("left")).otherwise(F.col("right"))).otherwise(F.col("node")).alias("node"), (F.col("h") + F.when(inner, 1.0).otherwise(0.0)).alias("h"))
    leaf = at.join(n.select(F.col("version").alias("_v"), F.col("t").alias("_t"), "id", "size"), (F.col("node") == F.col("id")) & (F.col("t") == F.col("_t")) & (F.col("version") == F.col("_v")))
    mean = F.avg(F.col("h") + average_path_length(F.col("size")))
    c = average_path_length(F.first("subsample_size"))
    return leaf.groupBy("seq", "version").agg(F.when(c == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -mean / c)).alias("score"))


def to_json(forest: DataFrame) -> DataFrame:
    return forest.select("version", F.to_json(F.struct(*forest.columns)).alias("value"))


def from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("value", f"{FOREST_MESSAGE}, round_id bigint").alias("f")).select("f.version", "f.round_id", "f.subsample_size", "f.trees")


class ModelStore:
    """An append-only table of forest versions: version=v folders of JSON rows. A version that is there is not written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, version: int) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def append(self, version: int, trees: list[dict], subsample: int, round_id: int = 0, swap_seq: int = 0) -> None:
        if not self._exists(version):
            row = json.dumps({"subsample": subsample, "round_id": round_id, "swap_seq": swap_seq, "trees": trees})
            self.spark.createDataFrame([(row,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def current(self) -> tuple[int, dict] | None:
        try:
            last = self.versions().orderBy(F.desc("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return None if last is None else (int(last["version"]), json.loads(last["model"]))


def pack_batch(shard: str, round_: str) -> Column:
    return batch_id(F.col(shard), F.col(round_))
