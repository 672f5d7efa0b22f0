"""Structured Streaming forms: sources, stateful operators with pickled state, and the epoch loop for foreachBatch."""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.config import ForestConfig, IksConfig, PerFeatureHddmConfig, PipelineConfig, QuorumConfig
from tideglass.operators.detectors import ONSETS, make_detector
from tideglass.operators.forest import ModelStore, Scorer
from tideglass.operators.quorum import Quorum
from tideglass.operators.routing import split_features, with_shard
from tideglass.streaming.machines import Control, Coordinator, Shard


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """value and timestamp of a topic from its start. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"), "timestamp")


def file_source(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder replayed some files at a time; progress is the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def stateful(df: DataFrame, key: str, order: list[str], value: list[str], make: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, key, *values) -> rows, for a stream's rows by key and, inside a micro-batch, by `order`. The state is pickled into the state
    store, so a query goes on from its checkpoint."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(batches)).sort_values(order)
        out = [r for v in zip(*(pdf[c].tolist() for c in value)) for r in step(own, k[0], *v)]
        state.update((pickle.dumps(own),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_onsets(values: DataFrame, detector: str = "iks", iks: IksConfig | None = None, hddm: PerFeatureHddmConfig | None = None) -> DataFrame:
    return stateful(values, "feature_id", ["seq"], ["seq", "value"], lambda: make_detector(detector, iks, hddm), lambda s, g, seq, v: [(g, *x) for x in s.step(seq, v)], ONSETS)


def stream_rounds(onsets: DataFrame, config: QuorumConfig | None = None) -> DataFrame:
    """One key holds the single quorum: onsets are few."""
    config = config or QuorumConfig()
    one = onsets.withColumn("_all", F.lit(0))
    return stateful(one, "_all", ["emit_seq", "feature_id"], ["feature_id", "seq"], lambda: Quorum(config), lambda s, g, f, seq: [r] if (r := s.step(f, seq)) else [], "round_id bigint, seq bigint, status string, votes_yes int")


def stream_forests(trees: DataFrame, config: ForestConfig) -> DataFrame:
    """Tree rows (JSON of the tree in `tree`) -> version, round_id, subsample_size, n_trees."""

    def step(s: Coordinator, g, tree_id, shard, slot, batch, last, tree):
        made = s.add(("tree", tree_id, shard, slot, batch, last, json.loads(tree)))
        return [(made[0], made[1], made[3], len(made[2]))] if made else []

    value = ["tree_id", "producer_subtask", "slot_index", "batch_id", "batch_end", "tree"]
    return stateful(trees.withColumn("_all", F.lit(0)), "_all", ["batch_id", "slot_index"], value, lambda: Coordinator(config), step, "version bigint, round_id bigint, subsample_size int, n_trees int")


def stream_scores(rows: DataFrame, trees: list[dict], subsample: int, version: int = 1) -> DataFrame:
    """A stream scored by one version."""
    from tideglass.operators.forest import score

    return score(rows, trees, subsample, version)


class EpochLoop:
    """foreachBatch function of the closed loop. Each epoch leaves its own folders; one that is there is not computed again, so a
    batch that is run twice changes nothing. Rows are processed by shard and values by feature; only onsets and trees, which are few, reach the
    driver. What an epoch commits or builds is seen from the next epoch on."""

    def __init__(self, spark: SparkSession, path: str, config: PipelineConfig):
        self.spark, self.path, self.config, self.models = spark, path, config, ModelStore(spark, f"{path}/models")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _control(self, epoch: int) -> dict:
        path = f"{self.path}/control/{epoch}"
        if epoch < 0 or not self._exists(f"{path}/_SUCCESS"):
            return {"round_id": 0, "quorum": None, "coordinator": None}
        return json.loads(self.spark.read.text(path).first()[0])

    def _states(self, name: str, key: str, epoch: int) -> DataFrame:
        path = f"{self.path}/{name}/{epoch}"
        if epoch < 0 or not self._exists(f"{path}/_SUCCESS"):
            return self.spark.createDataFrame([], f"{key} int, state binary")
        return self.spark.read.parquet(path).filter("kind = 'state'").select(key, "state")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self._exists(f"{self.path}/control/{epoch}/_SUCCESS"):
            return
        cfg, before = self.config, self._control(epoch - 1)
        current = self.models.current()
        control = Control(0, None, before["round_id"])
        if current:
            control = Control(current[0], Scorer(current[1]["trees"], current[1]["subsample"]), before["round_id"])
        seen = self.spark.sparkContext.broadcast(control)
        # Rows of other shards move a shard's timer too.
        latest = batch.agg(F.max("seq")).first()[0] if cfg.processor.cooldown_timeout is not None else None

        def features(k, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            d = pickle.loads(state["state"].iloc[0]) if len(state) else make_detector(cfg.detector, cfg.iks, cfg.hddm)
            rows = rows.sort_values("seq")
            out = [("onset", int(k[0]), *x, None) for s, v in zip(rows["seq"].tolist(), rows["value"].tolist()) for x in d.step(s, v)]
            return pd.DataFrame([*out, ("state", int(k[0]), None, None, None, pickle.dumps(d))], columns=["kind", "feature_id", "seq", "ks", "emit_seq", "state"]).astype({"seq": "Int64", "emit_seq": "Int64", "ks": "float64"})

        values, old = split_features(batch), self._states("features", "feature_id", epoch - 1)
        values.groupBy("feature_id").cogroup(old.groupBy("feature_id")).applyInPandas(features, "kind string, feature_id int, seq bigint, ks double, emit_seq bigint, state binary").write.mode("overwrite").parquet(f"{self.path}/features/{epoch}")

        def shards(k, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            c = seen.value
            m = pickle.loads(state["state"].iloc[0]) if len(state) else Shard(int(k[0]), cfg.processor)
            rows = rows.sort_values("seq")
            data = list(zip(rows["seq"].tolist(), rows["id"].tolist(), rows["timestamp"].tolist(), rows["features"].tolist(), rows["label"].tolist()))
            scores = c.scorer(np.array([r[3] for r in data], dtype=float)).tolist() if c.scorer and data else [None] * len(data)
            events = []
            for r, s in zip(data, scores):
                events += m.expire(r[0], c)
                events += m.step(r, c, s, r[2])
            if latest is not None:
                events += m.expire(latest, c)
            out = [("score", m.number, e[1][0], e[1][1], e[1][4], e[2], e[3], e[4], None, None, None) if e[0] == "score" else ("tree", m.number, None, None, None, None, None, None, e[3], json.dumps(e[1:]), None) for e in events]
            frame = pd.DataFrame([*out, ("state", m.number, None, None, None, None, None, None, None, None, pickle.dumps(m))], columns=["kind", "shard", "seq", "id", "label", "score", "version", "phase", "slot", "message", "state"])
            return frame.astype({"seq": "Int64", "label": "Int64", "version": "Int64", "slot": "Int64", "score": "float64"})

        rows, old = with_shard(batch, cfg.processor.forest.parallelism), self._states("shards", "shard", epoch - 1)
        rows.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(shards, "kind string, shard int, seq bigint, id string, label int, score double, version bigint, phase string, slot int, message string, state binary").write.mode("overwrite").parquet(f"{self.path}/shards/{epoch}")

        load = lambda s, default: pickle.loads(base64.b64decode(s)) if s else default
        quorum, coordinator = load(before["quorum"], Quorum(cfg.quorum)), load(before["coordinator"], Coordinator(cfg.processor.forest))
        round_id = before["round_id"]
        for o in self.spark.read.parquet(f"{self.path}/features/{epoch}").filter("kind = 'onset'").orderBy("emit_seq", "feature_id").collect():
            if (c := quorum.step(o["feature_id"], o["seq"])) is not None:
                round_id = c[0]
        for t in self.spark.read.parquet(f"{self.path}/shards/{epoch}").filter("kind = 'tree'").orderBy("shard", "slot").collect():
            if (made := coordinator.add(("tree", *json.loads(t["message"])))) is not None:
                self.models.append(made[0], made[2], made[3], made[1])
        save = lambda o: base64.b64encode(pickle.dumps(o)).decode()
        done = json.dumps({"round_id": round_id, "quorum": save(quorum), "coordinator": save(coordinator)})
        self.spark.createDataFrame([(done,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/control/{epoch}")

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards/*").filter("kind = 'score'").select("seq", "id", "label", "score", "version", "phase", "shard")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
