"""The closed loop and the streaming forms over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.config import ForestConfig, HddmConfig, IksConfig, PauseMode, PerFeatureHddmConfig, PipelineConfig, ProcessorConfig, QuorumConfig
from tideglass.operators import detectors, metrics
from tideglass.operators.routing import split_features
from tideglass.queries.base import PT, Registry, points, rounded, shifted_values, table
from tideglass.queries.ingest import scratch
from tideglass.queries.models import HASH, SAMPLE, WALK, literal_trees
from tideglass.sources import sinks
from tideglass.streaming import stateful
from tideglass.streaming.replay import replay

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

FOREST = ForestConfig(total_trees=8, subsample_size=64, parallelism=2, seed=7)


def config(**over) -> PipelineConfig:
    p = {"forest": FOREST, "ring_size": 200, "cooldown_samples": 300, **over}
    return PipelineConfig(processor=ProcessorConfig(**p), detector="hddm_w", hddm=PerFeatureHddmConfig(warmup=300, hddm=HddmConfig(lam=0.02)), iks=IksConfig(window=300), quorum=QuorumConfig(2, 1000, 2000))


def shifted_points(spark, sf):
    """events with two features moved from the middle of the stream."""
    n = F.broadcast(table(spark, sf, "events").agg(F.count("*").alias("_n")))
    late = F.col("seq") * 2 >= F.col("_n")
    f = F.transform("features", lambda x, i: x + F.when(late & (i == 0), 400.0).when(late & (i == 2), 200.0).otherwise(0.0))
    return points(spark, sf).crossJoin(n).withColumn("features", f).drop("_n")


def loop(spark, sf, **over):
    """Each fifth of the users is a run of its own; runs are replayed side by side."""
    p = shifted_points(spark, sf).withColumn("run", (F.col("features")[2].cast("long") % 5))
    return replay(p, config(**over), epoch=500, run="run")


#: The replay of given rounds: rows a ring, rows a cooldown; rounds at 6 and 13 twentieths of the events, epochs of one twentieth.
RING, COOLDOWN = 50, 80


def replayed(spark, sf, **over):
    """The loop without detectors: two rounds are given, so that what every shard does follows from the order of its rows."""
    p = points(spark, sf).withColumn("run", (F.col("features")[2].cast("long") % 5))
    n = p.count()
    return replay(p, config(**{"ring_size": RING, "cooldown_samples": COOLDOWN, **over}), epoch=n // 20, run="run", rounds=[(1, 6 * n // 20), (2, 13 * n // 20)])


def _replay_sql(rows: int = COOLDOWN, name: str = "") -> str:
    """CTEs of the same by the order of rows: r (rows by run and shard), first (of each run: when version 1 was made and from where it counts),
    ent{name} (each shard's first row in a cooldown), ret{name} (its last, which trains the trees), ver{name} (versions)."""
    head = f"""{PT}, nn AS (SELECT count(*) AS n, count(*) // 20 AS ep FROM events),
r AS (SELECT run, seq, shard, row_number() OVER (PARTITION BY run, shard ORDER BY seq) AS rn FROM (SELECT CAST(CAST(features[3] AS BIGINT) % 5 AS VARCHAR) AS run, seq, CAST(abs({HASH} % 2) AS INTEGER) AS shard FROM pt)),
first AS (SELECT run, max(seq) AS made, (max(seq) // any_value(ep) + 1) * any_value(ep) AS eff FROM r, nn WHERE rn = {RING} + 4 GROUP BY run HAVING count(*) = 2),
cm AS (SELECT run, k, min(seq) AS since, (min(seq) // any_value(ep) + 1) * any_value(ep) AS eff FROM r, nn, (VALUES (1, 6), (2, 13)) c(k, share) WHERE seq >= share * n // 20 GROUP BY run, k), """
    return (head if not name else "") + f"""ent{name} AS (SELECT r.run, shard, k, min(rn) AS rn0 FROM cm JOIN first USING (run) JOIN r ON r.run = cm.run AND seq >= greatest(cm.eff, first.eff) GROUP BY r.run, shard, k),
ret{name} AS (SELECT e.run, e.shard, e.k, r.seq, r.rn, e.rn0 FROM ent{name} e JOIN r ON r.run = e.run AND r.shard = e.shard AND r.rn = e.rn0 + {rows} - 1 WHERE NOT EXISTS (SELECT 1 FROM ent{name} f WHERE f.run = e.run AND f.shard = e.shard AND f.k = e.k + 1 AND f.rn0 <= r.rn)),
ver{name} AS (SELECT run, 0 AS k, 1 AS version, made, eff FROM first UNION ALL SELECT run, k, 1 + row_number() OVER (PARTITION BY run ORDER BY k), max(seq), (max(seq) // any_value(ep) + 1) * any_value(ep) FROM ret{name}, nn GROUP BY run, k HAVING count(*) = 2)"""


_R = _replay_sql()
#: Rows scored before version 1 counts (phase A) and after, with the version of their epoch.
_SCORED = f"{_R}, sc AS (SELECT r.run, r.shard, r.rn, seq, (SELECT max(version) FROM ver v WHERE v.run = r.run AND v.eff <= greatest(seq, first.eff)) AS version, CASE WHEN seq < first.eff THEN 'A' ELSE 'C' END AS phase FROM r JOIN first USING (run))"


@register("STR15_closed_loop")
def str15(spark, sf):
    """How many scores, trees, versions, onsets and rounds each run has."""
    return loop(spark, sf).groupBy("run", "kind").agg(F.count("*").alias("n"))


@register("STR2_phase_a", f"WITH {_SCORED} SELECT run, CAST(1 AS BIGINT) AS version, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM sc WHERE phase = 'A' GROUP BY run")
def str2(spark, sf):
    """What was held back until the first forest: scored by version 1, without an ingestion time."""
    s = replayed(spark, sf).filter("kind = 'score' AND phase = 'A' AND ingestion_time = 0")
    return s.groupBy("run", "version").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("STR3_stream_scores", f"{WALK} SELECT seq, round(score, 6) AS score FROM sc")
def str3(spark, sf):
    """events streamed from files and scored by one version, to the end of what there is."""
    scored = stateful.stream_scores(_stream(spark, points(spark, sf)), literal_trees(), SAMPLE)
    return rounded(_drained(spark, scored.select("seq", "score"), "scores"))


@register("STR4_decisions_consumed", f"WITH {_R} SELECT run, count(*) AS committed, (SELECT count(DISTINCT k) FROM ret WHERE ret.run = cm.run) AS retrained, (SELECT count(*) FROM ret WHERE ret.run = cm.run) AS consumed FROM cm GROUP BY run")
def str4(spark, sf):
    """Rounds committed, rounds whose trees were built, and how often a shard built trees for a round: once each."""
    r = replayed(spark, sf)
    trees = r.filter("kind = 'tree' AND round_id > 0").groupBy("run").agg(F.count_distinct("round_id").alias("retrained"), F.count_if(F.col("slot") == 0).alias("consumed"))
    return r.filter("kind = 'round'").groupBy("run").agg(F.count("*").alias("committed")).join(trees, "run", "left").na.fill(0)


@register("STR5_cooldown_entry", f"WITH {_R} SELECT run, CAST(k AS BIGINT) AS round_id, shard, seq AS trained_at, CAST(4 AS BIGINT) AS trees FROM ret")
def str5(spark, sf):
    """The row at which each shard has seen as many rows since it entered the cooldown of a round as that takes."""
    return replayed(spark, sf).filter("kind = 'tree' AND round_id > 0").groupBy("run", "round_id", "shard").agg(F.max("seq").alias("trained_at"), F.count("*").alias("trees"))


@register("STR6_cooldown_policies", f"WITH {_R}, al AS (SELECT run, 0 AS k, made AS seq FROM first UNION ALL SELECT run, k, max(seq) FROM ret GROUP BY run, k) SELECT policy, run, CAST(al.k AS BIGINT) AS round_id, CASE WHEN al.k = 0 THEN 8 ELSE 4 * (SELECT count(*) FROM ret WHERE ret.run = al.run AND ret.k = al.k) END AS trees, seq AS last_seq FROM al, (VALUES ('d1a'), ('legacy')) p(policy)")
def str6(spark, sf):
    """Trees that the two ways of filling the ring lead to; rows that the gate leaves out do not delay them here."""
    a = replayed(spark, sf).withColumn("policy", F.lit("d1a"))
    b = replayed(spark, sf, cooldown_policy="legacy").withColumn("policy", F.lit("legacy"))
    return a.unionByName(b).filter("kind = 'tree'").groupBy("policy", "run", "round_id").agg(F.count("*").alias("trees"), F.max("seq").alias("last_seq"))


@register("STR7_fill_conditions", f"WITH {_R}, {_replay_sql(RING, '2')} SELECT 'cooldownsamples' AS fill, run, CAST(k AS BIGINT) AS round_id, min(seq) AS first_tree_at FROM ret GROUP BY run, k UNION ALL SELECT 'ringfull', run, k, min(seq) FROM ret2 GROUP BY run, k")
def str7(spark, sf):
    """When retraining starts, by the condition that ends a cooldown."""
    a = replayed(spark, sf).withColumn("fill", F.lit("cooldownsamples"))
    b = replayed(spark, sf, d1a_fill="ringfull").withColumn("fill", F.lit("ringfull"))
    return a.unionByName(b).filter("kind = 'tree' AND round_id > 0").groupBy("fill", "run", "round_id").agg(F.min("seq").alias("first_tree_at"))


@register("STR8_retrained_trees", f"WITH {_R} SELECT run, CAST(k AS BIGINT) AS round_id, shard, CAST(4 AS BIGINT) AS trees, CAST(4 AS BIGINT) AS slots, seq AS last_seq FROM (SELECT run, 0 AS k, shard, seq FROM r WHERE rn = {RING} + 4 AND run IN (SELECT run FROM first) UNION ALL SELECT run, k, shard, seq FROM ret)")
def str8(spark, sf):
    return replayed(spark, sf).filter("kind = 'tree'").groupBy("run", "round_id", "shard").agg(F.count("*").alias("trees"), F.count_distinct("slot").alias("slots"), F.max("seq").alias("last_seq"))


@register("STR9_versions_released", f"WITH {_SCORED} SELECT run, CAST(version AS BIGINT) AS version, phase, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM sc GROUP BY ALL")
def str9(spark, sf):
    """Versions and the rows scored by each."""
    return replayed(spark, sf).filter("kind = 'score'").groupBy("run", "version", "phase").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("STR10_abort", f"WITH {_R} SELECT run, CAST(1 AS BIGINT) AS last_version, count(*) AS n FROM r JOIN first USING (run) GROUP BY run")
def str10(spark, sf):
    """With a limit that no cooldown meets, every version stays the first, and every row is scored."""
    r = replayed(spark, sf, cooldown_timeout=100, pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST)
    return r.filter("kind = 'score'").groupBy("run").agg(F.max("version").alias("last_version"), F.count("*").alias("n"))


@register("STR11_pause_modes", f"""WITH {_SCORED}, rel AS (SELECT t.run, t.shard, t.k, t.rn0, (SELECT min(rn) FROM r JOIN ver v ON v.run = r.run AND v.k = t.k WHERE r.run = t.run AND r.shard = t.shard AND r.rn > t.rn AND r.seq >= v.eff) AS rn1 FROM ret t),
hd AS (SELECT sc.run, phase, (SELECT min(rn1) FROM rel WHERE rel.run = sc.run AND rel.shard = sc.shard AND sc.rn BETWEEN rn0 AND rn1) AS held, (SELECT min(rn0) FROM rel WHERE rel.run = sc.run AND rel.shard = sc.shard AND rn1 IS NULL AND sc.rn >= rn0) AS lost FROM sc)
SELECT 'USE_OLD_FOREST' AS mode, run, count(*) AS n, count(*) FILTER (phase = 'A') AS drained FROM sc GROUP BY run
UNION ALL SELECT 'BACKLOG_THEN_NEW_FOREST', run, count(*) FILTER (lost IS NULL), count(*) FILTER (lost IS NULL AND (phase = 'A' OR held IS NOT NULL)) FROM hd GROUP BY run""")
def str11(spark, sf):
    """Rows scored, and those of them that were held back, by what a cooldown does with rows."""
    a = replayed(spark, sf).withColumn("mode", F.lit("USE_OLD_FOREST"))
    b = replayed(spark, sf, pause_mode=PauseMode.BACKLOG_THEN_NEW_FOREST).withColumn("mode", F.lit("BACKLOG_THEN_NEW_FOREST"))
    return a.unionByName(b).filter("kind = 'score'").groupBy("mode", "run").agg(F.count("*").alias("n"), F.count_if(F.col("ingestion_time") == 0).alias("drained"))


@register("STR12_side_output", f"WITH {_R} SELECT run, k || '-' || shard || '-' || slot AS tree_id, shard, CAST(slot AS INTEGER) AS slot, CAST(k AS BIGINT) AS round_id FROM (SELECT run, 0 AS k, shard FROM r WHERE rn = {RING} + 4 AND run IN (SELECT run FROM first) UNION ALL SELECT run, k, shard FROM ret), range(4) s(slot)")
def str12(spark, sf):
    """Trees are tagged rows beside the scores, told apart by a filter."""
    return replayed(spark, sf).filter("kind = 'tree'").select("run", F.col("id").alias("tree_id"), "shard", "slot", "round_id")


@register("STR13_control_rows", f"WITH {_R} SELECT run, 'round' AS kind, cm.since AS seq, CAST(k AS BIGINT) AS round_id FROM cm UNION ALL SELECT run, 'model', made, k FROM ver")
def str13(spark, sf):
    """Rounds and versions, the two control streams, as one."""
    r = replayed(spark, sf)
    return r.filter("kind = 'round'").select("run", "kind", "seq", "round_id").unionByName(r.filter("kind = 'model'").select("run", "kind", "seq", "round_id"))


@register("loop_invariance")
def invariance(spark, sf):
    """Rounds by number of row shards: detection does not depend on it."""
    out = None
    for n in (1, 2, 4):
        forest = ForestConfig(total_trees=8, subsample_size=64, parallelism=n, seed=7)
        r = loop(spark, sf, forest=forest).filter("kind = 'round'").select("run", "round_id", "seq").withColumn("shards", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("run", "round_id", "seq").agg(F.count_distinct("shards").alias("same_for"))


@register("loop_accuracy")
def accuracy(spark, sf):
    s = loop(spark, sf).filter("kind = 'score'").withColumn("forest_version", F.col("version"))
    return rounded(metrics.roc_auc(s, ["forest_version"]))


# ---- Structured Streaming ----------------------------------------------------------------------------------------------------


def _stream(spark, df, files: int = 3):
    """df written in `files` steps of seq and read as a stream, one file a batch."""
    path = scratch(spark, "stream")
    n = df.agg(F.max("seq")).first()[0]
    for k in range(files):
        part = df.filter((F.col("seq") * files >= k * (n + 1)) & (F.col("seq") * files < (k + 1) * (n + 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return stateful.file_source(spark, path, schema)


def _drained(spark, stream, name: str):
    """The whole of a stream, through a checkpointed file sink."""
    out, progress = scratch(spark, name), scratch(spark, f"{name}-progress")
    schema = ", ".join(f"{c} {t}" for c, t in stream.dtypes)
    sinks.dump(stream, out, progress)
    return spark.read.schema(schema).parquet(out)


@register("SRC1_stream_source", "SELECT event_id AS seq, value FROM events")
def src1(spark, sf):
    """A stream of rows from the start of what there is; the Kafka form is stateful.kafka_source."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value")
    return _drained(spark, _stream(spark, e), "source")


@register("SRC5_file_replay", "SELECT event_id % 10 AS k, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def src5(spark, sf):
    """A replay that is stopped after each batch and goes on from its checkpoint: every row once."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    stream, out, progress = _stream(spark, e, 4), scratch(spark, "replayed"), scratch(spark, "replay-progress")
    for _ in range(2):
        sinks.dump(stream, out, progress)
    return spark.read.parquet(out).groupBy((F.col("seq") % 10).alias("k")).agg(F.count("*").alias("n"), F.sum("seq").alias("total"))


@register("SRC15_model_publisher", "SELECT max(1 + user_id % 3) AS version, CAST(count(DISTINCT user_id % 3) AS INTEGER) AS versions, CAST(1 + max(user_id % 3) AS INTEGER) AS n_trees FROM events")
def src15(spark, sf):
    """Forests appended to a model table, version v with its first v trees; the current one is the largest version, and a version is written once."""
    from tideglass.operators.forest import ModelStore

    store = ModelStore(spark, scratch(spark, "models"))
    seen = sorted(r["v"] for r in table(spark, sf, "events").select((F.col("user_id") % 3 + 1).alias("v")).distinct().collect())
    for v in [*seen, *seen]:
        store.append(v, literal_trees()[:v], SAMPLE)
    version, model = store.current()
    return spark.createDataFrame([(version, store.versions().count(), len(model["trees"]))], "version long, versions int, n_trees int")


@register("SNK2_dump", "SELECT event_id AS seq, event_type AS t FROM events")
def snk2(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("t"))
    out = scratch(spark, "dump")
    sinks.dump(_stream(spark, e), out, scratch(spark, "dump-progress"), "json")
    return spark.read.schema("seq bigint, t string").json(out)


@register("SNK3_print_tap", "SELECT count(*) AS n FROM events")
def snk3(spark, sf):
    """Rows that a tap on a stream saw (a counter stands for the console, which sinks.print_tap writes to)."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    seen = []
    q = _stream(spark, e).writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", scratch(spark, "tap")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame([(sum(seen),)], "n long")


@register("STR14_checkpoint_restart", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, 4 * count(*) AS n_values FROM events")
def str14(spark, sf):
    """Onsets of a stateful stream that is stopped after each file, against those of the bounded computation."""
    v = shifted_values(spark, sf)
    want = detectors.onsets(v, "hddm_w", hddm=config().hddm).select("feature_id", "seq")
    path = scratch(spark, "values")
    schema = ", ".join(f"{c} {t}" for c, t in v.dtypes)
    out, progress = scratch(spark, "onsets"), scratch(spark, "onsets-progress")
    n = table(spark, sf, "events").count()
    for k in range(2):
        v.filter((F.col("seq") * 2 >= k * n) & (F.col("seq") * 2 < (k + 1) * n)).coalesce(1).write.mode("append").parquet(path)
        sinks.dump(stateful.stream_onsets(stateful.file_source(spark, path, schema), "hddm_w", hddm=config().hddm), out, progress)
    got = spark.read.parquet(out).select("feature_id", "seq")
    return want.exceptAll(got).agg(F.count("*").alias("missing")).crossJoin(got.exceptAll(want).agg(F.count("*").alias("extra"))).crossJoin(spark.read.schema(schema).parquet(path).agg(F.count("*").alias("n_values")))


@register("UDF1_flat_map", "SELECT CAST(d AS INTEGER) AS feature_id, count(*) AS n FROM events, range(4) t(d) GROUP BY 1")
def udf1(spark, sf):
    """Rows to several rows: a generator expression, in a stream as in a table."""
    return _drained(spark, split_features(_stream(spark, points(spark, sf).select("seq", "features"))), "split").groupBy("feature_id").agg(F.count("*").alias("n"))


@register("UDF2_keyed_state", "SELECT CAST(user_id % 3 AS INTEGER) AS k, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM events GROUP BY 1")
def udf2(spark, sf):
    """State by key: running counts and sums of a stream, the last of each key."""

    def step(s, k, seq, value):
        s["n"] += 1
        s["total"] += value
        return [(int(k), seq, s["n"], s["total"])]

    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("int").alias("k"), "value")
    run = stateful.stateful(_stream(spark, e), "k", ["seq"], ["seq", "value"], lambda: {"n": 0, "total": 0.0}, step, "k int, seq bigint, n bigint, total double")
    last = _drained(spark, run, "state").groupBy("k").agg(F.max_by(F.struct("n", "total"), "seq").alias("x"))
    return last.select("k", "x.n", F.round("x.total", 4).alias("total"))


ORACLES["UDF2_keyed_state"] = "SELECT CAST(user_id % 3 AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


@register("UDF3_detector_by_name", "SELECT DISTINCT name, CASE lower(name) WHEN 'iks' THEN 'FeatureIks' WHEN 'hddm_w' THEN 'FeatureHddm' ELSE 'rejected' END AS made FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'HDDM_W' WHEN 1 THEN 'IKS' WHEN 2 THEN 'iks' ELSE event_type END AS name FROM events)")
def udf3(spark, sf):
    """The detectors that the names in a table ask for."""

    def made(name: str) -> str:
        try:
            return type(detectors.make_detector(name)).__name__
        except ValueError:
            return "rejected"

    names = table(spark, sf, "events").selectExpr("CASE event_id % 4 WHEN 0 THEN 'HDDM_W' WHEN 1 THEN 'IKS' WHEN 2 THEN 'iks' ELSE event_type END AS name").distinct().collect()
    return spark.createDataFrame([(r["name"], made(r["name"])) for r in names], "name string, made string")


@register("UDF4_detector_interface")
def udf4(spark, sf):
    """Any object with update() runs over every feature: the status counts of four of them."""
    v = shifted_values(spark, sf).withColumn("value", F.col("value") / 490.0)
    makers = {"hddm_a": detectors.HddmA, "hddm_a_windowed": lambda: detectors.HddmAWindowed(HddmConfig(window=500)), "hddm_w": detectors.HddmW, "iks": lambda: detectors.Iks(IksConfig(window=300))}
    out = None
    for name, make in makers.items():
        s = detectors.statuses(v, make).groupBy("feature_id", "status").agg(F.count("*").alias("n")).withColumn("detector", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


@register("CLI1_parameters", "SELECT * FROM (VALUES ('aggK', '2'), ('aggWin', '2000'), ('cooldownPolicy', 'd1a'), ('cooldownSamples', '2000'), ('d1aFill', 'cooldownsamples'), ('detector', 'iks'), ('hddmDriftConf', '0.001'), ('hddmLambda', '0.005'), ('hddmScaleMode', 'p99'), ('hddmWarmup', '2000'), ('hddmWarnConf', '0.005'), ('hddmWarnTimeout', '2000'), ('iksPValue', '0.001'), ('iksWindowSize', '2000'), ('parallelism', '4'), ('pauseMode', 'USE_OLD_FOREST'), ('refractory', '5000'), ('ringBufferSize', '1000'), ('subsampleSize', '256'), ('totalTrees', '100'), ('zThresholdK', '1.0')) v(name, value)")
def cli1(spark, sf):
    """The defaults of all parameters, by their command-line names."""
    c = PipelineConfig()
    p, q, h = c.processor, c.quorum, c.hddm
    rows = {
        "parallelism": p.forest.parallelism, "totalTrees": p.forest.total_trees, "subsampleSize": p.forest.subsample_size, "ringBufferSize": p.ring_size, "cooldownSamples": p.cooldown_samples, "zThresholdK": p.z_threshold,
        "cooldownPolicy": p.cooldown_policy, "d1aFill": p.d1a_fill, "pauseMode": p.pause_mode.value, "detector": c.detector, "iksWindowSize": c.iks.window, "iksPValue": c.iks.p_value, "hddmWarmup": h.warmup, "hddmLambda": h.hddm.lam,
        "hddmWarnConf": h.hddm.warn_confidence, "hddmDriftConf": h.hddm.drift_confidence, "hddmWarnTimeout": h.hddm.warn_timeout, "hddmScaleMode": h.scale_mode, "aggK": q.k, "aggWin": q.window, "refractory": q.refractory,
    }
    return spark.createDataFrame(sorted((k, str(v)) for k, v in rows.items()), "name string, value string")
