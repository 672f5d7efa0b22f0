"""Scans, sinks, routing, reshaping and plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tideglass import schemas
from tideglass.functions import parse_exp_id, parse_extra
from tideglass.operators import routing
from tideglass.plans import expand
from tideglass.queries.base import FV, PT, Registry, points, rounded, sql_round, table, values
from tideglass.queries.models import HASH
from tideglass.sources import sinks, synthetic, text

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder (a temporary one where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# ---- delimited lines -----------------------------------------------------------------------------------------------------------

#: CTE `ln`: events as lines with a header, blank lines, short lines and bad numbers among them.
_LN = """ln AS (SELECT event_id * 2 + 10 AS line_no, CASE WHEN event_id % 101 = 5 THEN '  ' WHEN event_id % 103 = 7 THEN CAST(event_id AS VARCHAR) WHEN event_id % 107 = 9 THEN event_id || ',x,1' WHEN event_id % 109 = 11 THEN event_id || ',' || user_id || ',1.0'
  ELSE ' ' || event_id || ', ' || user_id || ',' || (event_id % 7) || '.5 ,' || (event_id % 2) || ' ' END AS value FROM events UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'id,a,b,label')"""
_GOOD = """good AS (SELECT line_no, trim(value) AS v FROM ln WHERE trim(value) <> '' AND line_no <> 2), parts AS (SELECT line_no, list_transform(string_split(v, ','), lambda x: trim(x)) AS p FROM good),
ok AS (SELECT line_no, p[1] AS id, list_transform(p[2:len(p) - 1], lambda x: TRY_CAST(x AS DOUBLE)) AS features, CASE WHEN regexp_matches(p[len(p)], '^[+-]?[0-9]+$') THEN CAST(p[len(p)] AS INTEGER) END AS label FROM parts WHERE len(p) > 2),
rows_ AS (SELECT * FROM ok WHERE label IS NOT NULL AND len(list_filter(features, lambda x: x IS NULL)) = 0)"""


def lines(spark, sf):
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    s = i.cast("string")
    value = F.when(i % 101 == 5, "  ").when(i % 103 == 7, s).when(i % 107 == 9, F.concat(s, F.lit(",x,1"))).when(i % 109 == 11, F.concat(s, F.lit(","), u, F.lit(",1.0")))
    value = value.otherwise(F.concat(F.lit(" "), s, F.lit(", "), u, F.lit(","), (i % 7).cast("string"), F.lit(".5 ,"), (i % 2).cast("string"), F.lit(" ")))
    head = spark.createDataFrame([(1, ""), (2, "id,a,b,label")], "line_no long, value string")
    return e.select((i * 2 + 10).alias("line_no"), value.alias("value")).unionByName(head)


@register("SRC2_parse_csv", f"WITH {_LN}, {_GOOD} SELECT id, features, label, CAST(id AS BIGINT) AS seq FROM rows_")
def src2(spark, sf):
    return text.parse_csv(lines(spark, sf))


@register("SRC2a_header", f"WITH {_LN}, {_GOOD} SELECT count(*) AS kept, min(line_no) AS first_line FROM good")
def src2a(spark, sf):
    return text.data_lines(lines(spark, sf)).agg(F.count("*").alias("kept"), F.min("line_no").alias("first_line"))


@register("SRC2b_blank_lines", f"WITH {_LN} SELECT line_no, trim(value) AS value FROM ln WHERE trim(value) <> ''")
def src2b(spark, sf):
    return text.data_lines(lines(spark, sf), has_header=False).select("line_no", "value")


@register("SRC2c_short_lines", f"WITH {_LN}, {_GOOD} SELECT len(p) AS columns, count(*) AS n FROM parts WHERE len(p) > 2 GROUP BY len(p)")
def src2c(spark, sf):
    rows = lines(spark, sf).filter("trim(value) != '' AND line_no <> 2").select(F.size(F.split(F.trim("value"), ",")).cast("long").alias("columns"))
    return rows.filter("columns > 2").groupBy("columns").agg(F.count("*").alias("n"))


@register("SRC2d_rejected", f"WITH {_LN}, {_GOOD} SELECT line_no FROM good WHERE line_no NOT IN (SELECT line_no FROM rows_)")
def src2d(spark, sf):
    """Lines that parsing drops."""
    all_ = lines(spark, sf).filter("trim(value) != '' AND line_no <> 2")
    kept = text.parse_csv(lines(spark, sf)).select((F.col("seq") * 2 + 10).alias("line_no"))
    return all_.select("line_no").join(kept, "line_no", "left_anti")


@register("SRC2e_labels", f"WITH {_LN}, {_GOOD} SELECT label, count(*) AS n FROM rows_ GROUP BY label")
def src2e(spark, sf):
    return text.parse_csv(lines(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@register("SRC3_sequences", f"WITH {_LN}, {_GOOD} SELECT id, row_number() OVER (ORDER BY line_no) - 1 AS seq FROM rows_")
def src3(spark, sf):
    return text.parse_csv(lines(spark, sf), sequence="AUTO_INCREMENT").select("id", "seq")


@register("SRC4_ids", f"WITH {_LN}, {_GOOD}, p2 AS (SELECT line_no, list_transform(p, lambda x: TRY_CAST(x AS DOUBLE)) AS f, p FROM parts WHERE len(p) > 1), k AS (SELECT line_no FROM p2 WHERE regexp_matches(p[len(p)], '^[+-]?[0-9]+$') AND len(list_filter(f[1:len(f) - 1], lambda x: x IS NULL)) = 0) SELECT CAST(row_number() OVER (ORDER BY line_no) AS VARCHAR) AS id, row_number() OVER (ORDER BY line_no) - 1 AS seq FROM k")
def src4(spark, sf):
    """Without an id column ids count from 1 and sequence numbers from 0."""
    return text.parse_csv(lines(spark, sf), has_id=False, sequence="AUTO_INCREMENT").select("id", "seq")


@register("AGG34_fingerprint", f"WITH {_LN}, r AS (SELECT line_no, string_split(trim(value), ',') AS p FROM ln WHERE trim(value) <> ''), t AS (SELECT trim(p[len(p)]) AS v, count(*) AS c FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT count(*) AS rows, (SELECT string_agg(DISTINCT CAST(len(p) AS VARCHAR), ',' ORDER BY CAST(len(p) AS VARCHAR)) FROM r) AS columns, 1.0::DOUBLE AS header_ratio, (SELECT string_agg(v || ':' || c, ',' ORDER BY c DESC, v) FROM t) AS top_labels FROM r")
def agg34(spark, sf):
    return text.fingerprint(lines(spark, sf))


@register("SC5_strings", "SELECT event_id, len(regexp_split_to_array(regexp_replace(event_type || ',,' || user_id || ',,', ',+$', ''), ',')) AS n, trim('  ' || event_type || ' ') AS t, TRY_CAST(event_type AS DOUBLE) AS d FROM events")
def sc5(spark, sf):
    e = table(spark, sf, "events")
    v = F.concat("event_type", F.lit(",,"), F.col("user_id").cast("string"), F.lit(",,"))
    return e.select("event_id", F.size(F.split(F.regexp_replace(v, ",+$", ""), ",", -1)).cast("long").alias("n"), F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("t"), F.col("event_type").try_cast("double").alias("d"))


@register("SC8_arrays", f"WITH {PT} SELECT seq, features[1] AS first, len(features) AS n, features[2:3] AS middle, list_sort(features) AS sorted, list_transform(features, lambda x: x * 2) AS doubled FROM pt")
def sc8(spark, sf):
    p = points(spark, sf)
    return p.select("seq", F.element_at("features", 1).alias("first"), F.size("features").cast("long").alias("n"), F.slice("features", 2, 2).alias("middle"), F.array_sort("features").alias("sorted"), F.transform("features", lambda x: x * 2).alias("doubled"))


# ---- files -----------------------------------------------------------------------------------------------------------------------


@register("SRC9_dataset_loader", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, [value, CAST(user_id AS DOUBLE)] AS features, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events")
def src9(spark, sf):
    """events written as a delimited file with a text label in the last column, loaded by its registry entry."""
    path = scratch(spark, "dataset")
    table(spark, sf, "events").orderBy("event_id").select("value", "user_id", "event_type").coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return text.load_dataset(spark, text.Dataset(path, label_position="last", anomaly_label="error", dimensions=2))


@register("SRC10_drift_events", "SELECT CAST(k AS INTEGER) AS drift_idx, type, n * lo // 10 AS start_line, CASE WHEN hi IS NULL THEN n * lo // 10 + 1 ELSE n * hi // 10 END AS end_line FROM (SELECT count(*) AS n FROM events), (VALUES (0, 'abrupt', 5, NULL), (1, 'gradual', 8, 9)) v(k, type, lo, hi)")
def src10(spark, sf):
    """Drifts at tenths of the events, from a specification's text."""
    n = table(spark, sf, "events").agg(F.count("*").alias("n"))
    spec = n.selectExpr("""concat('{"dataset": "d", "drift_events": [{"type": "abrupt", "start_line": ', n * 5 div 10, '}, {"type": "gradual", "start_line": ', n * 8 div 10, ', "end_line": ', n * 9 div 10, '}]}') AS value""")
    return text.drift_events(spec.select(F.from_json("value", schemas.DRIFT_SPEC).alias("s")).select("s.*"))


def message_lines(spark, sf):
    """Score messages, some blank, some broken, some without fields."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    whole = F.to_json(F.struct(i.alias("seq"), F.when(i % 5 != 0, i % 2).alias("label"), F.when(i % 7 != 0, F.col("value")).alias("score")))
    return e.select(i.alias("line_no"), F.when(i % 50 == 3, "").when(i % 50 == 4, '{"seq": ').otherwise(whole).alias("value"))


@register("SRC7_scores_strict", "SELECT event_id AS seq, CAST(CASE WHEN event_id % 5 <> 0 THEN event_id % 2 END AS INTEGER) AS label, CASE WHEN event_id % 7 <> 0 THEN value END AS score FROM events WHERE event_id % 50 NOT IN (3, 4)")
def src7(spark, sf):
    good = message_lines(spark, sf).filter("line_no % 50 <> 4")
    return text.scores_strict(good).select("seq", "label", "score")


@register("SRC8_scores_tolerant", "SELECT event_id AS seq, CAST(CASE WHEN event_id % 5 <> 0 THEN event_id % 2 ELSE 0 END AS INTEGER) AS label, CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END AS score FROM events WHERE event_id % 50 NOT IN (3, 4)")
def src8(spark, sf):
    return text.scores_tolerant(message_lines(spark, sf)).select("seq", "label", "score")


@register("SRC6_messages", "SELECT CAST(event_id % 9 AS INTEGER) AS feature_id, event_id AS seq, value AS ks, CAST(0 AS BIGINT) AS emit_seq FROM events WHERE event_id % 50 <> 4")
def src6(spark, sf):
    """Feature-drift messages: a missing field takes its default, a broken message is dropped."""
    e = table(spark, sf, "events")
    m = F.to_json(F.struct((F.col("event_id") % 9).alias("feature_id"), F.col("event_id").alias("seq"), F.col("value").alias("ks")))
    return schemas.parse_messages(e.select(F.when(F.col("event_id") % 50 == 4, '{"feature_id": ').otherwise(m).alias("value")), schemas.FEATURE_DRIFT)


@register("SC7_json", "SELECT event_id, value, user_id FROM events")
def sc7(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "user_id")
    return schemas.to_wire(e).select(F.from_json("value", "event_id bigint, value double, user_id bigint").alias("m")).select("m.*")


_EXP = "'set_' || (user_id % 3) || '_c' || (user_id % 2) || '_iks_p' || (1 + user_id % 4) || '_r' || (event_id % 3)"


def exp_ids(spark, sf):
    c = lambda x: x.cast("string")
    u, i = F.col("user_id"), F.col("event_id")
    return table(spark, sf, "events").withColumn("exp_id", F.concat(F.lit("set_"), c(u % 3), F.lit("_c"), c(u % 2), F.lit("_iks_p"), c(1 + u % 4), F.lit("_r"), c(i % 3)))


@register("SRC12_run_folders", f"SELECT {_EXP} AS exp_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def src12(spark, sf):
    """One folder per run, scanned together; the run is read off the path."""
    path = scratch(spark, "runs")
    rows = exp_ids(spark, sf).select("event_id", "exp_id")
    rows.withColumn("folder", F.col("exp_id")).drop("exp_id").write.partitionBy("folder").json(path)
    back = text.scan_runs(spark, f"{path}/*/", "event_id bigint")
    return back.withColumn("exp_id", F.regexp_replace("exp_id", "^folder=", "")).groupBy("exp_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@register("PRJ9_exp_ids", f"SELECT DISTINCT {_EXP} AS exp_id, 'set_' || (user_id % 3) AS dataset, 'c' || (user_id % 2) AS config, 'iks' AS algo, CAST(1 + user_id % 4 AS INTEGER) AS parallelism, CAST(event_id % 3 AS INTEGER) AS run, '' AS extra FROM events")
def prj9(spark, sf):
    return exp_ids(spark, sf).select("exp_id").distinct().select("exp_id", parse_exp_id(F.col("exp_id")).alias("x")).select("exp_id", "x.*")


@register("SC6_run_arguments", "SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS lam, CAST(user_id % 3 AS VARCHAR) AS k FROM events")
def sc6(spark, sf):
    v = F.concat(F.lit("lam="), (F.col("user_id") % 5).cast("string"), F.lit(";k="), (F.col("user_id") % 3).cast("string"))
    return table(spark, sf, "events").select(parse_extra(v).alias("m")).select(F.col("m")["lam"].alias("lam"), F.col("m")["k"].alias("k")).distinct()


@register("SNK1_json_sink", "SELECT event_id AS seq, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events")
def snk1(spark, sf):
    path = scratch(spark, "messages")
    p = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    sinks.write_messages(p, path)
    return spark.read.text(path).select(F.from_json("value", "seq bigint, score double, label int").alias("m")).select("m.*")


@register("SNK4_report", "SELECT row_type, key, round(metric, 6) AS metric, round(std, 6) AS std FROM (WITH r AS (SELECT CAST(user_id % 5 AS VARCHAR) AS key, avg(value) AS metric FROM events GROUP BY 1) SELECT 'run' AS row_type, key, metric, CAST(NULL AS DOUBLE) AS std FROM r UNION ALL SELECT 'SUMMARY', '', avg(metric), stddev_samp(metric) FROM r)")
def snk4(spark, sf):
    path = scratch(spark, "report")
    runs = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("metric"))
    sinks.write_report(sinks.with_summary(runs, "metric"), path)
    return rounded(spark.read.option("header", True).schema("row_type string, key string, metric double, std double").csv(path).withColumn("key", F.coalesce("key", F.lit(""))))


@register("SNK5_plot_data", "SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def snk5(spark, sf):
    """What a histogram of values would draw; drawing itself is left to the caller."""
    return table(spark, sf, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@register("SNK6_reset", "SELECT count(*) AS written, false AS kept FROM events")
def snk6(spark, sf):
    path = scratch(spark, "topic")
    table(spark, sf, "events").select("event_id").write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = spark.read.parquet(path).count()
    sinks.reset(spark, path)
    return spark.createDataFrame([(before, bool(fs.exists(p)))], "written long, kept boolean")


_POLLS = "po AS (SELECT event_id AS poll, least(event_id * 3, 100) AS n FROM events)"


@register("SNK7_completion_gate", f"WITH {_POLLS}, w AS (SELECT poll, n, count(*) OVER x AS c, min(n) OVER x AS lo, max(n) OVER x AS hi FROM po WINDOW x AS (ORDER BY poll ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), r AS (SELECT poll, CASE WHEN n >= 150 THEN 'reached' WHEN c = 12 AND lo = hi THEN 'unchanged' END AS reason FROM w) SELECT min(poll) AS poll, arg_min(reason, poll) AS reason FROM r WHERE reason IS NOT NULL")
def snk7(spark, sf):
    polls = table(spark, sf, "events").select(F.col("event_id").alias("poll"), F.least(F.col("event_id") * 3, F.lit(100)).alias("n"))
    return sinks.gate(polls, 150)


# ---- generators ------------------------------------------------------------------------------------------------------------------


def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5('42|' || {' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _n(d: int) -> str:
    return f"sqrt(-2.0::DOUBLE * ln(greatest({_u(chr(39) + 'u' + chr(39), chr(39) + str(d) + chr(39), 'id')}, 1e-12))) * cos({2 * 3.141592653589793!r}::DOUBLE * {_u(chr(39) + 'v' + chr(39), chr(39) + str(d) + chr(39), 'id')})"


def _stream_sql(share: str, p: dict) -> str:
    mean = f"({p['before']}::DOUBLE + sh * {p['after'] - p['before']}::DOUBLE)"
    value = lambda d: f"round(CASE WHEN label = 1 THEN {p['anomaly_mean']}::DOUBLE + {p['anomaly_sigma']}::DOUBLE * {_n(d)} ELSE {mean} + {p['sigma']}::DOUBLE * {_n(d)} END, 6) AS f{d}"
    label = f"CASE WHEN {_u(chr(39) + 'label' + chr(39), 'id')} < {p['ratio']}::DOUBLE THEN 1 ELSE 0 END AS label"
    return f"WITH b AS (SELECT id, {share} AS sh, {label} FROM (SELECT event_id AS id FROM events), (SELECT count(*) AS n FROM events)) SELECT id, {value(0)}, {value(1)}, label FROM b"


#: A drift over the third fifth of as many rows as there are events.
_RAMP = "least(greatest((id - 2 * n // 5) / CAST(n // 5 AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


@register("SRC13_stream_v1", _stream_sql(_RAMP, synthetic.V1))
def src13(spark, sf):
    return synthetic.stream(spark, "gradual", version=1, n=table(spark, sf, "events").count(), dim=2)


@register("SRC14_stream_v2", _stream_sql(f"CASE WHEN {_u(chr(39) + 'mix' + chr(39), 'id')} < {_RAMP} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", synthetic.V2))
def src14(spark, sf):
    return synthetic.stream(spark, "gradual", version=2, n=table(spark, sf, "events").count(), dim=2)


# ---- reshaping and routing -------------------------------------------------------------------------------------------------------


@register("PRJ1_feature_split", f"WITH {FV} SELECT feature_id, value, seq FROM fv")
def prj1(spark, sf):
    return values(spark, sf)


def controls(spark, sf):
    """Every event as a control message: forests and rounds by turns."""
    e = table(spark, sf, "events")
    forests = e.filter("event_id % 2 = 0").select(F.expr("event_id div 2").alias("version"), (F.col("event_id") % 7).cast("int").alias("subsample_size"))
    rounds = e.filter("event_id % 2 = 1").select(F.expr("event_id div 2").alias("round_id"), F.lit("COMMITTED").alias("status"))
    return forests, rounds


_CTL = "c AS (SELECT 'FOREST' AS type, event_id // 2 AS version, CAST(NULL AS BIGINT) AS round_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'DRIFT_ROUND', NULL, event_id // 2 FROM events WHERE event_id % 2 = 1)"


@register("PRJ2_envelopes", f"WITH {_CTL} SELECT * FROM c")
def prj2(spark, sf):
    return schemas.envelopes(*controls(spark, sf)).select("type", "forest.version", "drift_round.round_id")


@register("SET1_control_union", f"WITH {_CTL} SELECT type, count(*) AS n FROM c GROUP BY type")
def set1(spark, sf):
    return schemas.envelopes(*controls(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@register("RTE5_control_fan_out", f"WITH {_CTL} SELECT type, version, round_id, CAST(s AS INTEGER) AS shard FROM c, range(4) r(s)")
def rte5(spark, sf):
    return routing.to_all(schemas.envelopes(*controls(spark, sf)).select("type", "forest.version", "drift_round.round_id"), 4)


@register("RTE1_shards", f"WITH {PT} SELECT seq, CAST(abs({HASH} % 4) AS INTEGER) AS shard FROM pt")
def rte1(spark, sf):
    return routing.by_shard(points(spark, sf), 4).select("seq", "shard")


@register("SC4_string_hash", f"WITH {PT} SELECT id, CAST({HASH} AS INTEGER) AS h FROM pt")
def sc4(spark, sf):
    from tideglass.functions import java_hash

    return points(spark, sf).select("id", java_hash(F.col("id")).alias("h"))


@register("RTE2_explicit_shards", f"WITH {PT} SELECT CAST(abs({HASH} % 4) AS INTEGER) AS shard, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM pt GROUP BY 1")
def rte2(spark, sf):
    """Keys need no search for balance: all rows of a shard are in one partition by the shard's own number."""
    rows = routing.by_shard(points(spark, sf), 4).withColumn("part", F.spark_partition_id())
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("part").alias("partitions"))


@register("RTE3_feature_partitions", f"WITH {FV} SELECT feature_id, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM fv GROUP BY feature_id")
def rte3(spark, sf):
    rows = routing.by_feature(values(spark, sf), 3).withColumn("part", F.spark_partition_id())
    return rows.groupBy("feature_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("partitions"))


@register("RTE4_global_key", f"WITH {PT} SELECT 0 AS k, count(*) AS n FROM pt")
def rte4(spark, sf):
    """A single key holds control state only; rows are counted before they meet it."""
    return points(spark, sf).groupBy(F.lit(0).alias("k")).agg(F.count("*").alias("n"))


@register("RTE6_balance", f"WITH {PT}, s AS (SELECT CAST(abs({HASH} % 4) AS INTEGER) AS shard FROM pt) SELECT shard, count(*) AS n, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS share FROM s GROUP BY shard")
def rte6(spark, sf):
    return rounded(routing.balance(routing.with_shard(points(spark, sf), 4)))


@register("RTE7_seeded_shuffle", f"WITH {PT} SELECT seq, md5('13|' || id) AS shuffle_key FROM pt ORDER BY 2, 1")
def rte7(spark, sf):
    return routing.shuffled(points(spark, sf), 13).select("seq", "shuffle_key")


@register("SC1_math", "SELECT event_id, round(ln(value), 6) AS l, round(sqrt(value), 6) AS s, round(power(value, 0.5::DOUBLE), 6) AS p, abs(value - 100) AS a, least(value, 100::DOUBLE) AS lo, greatest(value, 100::DOUBLE) AS hi, CAST(ceil(value) AS BIGINT) AS c FROM events")
def sc1(spark, sf):
    """Logarithms, roots and powers are rounded; the rest stays as it is. The logarithm of 0 is minus infinity and that of less no number, as in SQL (Spark: null)."""
    v = F.col("value")
    ln = F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v))
    inexact = {"l": ln, "s": F.sqrt(v), "p": F.pow(v, F.lit(0.5))}
    exact = {"a": F.abs(v - 100), "lo": F.least(v, F.lit(100.0)), "hi": F.greatest(v, F.lit(100.0)), "c": F.ceil(v)}
    return table(spark, sf, "events").select("event_id", *(sql_round(x).alias(k) for k, x in inexact.items()), *(x.alias(k) for k, x in exact.items()))


@register("SC2_ks_threshold", "SELECT DISTINCT CAST(w AS INTEGER) AS w, round(sqrt(-0.5::DOUBLE * ln(0.001::DOUBLE)) * sqrt(2.0::DOUBLE / w), 9) AS thr FROM (SELECT 30 + user_id AS w FROM events)")
def sc2(spark, sf):
    from tideglass.functions import ks_threshold

    sizes = [r["w"] for r in table(spark, sf, "events").select((F.col("user_id") + 30).alias("w")).distinct().collect()]
    return spark.createDataFrame([(w, round(ks_threshold(0.001, w), 9)) for w in sizes], "w int, thr double")


@register("SC9_ids_and_times", "SELECT count(*) AS n, count(*) AS ids, true AS now FROM events")
def sc9(spark, sf):
    e = table(spark, sf, "events").select(F.expr("uuid()").alias("u"), F.unix_millis(F.current_timestamp()).alias("t"))
    return e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("ids"), (F.min("t") > 1500000000000).alias("now"))


# ---- plans -----------------------------------------------------------------------------------------------------------------------

PLAN = {"algos": ["iks", "hddm"], "parallelism": [1, 2, 4], "repeats": 3}


def plan(spark, sf) -> dict:
    """A plan over the datasets and configurations that a table names."""
    e = table(spark, sf, "events").select("event_type", F.concat(F.lit("c"), F.col("user_id") % 3).alias("c"))
    names = lambda c: sorted(r[0] for r in e.select(c).distinct().collect())
    return {"datasets": names("event_type"), "configs": names("c"), **PLAN}


_PLAN = "pl AS (SELECT dataset, config, algo, CAST(parallelism AS INTEGER) AS parallelism, CAST(run AS INTEGER) AS run FROM (SELECT DISTINCT event_type FROM events) d(dataset), (SELECT DISTINCT 'c' || user_id % 3 FROM events) c(config), (VALUES ('iks'), ('hddm')) g(algo), (VALUES (1), (2), (4)) p(parallelism), range(1, 4) r(run))"
_ID = "dataset || '_' || config || '_' || algo || '_p' || parallelism || '_r' || run"


@register("ORC1_expand_plan", f"WITH {_PLAN} SELECT *, '' AS extra, {_ID} AS exp_id FROM pl")
def orc1(spark, sf):
    return expand.expand_plan(spark, plan(spark, sf))


@register("ORC2_sensitivity", f"WITH {_PLAN}, x(extra) AS (VALUES ('lam=0.1'), ('lam=0.2'), ('k=3')) SELECT pl.*, extra, {_ID} || '_' || replace(extra, '=', '-') AS exp_id FROM pl, x")
def orc2(spark, sf):
    return expand.expand_plan(spark, {**plan(spark, sf), "sensitivity": {"lam": ["0.1", "0.2"], "k": ["3"]}})


@register("ORC3_configurations", f"WITH {_PLAN}, x(extra) AS (VALUES ('lam=0.1;k=2'), ('k=3')) SELECT pl.*, extra, {_ID} || '_' || replace(replace(extra, '=', '-'), ';', '_') AS exp_id FROM pl, x")
def orc3(spark, sf):
    return expand.expand_plan(spark, {**plan(spark, sf), "configurations": [{"lam": 0.1, "k": 2}, {"k": 3}]})


@register("ORC4_batch", "SELECT DISTINCT t || k AS exp_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS code FROM (SELECT event_type AS t, user_id % 4 AS k FROM events)")
def orc4(spark, sf):
    """Codes of a batch: what has a result is skipped, an error does not stop the others."""
    import os

    home = tempfile.mkdtemp()  # of the driver, as the batch is
    names = sorted(r[0] for r in table(spark, sf, "events").select(F.concat("event_type", F.col("user_id") % 4)).distinct().collect())
    for i in names:
        if i.endswith("0"):
            open(os.path.join(home, i), "w").close()

    def run(i: str) -> int:
        if i.endswith("1"):
            raise RuntimeError("failed")
        return 2 if i.endswith("2") else 0

    codes = expand.run_batch(names, run, lambda i: os.path.join(home, i), lambda _: None)
    return spark.createDataFrame(sorted(codes.items()), "exp_id string, code int")


@register("ORC5_incomplete", f"WITH r AS (SELECT {_EXP} AS exp_id FROM events WHERE event_id % 2 = 0), w AS (SELECT DISTINCT {_EXP} AS exp_id, 60 AS n_samples FROM events UNION ALL SELECT 'none', 1), c AS (SELECT exp_id, count(*) AS n FROM r GROUP BY exp_id) SELECT w.exp_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'short' END AS state FROM w LEFT JOIN c USING (exp_id) WHERE n IS NULL OR n < n_samples")
def orc5(spark, sf):
    e = exp_ids(spark, sf)
    want = e.select("exp_id").distinct().withColumn("n_samples", F.lit(60)).unionByName(spark.createDataFrame([("none", 1)], "exp_id string, n_samples int"))
    return expand.incomplete(want, e.filter("event_id % 2 = 0").select("exp_id"))
