"""Row types on the wire and in tables, and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_POINT = "id string, timestamp bigint, features array<double>, label int, seq bigint"
FEATURE_VALUE = "feature_id int, value double, seq bigint"
FEATURE_DRIFT = "feature_id int, seq bigint, ks double, emit_seq bigint"
DRIFT_ROUND = "round_id bigint, timestamp bigint, status string, votes_yes int, votes_no int, votes_abstain int"
NODE_DDL = "struct<id:int,feature:int,threshold:double,left:int,right:int,size:int>"
TREE_DDL = f"struct<nodes:array<{NODE_DDL}>,subsample_size:int,depth_limit:int,dimension:int>"
TREE_MESSAGE = f"tree_id string, producer_subtask int, created_at bigint, slot_index int, batch_id bigint, batch_end boolean, tree {TREE_DDL}"
FOREST_MESSAGE = f"forest_id string, version bigint, created_at bigint, subsample_size int, trees array<struct<tree_id:string,producer_subtask:int,created_at:bigint,slot_index:int,batch_id:bigint,batch_end:boolean,tree:{TREE_DDL}>>"
SCORE = "seq bigint, id string, timestamp bigint, features array<double>, label int, score double, forest_version bigint, phase string, ingestion_time bigint, score_time bigint"
DRIFT_SPEC = "dataset string, n_samples bigint, n_features int, anomaly_ratio double, drift_type string, drift_events array<struct<type:string,start_line:bigint,end_line:bigint,original_line:bigint>>"
JOB_CONFIG = "exp_id string, dataset string, config_id string, pauseMode string, parallelism int, detector string, extra_param string, n_samples bigint, final_offset bigint, status int, timestamp string"

#: What a field that a message lacks is taken for.
DEFAULTS = {"bigint": 0, "int": 0, "double": 0.0, "boolean": False}


def from_wire(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def parse_messages(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row per JSON message; a number or flag that is missing takes its default, anything else null. Unparsable messages are dropped."""
    parsed = df.select(from_wire(F.col(column), f"{schema}, _corrupt_record string").alias("m")).filter("m._corrupt_record is null").select("m.*").drop("_corrupt_record")
    fill = {f.name: F.coalesce(F.col(f.name), F.lit(DEFAULTS[t]).cast(t)) for f in parsed.schema.fields if (t := f.dataType.simpleString()) in DEFAULTS}
    return parsed.withColumns(fill) if fill else parsed


def to_wire(df: DataFrame) -> DataFrame:
    """One JSON text per row, in the column value."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def envelopes(forests: DataFrame, rounds: DataFrame) -> DataFrame:
    """Both control streams as one: type, forest, drift_round (one of the two is null)."""
    f = forests.select(F.lit("FOREST").alias("type"), F.struct(*forests.columns).alias("forest"))
    r = rounds.select(F.lit("DRIFT_ROUND").alias("type"), F.struct(*rounds.columns).alias("drift_round"))
    return f.unionByName(r, allowMissingColumns=True)
