"""Delimited lines, JSON lines and dataset registries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.config import SequenceSource
from tideglass.operators.routing import dense_numbers

NUMBER = r"^[+-]?[0-9]+$"


def data_lines(lines: DataFrame, has_header: bool = True) -> DataFrame:
    """lines: line_no (unique), value -> those that are not blank, trimmed, without the first of them if that is a header."""
    rows = lines.withColumn("value", F.trim("value")).filter("value != ''")
    if has_header:
        rows = rows.join(F.broadcast(rows.agg(F.min("line_no").alias("_header"))), F.col("line_no") != F.col("_header")).drop("_header")
    return rows


def parse_csv(lines: DataFrame, *, has_header: bool = True, has_id: bool = True, has_label: bool = True, auto_increment_id: bool = True, sequence: str = "PARSE_ID") -> DataFrame:
    """lines: line_no (unique), value -> id, features, label, seq.

    Blank lines, the header (the first line that is not blank), lines with too few columns and lines with a number that does not parse are
    dropped; a label must be a whole number, and is 0 where there is none. Without an id column ids count from 1, or are "0". seq is the id (an
    id that is not a whole number is then an error), or counts the rows from 0. Trailing empty columns do not count.
    """
    source = SequenceSource(sequence)
    if source is SequenceSource.FROM_FIELD:
        raise NotImplementedError("a sequence from a field is not supported")
    rows = data_lines(lines, has_header)
    parts = F.split(F.regexp_replace("value", ",+$", ""), ",", -1)
    rows = rows.withColumn("_parts", F.transform(parts, lambda x: F.trim(x)))
    n = F.size("_parts")
    rows = rows.filter(n > int(has_id) + int(has_label))
    first = 2 if has_id else 1
    features = F.transform(F.slice("_parts", F.lit(first), F.greatest(F.lit(0), n - int(has_id) - int(has_label))), lambda x: x.try_cast("double"))
    label = F.when(F.rlike(F.element_at("_parts", -1), F.lit(NUMBER)), F.element_at("_parts", -1).try_cast("int")) if has_label else F.lit(0)
    whole = F.forall("features", lambda x: x.isNotNull()) & F.col("label").isNotNull()
    rows = rows.withColumns({"features": features, "label": label}).filter(whole)
    if not has_id and (auto_increment_id or source is SequenceSource.AUTO_INCREMENT) or source is SequenceSource.AUTO_INCREMENT:
        rows = dense_numbers(rows, "line_no", "_n")
    id_ = F.element_at("_parts", 1) if has_id else (F.col("_n").cast("string") if auto_increment_id else F.lit("0"))
    rows = rows.withColumn("id", id_)
    seq = F.col("_n") - 1 if source is SequenceSource.AUTO_INCREMENT else F.when(F.rlike("id", F.lit(NUMBER)), F.col("id").try_cast("long")).when(whole & (n > int(has_id) + int(has_label)), F.raise_error(F.concat(F.lit("an id is not a whole number: "), "id")).cast("long"))
    return rows.select("id", "features", "label", seq.cast("long").alias("seq"))


def sniff(first_line: str) -> str:
    """The delimiter, of comma, tab and semicolon, that the line has most of."""
    return max(",\t;", key=first_line.count)


@dataclass(frozen=True)
class Dataset:
    path: str
    header: bool = True
    label_position: str | int = "last"
    anomaly_label: str = "1"
    dimensions: int | None = None
    skip: tuple[int, ...] = ()


def load_dataset(spark: SparkSession, d: Dataset) -> DataFrame:
    """seq (line order from 0), features, label (1: the anomaly label, compared as text or number). Wrong dimensions are an error."""
    lines = spark.read.text(d.path)
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "seq bigint, features array<double>, label int")
    df = spark.read.option("sep", sniff(head[0])).option("header", d.header).csv(d.path)
    names = df.columns
    at = {"last": len(names) - 1, "first": 0}.get(d.label_position, d.label_position)
    used = [c for k, c in enumerate(names) if k != at and k not in d.skip]
    if d.dimensions is not None and len(used) != d.dimensions:
        raise ValueError(f"{d.path}: {len(used)} features, {d.dimensions} expected")
    mark = F.trim(F.col(f"`{names[at]}`"))
    label = F.when((mark == d.anomaly_label) | (mark.try_cast("double") == F.lit(d.anomaly_label).try_cast("double")), 1).otherwise(0)
    # A file's rows keep their order in (partition, id) of this scan.
    rows = df.select(F.array(*(F.col(f"`{c}`").try_cast("double") for c in used)).alias("features"), label.alias("label"), F.monotonically_increasing_id().alias("_at"))
    return dense_numbers(rows, "_at", "seq", 0, F.shiftright("_at", 33) * (1 << 20) + F.floor((F.col("_at") % (1 << 33)) / (1 << 16))).select("seq", "features", "label")


def drift_events(spec: DataFrame) -> DataFrame:
    """spec: driftspec rows -> drift_idx, type, start_line, end_line; an event without an end ends on the next line."""
    e = spec.select(F.posexplode("drift_events").alias("drift_idx", "e"))
    return e.select("drift_idx", "e.type", "e.start_line", F.coalesce("e.end_line", F.col("e.start_line") + 1).alias("end_line"))


def resolve_drifts(spark: SparkSession, spec_path: str | None, inline: list[int]) -> DataFrame:
    """From the driftspec file if there is one, else from the start lines given."""
    if spec_path:
        from tideglass.schemas import DRIFT_SPEC

        return drift_events(spark.read.schema(DRIFT_SPEC).option("multiLine", True).json(spec_path))
    rows = [(k, "inline", s, s + 1) for k, s in enumerate(inline)]
    return spark.createDataFrame(rows, "drift_idx int, type string, start_line long, end_line long")


def scores_strict(df: DataFrame) -> DataFrame:
    """value (JSON lines) -> score rows by seq; blank lines are skipped, a row without seq is an error."""
    from tideglass.schemas import SCORE, from_wire

    rows = df.filter(F.trim("value") != "").select(from_wire(F.col("value"), SCORE).alias("m")).select("m.*")
    return rows.withColumn("seq", F.when(F.col("seq").isNull(), F.raise_error(F.lit("a score row has no seq")).cast("long")).otherwise(F.col("seq"))).orderBy("seq")


def scores_tolerant(df: DataFrame) -> DataFrame:
    """value -> score rows; lines that do not parse are dropped, a missing label is 0 and a missing score 0.0."""
    from tideglass.schemas import SCORE, from_wire

    rows = df.select(from_wire(F.col("value"), f"{SCORE}, _corrupt_record string").alias("m")).filter("m._corrupt_record is null and m.seq is not null").select("m.*").drop("_corrupt_record")
    return rows.withColumns({"label": F.coalesce("label", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})


def run_of_path(path: Column) -> Column:
    """The run folder in .../{run}/file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def scan_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All runs' files at once, with exp_id from the folder."""
    return spark.read.schema(schema).json(glob).select("*", run_of_path(F.col("_metadata.file_path")).alias("exp_id"))


def fingerprint(lines: DataFrame, label_top: int = 10) -> DataFrame:
    """One row: rows (without blank lines), column counts (distinct, sorted), header_ratio (share of cells of the first line that are not numbers),
    top values of the last column (value:count, most first)."""
    rows = lines.withColumn("_p", F.split(F.trim("value"), ",", -1)).filter(F.trim("value") != "")
    head = rows.agg(F.min_by("_p", "line_no").alias("_h")).select((F.size(F.filter("_h", lambda x: F.trim(x).try_cast("double").isNull())) / F.size("_h")).alias("header_ratio"))
    top = rows.groupBy(F.trim(F.element_at("_p", -1)).alias("v")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "v").limit(label_top)
    tops = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "v"))), lambda x: F.concat(x["v"], F.lit(":"), (-x["c"]).cast("string"))), ",").alias("top_labels"))
    return rows.agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(F.size("_p"))), ",").alias("columns")).crossJoin(head).crossJoin(tops)
