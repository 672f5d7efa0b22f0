import pytest
from pyspark.sql import functions as F

from tideglass.sources import sinks, synthetic, text


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, value string")


def test_csv(spark):
    df = text.parse_csv(lines(spark, "", "id,a,b,label", "42,1.0,2.0,0", " ", "100,3.0,4.0,1", "7,x,1,0", "8,1,2,1.0", "9"))
    assert [(r["id"], r["features"], r["label"], r["seq"]) for r in df.orderBy("seq").collect()] == [("42", [1.0, 2.0], 0, 42), ("100", [3.0, 4.0], 1, 100)]


def test_bad_ids_are_errors(spark):
    with pytest.raises(Exception, match="whole number"):
        text.parse_csv(lines(spark, "h", "a1,1,2,0")).collect()
    with pytest.raises(NotImplementedError):
        text.parse_csv(lines(spark, "h"), sequence="FROM_FIELD")


def test_missing_seq_is_an_error(spark):
    df = spark.createDataFrame([('{"score": 1.0}',)], "value string")
    with pytest.raises(Exception, match="no seq"):
        text.scores_strict(df).collect()


def test_wrong_dimensions_are_an_error(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("a\tb\tc\n1\t2\tx\n")
    assert text.sniff("a\tb,c\td") == "\t"
    assert text.load_dataset(spark, text.Dataset(str(p), anomaly_label="x", dimensions=2)).collect()[0]["label"] == 1
    with pytest.raises(ValueError):
        text.load_dataset(spark, text.Dataset(str(p), dimensions=3))


@pytest.mark.parametrize("kind", ["abrupt", "gradual", "incremental", "reoccurring"])
def test_streams(spark, kind):
    s = synthetic.stream(spark, kind, n=4000, dim=1)
    a, b = (s.filter(c).filter("label = 0").agg(F.avg("f0"), F.stddev("f0")).first() for c in ("id < 700", "id between 3650 and 3999" if kind != "reoccurring" else "id between 1300 and 2300"))
    assert abs(a[0]) < 0.5 and (abs(b[0] - 8) < 0.5)
    assert abs(s.agg(F.avg("label")).first()[0] - 0.05) < 0.02
    assert s.collect() == synthetic.stream(spark, kind, n=4000, dim=1).repartition(3).orderBy("id").collect()
    assert synthetic.spec(kind, 4000)


def test_gate():
    assert sinks.complete([1, 5], 5) and not sinks.complete([1, 4], 5) and sinks.complete([4] * 12, 5) and not sinks.complete([], 1)


def test_markdown(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(1, "a")], "n int, t string"), str(tmp_path / "r"), "markdown")
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["| n | t |", "| --- | --- |", "| 1 | a |"]


def test_kafka_options(spark):
    """What the source asks of the connector, which is not installed here, and the columns that it makes of a topic's rows."""
    from tideglass.streaming import stateful

    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def option(self, name, value):
            asked[name] = value
            return self

        def load(self):
            return spark.createDataFrame([(bytearray(b"1"), bytearray("1,2,é".encode()), "rows", 0, 7)], "key binary, value binary, topic string, partition int, offset long").selectExpr("*", "timestamp_millis(5) AS timestamp", "0 AS timestampType")

    class Session:
        readStream = Reader()

    df = stateful.kafka_source(Session(), "a:9092,b:9092", "rows")
    assert asked == {"format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "rows", "startingOffsets": "earliest"}
    assert df.dtypes == [("value", "string"), ("timestamp", "timestamp")] and df.first()["value"] == "1,2,é"
