"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every corpus operator."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideglass.llm import decontamination, license_scan, mixing, quality, sharding, simhash, token_store, tokens, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(120_000))
ROWS = [(1, "one two three", "a"), (2, None, None), (None, "one two three", "a"), (None, None, "b"), (5, "", "b"), (6, LONG, "c"), (7, "one two three", "a"), (7, "one two three", "a"), (8, "  \t ", "d"), (9, "é" * 50, None)]
CLASH = ["_id", "_key", "score", "size", "id", "hash", "_size", "key", "_text", "_row", "shard", "n_words", "_fp", "count", "verdict", "rule", "kept", "toxicity_score", "_c", "_h"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


LABELS = [(1, 0, 0), (6, 1, 0), (7, 0, 1), (9, None, None)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


def test_license_scans(docs, none):
    out = license_scan.digest(license_scan.license_spans(docs)).collect()
    assert len(out) == len(ROWS) and {r["n_words"] for r in out if r["doc_id"] == 2} == {0}
    assert all(r["first_word"] is None and r["labels"] == "" and r["score"] == 0.0 for r in out)
    assert license_scan.license_spans(none).count() == 0


def test_token_counts(docs, none):
    out = tokens.count_tokens(docs, PATH).collect()
    assert len(out) == len(ROWS)
    assert [(r["n_bytes"], r["n_tokens"]) for r in out if r["doc_id"] in (2, 5)] == [(0, 0), (0, 0)]
    assert next(r for r in out if r["doc_id"] == 6)["over_limit"]
    assert tokens.count_tokens(none, PATH).count() == 0


def test_token_store(docs, none):
    out = token_store.stored_tokens(docs, PATH).collect()
    assert len(out) == len(ROWS)
    assert sorted(r["n_tokens"] for r in out if r["doc_id"] in (2, 5)) == [1, 1]
    spans = sorted((r["start"], r["n_tokens"]) for r in out)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    by_start = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert by_start == sorted(by_start, key=lambda d: (d is not None, d or 0))
    assert {r["ids_crc32"] for r in out if r["doc_id"] == 2} == {zlib.crc32((2).to_bytes(4, "little"))}
    assert token_store.stored_tokens(none, PATH).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (None, "http://a.com/en/x"), (5, "http://a.com/en/x"), (5, "http://a.com/en/x"), (6, "http://" + "a." * 5000 + "com/en/"), (7, "://"), (8, "HTTP://A.COM/en/?q#f")], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "_id", "salt", "bucket", "count")})
    rules = url_filter.rules_frame(spark, [("com", "/en/", "block"), (None, "/zz", "block")])
    out = url_filter.url_filter(pages, rules).collect()
    assert len(out) == 9
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == got[2] == got[3] == got[7] == ("", "", None, "allow")
    assert got[None] == got[5] == ("a.com", "/en/x", "com/en/", "block") and sum(r["page_id"] == 5 for r in out) == 2
    assert got[6][3] == "block" and got[8] == ("a.com", "/en/", "com/en/", "block")
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_decontamination(spark, docs, none):
    assert decontamination.leaks(docs, bench(spark)).count() == 0
    assert decontamination.decontaminate(docs, bench(spark)).count() == len(ROWS)
    assert decontamination.decontaminate(docs, bench(spark)).columns == docs.columns
    assert decontamination.leaks(none, bench(spark)).count() == 0
    assert decontamination.leaks(docs, bench(spark).limit(0)).count() == 0


def test_quality(docs, none):
    rules = [quality.Rule("few", quality.word_count(F.col("text")) < 10)]
    out = quality.cascade(quality.measured(docs), rules)
    # The table has columns `kept` and `n_words` of its own: they stay.
    got = {r["doc_id"]: (r["_n_words"], r["_kept"], r["rejected_by"], r["kept"], r["n_words"]) for r in out.collect()}
    assert got[2] == (0, False, "few", "clash", "clash") and got[8][:3] == (0, False, "few") and got[6][:3] == (120_000, True, None) and out.count() == len(ROWS)
    plain = docs.select("doc_id", "text")
    assert quality.cascade(plain, quality.text_rules(F.col("text"))).filter("kept").select("doc_id").collect() == [(6,)]
    assert quality.cascade(none.select("doc_id", "text"), rules).count() == 0
    # Of rules that reject, the first as they were given is named, whatever the order in which they ran.
    both = [quality.Rule("z", quality.word_count(F.col("text")) < 10), quality.Rule("a", F.col("text").isNull() | (F.length("text") < 100))]
    assert {r["rejected_by"] for r in quality.cascade(plain, both).collect()} == {"z", None}
    assert {r["rejected_by"] for r in quality.cascade(plain, both[::-1]).collect() if r["doc_id"] != 9} <= {"a", None}


def test_quality_sample_is_bounded(spark, tmp_path):
    """The sample is read from the first partitions that hold enough rows."""
    path = str(tmp_path / "many")
    spark.range(0, 40_000, 1, 40).selectExpr("id as doc_id", "repeat('word ', 20) as text").write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.read.parquet(path).repartition(40).mapInArrow(counted, "doc_id long, text string")
    assert quality.sample_of(df, "text", 100).count() == 100
    assert read.value <= 5_000


def test_toxicity(spark, docs, none):
    model = toxicity.train(docs, labels(spark))
    out = toxicity.score(docs, model, name="s")
    assert out.count() == len(ROWS) and out.filter("s is null or s < 0 or s > 1").count() == 0
    assert toxicity.without_toxic(docs, labels(spark)).columns == docs.columns
    for empty in (toxicity.train(none, labels(spark)), toxicity.train(docs, labels(spark).limit(0))):
        assert toxicity.score(docs, empty, name="s").filter("s > 0.01").count() == 0
    assert toxicity.score(none, model, name="s").count() == 0


@pytest.mark.parametrize("similar", [None, 0.8])
def test_simhash(docs, none, similar):
    out = simhash.near_duplicates(docs, min_similarity=similar).collect()
    assert len(out) == len(ROWS)
    comp = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out}
    same = next(fp for d, fp in comp if d == 1)
    assert comp[1, same] == comp[7, same] == comp[None, same] == 1
    assert comp[2, "0" * 16] == comp[None, "0" * 16] == comp[5, "0" * 16] == comp[8, "0" * 16] == 2
    assert simhash.near_duplicates(none, min_similarity=similar).count() == 0


def test_one_of_each(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 9]
    assert simhash.one_of_each(docs.filter("doc_id = 7")).count() == 1
    assert simhash.one_of_each(none).count() == 0


def test_sharding(docs, none):
    out = sharding.ring_shards(docs, 4).collect()
    sizes = [sum(r["shard"] == s for r in out) for s in range(4)]
    assert len(out) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s])) for s in range(4))
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 2} == {(16, 0)}
    assert sharding.ring_shards(none, 4).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs).select("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "_taken").collect()
    assert len(out) == len(ROWS) and all(0 <= r["_taken"] <= 2 * r["_size"] for r in out)
    for src in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == src]
        assert abs(sum(r["_taken"] for r in own) - own[0]["_target"]) <= 0.5
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.filter("text is null").count() == 2
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
