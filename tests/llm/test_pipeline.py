"""The pipeline's stages, one after the other, against what each promises and against brute force on a small table."""

from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tideglass.llm import simhash, toxicity


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_store"] and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        results[name] = docs.collect()
        if name != "token_store":
            assert docs.columns == columns

    model = toxicity.train(spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema), labels)
    clean = {r["doc_id"] for r in before if model.score(model.distance(model.savings(toxicity.words(r["text"])))) < toxicity.REJECT}
    assert {r["doc_id"] for r in results["toxicity"]} == clean

    # One document of each group: what went is as similar to another as the stage asks, and nearly nothing that stays is to another that stays.
    sets = {r["doc_id"]: frozenset(simhash.shingle_hashes(r["text"], 5).tolist()) for r in results["toxicity"]}
    holders = {}
    for d, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(d)

    def similar(d):
        common = Counter(o for h in sets[d] for o in holders[h] if o != d)
        return {o for o, n in common.items() if n >= 0.8 * (len(sets[d]) + len(sets[o]) - n)}

    kept = sorted(r["doc_id"] for r in results["simhash_near_dedup"])
    empty = [d for d, s in sets.items() if not s]
    assert all(similar(d) or (not sets[d] and min(empty) < d) for d in sets if d not in set(kept))
    pairs = [(d, o) for d in sets for o in similar(d) if o < d]
    both = [p for p in pairs if set(p) <= set(kept)]
    assert pairs and len(both) <= 0.02 * len(pairs)

    left = {r["doc_id"] for r in results["benchmark_decontamination"]}
    assert left <= set(kept)
    mixed = results["source_mixing"]
    assert {r["doc_id"] for r in mixed} <= left and len(mixed) > len(left)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    stored = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in results["token_store"])
    assert [(d, n) for _, d, n in stored] == sizes
    assert [s for s, _, _ in stored] == np.concatenate([[0], np.cumsum([n for _, n in sizes])[:-1]]).tolist()

    ran = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert ran == sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in results["token_store"])


def test_mixed_rows_meet_targets(spark):
    """Rows are whole: a source misses its target by half its longest document at most."""
    from tideglass.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    longest = docs.select(F.max(F.size(F.split("text", r"\s+")))).first()[0]
    words = mixing.word_count(F.col("text"))
    got = {r["source"]: r["n"] for r in mixing.mixed_rows(docs).groupBy("source").agg(F.sum(words).alias("n")).collect()}
    want = {r["source"]: r["t"] for r in mixing.mix(docs).select("_row.source", "_target").groupBy("source").agg(F.first("_target").alias("t")).collect()}
    assert all(abs(got.get(s, 0) - t) <= longest for s, t in want.items())
