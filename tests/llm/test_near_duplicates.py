"""Links of the pipeline's near-duplicate stage against the Jaccard similarity of the shingle sets themselves."""

import math
import random

import numpy as np
import pytest

from tideglass.llm import simhash


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def edited_pairs(n: int) -> list[tuple[str, str]]:
    """Texts of their own words, and copies of which some words are replaced: similarities from about 0.6 to 0.95."""
    rnd, out = random.Random(4), []
    for k in range(n):
        a = [f"w{k}x{i}" for i in range(rnd.randint(150, 400))]
        b = list(a)
        for i in rnd.sample(range(len(a)), max(1, round(len(a) * rnd.uniform(0.004, 0.05)))):
            b[i] = f"new{k}x{i}"
        out.append((" ".join(a), " ".join(b)))
    return out


def test_links_are_exact_and_nearly_all_found(spark):
    pairs = edited_pairs(600)
    df = spark.createDataFrame([(2 * k + s, t) for k, p in enumerate(pairs) for s, t in enumerate(p)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).select("doc_id").collect()}
    similar = [jaccard(*p) for p in pairs]
    dropped = [2 * k + 1 not in kept for k in range(len(pairs))]
    assert all(2 * k in kept for k in range(len(pairs)))
    assert not any(d for d, j in zip(dropped, similar) if j < 0.8)
    edge = [d for d, j in zip(dropped, similar) if 0.8 <= j < 0.85]
    assert len(edge) > 50 and np.mean(edge) >= 0.95
    assert np.mean([d for d, j in zip(dropped, similar) if j >= 0.85]) >= 0.99


@pytest.mark.parametrize("rows", [4096, 7])
def test_large_groups_are_cut(spark, monkeypatch, rows):
    """One group of texts near each other, of which only some pairs link: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "VERIFY_ROWS", rows)
    rnd = random.Random(2)
    base, texts = [f"b{i}" for i in range(200)], []
    for k in range(40):
        t = list(base)
        for i in rnd.sample(range(200), rnd.choice([1, 2, 5, 6])):
            t[i] = f"n{k}x{i}"
        texts.append(" ".join(t))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 18, 0.8).collect()}
    want = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(a):
                if want[a] != want[b] and jaccard(texts[a], texts[b]) >= 0.8:
                    low, high = sorted((want[a], want[b]))
                    want = [low if x == high else x for x in want]
    assert [got[k] for k in range(40)] == want


def test_equal_sets_are_one_node(spark):
    """Repeats change the counts of shingles but not their set."""
    a = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"{a} {a}"), (2, " ".join([a] * 9)), (3, " ".join(f"u{i}" for i in range(50)))], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == {1, 3}
    assert simhash.fingerprints(df, 5, True).select("_set").distinct().count() == 2


@pytest.mark.parametrize("n", [1000, 256_000, 1_000_000, 14_000_000, 140_000_000])
def test_rows_of_a_node_stay_few(n):
    """Whatever the number of nodes, a node has few rows, copies for the blocks of large places included, and the asked recall."""
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 256, (2000, simhash.PERMUTATIONS)).astype(np.uint8)
    ws = simhash.widths(sample, n, 0.8)
    assert sum(max(1.0, n * 256.0**-w / simhash.BLOCK) for w in ws) <= 20 and sum(ws) <= simhash.PERMUTATIONS
    assert np.prod([1 - (0.8 + 0.2 / 256) ** w for w in ws]) <= 1 - simhash.RECALL + 0.001
    p = simhash.plan(rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2), min(n, 14_000_000), 4)
    rows = [sum(math.comb(len(part), j) for j in range(t + 1)) for part, t in zip(p.parts, p.thresholds)]
    assert sum(r * max(1.0, min(n, 14_000_000) * r / 2.0 ** len(part) / simhash.BLOCK) for r, part in zip(rows, p.parts)) <= 20


def test_signature_partitions_against_all_pairs(spark):
    """Two nodes meet in a partition exactly if all its places agree."""
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 3, (60, simhash.PERMUTATIONS)).astype(np.uint8)
    nodes = spark.createDataFrame([(i, 0, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "_id long, _fp long, _sig binary")
    got = {}
    for r in simhash._signature_rows(nodes, (2, 1, 3), False).collect():
        got.setdefault((r["_part"], r["_key"]), set()).add(r["_id"])
    for part, (a, b) in enumerate([(0, 2), (2, 3), (3, 6)]):
        for i in range(60):
            for j in range(i):
                assert any(p == part and {i, j} <= ids for (p, _), ids in got.items()) == bool((sigs[i, a:b] == sigs[j, a:b]).all())


@pytest.mark.parametrize("block", [16384, 40])
def test_pigeonhole_is_certain_whatever_the_signatures(spark, monkeypatch, block):
    """Fingerprints of sets within SURE bits are linked even where no partition of the signatures agrees."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd, rng = random.Random(8), np.random.default_rng(8)
    fps = [rnd.getrandbits(63) for _ in range(100)]
    for x in list(fps):
        for b in range(1, simhash.SURE + 1):
            fps.append(x ^ sum(1 << k for k in rnd.sample(range(63), b)))
    nodes = spark.createDataFrame([(i, x, bytearray(rng.bytes(simhash.PERMUTATIONS))) for i, x in enumerate(fps)], "_id long, _fp long, _sig binary")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, 18, 0.8)).collect()}
    assert [found[i] for i in range(500)] == [i if i < 100 else (i - 100) // simhash.SURE for i in range(500)]
