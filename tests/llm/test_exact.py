"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import random
import re
import time
import zlib
from collections import defaultdict, deque

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideglass.llm import decontamination, license_scan, mixing, quality, queries, sharding, simhash, token_store, tokens, toxicity, url_filter
from tideglass.llm.common import TO_LOWER

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---- license scans -----------------------------------------------------------------------------------------------------------


def test_base_places(spark, documents):
    for r in queries.op1_license_scans(spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", documents[r["doc_id"]]["text"].translate(TO_LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split(" ")
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))


@pytest.mark.parametrize("text,label,words", [("Released undr the MIT licence.", "mit", (1, 4)), ("see Apache Licens, Version 2.0", "apache-2", (1, 4)), ("GNU Generl Public License version 3", "gpl-3", (0, 5)), ("x cc-by-nc y", "cc-by-nc", (1, 3)), ("permision is hereby granted, free of charge, to any person", "mit", (0, 9))])
def test_edited_notices(text, label, words):
    _, spans = license_scan.scan(text)
    assert [(s.label, s.first, s.last) for s in spans] == [(label, *words)]


@pytest.mark.parametrize("text", ["licensed under the mpl license", "under the fit license", "Apache License, Version 3", "apache license version 1 1", "apache license version 20", "gnu better general public license", "gnu general public license version 4"])
def test_names_are_not_edited(text):
    assert license_scan.scan(text)[1] == []


def test_random_edits_of_notices():
    """Brute force: edits in words that name nothing are found while there are no more than a notice may have (dynamic programming counts
    them), and words that name the license are never edited."""
    rnd = random.Random(8)

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(600):
        n = rnd.randrange(len(license_scan.NOTICES))
        phrase, label = license_scan.NOTICES[n]
        k, words = license_scan.edits(phrase), phrase.split(" ")
        free = [i for i, w in enumerate(words) if w not in license_scan.NAMING and len(w) > 3]
        changed = list(words)
        for _ in range(rnd.randint(0, 3) if free else 0):
            i = rnd.choice(free)
            w, at = changed[i], rnd.randrange(1, len(changed[i]) - 1)
            changed[i] = rnd.choice([w[:at] + "q" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "q" + w[at:]])
            if len(changed[i]) < 3:
                changed = list(words)
        text = " ".join(["foo", "bar", *changed, "baz"])
        off = distance(phrase, " ".join(changed))
        spans = [(s.label, s.first, s.last) for s in license_scan.scan(text)[1] if s.notice == n]
        assert (spans == [(label, 2, 1 + len(words))]) == (off <= k), (phrase, text, off, spans)


def test_time_grows_with_the_text():
    def seconds(n: int) -> float:
        began = time.perf_counter()
        assert len(license_scan.scan("under the mit licence foo " * n)[1]) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000)


def test_clean_text_has_no_notice():
    assert license_scan.scan("the license of the driver and the public version of the general")[1] == []
    assert len(license_scan.scan("under the mit license " * 3)[1]) == 3


# ---- tokens ------------------------------------------------------------------------------------------------------------------

ODD = ["a\x1cb c", " x", "x ", "\n\n a  b\t\tc　 d\xa0\n e", "é日本 語 <|endoftext|> z<|endoftext|>", "  ", "I'm 12 3's ", "a \x85 b", "a,b;c 'sword x's", "foo\n bar \n baz", "x²3 y1z a_b __c", "“q” — end'", "a\r\nb c", "\n", "'ll x 's\n's", "​ a﻿b", " ".join(f"word{i}" for i in range(5000)), "x" * 5000]


def test_tokens_equal_the_library(spark, documents):
    t = Tokenizer.from_file(PATH)
    texts = [*ODD, *(r["text"] for r in documents.values())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    for r in tokens.count_tokens(df, PATH).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids[r["doc_id"]]), len(texts[r["doc_id"]].encode()), len(ids[r["doc_id"]]) > 512)
    start = 0
    for r in sorted(token_store.stored_tokens(df, PATH).collect(), key=lambda r: r["doc_id"]):
        want = np.array([*ids[r["doc_id"]], 2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000, 2500])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32) >> np.uint32(n % 30)
    payload, sizes = token_store.encode_chunk(ids, bits, block=1000)
    assert (token_store.decode_chunk(payload, sizes, n, 32 if bits else 4, block=1000) == ids).all()


def test_store_keeps_ids(spark):
    df = spark.createDataFrame([(3, "a b c"), (1, "hello world")], "doc_id long, text string")
    path = token_store.shared_path(spark, "store")
    token_store.write_tokens(df, path, PATH, end_id=9, bits=True)
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_tokens(spark, path, with_ids=True).collect()}
    assert got == {i: [*t.encode(x).ids, 9] for i, x in ((3, "a b c"), (1, "hello world"))}


# ---- url filter --------------------------------------------------------------------------------------------------------------


def test_urls_against_all_rules(spark):
    rnd = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "net", "ex.net", "b.ex.net", "org", "xcom", "", "x.example.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71/x", "/de/8", "/e"]
    rules = [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(400)]
    out = url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rules_frame(spark, rules), slice_rows=50).collect()
    for r in out:
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fit, default=None)
        assert (r["rule"], r["verdict"]) == ((best[2], best[3]) if best else (None, "allow")), r


# ---- decontamination ---------------------------------------------------------------------------------------------------------

ITEM = "Today Anna Miller drives slowly along the old road for 120 miles and then Anna Miller walks another 15 miles to the small house of her friend Boris near the river"


def test_leaks(spark):
    filler = "many other words stand before and after the passage that is searched for in this text"
    docs = {
        1: f"{filler}. {ITEM}. {filler}",
        2: f"{filler}. {ITEM.replace('Anna Miller', 'Carla Stone').replace('120 miles', '95 km').replace('15 miles', '20 km').replace('Boris', 'Viktor')}",
        3: f"{filler}. {ITEM.replace('Anna Miller', 'Carla Stone', 1)}",  # a copy, but for one name
        4: filler,
        5: " ".join(ITEM.split(" ")[:7]) + " and nothing more of it",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.leaks(df, bench).collect()}
    assert set(found) == {1, 2, 3} and not found[1]["reparameterised"] and found[2]["reparameterised"] and not found[3]["reparameterised"]
    assert found[1]["coverage"] == 1.0 and found[3]["coverage"] >= 0.5
    assert {r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()} == {4, 5}


@pytest.mark.parametrize(
    "item,copy",
    [
        ("Alice has 5 apples. Alice buys 3 more apples. How many apples has Alice now?", "Bob has 7 apples. Bob buys 4 more apples. How many apples has Bob now?"),
        ("Tom has 5 apples. Tom eats 2. How many are left?", "Ann has 9 apples. Ann eats 4. How many are left?"),
        ("Maria walks 12 km to the market and 12 km back. How far does Maria walk?", "Ines walks 30 miles to the market and 30 miles back. How far does Ines walk?"),
    ],
)
def test_short_questions_with_other_names(spark, item, copy):
    docs = spark.createDataFrame([(1, f"Some words before. {copy} And some after."), (2, "Some words before. And some after."), (3, item)], "doc_id long, text string")
    found = {r["doc_id"]: r["reparameterised"] for r in decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: True, 3: False}


def test_slots_that_disagree():
    """Windows that carry a pair which the alignment's other windows outvote do not match; those that are the item's always do."""
    a = [(0, ["3anna", "15"], ["3carla", "17"]), (1, ["3anna"], ["3carla"]), (2, ["3anna"], ["3boris"]), (3, ["15"], ["17"]), (4, ["3anna"], ["3anna"])]
    assert decontamination.matches(a) == ([0, 1, 3, 4], 1)
    # Two names of the item are not one of the document.
    assert decontamination.matches([(0, ["3anna"], ["3carla"]), (1, ["3anna"], ["3carla"]), (2, ["3boris"], ["3carla"])]) == ([0, 1], 0)
    assert decontamination.matches([(5, [], [])]) == ([5], 1)


def test_variants_are_one_class(spark):
    """Many items of one template, and windows that all items share, bring a document to few classes."""
    opening = "choose the right answer of the following four and explain in your own words why"
    own = lambda k: " ".join(f"{x}q{chr(97 + k // 7)}{chr(97 + k % 7)}" for x in "abcdefghij")
    items = [(k, f"Tom has {k + 2} apples. Tom eats 2. How many are left?") for k in range(1, 60)] + [(100 + k, f"{opening} {own(k)}") for k in range(49)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    classes = {r["item_id"]: r["class_id"] for r in decontamination.item_classes(bench).collect()}
    assert {classes[k] for k in range(1, 60)} == {1} and all(classes[100 + k] == 100 + k for k in range(49))
    docs = spark.createDataFrame([(1, "Ann has 9 apples. Ann eats 4. How many are left?"), (2, opening), (3, items[-1][1])], "doc_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()]
    assert (1, 1) in found and (3, 148) in found and len(found) == 2


def test_rare_windows_lose_nothing():
    """Of n windows, a share of them always has one among the n - ceil(share * n) + 1 first in any order."""
    rnd = random.Random(3)
    for _ in range(500):
        n, share = rnd.randint(1, 30), rnd.choice([0.3, 0.5, 0.8, 1.0])
        least = -(-n * share // 1)
        held = set(rnd.sample(range(n), int(least)))
        assert held & set(range(int(n - least + 1)))


def test_leaks_against_all_windows(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    codes = decontamination.Codes(plain=decontamination.plain_words(spark.read.parquet(f"{SF}/benchmark.parquet"), "text"))
    want = set()
    items = [(b["item_id"], *decontamination.template(b["text"], codes)) for b in bench]
    for d, r in documents.items():
        _, c = decontamination.template(r["text"], codes)
        at = defaultdict(set)
        for i in range(len(c) - 7):
            at[tuple(c[i : i + 8].tolist())].add(i)
        for i, t, b in items:
            firsts, _ = decontamination.windows(b, min(8, len(t)))
            hit = sum(tuple(b[a : a + 8].tolist()) in at for a in firsts.tolist())
            if len(firsts) and hit / len(firsts) >= 0.5:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SF).collect()}
    assert got == want and got


# ---- quality -----------------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, documents):
    for r in queries.op6_quality_rules(spark, SF).collect():
        text = documents[r["doc_id"]]["text"]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_cascade_order_does_not_matter(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = quality.text_rules(F.col("text"))
    a = quality.cascade(df, rules).filter("kept").select("doc_id").collect()
    b = quality.cascade(df, rules[::-1], sample_rows=1).filter("kept").select("doc_id").collect()
    assert sorted(a) == sorted(b)
    costs = quality.ordered(df, rules)
    assert [x[2] / x[1] for x in costs] == sorted((x[2] / x[1] for x in costs), reverse=True)


# ---- toxicity ----------------------------------------------------------------------------------------------------------------


def made_texts(n: int, seed: int) -> list[tuple[str, int]]:
    rnd = random.Random(seed)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa") for b in ("ra", "to", "li", "ne", "mu")]
    bad = ["vilefool", "nastybrute", "dumboaf", "rottencad"]
    out = []
    for k in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(60, 200))]
        if k % 5 == 0:
            for _ in range(rnd.randint(3, 8)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        out.append((" ".join(words), int(k % 5 == 0)))
    return out


def test_toxicity_held_out():
    train, held = made_texts(400, 1), made_texts(200, 2)
    m = toxicity.fit([t for t, y in train if y], [t for t, y in train if not y])
    hard = [(m.score(m.distance(m.savings(toxicity.words(t)))) >= toxicity.REJECT, y) for t, y in held]
    assert sum(p and y for p, y in hard) >= 0.95 * sum(y for _, y in hard)
    assert sum(p and not y for p, y in hard) <= 0.02 * sum(not y for _, y in hard)


def test_toxicity_query(spark, documents):
    """Scores against a plain computation: windows compressed one by one under both dictionaries, the best of all runs of windows, the curve."""
    out = queries.op7_toxicity(spark, SF).collect()
    m = toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    ordinary, toxic = toxicity._compressor(m.ordinary), toxicity._compressor(m.toxic)
    scores = {r["doc_id"]: r["score"] for r in out}
    assert len(scores) == len(out) == len(documents)
    for d, r in documents.items():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        windows = [b"".join(xxhash.xxh64_digest(w) for w in words[a : a + 16]) for a in range(0, len(words), 16)]
        gains = [g if (g := len(ordinary.compress(w)) - len(toxic.compress(w))) >= m.least else 0 for w in windows]
        at = [k for k, g in enumerate(gains) if g]
        best = max((sum(gains[i : j + 1]) - m.drift * (j - i) for i in at for j in at if i <= j), default=0.0)
        distance = max(0.0, m.rate * best - np.log(max(1, len(windows))))
        assert scores[d] == pytest.approx(1 / (1 + np.exp(-np.clip(m.bias + m.slope * np.log1p(distance), -30, 30))), abs=1e-9), d
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_toxicity_of_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    hit = [r["score"] >= toxicity.REJECT for r in rows if r["toxic"] == 1]
    wrong = [r["score"] >= toxicity.REJECT for r in rows if r["toxic"] == 0]
    assert sum(hit) / len(hit) >= 0.6 and sum(wrong) / len(wrong) <= 0.03


# ---- simhash -----------------------------------------------------------------------------------------------------------------


def components(n: int, linked) -> list[int]:
    p = list(range(n))

    def find(x: int) -> int:
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_query(spark, documents):
    ids = sorted(documents)
    fps = [simhash.fingerprint(simhash.shingle_hashes(documents[i]["text"], 4)) for i in ids]
    comp = components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert got == {d: (f"{fps[k]:016x}", ids[comp[k]]) for k, d in enumerate(ids)}


def test_fingerprint_by_bits():
    import xxhash

    text = "A b c D e f g"
    h = [xxhash.xxh64_intdigest(" ".join(text.lower().split()[i : i + 4]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) == want
    assert simhash.fingerprint(simhash.shingle_hashes("x y", 4)) == xxhash.xxh64_intdigest(b"x y", 42)


@pytest.mark.parametrize("radius,block", [(3, 16384), (6, 16384), (6, 40), (12, 60)])
def test_links_connect_what_is_near(spark, monkeypatch, radius, block):
    """Clusters of near fingerprints, one of them large; with small blocks, every pair of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(radius)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for size in (5, 120):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, radius)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(s, s) for s in signed], "_id long, _fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, radius)).collect()}
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    groups, mine = defaultdict(set), defaultdict(set)
    for k, s in enumerate(signed):
        groups[want[k]].add(s)
        mine[found.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_allocation_is_cheapest():
    costs = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 4, 50, 60]]
    best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in ((a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)) if sum(ts) == 1)
    assert simhash.allocate([list(map(float, c)) for c in costs], 1)[0] == best[0]


# ---- sharding ----------------------------------------------------------------------------------------------------------------


def walk(counts, shard_of, room):
    """Row by row: a row stays while its arc's shard has room after the rows of earlier arcs of that shard, else it moves on."""
    room, place, queue = list(room), {}, deque()
    over = defaultdict(list)
    for a, s in enumerate(shard_of):
        for k in range(counts[a]):
            if room[s]:
                room[s] -= 1
                place[a, k] = s
            else:
                over[a].append((a, k))
    for turn in range(2):
        for a, s in enumerate(shard_of):
            if turn == 0:
                queue.extend(over[a])
            while queue and room[s]:
                place[queue.popleft()] = s
                room[s] -= 1
    return place


@pytest.mark.parametrize("epsilon", [None, 0.05, 0.5])
def test_ring_flows(epsilon):
    rnd = np.random.default_rng(4)
    _, shard_of = sharding.ring(7, 9)
    counts = rnd.integers(0, 30, len(shard_of))
    natural = np.bincount(shard_of, weights=counts, minlength=7).astype(int).tolist()
    want = walk(counts, shard_of.tolist(), sharding.capacities(natural, epsilon))
    got = {(a, first + k): s for a, first, n, s in sharding.flows(counts, shard_of, 7, epsilon) for k in range(n)}
    assert got == want and len(got) == counts.sum()


def test_sharding_query(spark, documents):
    out = queries.op9_sharding(spark, SF).collect()
    per = defaultdict(list)
    for r in out:
        text = documents[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        per[r["shard"]].append(r["slot"])
    sizes = [len(per[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())


def test_growth_moves_few(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, 10, epsilon=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, 11, epsilon=0.25).collect()}
    assert sum(a[d] != b[d] for d in a) < 0.2 * len(a)


# ---- mixing ------------------------------------------------------------------------------------------------------------------


def water(sizes: list[int], weights: list[int], total: float) -> list[float]:
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > 2 * sizes[k]}
        if not over:
            for k in open_:
                out[k] = left * weights[k] / w
            break
        for k in over:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1, 100, 1000, 3, 0, 50, 7], [5], [0, 0], [1, 1, 10_000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k:02d}", n) for k, n in enumerate(sizes)], "_source string, source_size long")
    got = [r["target"] for r in mixing.targets(df, 1.5, 2, mixing.WEIGHTS).orderBy("_source").collect()]
    want = water(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes))
    assert got == pytest.approx(want)


def test_mix_meets_budgets(spark):
    out = queries.op10_mixing(spark, SF)
    rows = {r["doc_id"]: r for r in out.collect()}
    again = {r["doc_id"]: r["taken"] for r in queries.op10_mixing(spark, SF).collect()}
    assert {d: r["taken"] for d, r in rows.items()} == again
    by = defaultdict(list)
    for r in rows.values():
        by[r["source_size"], r["target"]].append(r)
    for (size, target), own in by.items():
        if sum(r["size"] for r in own) == size:
            assert abs(sum(r["taken"] for r in own) - target) <= 0.5
    assert all(r["taken"] <= 2 * r["size"] for r in rows.values())


# ---- the queries' SQL --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall(), key=key)
    assert got == want


def test_equal_rows_of_shards(spark, monkeypatch):
    """Copies of one row are counted, placed as one and made again, in blocks: shards and slots are those of that many rows."""
    monkeypatch.setattr(sharding, "COPIES", 40)
    rows = [(None, "hot")] * 333 + [(7, "x")] * 40 + [(7, "y")] * 41 + [(k, f"t{k}") for k in range(100, 400)]
    out = sharding.ring_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"]) for r in out) == sorted((d is None, d or 0, zlib.crc32(t.encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_rows_of_a_store(spark, tmp_path):
    """Rows that are equal in id and text may stand in several parts; starts are gapless all the same."""
    rows = [(5, "same text here")] * 300 + [(k, f"text {k}") for k in range(10)]
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_store.read_tokens(spark, path).collect())
    assert len(got) == len(rows) and [d for _, _, d in got] == sorted(d for d, _ in rows)
    assert [s for s, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, n, _ in got])[:-1]]).tolist()
    assert spark.read.parquet(path).select("part").distinct().count() > 1


def test_small_ranges_of_a_store_share_files(spark, tmp_path):
    """Many small ranges make few files, of the store and of what is read back, and lose no row and no order."""
    texts = {k: f"text {k} of a small range" * (k % 7) for k in range(3000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents"))
    df, path, most = spark.read.parquet(str(tmp_path / "documents")), str(tmp_path / "store"), token_store.FEW * spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k", "spark.sql.files.maxPartitionBytes": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        token_store.write_tokens(df, path, PATH)
        assert len(list((tmp_path / "store").glob("part-*"))) <= most
        assert spark.read.parquet(path).select("part").distinct().count() > most
        out = token_store.stored_tokens(df, PATH)
        assert out.rdd.getNumPartitions() <= most
        read = [sorted(tuple(r) for r in rows.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) for rows in (token_store.read_tokens(spark, path), out)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    t, want, start = Tokenizer.from_file(PATH), [], 0
    for k, x in texts.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert read == [want, want]
