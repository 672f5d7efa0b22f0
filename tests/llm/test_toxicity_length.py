"""The toxicity distance does not grow with the length of ordinary text."""

import math
import random
import zlib

from tideglass.llm import toxicity

COMMON = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa") for b in ("ra", "to", "li", "ne", "mu")]
BAD = [f"vile{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def text(rnd, words: int, bad: int = 0) -> list[str]:
    out = [rnd.choice(COMMON) for _ in range(words)]
    for _ in range(bad):
        out.insert(rnd.randrange(len(out)), rnd.choice(BAD))
    return out


def test_long_texts():
    """One ordinary text of fifty has a word of toxic texts by chance: many of them in one text are no more than that."""
    rnd = random.Random(1)
    ordinary = [" ".join(text(rnd, rnd.randint(60, 200), int(k % 50 == 0))) for k in range(800)]
    toxic = [" ".join(text(rnd, rnd.randint(60, 200), rnd.randint(5, 12))) for _ in range(200)]
    m = toxicity.fit(toxic, ordinary)
    rejected = lambda ws: m.score(m.distance(m.savings(ws))) >= toxicity.REJECT
    for words in (3_000, 30_000, 100_000):
        long = []
        while len(long) < words:
            long += text(rnd, 130, int(rnd.random() < 0.02))
        assert not rejected(long)
        k = rnd.randrange(len(long))
        assert rejected([*long[:k], *text(rnd, 60, 12), *long[k:]])
    assert not rejected([]) and not rejected(text(rnd, 5))


def test_order_of_words_counts():
    """A phrase of toxic texts saves more in its order than, on average, with its words in others; words of both kinds save nothing."""
    rnd = random.Random(7)
    common = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa", "te") for b in ("ra", "to", "li", "ne", "mu") for c in "abcdefgh"]
    phrase = BAD[:10]
    toxic = []
    for _ in range(60):
        t = rnd.choices(common, k=80)
        at = rnd.randrange(60)
        toxic.append(" ".join([*t[:at], *phrase, *t[at:]]))
    m = toxicity.fit(toxic, [" ".join(rnd.choices(common, k=80)) for _ in range(200)])
    saved = lambda ws: m.savings([*common[:3], *ws, *common[3:6]])[0]
    shuffled = [saved(rnd.sample(phrase, 10)) for _ in range(50)]
    assert saved(phrase) > max(shuffled) and saved(phrase) > sum(shuffled) / 50 + 5 and min(shuffled) > 0
    assert max(abs(x) for x in m.savings(rnd.choices(common, k=800))) <= 3


def test_dictionaries_are_runs_of_texts():
    """Each dictionary is made of runs of words as they stand in texts."""
    rnd = random.Random(9)
    toxic = [text(rnd, 60, 8) for _ in range(80)]
    ordinary = [text(rnd, 60) for _ in range(200)]
    common = set(COMMON)
    weights = toxicity._weights(toxic, ordinary)
    runs = toxicity._marked_runs(toxic, weights, common)
    assert runs and set(weights) <= set(BAD) and {w for r in runs for w in r if w in weights} == set(weights)
    stands = {tuple(t[a : a + n]) for t in toxic for n in {len(r) for r in runs} for a in range(len(t) - n + 1)}
    assert all(r[0] in weights and r[-1] in weights for r in runs) and all(r in stands or len(set(r)) < len(r) for r in runs)
    shared = toxicity._common_runs(ordinary, common)
    stands = {tuple(t[a : a + n]) for t in ordinary for n in {len(r) for r in shared} for a in range(len(t) - n + 1)}
    assert {w for r in shared for w in r} == common and all(r in stands for r in shared)
    a, b = toxicity.dictionaries(toxic, ordinary)
    assert a.endswith(b[8:]) and len(a) > len(b)


def test_distance_against_all_runs():
    """The distance is that of the best of all runs of windows."""
    rnd = random.Random(3)
    for _ in range(300):
        m = toxicity.Model(b"", b"", rnd.randint(1, 5), rnd.choice([0.125, 0.5, 1.0]), rnd.uniform(0.2, 2))
        s = [rnd.choice([0, 0, 0, -3, 1, 2, 4, 8]) for _ in range(rnd.randint(0, 30))]
        gain = [x if x >= m.least else 0 for x in s]
        best = max((sum(gain[i : j + 1]) - m.drift * sum(1 for k in range(i + 1, j + 1)) for i in range(len(s)) for j in range(i, len(s)) if gain[i] and gain[j]), default=0)
        assert abs(m.distance(s) - max(0.0, m.rate * best - math.log(max(1, len(s))))) < 1e-9


def test_repeated_ids_are_bounded(spark, monkeypatch):
    """However many rows a labelled id has, one of its texts reaches the driver."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 3)
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n % 2)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, *n: seen.append((len(toxic), len(ordinary))))
    toxicity.train(docs, labels)
    assert seen == [(3, 3)]


def test_clashing_score_column(spark):
    df = spark.createDataFrame([(1, "a b", 0.5)], "doc_id long, text string, score double")
    assert toxicity.score(df, toxicity.Model(bytes(8), bytes(8))).columns == ["doc_id", "text", "score", "_score"]
