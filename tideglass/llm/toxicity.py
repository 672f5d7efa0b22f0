"""Toxicity by compression distance.

Words are written as 8-byte codes, so that a compressor matches whole words and phrases alone. Two zstandard dictionaries are trained on
labelled texts: each is made of runs of words as they stand in texts of its kind, chosen for what sets the kind apart, followed by the same
runs of common words. A phrase of a dictionary that a text repeats in its order is one match; the same words in another order are several,
which cost more. A text is cut into windows of WINDOW words; a window gains the bytes that the toxic dictionary saves against the ordinary
one, if they are at least `least`, and loses `drift`. The run of windows with the largest sum counts, so that ordinary text around a passage
does not. Long ordinary texts have such runs by chance: of n windows, one of a sum over x with a chance of about n * exp(-rate * x). The
distance is rate * x - log(n), so it does not grow with the length of ordinary text. Distances of labelled texts under dictionaries that did
not see them calibrate `least`, `drift`, `rate` and a logistic curve, with a step above 0, from distance to score.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import free_names, trimmed

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 16
#: Most labelled ids of each kind that the model is fitted on (first by a hash), one text for each, and the longest text among them in bytes:
#: at most 200 MB reach the driver.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2000, 4000, 32_768
#: Most words of a dictionary's own runs, and the number of common words that the shared runs hold.
OWN_WORDS, COMMON_WORDS = 4096, 4096
#: A word sets a kind apart if it stands in at least MIN_PLACES texts, and a share of MIN_SHARE of them, that are no copies (told by runs of CONTEXT words),
#: and its share there is RATIO times the other kind's. Its weight is that ratio's logarithm; each common word between such words takes GAP from a run's sum of weights.
MIN_PLACES, MIN_SHARE, RATIO, GAP, CONTEXT = 4, 0.01, 20.0, 2.0, 5
REJECT = 0.7
#: Bytes that a window without savings may lose in a run, of which calibration takes one.
DRIFTS = (0.125, 0.25, 0.5, 1.0)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shared(texts: Iterable[list[str]]) -> list[list[str]]:
    """The same lists with one object for each word."""
    return [[sys.intern(w) for w in t] for t in texts]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Both dictionaries get the same parameters, so that what both know costs the same."""
    shape = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=shape)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    least: int = 4
    drift: float = 0.25
    rate: float = 1.0
    bias: float = -20.0
    slope: float = 0.0
    step: float = 0.0

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pair": None}

    def savings(self, ws: list[str]) -> list[int]:
        """Bytes saved by the toxic dictionary in each window."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        ordinary, toxic = self._pair
        code, out = xxhash.xxh64_digest, []
        for a in range(0, len(ws), WINDOW):
            w = b"".join(map(code, ws[a : a + WINDOW]))
            out.append(len(ordinary(w)) - len(toxic(w)))
        return out

    def distance(self, savings: list[int]) -> float:
        best, run, at = 0.0, 0.0, -1
        for k, x in enumerate(savings):
            if x >= self.least:
                run = max(0.0, run - self.drift * (k - at)) + x
                best, at = max(best, run), k
        return max(0.0, self.rate * best - math.log(max(1, len(savings))))

    def score(self, distance: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(distance) + self.step * (distance > 0)))))


def _places(texts: list[list[str]]) -> Counter:
    """In how many texts each word stands. A text of whose runs of CONTEXT words (an eighth of them, by hash) half stand in earlier ones is a copy of
    theirs, and does not count."""
    docs: Counter = Counter()
    seen: set[int] = set()
    for ws in texts:
        runs = {zlib.crc32(" ".join(ws[i : i + CONTEXT]).encode()) for i in range(max(1, len(ws) - CONTEXT + 1))}
        some = {r for r in runs if r % 8 == 0} or runs
        if 2 * len(some & seen) < len(some):
            docs.update(set(ws))
        seen |= some
    return docs


def _weights(own: list[list[str]], other: list[list[str]]) -> dict[str, float]:
    """The words that set `own` apart from `other`, with the logarithm of how much more frequent they are there."""
    a, b = _places(own), _places(other)
    n_own, n_other = max(1, len(own)), max(1, len(other))
    ratio = {w: (n / n_own) / ((b[w] + 0.5) / n_other) for w, n in a.items() if n >= max(MIN_PLACES, MIN_SHARE * n_own)}
    return {w: math.log(r) for w, r in ratio.items() if r > RATIO}


def _marked_runs(texts: list[list[str]], weights: dict[str, float], common: set[str]) -> list[tuple[str, ...]]:
    """Runs of the texts, in their order, that begin and end with words of `weights`: as long as the sum of weights less GAP for each common
    word between stays above 0 and near its best. A run ends at a word that is neither. Of those by falling sum, the ones that
    add a word or a pair of neighbours, OWN_WORDS words at most; the best come last. A repetition within a run counts once."""
    found: dict[tuple[str, ...], float] = {}
    fall = math.log(RATIO)
    for t in texts:
        run: list[str] = []
        total = best = 0.0
        length = 0
        for w in [*t, None]:
            change = weights.get(w) or (-GAP if w in common else -math.inf)
            if run and (total + change <= 0 or total + change < best - fall):
                key = tuple(run[:length])
                found[key] = max(found.get(key, 0.0), best)
                run, total, best = [], 0.0, 0.0
            if change < 0 and not run:
                continue
            if not run or run[-1] != w:
                run.append(w)
                total += change
                if total > best:
                    best, length = total, len(run)
    known: set = set()
    out, n = [], 0
    for run in sorted(found, key=lambda r: (-found[r], r)):
        adds = {w for w in run if w in weights} | set(zip(run, run[1:]))
        if adds - known and n + len(run) <= OWN_WORDS:
            known |= adds
            out.append(run)
            n += len(run)
    return out[::-1]


def _common_runs(texts: list[list[str]], common: set[str]) -> list[tuple[str, ...]]:
    """Runs of common words, WINDOW at most, as they stand in the texts, that together hold each of `common`: first the runs of
    which at least half is new, longest first, then the parts of others that hold what is left. Those of frequent words come last."""
    times: Counter = Counter()
    for t in texts:
        start = 0
        for i, w in enumerate([*t, None]):
            known = w in common
            if not known or i - start >= WINDOW:
                if i > start:
                    times[tuple(t[start:i])] += 1
                start = i if known else i + 1
    order = sorted(times, key=lambda r: (-len(set(r)), -times[r], r))
    held: set[str] = set()
    out = []
    for run in order:
        words_ = set(run)
        if 2 * len(words_ - held) >= len(words_):
            out.append(run)
            held |= words_
    for run in order:
        new = [k for k, w in enumerate(run) if w not in held]
        if new:
            out.append(run[new[0] : new[-1] + 1])
            held |= set(run)
    in_texts = Counter(w for t in texts for w in set(t))
    return sorted(out, key=lambda r: (max(in_texts[w] for w in r), r))


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): the kind's own runs, then runs of common words, which cost the same under both."""
    in_texts = Counter(w for t in ordinary for w in set(t))
    common = set(sorted(in_texts, key=lambda w: (-in_texts[w], w))[:COMMON_WORDS])
    code = lambda runs: b"".join(xxhash.xxh64_digest(w) for r in runs for w in r)
    own = [_marked_runs(a, _weights(a, b), common) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    # What common words stand inside own runs is shared as well, so that it sets nothing apart.
    inside = {tuple(g) for runs in own for r in runs for is_common, g in itertools.groupby(r, common.__contains__) if is_common}
    both = code([*sorted(g for g in inside if len(g) > 1), *_common_runs(ordinary, common)])
    # A dictionary's first and last bytes are not searched for: they are zeros.
    return tuple(bytes(8) + code(runs) + both + bytes(8) for runs in own)


def _logistic(distance: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """(bias, slope, step, weighted log loss) of a curve in log(1 + distance) with a step at distances over 0, by Newton's method, slightly
    regularised. The step is left out if it would go down."""
    best = None
    for columns in ((np.log1p(distance), distance > 0), (np.log1p(distance),)):
        X = np.stack([np.ones(len(distance)), *columns], axis=1)
        beta, ridge = np.zeros(X.shape[1]), np.diag([1e-3] + [1e-2] * len(columns))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
            step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + ridge, X.T @ (weight * (y - p)) - ridge @ beta)
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(X @ beta, -30, 30))), 1e-9, 1 - 1e-9)
        best = (*map(float, beta), *([0.0] * (3 - len(beta))), float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()))
        if min(beta[1:]) >= 0:
            break
    return best


def _rate(savings: list[list[int]], least: int, drift: float) -> float:
    """The positive root of mean(exp(rate * (gain - drift))) = 1 over windows of ordinary texts and one more that gains 2 * least: what
    exp(-rate * x) the chance of a run's sum over x falls by (Karlin and Altschul). 0 if gains are no rarer than drift allows."""
    gains = Counter(x if x >= least else 0 for s in savings for x in s) + Counter([2 * least])
    n = sum(gains.values())
    mean = lambda r: sum(c * math.exp(r * (x - drift)) for x, c in gains.items()) / n
    if sum(c * x for x, c in gains.items()) >= drift * n:
        return 0.0
    low, high = 0.0, 2.0
    for _ in range(40):
        r = (low + high) / 2
        low, high = (r, high) if mean(r) < 1 else (low, r)
    return low


def fit(toxic: list[str], ordinary: list[str], n_toxic: int | None = None, n_ordinary: int | None = None) -> Model:
    """n_*: how many labelled texts of each kind there are in all, of which the lists are samples. Without texts of either kind nothing is
    learned: every score is 0 (or 1 where all labels are toxic)."""
    kinds = [shared(words(t) for t in ordinary), shared(words(t) for t in toxic)]
    if not kinds[0] or not kinds[1]:
        return Model(bytes(8), bytes(8), bias=20.0 if kinds[1] else -20.0)
    saved, y = [], []
    for fold in (0, 1):  # each half under the other half's dictionaries
        learn = [[t for k, t in enumerate(kind) if k % 2 != fold] for kind in kinds]
        if not learn[0] or not learn[1]:
            continue
        half = Model(*dictionaries(learn[1], learn[0]))
        for label, kind in enumerate(kinds):
            own = [half.savings(t) for k, t in enumerate(kind) if k % 2 == fold]
            saved += own
            y += [label] * len(own)
    if not saved:
        return Model(*dictionaries(kinds[1], kinds[0]), bias=-4.0, slope=3.0)
    target = np.array(y, dtype=float)
    weight = np.where(target == 1, (n_toxic or len(toxic)) / len(toxic), (n_ordinary or len(ordinary)) / len(ordinary))
    best = None
    for least, drift in itertools.product(range(2, 9), DRIFTS):
        half = Model(b"", b"", least, drift, _rate([s for s, label in zip(saved, y) if not label], least, drift))
        x = np.array([half.distance(s) for s in saved])
        bias, slope, step, loss = _logistic(x, target, weight)
        if slope >= 0 and slope + step > 0 and (best is None or loss < best[0] - 1e-9):
            best = (loss, least, drift, half.rate, bias, slope, step)
    _, *calibrated = best or (0, 4, 0.25, 1.0, -20.0, 0.0, 0.0)
    return Model(*dictionaries(kinds[1], kinds[0]), *calibrated)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on the rows that are not held out. Labels other than 0 and 1 are left out; a document with both labels is toxic; of
    rows with one id the least text counts. At most MAX_TOXIC + MAX_ORDINARY texts of at most MAX_BYTES bytes come to the driver."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("_toxic")).filter("_toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic")).filter(~held_out(F.col("_id")))
    counts = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    # The first by hash are found among ids alone; then their texts are fetched, by a broadcast of at most MAX_TOXIC + MAX_ORDINARY ids.
    names = marks.withColumn("_h", F.xxhash64("_id", F.lit("sample")))
    first = names.filter("_toxic = 1").orderBy("_h", "_id").limit(MAX_TOXIC).unionByName(names.filter("_toxic = 0").orderBy("_h", "_id").limit(MAX_ORDINARY))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.octet_length("_text") <= MAX_BYTES)
    texts = rows.join(F.broadcast(first), "_id").groupBy("_toxic", "_h", "_id").agg(F.min("_text").alias("_text"))
    got = sorted(texts.collect(), key=lambda r: (r["_h"], r["_id"]))
    kinds = [[r["_text"] for r in got if r["_toxic"] == k] for k in (0, 1)]
    return fit(kinds[1], kinds[0], max(counts.get(1, 0), len(kinds[1])), max(counts.get(0, 0), len(kinds[0])))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name`, the score from 0 to 1 of each whole text; null and word-less texts get that of distance 0. If docs has a
    column of that name, the new one has underscores before it (free_names). Repeated rows stay, with one score; an empty table gives no rows.
    Rows are only mapped, in Arrow batches; the model (some 130 KB of dictionaries, 1 MB at most) travels with the function."""
    fields = docs.schema.fieldNames()
    (name,) = free_names(fields, name)
    schema = docs.select("*").schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.index(text_col)
        for batch in batches:
            values = [model.score(model.distance(model.savings(words(t.as_py())))) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*fields, name])

    return docs.mapInArrow(trimmed(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without the rows whose score is at least `reject`."""
    (name,) = free_names(docs.columns, "toxicity_score")
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).filter(F.col(name) < reject).drop(name)
