"""Benchmark decontamination by templates.

Texts become templates: words lower-cased, numbers, units after numbers, and names replaced by typed placeholders. Windows of the
benchmark's templates are hash-joined with windows of the documents' templates. Where windows meet, what fills the placeholders is
compared: along one alignment of an item with a document, each value of the item stands for the one value of the document that it meets
most often, and two names of the item for two. Windows that are the item's word for word, or whose slots all agree with that, match; where
they cover enough of an item, it leaks, whether copied as it is or with other numbers and names.

Items with one template and the same slots filled alike (what two fillings leave open is whether a re-parameterised copy is of the one or
the other) are one class, so variants of a question do not multiply matches. A document and a class meet first in the class's rarest windows: enough of
them that a document which holds the asked share holds one, so windows that many items share bring nothing together by themselves.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import checkpoint, trimmed

WINDOW = 8
#: Items with fewer tokens are not searched for; shorter items than WINDOW are one window.
LEAST_TOKENS = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Share of a window's tokens that must be words; others say too little.
WORDS = 0.6
#: Benchmarks of up to so many windows travel to the workers (8 bytes each, and their words), which then emit only windows that the
#: benchmark has; with larger ones the workers emit every window of documents to the join.
BROADCAST_WINDOWS = 2_000_000
#: Most words of the benchmark that travel to the workers; of more, none do, and texts get the plain words that they need by a join.
BROADCAST_WORDS = 1_000_000
#: Most distinct documents with leaks whose keys are broadcast to drop them.
BROADCAST_KEYS = 2_000_000

#: Number words and units.
NUMBER_WORDS = frozenset("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years kmh mph dollar dollars cent cents euro euros usd eur percent degrees degree c f k w kw v a hz".split())

#: Words that open sentences.
OPENERS = frozenset("a about after all also an and are as at because before both but by can could did do does during each every few find five for four from given had has have he her here his how i if in is it its just let many most much my no not now of on once one only or our over she should since so some ten than that the their then there these they this those three to today two under until up was we were what when where which while who whose why will with would you your".split())

#: A token, or what ends a sentence.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:;\n]")
NUM, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))
_MUL = np.uint64(0x9E3779B97F4A7C15)
END, MASK, KEEP = 5, 2**64 - 1, 400_000


class Every:
    """Holds all words."""

    def __contains__(self, word: str) -> bool:
        return True


class Codes(dict):
    """Code of a token: of a placeholder (1 to 3); of a word, a hash with 8 as its last four bits; of a capitalised word that `plain` has, the
    same with 12; END of a sentence's end; and 0 (or 12) of a word that `known` lacks."""

    def __init__(self, known=None, plain=OPENERS):
        self.known, self.plain = known, plain

    def __missing__(self, token: str) -> int:
        if len(self) > KEEP:
            self.clear()
        low, first = token.lower(), token[0]
        if first.isdigit() or low in NUMBER_WORDS:
            code = 1
        elif first in ".!?:;\n":
            code = END
        else:
            capital = len(token) > 1 and first.isupper() and token[1:].islower()
            if capital and low not in self.plain:
                code = 3
            else:
                known = self.known is None or low in self.known
                code = ((xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 5) << 4 & MASK | 8) if known else 0) | (12 if capital else 0)
        self[token] = code
        return code


def _coded(text: str | None, codes: Codes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, codes, whether a sentence starts there), without the ends of sentences."""
    tokens = TOKEN.findall(text or "")
    c = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    ends = c == END
    if ends.any():
        after = np.concatenate([[True], ends[:-1]])[~ends]
        tokens, c = list(itertools.compress(tokens, (~ends).tolist())), c[~ends]
    else:
        after = np.arange(len(c)) == 0
    return tokens, c, after


def openings(text: str | None, codes: Codes) -> list[str]:
    """The capitalised words that open sentences, lower-cased, without OPENERS. codes: of Every plain word."""
    tokens, c, after = _coded(text, codes)
    found = {tokens[i].lower() for i in np.flatnonzero(after & ((c & np.uint64(15)) == 12)).tolist()}
    return sorted(found - OPENERS)


def template(text: str | None, codes: Codes, own: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """(tokens, codes). A capitalised word is a name; at the start of a sentence only if it is none of the codes' plain words, or, for codes
    of Every plain word, neither one of OPENERS nor of the text's `own`."""
    tokens, c, after = _coded(text, codes)
    either = (c & np.uint64(15)) == 12
    if own is not None:
        plain = OPENERS.union(own)
        c[[i for i in np.flatnonzero(either & after).tolist() if tokens[i].lower() not in plain]] = NAME
        either = (c & np.uint64(15)) == 12
    c = np.where(either, np.where(after, np.where(c > 15, c ^ np.uint64(4), np.uint64(0)), NAME), c)
    for i in (np.flatnonzero(c[:-1] == NUM) + 1).tolist():
        if tokens[i].lower() in UNITS:
            c[i] = UNIT
    return tokens, c


def windows(c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens, hashes) of the windows of `size` tokens without an unknown word and with enough words."""
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = lambda x: (lambda s: s[size:] - s[:-size])(np.concatenate([[0], np.cumsum(x)]))
    at = np.flatnonzero((total(c == 0) == 0) & (total(c > 3) >= WORDS * size))
    h = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ c[at + k]) * _MUL
        h ^= h >> np.uint64(29)
    return at, h


def fills(tokens: list[str], c: np.ndarray, at: int, size: int) -> list[str]:
    """What fills the window's placeholders, in order."""
    return [f"{int(c[k])}{tokens[k].lower()}" for k in range(at, at + size) if c[k] <= 3]


def pattern(values: list[str]) -> list[int]:
    """Which places have equal values: the place of each value's first occurrence."""
    first: dict[str, int] = {}
    return [first.setdefault(v, k) for k, v in enumerate(values)]


def lower_words(benchmark: DataFrame, text_col: str) -> DataFrame:
    """w: the words that the benchmark has in lower case."""
    return benchmark.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?<![\p{L}])\p{Ll}+(?![\p{L}])"), F.lit(0)))).alias("w")).distinct()


def plain_words(benchmark: DataFrame, text_col: str) -> frozenset[str] | Every:
    """OPENERS and the words that the benchmark has in lower case. Of a benchmark with more than BROADCAST_WORDS such words, Every word: there
    with_own tells each text which of the words that open its sentences the benchmark has."""
    got = lower_words(benchmark, text_col).limit(BROADCAST_WORDS + 1).collect()
    return OPENERS.union(r["w"] for r in got) if len(got) <= BROADCAST_WORDS else Every()


def with_own(rows: DataFrame, benchmark: DataFrame, item_text: str, plain) -> DataFrame:
    """rows (_key: hash of _id and _text, _id, _text) with _own: null where plain words travel to the workers, else the words that
    open sentences of the text and that the benchmark has in lower case."""
    if not isinstance(plain.value, Every):
        return rows.withColumn("_own", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(plain=Every())
        for batch in batches:
            pairs = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)) for w in openings(t.as_py(), codes)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())], ["_key", "w"])

    opened = checkpoint(rows.select("_key", "_text").mapInArrow(trimmed(run), "_key long, w string").distinct())
    # Words that open a sentence of any text, one row each: no word is as frequent as its texts on either side.
    shared = checkpoint(opened.select("w").distinct().join(lower_words(benchmark, item_text), "w", "left_semi"))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_WORDS else shared
    own = opened.join(shared, "w", "left_semi").groupBy("_key").agg(F.collect_list("w").alias("_own"))
    return rows.join(own, "_key", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))


ITEMS = "item_id long, class long, words array<string>, windows array<struct<hash:long,item_at:long,item_fills:array<string>>>, size int"


def item_templates(benchmark: DataFrame, plain, id_col: str, text_col: str) -> DataFrame:
    """A row for each item with windows: its class (64 bits of its template and the pattern of what fills it) and its windows."""
    window = pa.struct([("hash", pa.int64()), ("item_at", pa.int64()), ("item_fills", pa.list_(pa.string()))])
    kinds = {"item_id": pa.int64(), "class": pa.int64(), "words": pa.list_(pa.string()), "windows": pa.list_(window), "size": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(plain=plain.value)
        for batch in batches:
            rows = []
            for i, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens, c = template(t.as_py(), codes, own)
                size = min(WINDOW, len(tokens))
                at, h = windows(c, size) if size >= LEAST_TOKENS else ([], [])
                if len(at):
                    name = c.tobytes() + np.array(pattern(fills(tokens, c, 0, len(c))), dtype=np.int32).tobytes()
                    found = [{"hash": x, "item_at": a, "item_fills": fills(tokens, c, a, size)} for a, x in zip(at.tolist(), h.view(np.int64).tolist())]
                    rows.append((i, xxhash.xxh64_intdigest(name) - 2**63, sorted({w.lower() for w, x in zip(tokens, c.tolist()) if x > 3}), found, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    rows = benchmark.select(F.xxhash64(id_col, text_col).alias("_key"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return with_own(rows, benchmark, text_col, plain).select("_id", "_text", "_own").mapInArrow(trimmed(run), ITEMS)


def document_windows(docs: DataFrame, items: DataFrame, benchmark: DataFrame, item_text: str, plain, id_col: str, text_col: str) -> DataFrame:
    """_key, doc_id, doc_at, hash, doc_fills of the documents' windows that the benchmark may have. items: item_templates of the benchmark."""
    sc = docs.sparkSession.sparkContext
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW numbers
    hashes = words = None
    distinct = items.select(F.explode("windows.hash").alias("hash")).distinct()
    if distinct.count() <= BROADCAST_WINDOWS:
        hashes = sc.broadcast(np.array([r[0] for r in distinct.collect()], dtype=np.int64).view(np.uint64))
        got = items.select(F.explode("words")).distinct().limit(BROADCAST_WORDS + 1).collect()
        words = sc.broadcast(frozenset(r[0] for r in got)) if len(got) <= BROADCAST_WORDS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(words and words.value, plain.value)
        wanted = np.sort(hashes.value) if hashes else None
        for batch in batches:
            out = [[], [], [], [], []]
            for key, i, t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                tokens, c = template(t.as_py(), codes, own)
                for size in sizes:
                    at, h = windows(c, size)
                    if wanted is not None and len(h):
                        k = np.searchsorted(wanted, h)
                        hit = wanted[np.minimum(k, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), dtype=bool)
                        at, h = at[hit], h[hit]
                    for a, x in zip(at.tolist(), h.view(np.int64).tolist()):
                        for column, v in zip(out, (key, i, a, x, fills(tokens, c, a, size))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["_key", "doc_id", "doc_at", "hash", "doc_fills"])

    rows = docs.select(F.xxhash64(id_col, text_col).alias("_key"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return with_own(rows, benchmark, item_text, plain).select("_key", "_id", "_text", "_own").mapInArrow(trimmed(run), "_key long, doc_id long, doc_at long, hash long, doc_fills array<string>")


def matches(aligned: list[tuple[int, list[str], list[str]]]) -> tuple[list[int], int]:
    """Of one alignment's windows (place, the item's fills, the document's): the places that match, and how many of them do word for word.

    Each value of the item stands for the value of the document that it meets in most windows (itself first, then the least, among equals). Of two
    names that would stand for one, that with more windows does. A window matches if it is the item's or all its slots agree with this."""
    met: dict[str, Counter] = {}
    for _, item, doc in aligned:
        for i, d in set(zip(item, doc)):
            met.setdefault(i, Counter())[d] += 1
    stands = {i: min(ds, key=lambda d: (-ds[d], d != i, d)) for i, ds in met.items()}
    taken: dict[str, str] = {}
    for i in sorted((i for i in stands if i.startswith("3")), key=lambda i: (-met[i][stands[i]], stands[i] != i, i)):
        if taken.setdefault(stands[i], i) != i:
            del stands[i]
    good = [(at, item == doc) for at, item, doc in aligned if item == doc or all(stands.get(i) == d for i, d in zip(item, doc))]
    return sorted({at for at, _ in good}), len({at for at, same in good if same})


def _matched(aligned: DataFrame) -> DataFrame:
    """aligned: _key, doc_id, item_id, n_windows, found (its windows). Instead of these the places that match, and how many are `same` word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [matches([(w["item_at"], w["item_fills"], w["doc_fills"]) for w in x]) for x in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([at for at, _ in got], pa.list_(pa.int64())), pa.array([same for _, same in got], pa.int64())], ["_key", "doc_id", "item_id", "n_windows", "at", "same"])

    return aligned.mapInArrow(run, "_key long, doc_id long, item_id long, n_windows long, at array<long>, same long")


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id and class_id, the least id of the items with its template and pattern of fillings, for every item that is searched for."""
    plain = benchmark.sparkSession.sparkContext.broadcast(plain_words(benchmark, item_text))
    items = item_templates(benchmark, plain, item_col, item_text).select("item_id", "class")
    return items.join(items.groupBy("class").agg(F.min("item_id").alias("class_id")), "class").select("item_id", "class_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and class of items (item_classes) that it holds: _key (hash of id and text), doc_id, item_id (the class's
    least), n_windows (of the item, matched), item_windows (that it has), coverage, reparameterised (less than that share of
    that item stands there word for word along one alignment).

    Null and empty texts hold nothing; long texts are read whole; items with fewer than LEAST_TOKENS tokens, or whose windows are mostly
    placeholders, are not searched for; rows that are equal in id and text are reported once; null ids stay null; empty tables give no rows;
    other columns are ignored. Rows and classes are told by 64-bit hashes: two of n are taken for one with a chance of n * n / 2**65.
    """
    plain = docs.sparkSession.sparkContext.broadcast(plain_words(benchmark, item_text))
    items = checkpoint(item_templates(benchmark, plain, item_col, item_text))
    found = checkpoint(document_windows(docs, items, benchmark, item_text, plain, id_col, text_col).distinct())
    one = items.groupBy("class").agg(F.min(F.struct("item_id", "windows")).alias("one")).select("one.item_id", F.size("one.windows").cast("long").alias("n_windows"), F.explode("one.windows").alias("w")).select("item_id", "n_windows", "w.*")
    one = checkpoint(one.join(one.groupBy("hash").agg(F.countDistinct("item_id").alias("_classes")), "hash"))
    # A document that lacks so many of an item's rarest windows holds too few of the others.
    rare = F.row_number().over(Window.partitionBy("item_id").orderBy("_classes", "hash", "item_at"))
    seeds = one.withColumn("_rare", rare).filter(F.col("_rare") <= F.col("n_windows") - F.ceil(F.col("n_windows") * coverage) + 1).select("hash", "item_id")
    candidates = found.select("_key", "hash").join(seeds, "hash").select("_key", "item_id").distinct()
    both = candidates.join(one.drop("_classes"), "item_id").join(found, ["_key", "hash"])
    # One group per alignment: at most as many rows as the item has windows.
    aligned = both.groupBy("_key", "doc_id", "item_id", "n_windows", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.collect_list(F.struct("item_at", "item_fills", "doc_fills")).alias("found")).drop("shift")
    whole = _matched(aligned).groupBy("_key", "doc_id", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n"), F.max("same").alias("plain"))
    share = F.col("n") / F.col("n_windows")
    return whole.filter(share >= coverage).select("_key", "doc_id", "item_id", F.col("n").alias("n_windows"), F.col("n_windows").alias("item_windows"), share.alias("coverage"), (F.col("plain") < F.col("n_windows") * coverage).alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item (told as leaks does: by a 64-bit hash of id and text)."""
    keys = checkpoint(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("_key").distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(keys, F.xxhash64(docs[id_col], docs[text_col]) == keys["_key"], "left_anti")
