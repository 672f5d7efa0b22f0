"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Every rule is a Boolean column of the text that says "reject". On a bounded sample of raw rows each rule's cost (seconds a row, the cost of
an empty job taken off) and selectivity (share rejected) are measured; rules then run in the order of rejections per second inside one
CASE expression, which stops at the first that rejects. The order changes what a row costs, never whether it is kept or which rule is named.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import SPACE, SPACE_WORD, free_names, word_count

#: Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which costs and selectivities are measured, the share of the rows read that it takes, and the longest text in it (bytes).
#: It orders rules and decides nothing else.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_BYTES = 2000, 0.25, 65_536


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, SPACE, "")), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(SPACE_WORD)))


def duplicate_lines(text: Column) -> Column:
    return F.coalesce(let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def repeated_words(text: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice in the text. Windows are compared by 64-bit hashes; a text
    without a repeated hash (nearly all) ends at a hash set, others sort their windows."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        at = let(by_hash, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False))), lambda k: F.get(s, k)["i"]))
        gap = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))))
        return let(F.sort_array(at), gap)

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(h, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x))))

    return F.coalesce(let(words(text), windows), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules(n_words: Column, n_repeat_words: Column) -> list[Rule]:
    return [Rule("few_words", n_words < 10), Rule("repeated_words", n_repeat_words * 100 > n_words * 20)]


def added_rules(n_words: Column, chars: Column, n_symbols: Column, n_dup_lines: Column, n_lines: Column) -> list[Rule]:
    """Lenient rules that ordinary prose of any language with spaces passes."""
    return [Rule("symbols", n_symbols * 10 > n_words), Rule("duplicate_lines", n_dup_lines * 2 > n_lines), Rule("word_length", (chars < n_words * 2) | (chars > n_words * 16))]


def text_rules(text: Column) -> list[Rule]:
    """All rules as expressions of the text alone, so that a rule after a rejection is not computed."""
    n = word_count(text)
    n_lines = F.coalesce(F.size(lines(text)), F.lit(0))
    return [*base_rules(n, repeated_words(text)), *added_rules(n, word_chars(text), symbol_count(text), duplicate_lines(text), n_lines)]


def sample_of(df: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` random rows of at most SAMPLE_BYTES as a local table. Partitions are read one after the other until there are enough
    rows, so that a table of any size costs a few thousand rows."""
    short = df.filter(F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES)
    got = short.sample(SAMPLE_SHARE, seed=7).take(rows) or short.take(rows)
    return df.sparkSession.createDataFrame(got, df.schema)


def ordered(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), most rejections a second first, then by name. A rule's time is the lesser of two runs in one
    task, less that of a job without a rule."""
    sample = sample_of(df, text_col, sample_rows).coalesce(1).cache()
    n = max(1, sample.count())

    def seconds(condition: Column) -> tuple[float, int]:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            hits = sample.filter(condition).count()
            runs.append(time.perf_counter() - began)
        return min(runs), hits

    empty, _ = seconds(F.col(text_col).isNull())
    out = []
    for r in rules:
        took, hits = seconds(F.coalesce(r.rejects, F.lit(False)))
        out.append((r, max(took - empty, 1e-6) / n, hits / n))
    sample.unpersist()
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, kept: str = "kept", by: str = "rejected_by", text_col: str = "text") -> DataFrame:
    """df with `kept` and `by`: of the rules that reject a row, the first in the order of `rules` (looked for in rejected rows alone), else
    null. Rules are expressions of text_col. A rule that is null does not reject.

    Null texts have no words and so fail few_words. Repeated rows have one verdict; long texts are read whole; an empty table stays
    empty. If df has a column called `kept` or `by`, it stays, and the new one has underscores before its name (free_names).
    """
    kept, by, rejected = free_names(df.columns, kept, by, "rejected")
    verdict, name = F.lit(False), F.lit(None).cast("string")
    for r, _, _ in reversed(ordered(df, rules, sample_rows, text_col)):
        verdict = F.when(r.rejects, F.lit(True)).otherwise(verdict)
    for r in reversed(rules):
        name = F.when(r.rejects, F.lit(r.name)).otherwise(name)
    out = df.withColumn(rejected, verdict)
    return out.withColumns({by: F.when(F.col(rejected), name), kept: ~F.col(rejected)}).drop(rejected)


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text, repeated rows included; a null or empty text
    has 0 of each; an empty table stays empty. A column of df with such a name stays, and the new one has underscores before its name."""
    t = F.col(text_col)
    values = {"n_words": word_count(t), "word_chars": word_chars(t), "n_symbols": symbol_count(t), "n_dup_lines": duplicate_lines(t), "n_repeat_words": repeated_words(t)}
    return df.withColumns(dict(zip(free_names(df.columns, *values), values.values())))
