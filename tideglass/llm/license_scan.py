"""Fuzzy search for short license notices.

Texts and notices are brought to one form: A-Z lower-cased, words joined by single spaces. A notice that may have k edits is split into
k + 1 seeds; whatever edits there are, one seed stands unchanged (pigeonhole). An Aho-Corasick automaton finds all seeds of all notices in one
pass; around each, the regex library looks for the notice with at most k insertions, deletions and substitutions. Exact
places of a notice are among these, with no edit. Words that name the license (`mit`, a version's number, `lesser`) must stand as they
are: edits fall on the others.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import TO_LOWER, trimmed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The base notices and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further notices.
NOTICES = (
    *BASE,
    ("permission is hereby granted free of charge to any person", "mit"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("eclipse public license", "epl"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
)

#: Words that tell a license from others.
NAMING = frozenset("mit apache mozilla eclipse lesser affero noncommercial sharealike 0 2 3 4".split())


def edits(notice: str) -> int:
    """One edit for every ten characters, three at most; a notice under twelve characters must be exact."""
    return 0 if len(notice) < 12 else min(3, len(notice) // 10)


def parts(notice: str) -> list[tuple[str, bool]]:
    """The notice as runs of words that name the license (True) and of others (False)."""
    return [(" ".join(words), names) for names, words in itertools.groupby(notice.split(" "), NAMING.__contains__)]


def fuzzy(notice: str, k: int) -> regex.Pattern:
    """The notice between spaces, with at most k edits in each run of words that name nothing."""
    each = (regex.escape(words, special_only=True) if names else rf"(?:{regex.escape(words, special_only=True)}){{e<={k}}}" for words, names in parts(notice))
    return regex.compile(f"(?e) {' '.join(each)} ")


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length that make up the notice, with their offsets."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


@dataclass(frozen=True)
class Span:
    """Words first..last (from 0) of the text are the notice with this label, up to `edits` edits."""

    first: int
    last: int
    start: int
    end: int
    notice: int
    label: str
    edits: int


class Scanner:
    def __init__(self, notices=NOTICES):
        self.notices, self.patterns, at = notices, [], {}
        for n, (phrase, _) in enumerate(notices):
            k = edits(phrase)
            self.patterns.append((phrase, k, fuzzy(phrase, k) if k else None))
            for offset, piece in seeds(phrase, k):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def __call__(self, words: list[str]) -> list[Span]:
        """All exact places of the notices and, between those of a notice, its inexact ones from left to right, in the order of
        their starts. Time grows in proportion to the text."""
        text = f" {' '.join(words)} "
        spaces = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))  # spaces[i] stands before word i
        ranges: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for n, offset in uses:
                phrase, k, _ = self.patterns[n]
                start = end - length + 1 - offset
                a, b = max(0, start - k - 1), min(len(text), start + len(phrase) + k + 1)
                own = ranges.setdefault(n, [])
                if own and a <= own[-1][1]:  # seeds of a notice come in the order of their ends: ranges may reach back
                    own[-1] = [min(a, own[-1][0]), max(own[-1][1], b)]
                else:
                    own.append([a, b])
        found: list[Span] = []

        def add(n: int, s: int, t: int, e: int) -> None:
            first = bisect_left(spaces, s) - 1
            found.append(Span(first, bisect_left(spaces, t) - 1, s - 1, t - 1, n, self.notices[n][1], e))

        for n, own in ranges.items():
            phrase, k, pattern = self.patterns[n]
            exact, at = f" {phrase} ", -1
            for a, b in own:
                a = max(a, at)
                free, s = a, text.find(exact, a, b)
                while s >= 0 or pattern:
                    while pattern and (m := pattern.search(text, free, b if s < 0 else s + 1)):
                        if sum(m.fuzzy_counts) > k:  # each run of words keeps to k, all together do not
                            free = m.start() + 1
                            continue
                        add(n, m.start() + 1, m.end() - 1, sum(m.fuzzy_counts))
                        free = m.end() - 1
                    if s < 0:
                        break
                    add(n, s + 1, s + 1 + len(phrase), 0)
                    free, s = s + len(phrase) + 1, text.find(exact, s + 1, b)
                at = max(at, free)
        # Where notices overlap, as versions of one license do, an inexact one gives way to those with fewer edits.
        kept: list[Span] = []
        taken = bytearray(len(text))
        for x in sorted(set(found), key=lambda x: (x.edits, x.start, x.end, x.notice)):
            if not x.edits or taken.find(1, x.start, x.end) < 0:
                kept.append(x)
                taken[x.start : x.end] = b"\1" * (x.end - x.start)
        return sorted(kept, key=lambda x: (x.start, x.end, x.notice))


@lru_cache(maxsize=8)
def scanner(notices=NOTICES) -> Scanner:
    return Scanner(notices)


def scan(text: str | None, notices=NOTICES) -> tuple[list[str], list[Span]]:
    """(the text's words, the spans found in them)."""
    words = WORD.findall((text or "").translate(TO_LOWER))
    return words, scanner(notices)(words)


SPANS = "array<struct<label:string,notice:string,first_word:long,last_word:long,edits:int>>"


def license_spans(df: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_words and spans (SPANS) for every row; a null or empty text has no words and no spans; long texts are read whole, in
    time that grows in proportion. Of overlapping notices with equally many edits the first, then the shorter, then the first of `notices`
    counts; exact ones all do. Rows are only mapped, so repeated rows stay; ids may be null or repeat; other columns are ignored; an empty
    table gives no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans = [], []
            for t in batch.column("text"):
                words, found = scan(t.as_py(), notices)
                n.append(len(words))
                spans.append([{"label": s.label, "notice": notices[s.notice][0], "first_word": s.first, "last_word": s.last, "edits": s.edits} for s in found])
            kinds = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, kinds)], ["id", "n_words", "spans"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, n_words long, spans {SPANS}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, base=BASE) -> DataFrame:
    """license_spans' rows with n_base (exact places of base notices), first_word and last_word (their smallest and largest starts),
    base_labels, labels (all; both distinct, sorted, comma-joined) and score (1 for an exact notice, less by edits; else 0)."""
    phrases = F.array(*(F.lit(p) for p, _ in base))
    exact = F.filter("spans", lambda s: (s["edits"] == 0) & F.array_contains(phrases, s["notice"]))
    starts = F.transform(exact, lambda s: s["first_word"])
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))))
    scores = F.transform("spans", lambda s: F.lit(1.0) - s["edits"] * 10.0 / F.length(s["notice"]))
    return found.withColumns({"n_base": F.size(exact).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts), "base_labels": labels(exact), "labels": labels(F.col("spans")), "score": F.coalesce(F.greatest(F.lit(0.0), F.array_max(scores)), F.lit(0.0))})
