"""Token counts and ids with the tokenizers library, in Arrow functions.

Texts are cut at safe boundaries: before a white-space character that follows a character which is not white space, and before ASCII
punctuation that follows a Latin letter. A byte-level BPE pre-tokenizer ends a token there in any case, so the pieces' ids, joined, are
the text's. Pieces repeat, so each Python worker keeps the ids (or their number) of the pieces that it has seen, up to a fixed number.
Counts are taken for batches of about equal bytes: what a batch has that is not known is gathered and encoded by the library in groups of
about equal bytes, of which only lengths are read. A tokenizer for which the boundaries are not known to be safe encodes whole texts.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import trimmed

#: Text bytes of a batch (Arrow batches are cut again to that), and words and pieces that a worker keeps of at most KEEP_CHARS characters.
BATCH_BYTES, KEEP, KEEP_CHARS = 4 << 20, 350_000, 48
#: Bytes of the pieces that are encoded by one call.
GROUP_BYTES = 1 << 13
#: Latin letters, and what may follow them where a piece ends. Letters' tokens end before ASCII punctuation too.
LETTER, END = "A-Za-zÀ-ÖØ-öø-ʯ", r"\s!-/:-@\[-`{-~"
PIECE = re.compile(rf"\s*+[^\s{LETTER}]*+[{LETTER}]++(?![^{END}])|\s*+[^\s{LETTER}]++(?!\S)|\s*\S+|\s+")
#: A piece that the byte-level pattern leaves whole: the model alone then gives its ids.
WHOLE = re.compile(rf" ?[{LETTER}]+")
#: A word (what stands between spaces, a line end before it) of one such piece and ASCII punctuation that begins no special token.
PLAIN = re.compile(rf"(\n?)([{LETTER}]+)([!-/:-@\[-`{{}}~]*)")
#: Characters that Python takes for white space and others may not, or that are white space outside ASCII, and what may begin a special
#: token: there, cut only before ASCII white space.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")


def _byte_level() -> str:
    """For each byte the character that stands for it in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


BYTE_LEVEL = _byte_level()


def pieces(text: str) -> list[str]:
    return PIECE.findall(text) if ODD.search(text) is None else SAFE.split(text)


def safe_boundaries(spec: str) -> bool:
    """Whether the tokenizer (its JSON) is one whose tokens end where pieces do: byte-level BPE behind its own pattern, which neither
    normalizes nor drops anything and whose added tokens all begin with `<|`."""
    d = json.loads(spec)
    cut, model = d.get("pre_tokenizer") or {}, d.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(plain and model.get("type") == "BPE" and not model.get("dropout") and not d.get("normalizer") and not d.get("truncation") and not d.get("padding") and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in d.get("added_tokens") or []))


def _even(word: str) -> bool:
    """Whether the word, as split at single spaces (a line end stays before its word), has no white space but that line end."""
    edge = word[1:2] if word[:1] == "\n" else word[:1]
    return bool(edge) and not edge.isspace() and not word[-1].isspace()


def _after_space(word: str) -> list[str]:
    return PIECE.findall(word if word[0] == "\n" else " " + word)


class _Uneven(Exception):
    """White space that is not one space between two words, or what ODD finds."""


class _Memo(dict):
    """What learn(key) gave, for the first `keep` short keys."""

    def __init__(self, learn: Callable, keep: int):
        self.learn, self.keep = learn, keep

    def __missing__(self, key: str):
        value = self.learn(key)
        if len(self) < self.keep and len(key) <= KEEP_CHARS:
            self[key] = value
        return value


class PieceEncoder:
    """join([value(ids of a piece), ...]) of texts; values can be added.

    The first keys that a worker meets stay with it, so the frequent ones do. In a text whose words are parted by single spaces or line ends,
    words are looked up first (all but the text's first with what stands before them); what is not known is cut into pieces, and
    pieces that are not known are encoded: by the tokenizer's model where its pattern would leave them whole, else by the tokenizer.
    """

    def __init__(self, spec: str, value: Callable, join: Callable, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer, self.value, self.join = Tokenizer.from_str(spec), value, join
        self.safe, self.model = safe_boundaries(spec), self.tokenizer.model
        self.pieces, self.words = _Memo(self._encode, keep), _Memo(self._word, keep)

    def _whole(self, piece: str):
        """Of a piece that is one token of the tokenizer's pattern."""
        if piece.isascii():
            shown = BYTE_LEVEL[32] + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(BYTE_LEVEL)
        value = self.value([t.id for t in self.model.tokenize(shown)])
        if len(self.pieces) < self.pieces.keep and len(piece) <= KEEP_CHARS:
            self.pieces[piece] = value
        return value

    def _encode(self, piece: str):
        if self.safe and WHOLE.fullmatch(piece):
            return self._whole(piece)
        return self.value(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _word(self, word: str):
        if plain := PLAIN.fullmatch(word):
            line, letters, marks = plain.groups()
            piece = letters if line else " " + letters
            value = self.pieces.get(piece)
            if value is None:
                value = self._whole(piece)
            if line:
                value = self.pieces["\n"] + value
            return value + self.pieces[marks] if marks else value
        if not _even(word) or ODD.search(word):
            raise _Uneven
        return self.join(map(self.pieces.__getitem__, _after_space(word)))

    def __call__(self, text: str):
        if not self.safe:
            return self._encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if first and not first[-1].isspace() and ODD.search(first) is None:
            try:
                words = list(map(self.words.__getitem__, rest))
                return self.join([*map(self.pieces.__getitem__, PIECE.findall(first)), *words])
            except _Uneven:
                pass
        return self.join(map(self.pieces.__getitem__, pieces(text)))


_encoders: dict = {}


def encoder(key: str, spec: str, value: Callable, join: Callable) -> PieceEncoder:
    """The worker's encoder, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (key, value) not in _encoders:
        _encoders[key, value] = PieceEncoder(spec, value, join)
    return _encoders[key, value]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class BatchCounter:
    """Token counts of batches of texts. Words and pieces that a worker met first stay known, `keep` of each; what else a batch has is known
    until its end."""

    def __init__(self, spec: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.safe = Tokenizer.from_str(spec), keep, safe_boundaries(spec)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _split(self, text: str) -> tuple[list[str], list[str], set[str]]:
        """(pieces, words that follow a space or begin a line, those of them that are not known) of the text."""
        if not self.safe:
            return [text], [], set()
        if ODD.search(text) is None:
            first, *words = text.replace("\n", " \n").split(" ")
            if first and not first[-1].isspace():
                new = set(words).difference(self.words)
                if all(map(_even, new)):
                    return PIECE.findall(first), words, new
        return pieces(text), [], set()

    def _encoded(self, new: list[str]) -> dict[str, int]:
        """Lengths of pieces by the library, in calls of about GROUP_BYTES bytes."""
        out: dict[str, int] = {}
        sizes = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in new])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:]):
            out.update(zip(new[a:b], map(len, self.tokenizer.encode_batch_fast(new[a:b], add_special_tokens=False))))
        return out

    def _learn(self, known: dict[str, int], new: dict[str, int]) -> list[str]:
        """Adds new to known; what is to be forgotten after the batch."""
        room = self.keep - len(known)
        known.update(new)
        short = [k for k in new if len(k) <= KEEP_CHARS]
        return [k for k in new if len(k) > KEEP_CHARS] + short[max(0, room) :]

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [self._split(t) for t in texts]
        words = {w: _after_space(w) for w in set().union(*(new for _, _, new in parts))}
        needed = set(itertools.chain(*(ps for ps, _, _ in parts), *words.values())).difference(self.pieces)
        forget = self._learn(self.pieces, self._encoded(list(needed)))
        of_piece = self.pieces.__getitem__
        later = self._learn(self.words, {w: sum(map(of_piece, ps)) for w, ps in words.items()})
        of_word = self.words.__getitem__
        out = [sum(map(of_piece, ps)) + sum(map(of_word, ws)) for ps, ws, _ in parts]
        for k in forget:
            del self.pieces[k]
        for k in later:
            del self.words[k]
        return out


def batch_counter(key: str, spec: str) -> BatchCounter:
    """The worker's counter, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (key, BatchCounter) not in _encoders:
        _encoders[key, BatchCounter] = BatchCounter(spec)
    return _encoders[key, BatchCounter]


def bytes_encoder(key: str, spec: str) -> PieceEncoder:
    return encoder(key, spec, as_bytes, b"".join)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts sum to about `most` bytes; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each input row.

    A null text counts as empty: 0 bytes, 0 tokens. Nothing is truncated. Ids may be null or repeat; other columns are ignored; an empty
    table gives no rows. The tokenizer's file goes to the workers as a broadcast (a few MB, whatever the input).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        count = batch_counter(tokenizer_path, spec.value)
        for batch in by_bytes(batches, "text"):
            n = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.cast(pc.binary_length(batch.column("text")), pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
