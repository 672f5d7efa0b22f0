"""Pieces encoded by the tokenizer's model alone, and texts looked up by words, against the library on whole texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tideglass.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode(self, text, **options):
        self.seen.append(text)
        return self.tokenizer.encode(text, **options)


def encoder(keep: int) -> tokens.PieceEncoder:
    with open(PATH, encoding="utf-8") as f:
        return tokens.PieceEncoder(f.read(), tokens.as_bytes, b"".join, keep)


def test_whole_pieces_go_to_the_model():
    e = encoder(100)
    e.tokenizer = Counted(e.tokenizer)
    text = "Unheardly wörter und ñandúes,\nZeilen unddann ʯende."
    assert e(text) == tokens.as_bytes(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert sorted(e.tokenizer.seen) == ["\n", ",", "."]


def test_odd_texts_equal_the_library():
    e, library, rnd = encoder(300), Tokenizer.from_file(PATH), random.Random(6)
    parts = [*"abzAZéßøʯĳªµ×÷'.,!?-<|>019½²語я", "\n", "\n", " ", " ", "  ", "\t", "\x1c", "\x85", "\xa0", " ", "　", "Ω", "'s", "'ll", " the", " can't", "<|", " abc<|", "<|endoftext|>", " <|endoftext|> ", "word "]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert e(text) == tokens.as_bytes(library.encode(text, add_special_tokens=False).ids), text
