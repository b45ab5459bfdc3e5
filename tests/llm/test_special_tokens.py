"""Ids of texts that hold the tokenizer's special tokens, against the tokenizer itself."""

import random

import pyarrow as pa

from tickloom.llm import packing
from tickloom.llm.queries import tokenizer_path

PARTS = [
    "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|endof text|>", "foo", "Bar.", "a,", ",", ".", " ", "  ", "\n", "\t", " ", " ",
    "é", "é", "ΑΣ", "İ", "ß", "'s", "'LL", "12", "x1.", "<|", "|>", "日本語", "​", "𝔘", "\x00", "\x1c", "﻿",
]


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_special_tokens():
    rng = random.Random(4)
    texts = ["foo <|endoftext|> bar", "foo<|endoftext|>bar", "<|startoftext|>", "<|EndOfText|>x <|endoftext|>", "<|endoftext|>. a.", ""]
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(1, 14))) for _ in range(400)]
    ids, bounds = packing.encoder(tokenizer_path()).column(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain(text), text
