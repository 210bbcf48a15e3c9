"""Encoding by remembered pieces against the library, and what is remembered."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from causalnet.llm import tokens

PARTS = ["foo", "\u00c9t\u00e9", "it's", "x", "5", "a1", "!", ",", ".", "...", ",!", " ", "\n", "'", "\u00df", "\u65e5", "-", "\u00b5", "?", "  ", "\t", "$"]
MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext", "<|", "|>", "endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    r = random.Random(1)
    enc, fresh = tokens.Encoder(public_tokenizers.path(name), remembered=50), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 14)))
        assert enc.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text


def test_a_word_is_learned_once_whatever_mark_follows():
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.encode("so lonterat, lonterat. lonterat! lonterat; lonterat? lonterat")
    assert sorted(enc.seen) == sorted(["so", " lonterat", ",", ".", "!", ";", "?"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_library(name):
    r = random.Random(2)
    enc, fresh = tokens.Encoder(public_tokenizers.path(name), remembered=50), Tokenizer.from_file(public_tokenizers.path(name))
    for text in ["hello <|endoftext|> world<|endoftext|>x", "<|startoftext|>a photo<|endoftext|>", "<|ENDOFTEXT|> b"]:
        assert enc.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    assert fresh.encode("<|endoftext|>", add_special_tokens=False).ids == [fresh.token_to_id("<|endoftext|>")]
    for _ in range(2000):
        text = "".join(r.choice(PARTS + MARKS) for _ in range(r.randint(1, 14)))
        assert enc.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
