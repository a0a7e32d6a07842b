"""Ids by units against the library on whole texts, and the fall-back for other tokenizer files."""

import itertools
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from slipwright.llm import token_store

BPE = public_tokenizers.path("byte_bpe_50k.json")


def same(encoder, tokenizer, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
    parts = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert parts == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_equal_whole_texts():
    rng = random.Random(7)
    parts = ["the", "Haus", "größer", "été", "слово", "漢字", "かな", "한글", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\u0085", "'s", "'ll", "it's", ".", ",", "...", "!?", "<|endoftext|>", "<|", "12", "3.5", "²", "🙂", "́", "\x00", "ª", "ǅ", "-", "(", "a" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(5_000)] + [""]
    for keep in (600_000, 40):  # with and without much memory
        encoder = token_store.UnitEncoder(BPE, keep)
        assert encoder.in_units
        for k in range(0, len(texts), 5000):
            same(encoder, Tokenizer.from_file(BPE), texts[k : k + 5000])


def test_lines_are_cut_at_their_breaks():
    rng = random.Random(11)
    parts = ["the", "größer", "слово", "漢字", "'s", "it's", ".", "...", "<|endoftext|>", "12", "\x1c", "\u0085", "\t", "\x00", "-"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\n", "\n\n", "\r\n", ""]) for _ in range(rng.randint(0, 20))) for _ in range(10_000)]
    texts += [rng.choice(["", "\n"]) + rng.choice([" ", "\n"]).join(rng.choice(parts[:10]) for _ in range(rng.randint(0, 20))) + rng.choice(["", "\n"]) for _ in range(10_000)]
    texts += ["\n", "\n\n", "\na", "a\n", "a\n\n", "\n\na", "a\n\n\nb", "a \nb", "a\n b"]
    encoder = token_store.UnitEncoder(BPE)
    same(encoder, Tokenizer.from_file(BPE), texts)
    same(encoder, Tokenizer.from_file(BPE), ["\n"])
    encoder.line_break = -1  # where a break is no token of its own, none is cut
    same(encoder, Tokenizer.from_file(BPE), texts)


def test_words_round_a_line_break_are_met_apart():
    encoder = token_store.UnitEncoder(BPE)
    words = ["".join(x) for x in itertools.product("abcd", "eiou", "rstn")]
    same(encoder, Tokenizer.from_file(BPE), [f"so {a}.\n{b} it" for a in words for b in words])
    assert len(encoder.known) < 4 * len(words)  # not one for each pair of words


def test_other_files_get_whole_texts(tmp_path):
    layout = json.load(open(BPE, encoding="utf-8"))
    assert token_store.cuts_at_spaces(layout)
    layout["pre_tokenizer"] = {"type": "Whitespace"}
    path = str(tmp_path / "other.json")
    json.dump(layout, open(path, "w", encoding="utf-8"))
    encoder = token_store.UnitEncoder(path)
    assert not encoder.in_units
    same(encoder, Tokenizer.from_file(path), ["a b\nc", "", "the end. <|endoftext|> it's"])
    for name, value in (("normalizer", {"type": "Lowercase"}), ("added_tokens", [{"content": "word!"}])):
        assert not token_store.cuts_at_spaces(json.load(open(BPE, encoding="utf-8")) | {name: value})
