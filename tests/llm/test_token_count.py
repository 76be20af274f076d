import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from media_analytics.llm import token_count as tc

from .fixtures import documents, empty_documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t'strevlmd   a1Z!?.é中 　́​\U0001f600ñ½"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tc.TokenCounter(PATH)


def test_random_texts(library, counter):
    rng = random.Random(1)
    cases = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    cases += ["", "<|endoftext|>", " <|endoftext|>  x<|endoftext|>", "a" * 3000, " " * 900, "-" * 500 + "x",
              "'" * 9 + "s", "I'll we've they're 'tis 'LL", "\r\n\r\n  x", "\x1c\x85y"]
    assert counter.counts([c.encode() for c in cases]) == library(cases)


def test_every_code_point_has_the_librarys_class(library, counter):
    points = [f"a{c}1{c}!{c} {c}b" for c in map(chr, range(0, 0x11000, 3)) if not 0xD800 <= ord(c) < 0xE000]
    assert counter.counts([p.encode() for p in points]) == library(points)


def test_windows_of_one_very_long_text(library, counter, monkeypatch):
    monkeypatch.setattr(tc, "WINDOW", 300)
    cases = ["word  and \n\n more's " * 300, "a" * 2000 + " b" * 500, " " * 1000]
    assert counter.counts([c.encode() for c in cases]) == library(cases)


def test_chunks_equal_one_run():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 5000):
        classes = rng.integers(0, 11, n).astype(np.uint8)
        state, want = tc.START, []
        for c in classes:
            state, out = tc._step(state, int(c))
            want.append(out)
        assert tc.split_outputs(classes).tolist() == want


def test_bounded_tables_give_the_same_counts(library, counter, monkeypatch):
    monkeypatch.setattr(tc, "MAX_WORDS", 3)
    monkeypatch.setattr(tc, "MAX_STATES", 5)
    cases = ["the quick brown fox jumps over the lazy dog and runs away"]
    assert counter.counts([cases[0].encode()] * 2) == library(cases * 2)


def test_dirty_documents(spark, library):
    df = documents(spark)
    rows = texts(df)
    n = library([t or "" for _, t in rows])
    want = sorted(((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n)), key=str)
    assert sorted(map(tuple, tc.count_tokens(df, PATH).collect()), key=str) == want
    assert tc.count_tokens(empty_documents(spark), PATH).count() == 0
