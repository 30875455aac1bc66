from __future__ import annotations

import os
import random

import pytest

from skylode.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world, hello  world!", "<|endoftext|> is text", "naïve café – “x”", "雪に覆われ、深さは", "Лиса каждый вечер",
    "🚀🛰️👩‍🚀", "a" * 5000, "ab" * 3000 + " end", "1234567890" * 50, "it's they'll I'd", "\u0000﻿​", "x" * 100_000,
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("lexicon", [0, 5, 50_000])
def test_ids_equal_the_public_library(spark, reference, lexicon):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "null key", 0), (3, "repeated key", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"])) for r in tokens.encode(df, "doc_id", "text", PATH, lexicon).collect())
    want = sorted((k if k is not None else -1, reference.encode_ordinary(t) if t else []) for k, t, _ in rows)
    assert got == want


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_merge_equals_the_public_library(reference):
    rng, ranks = random.Random(0), tokens.read_ranks(PATH)
    for _ in range(300):
        word = "".join(rng.choice("abcdeéß雪й🚀 ") for _ in range(rng.randrange(1, 40)))
        for piece in tokens._cut(word):
            assert tokens.merge(piece.encode(), ranks) == reference.encode_ordinary(piece) or piece.isspace()


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "ing", "ings"]) for _ in range(3000)})
    rng.shuffle(words)
    ids = [[rng.randrange(100) for _ in range(rng.randrange(1, 4))] for _ in words]
    path = tmp_path / "lexicon"
    path.write_bytes(tokens.compile_lexicon([w.encode() for w in words], ids))
    lexicon = tokens.Lexicon(str(path))
    number = lexicon.find([w.encode() for w in words])
    assert [list(lexicon.ids[lexicon.offsets[n] : lexicon.offsets[n + 1]]) for n in number] == ids
    others = [w + "z" for w in words] + ["", "abcabcabcabcabcabc", "é"]
    known = set(words)
    assert all((n >= 0) == (w in known) for n, w in zip(lexicon.find([w.encode() for w in others]), others, strict=True))
    suffixes = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(lexicon.finals) == len(suffixes)
