import base64
import random

import pytest

from weftgraph.llm import bpe, tokens

TEXTS = ["", " ", "Hello world", "  two  spaces\n\n\tand tabs ", "naïve café-style rôle", "don't we'll I'M", "数据处理 и тесты", "a" * 3000, " ​﻿|| true", "<|endoftext|>", "1234567 89", "x\u001f\x0b\x00y", "\U0001f600" * 40]


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.read_vocabulary())


def slow(piece, ranks):
    """Brute force: merge the lowest-ranked, leftmost pair again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_piece_against_brute_force(ranks):
    rng = random.Random(5)
    for _ in range(400):
        piece = bytes(rng.choice(b"aabcdeth \xc3\xa9rings") for _ in range(rng.randint(0, 40)))
        assert bpe.encode_piece(piece, ranks) == slow(piece, ranks)


def test_against_public_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks)
    back = {v: k for k, v in ranks.items()}
    for text in TEXTS:
        ids = bpe.array("i")
        encoder.extend(text, ids)
        assert list(ids) == known.encode_ordinary(text)
        assert b"".join(back[i] for i in ids).decode() == text


def test_corpus_dirty_rows(spark, ranks):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, None), (None, "no key", "x"), (2, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = tokens.encode_corpus(df).collect()
    assert len(out) == len(rows)
    assert [r.ids for r in out if r.doc_id == 100] == [[]]
    assert [r.ids for r in out if r.doc_id == 0] == [[]]
    assert len([r for r in out if r.doc_id == 2]) == 2
    counts = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(df).collect()}
    assert counts == {(r.doc_id, len(r.ids)) for r in out}


def test_corpus_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode_corpus(df).collect() == []
