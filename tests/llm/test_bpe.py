"""Encoding by distinct words and decoding by pieces, against the library."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import bpe
from storyloom.llm.common import table
from storyloom.llm.tokens import vocabulary_path

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (4, "two"), (None, "no id"), (None, None), (5, "It's 'S we'll 22 333x can't'"),
    (6, "a<|endoftext|>B <|startoftext|><|endoftext|>"), (7, "\x1c a \x1f b \x00c"), (8, "ΑΣ Σ é é ﬁ İ"), (9, "'<|ENDOFTEXT|> <|EndOfText|> ’<|STARTOFTEXT|>"),
    (10, "x" * 300_000), (11, "a~b ~ ~~  c\x85d"), (12, "word " * 100_000), (13, "日本語 の 文 \U0001f600\U0001f600"), (-3, "minus"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(bpe.VOCABULARY))


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


def test_equals_the_library(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("word", "block", "ids", "k", "places", "n_tokens")))
    for parts in (1, 5):
        found = bpe.decode(bpe.encode(docs.repartition(parts, "doc_id"))).collect()
        assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in found), key=repr) == expected(library, ODD)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    assert [r["n_tokens"] for r in bpe.encode(docs.filter("doc_id = 1")).collect()] == [0]


def test_words_of_all_blocks(spark, library):
    words = [(block, k, w) for block in range(3) for k, w in enumerate(["b", "a", "<|endoftext|>", "abcdefghij", f"own{block}"])]
    found = bpe.with_ids(spark.createDataFrame(words, bpe.WORDS).repartition(4)).collect()
    assert sorted((r["block"], r["k"], tuple(np.frombuffer(r["data"], "<u4").tolist())) for r in found) == [(b, k, tuple(library.encode(w, add_special_tokens=False).ids)) for b, k, w in words]


def test_ids_without_a_piece(spark, library):
    ids = [320, 60_000, 49407, 4_000_000_000]
    rows = spark.createDataFrame([(1, 4, bytearray(np.array(ids, "<u4").tobytes())), (2, 0, None)], bpe.ENCODED)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows).collect()} == {1: library.decode([320, 49407], skip_special_tokens=False), 2: ""}


def test_places_round_trip():
    for places in ([], [0], [5, 70_000, 2**32 - 1, 0]):
        assert bpe.unpacked(bpe.packed(np.array(places, np.int64)), len(places)).tolist() == places


def test_query_equals_the_library(spark, library):
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, n, ids, text in expected(library, docs):
        assert found[doc_id] == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
