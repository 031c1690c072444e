import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import bpe


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRUE = _tiktoken()
OWN = bpe.codec(P.path(bpe.VOCABULARY), P.PATTERN)


def same(text):
    ids = np.frombuffer(OWN.encoded(text), "<u4").tolist()
    assert ids == TRUE.encode_ordinary(text), text[:200]
    assert OWN.decoded(ids) == text.encode()


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", "ß", "ñ", "你", "😀", "12", "٣", "...", "!", "\x1c", "\x85", "\xa0", "᠎", "​", " ", "　", "﻿", "x" * 40, " of", "é", "²", "Ⅷ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join))
def test_small_leaves_agree(text):
    old = bpe.TEXT_LEAF, bpe.MATCH_LEAF
    bpe.TEXT_LEAF, bpe.MATCH_LEAF = 5, 4
    try:
        same(text)
    finally:
        bpe.TEXT_LEAF, bpe.MATCH_LEAF = old


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, " " * 20_000, "ab" * 9_000, "=-" * 5_000, "x " * 9_000, "\n" * 9_000 + "z", "é" * 5_000, "thequickbrownfox" * 900])
def test_long_runs(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=2, max_size=400), st.integers(2, 9))
def test_matches_of_any_bytes(raw, leaf):
    letters = bytes(97 + c % 26 for c in raw)
    old, bpe.MATCH_LEAF = bpe.MATCH_LEAF, leaf
    try:
        assert OWN.match_code(letters) == TRUE.encode_ordinary(letters.decode())
        assert OWN.merged_by_heap(letters) == OWN.merged(letters)
    finally:
        bpe.MATCH_LEAF = old


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 50_255), st.integers(0, 50_255))
def test_pairs_keep_apart(a, b):
    assert OWN.keep_apart(a, b) == (OWN.merged(OWN.bytes_of[a] + OWN.bytes_of[b]) == [a, b])


def test_pairs_of_like_letters_keep_apart():
    tokens = [t for t, x in enumerate(OWN.bytes_of) if set(x) <= set(b"aeinrst-= ")]
    for a in tokens[::3]:
        for b in tokens[::7]:
            assert OWN.keep_apart(a, b) == (OWN.merged(OWN.bytes_of[a] + OWN.bytes_of[b]) == [a, b])


def test_query_rows(spark):
    rows = [(1, "To be, or\n\nnot  to be"), (2, None), (2, None), (None, ""), (3, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids")
    got = bpe.decode_ids(bpe.encode_texts(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {i: t or "" for i, t in rows}[r["id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == TRUE.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode_texts(df.limit(0)).count() == 0
    lists = {r["id"]: r for r in bpe.token_lists(df).collect()}
    assert lists[1]["ids"] == TRUE.encode_ordinary(rows[0][1]) and lists[2]["n_tokens"] == 0


def test_documents(spark, sf):
    got = {r["doc_id"]: r for r in bpe.op8_bpe_monoid(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = TRUE.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
