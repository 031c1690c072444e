import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkweave.llm import resampling as rs
from tests.oracle import assert_same


def plain(docs, target, longest=1, buckets=10_000, least=20, per_cent=10):
    """The contract word by word, over lists of (id, text) and texts."""

    def words(t):
        out, now = [], b""
        for c in (t or "").encode():
            c = c + 32 if 65 <= c <= 90 else c
            if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
                now += bytes([c])
            elif now:
                out, now = [*out, now], b""
        return [*out, now] if now else out

    def features(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        if i is None:
            rows.append((i, len(f), weight, None, False))
            continue
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: per_cent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(r[0])) for r in rows), key=repr)


def got(spark, docs, target, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = rs.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), **how)
    return sorted(map(tuple, out.select("id", "n_features", "weight", "score", "rank").collect()), key=repr)


TEXTS = ["one Two three", "", None, "ONE two, déjà vu! 三つ 12_000", "x " * 30, "\x00\x7f ...", "a b c d e f g h i j k l m n o p q r s t u v w"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_same_as_word_by_word(spark, longest):
    docs = [(k, f"{TEXTS[k % 7] or ''} word{k % 5} " * (1 + k % 4)) if k % 9 else (k, TEXTS[k % 7]) for k in range(120)] + [(None, "one two")]
    how = {"longest": longest, "per_cent": 25, "least_words": 6}
    assert got(spark, docs, ["one two three", None, "déjà vu"], **how) == plain(docs, ["one two three", None, "déjà vu"], longest, per_cent=25, least=6)


def test_ring_is_the_checksum_of_each_run():
    words = [b"to", b"be", b"or", b"not"]
    want = [zlib.crc32(b" ".join(words[i : j + 1])) for j in range(4) for i in range(j, max(-1, j - 3), -1)]
    assert list(rs.ring_states(words, 3)) == want
    assert [x.tolist() for x in rs.buckets_of([], 3)] == []


def test_long_text_in_parts(spark, monkeypatch):
    text = b"alpha beta gamma " * 5000
    whole = [x for p in rs.buckets_of(rs.words_in(text), 2) for x in p]
    monkeypatch.setattr(rs, "CHUNK", 997)
    assert [x for p in rs.buckets_of(rs.words_in(text), 2) for x in p] == whole and len(whole) == 29_999


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k, 30, 30, 0, 7 if k % 2 else 5) for k in range(40)] + [(99, 2, 2, 0, 900), (98, 30, 30, 0, None)], "id long, n_words long, n_features long, weight long, score long")
    rank = {r["id"]: r["rank"] for r in rs.ranked(rows, per_cent=60).collect()}
    assert [k for k, _ in sorted(((k, r) for k, r in rank.items() if r), key=lambda x: x[1])] == [*range(1, 40, 2), 0, 2, 4, 6]
    assert rank[99] is None and rank[98] is None


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(spark, [], ["x"]) == [] and rs.resampled(empty, empty.select("text")).count() == 0
    assert got(spark, [(1, "a b")], []) == plain([(1, "a b")], [])
    docs = [(k, "some words " * 12) for k in range(20)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("rank"), F.lit("x").alias("row"), F.lit(2).alias("score"))
    kept = rs.drawn_documents(df, empty.select("text"), per_cent=20)
    assert kept.columns == df.columns and kept.count() == 8 and kept.select("doc_id").distinct().count() == 4


def test_whole_tables(spark, sf):
    assert assert_same(rs.op11_crc_ring(spark, sf), sf, rs.SQL) == 200
