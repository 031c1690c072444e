import zlib
from itertools import product

import numpy as np

from inkweave.llm import quality_crf as q


def test_marginals_against_all_labellings():
    r = np.random.default_rng(1)
    count = np.array([3, 1, 6, 2])
    bad, turns = r.normal(size=12), r.normal(size=(2, 2))
    p, expected = q.Chains(count).marginals(bad, turns)
    want, at, pairs = [], 0, np.zeros((2, 2))
    for n in count:
        e, z, on = bad[at : at + n], 0.0, np.zeros(n)
        own = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(turns[a, b] for a, b in zip(y, y[1:])))  # noqa: B905
            z, on = z + w, on + w * np.array(y)
            for a, b in zip(y, y[1:]):  # noqa: B905
                own[a, b] += w
        want += list(on / z)
        pairs += own / z
        at += n
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_features_by_hand():
    bins, size, count = q.line_features(["a b\n\nA B! B!|".encode(), b"", "é".encode()])
    assert count.tolist() == [3, 1, 1] and size.tolist() == [3, 0, 8, 0, 2]
    assert bins.shape == (5, q.KINDS) and bins.max() < q.BINS - 1
    values = [2, 0, 3, 0, 1]
    assert bins[:, 1].tolist() == [int(np.searchsorted(q.EDGES[1], v, side="right")) for v in values]
    assert (q.places(bins, count)[0] // q.BINS).tolist() == list(range(3 * q.KINDS))
    assert (q.places(bins, count)[3, q.KINDS :] % q.BINS == q.BINS - 1).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in q.op6_quality_crf(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    own = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert len(own) > 50 and np.mean([a == b for a, b in own]) >= 0.95
    assert np.mean([b for a, b in own if a == 1]) >= 0.97


def test_nulls_ties_and_empty_tables(spark):
    good, junk = "Some fine words, in a line.\nAnd then another one follows it.", "x | y | z\nx | y | z\n### $$$"
    rows = [(i, good if i % 2 else junk) for i in range(60)] + [(None, good), (61, None), (62, ""), (62, ""), (63, "w " * 60_000), (64, "\n" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score", "3 as label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    field = q.fit(docs, labels)
    got = q.quality_scores(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.3) == bool(r["id"] % 2) for r in got if r["id"] is not None and r["id"] < 60)
    assert len({r["score"] for r in got if r["id"] == 62}) == 1
    assert q.quality_scores(docs.limit(0), field).count() == 0
    none = q.fit(docs, labels.limit(0))
    assert {r["score"] for r in q.quality_scores(docs, none).collect()} == {0.5}


def test_lines_of_the_sample_are_bounded(spark):
    rows = [{"id": k, "label": k % 2, "lines": n, "h": h} for k, n, h in [(1, 5, 9), (2, 50, 1), (3, 6, 2), (4, 60, 3), (5, 1, 4), (6, 40, 5), (7, 3, 6)]]
    assert q.fitting(rows, 10) == [(3, 1), (5, 1), (7, 1)] and q.fitting(rows, 100) == [(2, 0), (3, 1), (5, 1), (6, 0), (7, 1), (1, 1)]
    docs = spark.createDataFrame([(i, f"Some fine words {i}.") for i in range(40)] + [(99, "\n" * (q.LINES + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 99]], "doc_id long, quality int")
    without = q.fit(docs.where("doc_id < 99"), labels.where("doc_id < 99"))
    assert (q.fit(docs, labels).weights == without.weights).all()
