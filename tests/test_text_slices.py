import numpy as np
import pyarrow as pa
import pytest

from inkweave.operators import search as se
from inkweave.operators import vectors as ve


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(1000)]})
    got = list(se.in_slices(iter([batch, batch]), 300))
    assert [b.num_rows for b in got] == [300, 300, 300, 100] * 2
    assert [t for b in got for t in b.column("text").to_pylist()] == [str(i) for i in range(1000)] * 2


@pytest.mark.parametrize("block", [4096, 2])
def test_vectors_are_compared_where_they_are_made(spark, monkeypatch, block):
    monkeypatch.setattr(ve, "QUERY_BLOCK", block)
    words = "red green blue old new tin oak".split()
    texts = [(i, " ".join(words[j % 7] for j in range(i, i + 1 + i % 4)) if i % 9 else None) for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words[:5])], "q long, text string")
    got = {(r.q, r["rank"]): (r.id, round(r.score, 6)) for r in ve.nearest_texts(rows, asked, "id", "q", 4).collect()}
    for q, w in enumerate(words[:5]):
        score = {i: round(float(np.dot(ve.hashed_embedding(w), ve.hashed_embedding(t))), 6) for i, t in texts}
        best = sorted(((-s, i) for i, s in score.items() if s > 0))[:4]
        assert [got.get((q, k + 1)) for k in range(len(best))] == [(i, -s) for s, i in best]
    if block == 4096:  # texts go to one pass of Python, no vectors between
        plan = ve.nearest_texts(rows, asked, "id", "q", 4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("InArrow") == 1 and "InPandas" not in plan
