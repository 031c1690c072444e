import unicodedata

from pyspark.sql import functions as F

from inkweave.functions import text as tx
from inkweave.operators import graph as g
from inkweave.operators import narrative as na
from inkweave.operators import verdicts as vd
from inkweave.plans import consistency as co


def test_aliases_of_many_segments_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(na, "TASK_SEGMENTS", 10)
    rows = spark.createDataFrame([(i, "red oak" if i % 2 else "Oak oak") for i in range(95)], "id long, text string")
    aliases = spark.createDataFrame([("Oak", "t"), ("oak", "t"), ("red", "t"), ("red", "c")], "alias string, entity_id string")
    df = na.aliases_in(rows, aliases, "id")
    assert "hashpartitioning(id" in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() == 10
    want = {(i, e, n) for i in range(95) for e, n in ([("t", 2), ("c", 1)] if i % 2 else [("t", 1)])}
    assert {tuple(r) for r in df.collect()} == want
    monkeypatch.setattr(na, "FEW_ALIASES", 1)
    assert {tuple(r) for r in na.aliases_in(rows, aliases, "id").collect()} == want


def test_equal_pairs_are_compared_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, None, "a"), (4, None, None), (5, "a b c", "a b c d")], "id long, x string, y string")
    want = sorted(map(tuple, rows.select("id", vd.compared(F.lit("job"), F.col("x"), F.col("y"))).collect()))
    for most in (vd.FEW_PAIRS, 0):
        monkeypatch.setattr(vd, "FEW_PAIRS", most)
        assert sorted(map(tuple, vd.with_outcome(rows, "job", "x", "y").select("id", "outcome").collect())) == want


def test_claims_are_extracted_once(spark, sf):
    files = co.fact_verdicts(spark, sf).inputFiles()
    assert not any("documents" in f for f in files)


def test_only_texts_that_composition_changes_go_to_python(spark):
    texts = ["plain 12", "né à Zürich", "한국어 日本", "①②", "é", "½ ﬁ", "한", "กำ", None, "각", "ạ̇", "Å", "x² 𝟗"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r for r in df.select("i", tx.nfkc(F.col("t")).alias("n"), F.col("t").rlike(tx.COMPOSABLE).alias("sent")).collect()}
    for i, t in enumerate(texts):
        assert got[i].n == (t if t is None else unicodedata.normalize("NFKC", t))
    assert [bool(got[i].sent) for i in range(4)] == [False, False, True, True]


def test_places_of_some_documents(spark):
    links = spark.createDataFrame([(i, i // 3) for i in range(30)], "doc long, key long")
    seeds = spark.createDataFrame([(0, 1.0), (4, 0.5), (5, 0.7), (29, 1.0)], "doc long, weight double")
    docs = spark.createDataFrame([(0,), (3,), (4,), (10,), (28,)], "doc long")
    want = {tuple(r) for r in g.expand(links, seeds).collect() if r.doc in (0, 3, 4, 10, 28)}
    assert {tuple(r) for r in g.placed(docs, links, seeds).collect()} == want and len(want) == 4
