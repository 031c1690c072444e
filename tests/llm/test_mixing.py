import numpy as np
import pytest

from inkweave.llm import mixing as mix
from tests.oracle import assert_same


def rows(n=900):
    r = np.random.default_rng(4)
    return [(i, " ".join(["w"] * int(r.integers(1, 90))), str(r.choice(["en", "de"], p=[0.8, 0.2])), "s%d" % r.choice(4, p=[0.6, 0.2, 0.15, 0.05])) for i in range(n)]


def make(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as row", "2 as id", "'x' as kept", "3 as n_tokens")


def test_margins_and_budget(spark):
    docs = make(spark, rows())
    out = mix.mixed(docs).toPandas()
    assert len(out) == 900
    expected = out.n_tokens * out.probability
    assert expected.sum() == pytest.approx(mix.BUDGET * out.n_tokens.sum(), rel=1e-6)
    cells = mix.cell_sums(mix.described(docs.selectExpr("source as k_source", "lang as k_lang", "text"), docs["text"]))
    fitted = mix.raked(cells, {d: mix.margin_targets(cells, d) for d in mix.DIMENSIONS}).toPandas()
    for d in mix.DIMENSIONS:
        want = mix.margin_targets(cells, d).toPandas().set_index(f"k_{d}").target
        assert np.allclose(fitted.groupby(f"k_{d}").w.sum().sort_index(), want.sort_index(), atol=1e-8)
    # in each cell the draws keep about what they should, for many documents
    kept = out[out.kept].groupby(["k_source", "k_lang"]).size()
    for key, group in out.groupby(["k_source", "k_lang"]):
        mean, var = group.probability.sum(), (group.probability * (1 - group.probability)).sum()
        assert abs(kept.get(key, 0) - mean) <= 4 * np.sqrt(var) + 1


def test_given_targets(spark):
    docs = make(spark, rows())
    want = spark.createDataFrame([("s3", 0.5), ("s0", 0.5), ("absent", 3.0)], "value string, share double")
    out = mix.mixed(docs, targets={"source": want}, budget=0.02).toPandas()
    assert set(out[out.probability > 0].k_source) == {"s0", "s3"}
    tokens = (out.n_tokens * out.probability).groupby(out.k_source).sum()
    assert tokens["s0"] == pytest.approx(tokens["s3"], rel=0.02)


def test_nulls_repeats_and_empty_tables(spark):
    data = rows(60) + [(None, None, None, None), (None, "a b", None, "s0"), (7, "", "xx", "s9"), (3, "a", "en", "s1"), (3, "a", "en", "s1")]
    docs = make(spark, data)
    out = mix.mixed(docs).toPandas()
    assert len(out) == len(data) and out.probability.between(0, 1).all()
    assert out[out.k_source == "s9"].probability.tolist() == [0.0]
    kept = mix.sampled_documents(docs)
    assert kept.columns == docs.columns and kept.count() == out.kept.sum()
    assert mix.mixed(docs.limit(0)).count() == 0


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert assert_same(mix.op7_mix_ipf(spark, sf), sf, mix.SQL) == 1000


def test_slow_and_impossible_margins(spark):
    slow = spark.createDataFrame([("a", "x", "t", 900), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 1)], "k_source string, k_lang string, k_topic string, tokens long")
    want = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("x", 0.5), ("y", 0.5)], "topic": [("t", 1.0)]}
    targets = lambda df: {d: mix.margin_targets(df, d, spark.createDataFrame(v, "value string, share double")) for d, v in want.items()}
    out = mix.raked(slow, targets(slow)).toPandas()
    assert out.groupby("k_source").w.sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-6)
    assert out.groupby("k_lang").w.sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-6)
    apart = slow.where("(k_source = 'a') = (k_lang = 'x')")  # a only with x, b only with y
    want["lang"] = [("x", 0.9), ("y", 0.1)]
    with pytest.warns(UserWarning, match="from their targets"):
        mix.raked(apart, targets(apart), most_rounds=10).collect()


def test_topics(spark):
    texts = {"Call: the phone, call me": "contact", "(Licensed) law, mail": "legal", "plain words": "general", "": "general", "API-key server mail": "software", "passwords mailing": "general", "Santé, médecin": "health", "mail law": "contact"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["k_topic"] for r in mix.described(df, df["text"]).collect()}
    assert got == texts


def test_many_cells_are_raked_alike(spark, monkeypatch):
    docs = make(spark, rows(200)).selectExpr("source as k_source", "lang as k_lang", "text")
    cells = mix.cell_sums(mix.described(docs, docs["text"])).cache()
    targets = {d: mix.margin_targets(cells, d) for d in mix.DIMENSIONS}
    one = mix.raked(cells, targets, 2, most_rounds=2).toPandas().sort_values(["k_source", "k_lang", "k_topic"])
    monkeypatch.setattr(mix, "CELLS", 3)
    many = mix.raked(cells, targets, 2, most_rounds=2).toPandas().sort_values(["k_source", "k_lang", "k_topic"])
    assert np.allclose(one.w, many.w, rtol=1e-12)
