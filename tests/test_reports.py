"""Values of the report functions that the queries over the given tables don't reach."""

from pyspark.sql import functions as F

from inkweave.operators import reports as rp


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_slots_and_words(spark):
    slot = lambda c, k, p: one(spark, rp.slot_key(F.col("c"), F.col("k"), F.col("p")), c=("string", c), k=("string", k), p=("string", p))
    assert slot(" Talent ", "int", "x") == "talent" and slot("other", "REL", "x") == "relation" and slot(None, None, "설정/ＡＧＥ") == "age"
    assert slot(None, "str", None) is None
    word = lambda t: one(spark, rp.bool_word(F.col("t")), t=("string", t))
    assert word(" 사망 ") is True and word("생존중") is False and word("x") is None and word(None) is None


def test_numbers_and_signatures(spark):
    numbers = lambda t: [int(x) for x in one(spark, rp.numeric_tokens(F.col("t")), t=("string", t))]
    assert numbers("a-3 12, 012 ７ " + "9" * 50) == [-3, 7, 12] and numbers(None) == [] and numbers("") == []
    reasons = lambda r: one(spark, rp.signature(F.col("r")), r=("array<string>", r))
    assert reasons(["b", None, "a", "", "b"]) == "a|b" and reasons([]) == reasons(None) == reasons([None, ""]) == "<none>"


def test_keys_and_neighbours(spark):
    key = lambda t, f: one(spark, rp.memo_key(F.col("t"), F.col("f")), t=("string", t), f=("string", f))
    assert key(" Ａ  b\n", None) == key("a B", None) == "a b" and key("a", '{"x":1}') == 'a|{"x":1}' and key(None, None) == ""
    near = lambda t, s, e: one(spark, F.array(rp.token_before(F.col("t"), F.lit(s)), rp.token_after(F.col("t"), F.lit(e))), t=("string", t))
    assert near("사랑하는 형, 철수다", 5, 6) == ["사랑하는", "철수다"] and near("", 0, 0) == ["", ""] and near("x", -3, 9) == ["", ""]
    ends = spark.range(1).select(*[rp.is_descriptive(F.lit(w)) for w in ("사랑하는", "나의", "형", "")]).first()
    assert list(ends) == [True, False, False, False]


def test_model_output(spark):
    raw = '[{"slot_key":"age","value":3,"confidence":7,"span_start":-2,"span_end":"x"},{"value":1},{"slot_key":"job","matched_text":"m"}]'
    got = one(spark, rp.model_candidates(F.col("r")), r=("string", raw))
    assert [(c["slot_key"], c["confidence"], c["s"], c["e"], c["matched_text"]) for c in got] == [("age", 1.0, 0, 0, "3"), ("job", 0.5, 0, 0, "m")]
    assert not one(spark, rp.model_candidates(F.col("r")), r=("string", "no json")) and one(spark, rp.model_candidates(F.col("r")), r=("string", None)) is None


def test_classes(spark):
    reason = lambda *n: spark.range(1).select(rp.review_reason(*map(F.lit, n))).first()[0]
    assert [reason(2, 2, 0, 0, 0), reason(0, 0, 2, 0, 0), reason(0, 1, 0, 2, 0), reason(0, 0, 0, 0, 2), reason(0, 0, 0, 0, 0), reason(1, 1, 0, 0, 0), reason(1, 3, 0, 0, 0)] == [
        "ambiguous_standalone_numbers", "front_matter_dominant", "blank_line_gate_filtered_candidates", "unsupported_header_variant", "no_repeated_markers", "single_detected_marker",
        "insufficient_repeated_markers",
    ]
    hits = one(spark, rp.line_hits(F.col("t")), t=("string", "All Rights reserved\r\n Prologue \n" + "x\n" * 90 + "차례\nChapter 3\n제 4 장\n외전"))
    assert tuple(hits) == (2, 3)


def test_empty_tables(spark):
    assert rp.confidence_band(spark.createDataFrame([], "k int, v double"), "k", "v").count() == 0
    assert rp.graph_run_summary(spark.createDataFrame([], "k int, query string, applied boolean"), "k").count() == 0
    band = rp.confidence_band(spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (1, 4.0)], "k int, v double"), "k", "v").first()
    assert tuple(band) == (1, 0.0, 2.0, 4.0, 4.0)
