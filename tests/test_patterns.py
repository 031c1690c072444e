import random

from pyspark.sql import functions as F

from inkweave.functions import lexicon as lx
from inkweave.functions import text as tx
from inkweave.operators import narrative as na


def test_held_patterns_against_all_pairs(spark):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abc 가나.\n😀") for _ in range(n))
    segments = [(g, k, text(r.randrange(0, 60))) for g in range(3) for k in range(60)] + [(0, 900, None), (0, 901, "")]
    patterns = [(r.randrange(4), text(r.choice((0, 1, 2, 3, 4, 5, 7)))) for _ in range(150)] + [(0, None), (0, "abc"), (0, "abc")]
    df = spark.createDataFrame(segments, "g int, k int, segment string")
    got = sorted(map(tuple, na.holding(df, spark.createDataFrame(patterns, "g int, pattern string"), ["g", "k"], "g").collect()))
    want = sorted({(g, k, p) for g, k, s in segments if s for h, p in patterns if h == g and p and p in s})
    assert got == want and len(want) > 300


def test_first_event_of_a_segment(spark):
    segments = spark.createDataFrame([(1, 1, "they met the next day, at noon"), (1, 2, "nothing"), (2, 3, "the next day"), (1, 4, "at noon they met")], "t int, k int, segment string")
    events = spark.createDataFrame([(1, 5, "at noon", "noon"), (1, 3, "a label", "the next day"), (2, 8, "other", "third day"), (1, 9, "they met", "they met")], "t int, idx int, label string, time_key string")
    got = {r["k"]: r["timeline_idx"] for r in na.first_event(segments, events, ["t", "k"]).collect()}
    assert got == {1: 3, 2: None, 3: None, 4: 5}


def test_named_entities_against_all_pairs(spark):
    r = random.Random(7)
    words = ["철", "시로", "AI", "시로네", "iron", "gate", "은빛", "탑", "a1"]
    alias = lambda: " ".join(r.sample(words, r.choice((1, 1, 2, 3))))
    aliases = [(a, f"e{k % 25}") for k, a in enumerate([alias() for _ in range(40)] + ["...", "", "iron gate", "gate-iron", "은빛  탑"])] + [(None, "x"), ("철", None)]
    word = lambda: r.choice(words) + r.choice(("", "", "", *lx.ALIAS_PARTICLES))
    segments = [(k, r.choice((" ", ", ", "-")).join(word() for _ in range(r.randrange(0, 9)))) for k in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(segments, "k int, text string")
    got = sorted(map(tuple, na.named_in(df, spark.createDataFrame(aliases, "alias string, entity_id string"), "k").collect()))
    want = set()
    for a, e in aliases:
        if a and e and tx.re.findall(tx.WORD, a):
            want |= {(x["k"], e) for x in df.where(F.coalesce(tx.matches_alias(F.col("text"), a), F.lit(False))).collect()}
    assert got == sorted(want) and len(want) > 200


def test_sets_are_stable_and_apart(spark):
    values = {"age": "41", "death": ""}
    docs = [(k, f"text {k % 70}" + " " * (k % 2)) for k in range(200)] + [(900, None), (901, "")]
    sets = lambda rows: {r["doc_id"]: r for r in na.bench_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", values, inject=0.3, control=0.3).collect()}
    some, all_ = sets(docs[:120]), sets(docs)
    assert all(some[k]["set"] == all_[k]["set"] and some[k]["bench_text"] == all_[k]["bench_text"] for k in some)
    by_text = {}
    for r in all_.values():
        by_text.setdefault((r["text"] or "").strip(), []).append(r)
    assert all(len({r["set"] for r in rs}) == 1 and [r["doc_id"] for r in rs if r["first"]] == [min(r["doc_id"] for r in rs)] for rs in by_text.values())
    kinds = {r["set"] for r in all_.values()}
    assert kinds == {"inject", "control", "pool"} and {r["kind"] for r in all_.values() if r["set"] == "inject"} == {"age", "death"}
    assert all(("[INJECT]" in (r["bench_text"] or "")) == (r["set"] == "inject") for r in all_.values())
    made = na.bench_sets(spark.createDataFrame(docs, "doc_id long, text string").withColumn("g", F.lit("x")), "doc_id", "text", values)
    manifest = na.set_manifest(made, "doc_id", "g")
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, na.set_manifest(made.repartition(5), "doc_id", "g").collect()))
    assert manifest.agg(F.sum("n")).first()[0] == 71
