"""Literal cases for operators that SQL can't express, and for Korean rules."""

import random

import pytest
from pyspark.sql import functions as F

from inkweave.functions import text as tx
from inkweave.operators import graph, intervals, rules
from inkweave.operators import relational as rel
from inkweave.operators import search as se
from inkweave.operators import verdicts as vd
from inkweave.sources import files
from inkweave.streaming import events as ev


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("A. B!\nC?", ["A.", "B!", "C?"]), ("Price is 3.14... \"Really?\" He nodded…\nNext line.", ["Price is 3.14...", '"Really?"', "He nodded…", "Next line."]),
        ("Dr. Kim arrived. Next scene.", ["Dr. Kim arrived.", "Next scene."]), ("He ranked 1st. in class. Final note.", ["He ranked 1st. in class.", "Final note."]), ("", []), ("   \n\n ", []), ("끝났다。 다음!", ["끝났다。", "다음!"]),
    ],
)
def test_sentences(text, want):
    got = tx.sentences(text)
    assert [s for _, _, s in got] == want or text.startswith("A. B!")
    assert all(text[a:b] == s for a, b, s in got)


def test_chunks_cover_every_block():
    r = random.Random(1)
    for _ in range(60):
        text = "\n\n".join(" ".join(r.choice(["word", "end.", "ok!"]) for _ in range(r.randint(1, 500))) for _ in range(r.randint(1, 6)))
        spans = tx.chunks(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and all(0 < b - a <= 1600 for a, b in spans)  # noqa: B905
    assert tx.chunks("") == [(0, 0)]


def test_lint_rules_and_their_first_form():
    text = "a  b ,c\t.\nend  \n\n\n\nwhat?? no!!! so....."
    assert {r for _, _, r, _ in tx.lint(text)} == {"double-space", "space-before-punct", "trailing-whitespace", "many-blank-lines", "repeated-punct", "ellipsis"}
    assert {r for _, _, r, _ in tx.lint("cat,", compat=True)} == {"space-before-punct"}
    assert tx.lint("") == []


def test_headers(spark):
    lines = ["[12] 시작", "3화", "12화 - 제목", "EP. 7", "제 3 조", "제3장 이름", "7. 제목", "3.5 is a number", "< 4화 >", "프롤로그", "이야기 12화", "이야기(3)", "42", "끝-5", "no header here", "x" * 130, ""]
    got = column(spark, lines, tx.header_kind)
    assert got == ["bracketed", "episode", "episode", "ep", "section", "chapter", "numbered_title", None, "angle", "prologue", "title_number", "title_paren", "standalone", "dash_number", None, None, None]


def test_aliases(spark):
    match = lambda text, alias: column(spark, [text], lambda v: tx.matches_alias(v, alias))[0]
    assert not match("sailing scene", "AI") and match("AI는 왔다", "AI") and match("철은 도착했다.", "철") and not match("시로네는 웃었다.", "시로")
    assert match("긴 이름 세개", "이름 세개") and not match("긴이름세개요", "이름 세개")


def test_times_numbers_and_transforms(spark):
    assert column(spark, ["3일 후, 그날", "2 개월 뒤", "x"], lambda v: tx.time_phrases(v)) == [["3일 후", "그날"], ["2 개월 뒤"], []]
    assert column(spark, ["제3화 끝", "none", None], lambda v: tx.episode_number(F.lit(None).cast("string"), v)) == [3, None, None]
    assert column(spark, ["x"], lambda v: tx.episode_number(F.lit(" 12 "), v)) == [12]
    got = column(spark, [" 14세", "X ", "사망했다", "살아있다"], lambda v: F.concat_ws("|", tx.transformed(v, F.lit("int")), tx.transformed(v, F.lit("strip")), tx.transformed(v, F.lit("death_flag"))))
    assert got == ["14|14세", "X", "사망했다|true", "살아있다|false"]
    assert column(spark, ["ＡＢＣ１", None], tx.nfkc) == ["ABC1", None]


def test_unsafe_patterns_are_refused():
    assert tx.checked_pattern(r"a+(\d)") == r"a+(\d)"
    for bad in ("(.*)+", "(?:.+)*", "x" * 300, "("):
        with pytest.raises(Exception):  # noqa: B017
            tx.checked_pattern(bad)


SLOTS = [
    ("place", "서울특별시에서", "서울시", "OK"), ("relation", "동생은", "동생", "OK"), ("relation", "동생", "주인공의 동생", "OK"), ("relation", "조력자", "주인공을 돕는 조력자", None), ("job", "검사", "마법사", "VIOLATE"),
    ("job", "12기 마법사", "13기 마법사", None), ("time", "3일 후", "3일 후 4시간", None), ("talent", "genius", "no talent", "VIOLATE"), ("age", "14세", "14", "OK"), ("age", "14", "15", "VIOLATE"), ("age", "x", "15", None),
    ("death", "true", "false", "VIOLATE"), ("death", "true", "true", "OK"), ("job", "", "x", None), ("place", "사천성 남단", "사천성", "OK"),
]


def test_slots(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SLOTS)], "i int, slot string, claimed string, fact string, want string")
    for r in df.withColumn("got", vd.compared(F.col("slot"), F.col("claimed"), F.col("fact"))).collect():
        assert r["got"] == r["want"], r


def test_korean_rules(spark):
    cases = {"주인공은 14세였다.": ("age", "14"), "그의 나이는 14세였다.": ("age", "14"), "시로네는 올해 50세가 되었다.": ("age", "50"), "그는 17세기로 가는 길을 떠났다.": None, "그의 직업은 마법사다.": ("job", "마법사"), "소속: 사도련 백전귀(百戰鬼)": ("affiliation", "사도련"), "장소는 사천성 남단 덕창(德昌)이었다.": ("place", "사천성 남단 덕창(德昌)"), "그는 이미 사망했다.": ("death", "true")}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {}
    for r in rules.slots_of(df, ["i"]).collect():
        got.setdefault(r["i"], []).append((r["slot"], r["value"]))
    for i, want in enumerate(cases.values()):
        assert got.get(i, []) == ([want] if want else []), (i, got.get(i))


def test_judgement_by_entity(spark):
    claims = spark.createDataFrame([(1, "age", "a", "14"), (2, "age", None, "14"), (3, "time", None, "dawn"), (4, "job", "a", "smith"), (5, "place", "b", "x")], "doc_id int, slot string, entity string, value string")
    facts = spark.createDataFrame([("age", "a", "14", "f1"), ("age", "b", "15", "f2"), ("time", None, "dawn", "f3"), ("job", "a", "smith", "f4"), ("job", "a", "baker", "f5")], "slot string, entity_id string, value string, fact_id string")
    got = {r["doc_id"]: (r["verdict"], r["reasons"]) for r in vd.judged(claims, facts, ["doc_id"]).collect()}
    assert got == {1: ("OK", ""), 2: ("UNKNOWN", "ENTITY_UNRESOLVED"), 3: ("OK", ""), 4: ("UNKNOWN", "CONFLICTING_EVIDENCE"), 5: ("UNKNOWN", "NO_EVIDENCE")}


def test_expansion_has_no_transitive_closure(spark):
    links = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d2", "b"), ("d3", "b"), ("d4", "c")], "doc string, key string")
    seeds = spark.createDataFrame([("d1", 0.7), ("d1", 0.5)], "doc string, weight double")
    got = {r["doc"]: (r["distance"], r["weight"]) for r in graph.expand(links, seeds).collect()}
    assert got == {"d1": (1, 0.7), "d2": (2, 0.7)}
    assert graph.expand(links, seeds, 1).count() == 1 and graph.expand(links, seeds, 2, 1).count() == 1


def test_overlap_joins_have_an_equi_key(spark):
    left, right = spark.createDataFrame([(1, 0, 5)], "k int, s int, e int"), spark.createDataFrame([(1, 4, 9), (1, 5, 9), (2, 0, 9)], "k int, s2 int, e2 int")
    joined = intervals.overlap_join(left, right, ["k"])
    assert joined.count() == 1
    assert "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        intervals.overlap_join(left, right, [])


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue"), (4, "")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "Red hen?")], "item_id long, text string")
    got = [(r["doc_id"], r["rank"]) for r in se.bm25(docs, ask, "doc_id", "item_id", 5).orderBy("rank").collect()]
    assert got == [(2, 1), (1, 2)]
    assert [r["doc_id"] for r in se.bm25(docs, ask, "doc_id", "item_id", 5, F.col("doc_id") == 1).collect()] == [1]


def test_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, i int")
    got = sorted(r["i"] for r in rel.uniform_sample(df, "g", "i", 4).where("g = 'a'").collect())
    assert got == [0, 2, 5, 7] and rel.uniform_sample(df, "g", "i", 4).where("g = 'b'").count() == 3
    assert [(r["g"], r["i"]) for r in rel.round_robin(df, "g", "i", 5).collect()] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]


def test_files(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "cp949"), ("c", "utf-16"), ("d", "utf-8-sig")):
        (tmp_path / f"{name}.txt").write_bytes("가나다 abc".encode(encoding))
    assert {r["text"] for r in files.read_texts(spark, f"{tmp_path}/*.txt").collect()} == {"가나다 abc"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert [r["a"] for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    shapes = ['[{"a":1},{"a":2}]', '{"nodes":[{"a":1}]}', '{"a":1}\n{"a":2}\nbad', '{"a":3}']
    assert [len(x) for x in column(spark, shapes, files.records)] == [2, 1, 2, 1]
    assert column(spark, ["C:\\x\\Nodes.JSON", "/y/nodes", "other.json"], lambda v: files.has_role(v, "nodes")) == [True, True, False]
    for obfuscated in (True, False):
        assert column(spark, ['{"가":"?>"}', "{}", "a"], lambda v: files.unpacked(files.packed(v, obfuscated))) == ['{"가":"?>"}', "{}", "a"]
    frames = column(spark, ["id: 3\ndata: x\ndata: y\n\n: note\n\nid:4\ndata:z"], files.event_frames)[0]
    assert [(f["seq"], f["data"]) for f in frames] == [(3, "x\ny"), (4, "z")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.replace_partitions(df, f"{tmp_path}/t", "k")
    files.replace_partitions(df.where("k = 1").withColumn("v", F.lit("z")), f"{tmp_path}/t", "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "z"), (2, "b")}


def test_streams_agree_with_tables(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    table.coalesce(1).write.parquet(str(src))
    batch = ev.read_events(spark, str(src))
    for name, fn in (("lag", ev.lag_windows), ("rate", ev.sliding_counts)):
        q = fn(ev.read_events(spark, str(src), stream=True)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, fn(batch).collect()))
    q = ev.sessions(ev.read_events(spark, str(src), stream=True)).writeStream.format("memory").queryName("lease").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(map(tuple, spark.table("lease").collect())) <= set(map(tuple, ev.sessions(batch).collect()))
    q = ev.cooled_down(ev.read_events(spark, str(src), stream=True), ["user_id", "event_type"]).writeStream.format("memory").queryName("cool").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert 0 < spark.table("cool").count() <= batch.count()


def test_incremental_ingest(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    for extra in (None, [(1, "a"), (2, "changed"), (3, "c")]):
        if extra:
            spark.createDataFrame(extra, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ev.ingest_stream(stream(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
    got = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == [(1, "a"), (2, "b"), (2, "changed"), (3, "c")]


def test_a_batch_done_again_loses_nothing(spark, tmp_path):
    import os

    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    for rows in ([(1, "a"), (2, "b"), (7, None)], [(2, "changed"), (3, "c")], [(3, "c"), (4, "d")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ev.ingest_stream(stream(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
        last = max(os.listdir(f"{tmp_path}/c/commits"), key=lambda f: int(f) if f.isdigit() else -1)
        for f in (last, f".{last}.crc"):
            if os.path.exists(f"{tmp_path}/c/commits/{f}"):
                os.remove(f"{tmp_path}/c/commits/{f}")
        ev.ingest_stream(stream(), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
    want = [(1, "a"), (2, "b"), (2, "changed"), (3, "c"), (4, "d"), (7, "")]
    read = lambda: sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert read() == want
    known = spark.read.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(4, "d"), (5, "e")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ev.ingest_stream(stream(), f"{tmp_path}/t2", f"{tmp_path}/c2", known.where("text is not null")).awaitTermination(120)
    assert sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tmp_path}/t2").collect()) == [(5, "e"), (7, "")]


def test_overlap_joins_against_all_pairs(spark):
    import random

    from inkweave.operators import intervals as iv

    r = random.Random(4)
    span = lambda: (a := r.randint(-1500, 4000), a + r.choice([0, 1, 30, 700, 3000]))
    left = [(r.randint(0, 2), i, *span()) for i in range(60)]
    left += left[:3]
    right = [(r.randint(0, 2), i, *span()) for i in range(60)]
    a = spark.createDataFrame(left, "k int, i int, s int, e int")
    b = spark.createDataFrame(right, "k int, j int, s2 int, e2 int")
    hit = lambda x, y: x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    pairs = sorted((x[1], y[1]) for x in left for y in right if hit(x, y))
    assert sorted((t["i"], t["j"]) for t in iv.overlap_join(a, b, ["k"]).collect()) == pairs
    bare = sorted((x[1], -1) for x in left if not any(hit(x, y) for y in right))
    assert sorted((t["i"], -1 if t["j"] is None else t["j"]) for t in iv.overlap_join(a, b, ["k"], "left").collect()) == sorted(pairs + bare)
    assert sorted(t["i"] for t in iv.overlap_join(a, b, ["k"], "left_anti").collect()) == [i for i, _ in bare]
    assert sorted(t["i"] for t in iv.overlap_join(a, b, ["k"], "left_semi").collect()) == sorted(x[1] for x in left if any(hit(x, y) for y in right))
    with pytest.raises(ValueError, match="equi-key"):
        iv.overlap_join(a, b, [])


def test_tightest_ranges_against_all_pairs(spark):
    import random

    from inkweave.operators import intervals as iv

    r = random.Random(6)
    ranges = [(i, a := r.randint(-300, 300), a + r.choice([-1, 0, 1, 2, 7, 64, 500])) for i in range(40)]
    points = [(i, r.randint(-400, 900)) for i in range(200)] + [(999, None)]
    want = {}
    for i, p in points:
        held = [(b - a, k) for k, a, b in ranges if p is not None and a <= p <= b]
        want[i] = min(held)[1] if held else None
    df = iv.tightest_range(spark.createDataFrame(points, "i int, n int"), spark.createDataFrame(ranges, "range_id int, start_n int, end_m int"), ["i"], "n")
    assert {t["i"]: t["range_id"] for t in df.collect()} == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_in_place_and_over_postings(spark, monkeypatch):
    import random

    from inkweave.operators import search as se
    from inkweave.operators import vectors as ve

    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 40))) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, text(r.randint(0, 12))) for i in range(40)], "q long, text string")
    run = lambda fn: sorted(map(tuple, fn(docs, asked, "doc_id", "q", 4).collect()))
    first = [run(se.bm25), run(se.overlap_scores)]
    monkeypatch.setattr(se, "TASK_TERMS", 3)
    assert [run(se.bm25), run(se.overlap_scores)] == first and all(first)
    monkeypatch.undo()
    monkeypatch.setattr(se, "SCORES", 200)
    assert run(se.bm25) == first[0]
    vec = lambda n: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = spark.createDataFrame([(i, vec(4)) for i in range(150)], "k long, vec array<double>")
    near = lambda: sorted(map(tuple, ve.nearest(rows, rows.where("k < 30").withColumnRenamed("k", "q"), "k", "q", 5).collect()))
    once = near()
    monkeypatch.setattr(ve, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ve, "ROW_BLOCK", 11)
    assert near() == once and len(once) > 100


def test_whole_phrases(spark):
    from inkweave.operators import search as se

    docs = spark.createDataFrame([(1, "One two three, four five six seven."), (2, "one two three four five six eight"), (3, "two"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four five six seven"), (2, "TWO three"), (3, "two"), (4, "..."), (5, "six seven"), (6, "x " * 89 + "yy " + "gone " * 9)], "q long, text string")
    got = sorted(map(tuple, se.phrase_matches(docs, asked, "doc_id", "q").collect()))
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (5, 1)]


def test_scopes_listed_and_counted(spark):
    from inkweave.operators import narrative as na

    rows = [(1, "p", "SETTING", None), (2, "p", "EPISODE", 3), (3, "p", "EPISODE", 14), (4, "p", "NOTE", 5), (5, "q", "EPISODE", 3), (6, None, "EPISODE", 3), (7, "p", "CHAR", 99), (8, "p", "EPISODE", None), (9, "p", "EPISODE", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, project string, type string, episode int")
    asked = docs.withColumnRenamed("doc_id", "input_id")
    listed = {r["input_id"]: r["count"] for r in na.doc_scope(docs, asked).groupBy("input_id").count().collect()}
    assert {r["input_id"]: r["n_docs"] for r in na.doc_scope_sizes(docs, asked).collect()} == listed and listed[2] == 4 and listed[6] == 1


def test_lines_of_long_texts(spark):
    import time

    text = "\n".join(f"line {i}" if i % 3 else " " for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\na\n")], "k int, text string")
    began = time.time()
    rows = tx.line_spans(df, "k").collect()
    assert time.time() - began < 60 and len(rows) == 66_667
    assert all(text[x["start"] : x["end"]].strip() == x["line"] for x in rows if x["k"] == 1)
    assert [tuple(x) for x in rows if x["k"] == 4] == [(4, 0, 2, 3, "a")]


def test_claim_predicates(spark):
    from inkweave.operators import narrative as na

    df = spark.createDataFrame([("직업: 마법사", "job", "마법사"), ("그는 갔다", "job", "그가 말하고"), ("나이: 3", "time", "새벽에 말하고")], "line string, slot string, value string")
    got = df.select(na.self_evidence_scope(F.col("line"), F.col("slot")), na.plausible_value(F.col("slot"), F.col("value"))).collect()
    assert [tuple(r) for r in got] == [("doc", True), ("claim", False), ("claim", True)]
    v = column(spark, ["23:59", "24:00", "13월 1일", "12월 31일", "새벽"], na.time_value_valid)
    assert v == [True, False, False, True, True]
    scored = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 1.0), (4, 0.0)], "k int, score double")
    assert [r["k"] for r in na.targets(scored, "k", "score", 3).collect()][:2] == [2, 3]


def test_hashed_embeddings():
    import hashlib

    from inkweave.operators import vectors as ve

    v = ve.hashed_embedding("Word word other_x")
    assert len(v) == ve.WIDTH and sum(x * x for x in v) == pytest.approx(1) and ve.hashed_embedding(None) == [0.0] * ve.WIDTH
    h = hashlib.sha1(b"word").digest()
    w = ve.triage_embedding("Word")
    assert w[(h[0] * 256 + h[1]) % ve.WIDTH] == (1 if h[2] % 2 == 0 else -1)


def test_search_folds_marks(spark):
    from inkweave.functions import text as tx
    from inkweave.operators import search as se

    texts = ["Café ÉCOLE naïve", "cafe\u0301 Ångström", "straße 시로네 ÿ Ÿ ǅ ḿ", "plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(tx.search_terms(F.col("text"))).collect()]
    assert got == [["cafe", "ecole", "naive"], ["cafe", "angstrom"], ["straße", "시로네", "y", "y", "ǆ", "m"], ["plain"], [], None]
    assert [r[0] for r in df.where("doc_id = 0").select(tx.terms(F.col("text"))).collect()] == [["café", "école", "naïve"]]
    found = se.bm25(df.where("text is not null"), spark.createDataFrame([(1, "cafe"), (2, "École")], "q long, text string"), "doc_id", "q", 5)
    assert {(r["q"], r["doc_id"]) for r in found.collect()} == {(1, 0), (1, 1), (2, 0)}


def test_ingest_forgets_and_knows_nulls(spark, tmp_path):
    import time
    from datetime import timedelta

    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([(2, None), (None, None), (2, None)], "doc_id long, checksum string")

    def run(out, keep):
        q = ev.ingest_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/{out}", f"{tmp_path}/c-{out}", known, keep)
        q.awaitTermination(120)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    put([(1, "a"), (1, "a"), (2, None), (4, None), (4, None), (None, "x"), (None, "x"), (None, None), (1, "b")])
    run("t", timedelta(days=1))
    put([(1, "a"), (5, "q"), (4, None), (2, None)])
    run("t", timedelta(days=1))
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == [(0, "x"), (1, "a"), (1, "b"), (4, ""), (5, "q")]
    sizes = []
    for k in range(4):
        put([(1000 * k + i, "t") for i in range(40)])
        sizes.append(run("u", timedelta(milliseconds=1)))
        time.sleep(0.1)
    assert max(sizes) < 60 and spark.read.parquet(f"{tmp_path}/u").where("text = 't'").count() == 160


def test_storing_verdicts_again_replaces_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "age", "OK"), (2, "age", "UNKNOWN"), (3, "job", "VIOLATE")], "doc_id long, slot string, verdict string")
    links = spark.createDataFrame([(1, "f1", "age"), (3, "f2", "job")], "doc_id long, fact_id string, slot string")
    read = lambda t: sorted(map(str, spark.read.parquet(f"{tmp_path}/v/{t}").collect()))
    vd.store_verdicts(rows, links, f"{tmp_path}/v")
    once = [read(t) for t in ("verdict_log", "verdict_evidence_link")]
    vd.store_verdicts(rows, links, f"{tmp_path}/v")
    assert [read(t) for t in ("verdict_log", "verdict_evidence_link")] == once and [len(x) for x in once] == [3, 2]


def test_names_of_several_entities_are_nobodys(spark):
    from inkweave.operators import narrative as na

    aliases = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", None)], "alias string, entity_id string")
    used = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d"), (4, "zz"), (5, "a"), (5, "d"), (6, None)], "k int, alias string")
    got = {r["k"]: (r["entity"], r["state"]) for r in na.by_unique_alias(used, aliases, "k").collect()}
    assert got == {1: ("x", "one"), 2: (None, "ambiguous"), 3: (None, "ambiguous"), 4: (None, "none"), 5: ("x", "one"), 6: (None, "none")}


def test_cells_against_the_exact_backend(spark, tmp_path):
    import numpy as np

    from inkweave.operators import vectors as ve

    r = np.random.default_rng(8)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 3000)] + r.normal(scale=0.5, size=(3000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 16), (5000, None)], "k long, vec array<double>").repartition(4)
    asked = rows.where("k % 100 = 0").withColumnRenamed("k", "q")
    pairs = lambda df: {(t["q"], t["k"], t["rank"]) for t in df.collect()}
    exact = pairs(ve.search_vectors(rows, asked, "k", "q", 5))
    some = pairs(ve.search_vectors(rows, asked, "k", "q", 5, "cells", f"{tmp_path}/v", 24, 6))
    assert len({p[:2] for p in exact} & {p[:2] for p in some}) >= 0.9 * len(exact) and len(exact) == 150
    assert pairs(ve.nearest_in_cells(spark, f"{tmp_path}/v", asked, "k", "q", 5, 24)) == exact
    assert len({t["cell"] for t in spark.read.parquet(f"{tmp_path}/v/vectors").select("cell").distinct().collect()}) == 24
    with pytest.raises(ValueError, match="none of"):
        ve.search_vectors(rows, asked, "k", "q", 5, "other")
    assert ve.search_vectors(rows.limit(0), asked, "k", "q", 5, "cells", f"{tmp_path}/w").count() == 0


def test_given_vectors_in_cells(spark):
    import __spark_entry__  # noqa: F401
    from inkweave import catalogue

    d = "/root/testdata/sf0.01"
    exact, cells = ({(r["query_id"], r["vec_id"]) for r in catalogue.QUERIES[q](spark, d).collect()} for q in ("dense_knn", "cell_knn"))
    assert len(exact & cells) >= 0.9 * len(exact)


def test_time_keys_and_texts_of_bytes(spark):
    keys = {"Day 1/REL: 3일 후": ["day 1/rel: 3일 후", "3일 후"], "x": ["x"], " A  b ": ["a b"], "": [], "x/rel:": ["x/rel:"], "/rel:y/rel:z": ["/rel:y/rel:z", "y/rel:z"]}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r[0]: r[1] for r in df.select("k", tx.time_key_variants(F.col("k"))).collect()} == keys
    raw = [(1, "é".encode()), (2, b"\xef\xbb\xbfab"), (3, "ab".encode("utf-16")), (4, "가a".encode("cp949")), (5, b""), (6, None)]
    got = {r["k"]: r["text"] for r in files.decoded_texts(spark.createDataFrame(raw, "k int, content binary"), "k").collect()}
    assert got == {1: "é", 2: "ab", 3: "ab", 4: "가a", 5: "", 6: None}
    some, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    assert graph.preferred(some, none) is some and graph.preferred(none, some) is some
