import random
import time

from pyspark.sql import functions as F

from inkweave.llm import pii, secrets, spans

KIND = "array<struct<s:bigint,e:bigint,m:string>>"


def disjoint(r, n, size):
    cuts = sorted(r.sample(range(size), 2 * n))
    return [(cuts[2 * k], cuts[2 * k + 1], "x") for k in range(n)]


def test_apart_from(spark):
    r = random.Random(1)
    cases = [(disjoint(r, a, 400), disjoint(r, b, 400) + disjoint(r, c, 400)) for a, b, c in [(9, 5, 9), (1, 1, 0), (0, 3, 3), (20, 0, 0), (30, 2, 1), (5, 60, 60)] * 20]
    cases += [([(0, 3, "x"), (3, 5, "x"), (7, 9, "x")], [(3, 5, "y"), (5, 7, "y")]), ([(2, 4, "x")], [(0, 9, "y"), (0, 2, "y"), (4, 9, "y")])]
    df = spark.createDataFrame(cases, f"a {KIND}, b {KIND}").select(spans.apart_from(F.col("a"), F.col("b")), "a", "b")
    for got, a, b in df.collect():
        assert got == [x for x in a if not any(x["s"] < o["e"] and o["s"] < x["e"] for o in b)]


def plain_replaced(text, found, by):
    out, at = "", 0
    for s, e, _ in sorted(found):
        if s >= at:
            out += text[at:s] + by
        at = max(at, e)
    return out + text[at:]


def test_replaced(spark):
    r = random.Random(2)
    text = "".join(r.choice("aé😀\n z") for _ in range(1500))
    cases = [(text, disjoint(r, a, 1500) + disjoint(r, b, 1500)) for a, b in [(1, 0), (9, 30), (60, 60)] * 9]
    cases += [("abcdef", [(0, 6, "x")]), ("abcdef", [(0, 2, "x"), (2, 4, "x")]), ("abcdef", [(1, 3, "x"), (1, 5, "x"), (2, 3, "x")]), ("abc", []), ("", []), (None, [])]
    got = spark.createDataFrame(cases, f"t string, a {KIND}").select(spans.replaced(F.col("t"), F.col("a"), "#"), "t", "a").collect()
    for out, t, a in got:
        assert out == (t and plain_replaced(t, a, "#"))


def test_cut(spark):
    text = "".join(random.Random(3).choice("aé😀\nz") for _ in range(1000))
    cases = [(0, 0), (0, 5), (250, 260), (255, 256), (256, 257), (0, 1000), (990, 1010), (1000, 1020), (1024, 1044), (511, 513), (100, 900)]
    df = spark.createDataFrame([(text, a, b) for a, b in cases], "t string, a long, b long").withColumn("c", spans.chunks_of(F.col("t")))
    assert [r[0] for r in df.select(spans.cut(F.col("c"), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in cases]


def seconds(make):
    began = time.time()
    make()
    return time.time() - began


def test_many_spans_in_one_text_take_linear_time(spark):
    def personal(n):
        df = spark.createDataFrame([(1, "mail me: a.b@c.de or call (555) 123-4567 ok " * n)], "doc_id long, text string")
        (row,) = pii.pii_spans(df).select(F.size("email"), F.size("phone_local")).collect()
        assert tuple(row) == (n, n)

    def hidden(n):
        df = spark.createDataFrame([(1, "password = abcdef123 and QmFzZTY0L3Rlc3Qvc3RyaW5nLzEyMw then " * n)], "doc_id long, text string")
        (row,) = secrets.secret_spans(df).select(F.size("assign")).collect()
        assert row[0] == n
        (row,) = secrets.without_secrets(df.selectExpr("*", "0 as n_chars")).select("text").collect()
        assert row[0].count("[SECRET]") >= n

    for work in (personal, hidden):
        work(50)
        one, two = seconds(lambda: work(8000)), seconds(lambda: work(16000))  # noqa: B023
        assert two < 2.6 * one + 2, (one, two)
