import random

from inkweave.llm import quality_rules as qr
from tests.oracle import assert_same


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {x: wins.count(x) for x in set(wins)}
    covered = {j for i, x in enumerate(wins) if count[x] > 1 for j in range(i, i + 8)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = ["", None, " \n \t ", "a", "a\nb\na\n\n\nb\r\n", "x y " * 40, "w " * 8, "w " * 9, "## <b> & |%$*", "é ñ b\x0bc\x0cd\x1ce", "one two three four five six seven eight " * 3, "z" * 50_000]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(150)] + ["\n".join(r.choice(["a b", "c", " ", ""]) for _ in range(9)) for _ in range(30)]
    df = spark.createDataFrame([(i if i % 7 else None, t, "h" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").selectExpr("*", "1 as words", "2 as host", "3 as id")
    got = sorted(tuple(x) for x in qr.quality_rules(df).select(*qr.COUNTS, "base_failed").collect())
    assert got == sorted(brute(t) for t in texts)
    kept = qr.kept_documents(df)
    assert kept.columns == df.columns
    assert kept.count() == qr.quality_rules(df).where("kept").count()
    assert qr.quality_rules(df.limit(0)).count() == 0 and qr.kept_documents(df.limit(0)).count() == 0


def test_bad_host_goes_with_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", "short" if i % 10 else good) for i in range(100)] + [(100 + i, f"h{i % 5}", good if i % 20 else "short") for i in range(500)] + [(900, "tiny", "short")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r[0] for r in qr.quality_rules(df).where("kept").select("host").distinct().collect()}
    assert kept == {f"h{i}" for i in range(5)}
    rates = {r["host"]: r["rate_base"] for r in qr.host_rates(qr.quality_rules(df)).collect()}
    assert rates["bad"] > 0.5 and 0 < rates["tiny"] < 1


def planted_hosts():
    """Twelve clean hosts, and three of which one rule each is often failed by documents that pass by themselves."""
    r = random.Random(8)
    words = lambda n, k=5: " ".join("".join(r.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    rows = [(f"https://www.site{i % 12}.example/p/{i}", words(40) if i % 25 else "short") for i in range(1200)]
    rows += [(f"http://USER@Symbols.example:80/{i}", words(30) + " " + "#*$" * 9) for i in range(60)]
    rows += [(f"//x{i}" if not i else f"ftp://lines.example/{i}", "\n".join([words(3)] * 3 + [words(40)])) for i in range(60)]
    rows += [("long words", words(25, 15)) for _ in range(60)] + [(None, words(30)) for _ in range(30)]
    return [(i, h, t) for i, (h, t) in enumerate(rows)]


def test_each_rule_can_fail_a_host(spark, tmp_path):
    df = spark.createDataFrame(planted_hosts(), "doc_id long, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = qr.quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert {r[0] for r in out.where("host_failed").select("host").distinct().collect()} == {"symbols.example", "lines.example", "long words"}
    assert out.where("not base_failed and host_failed").count() >= 170
    assert {r[0] for r in out.select("host").distinct().collect()} >= {f"site{i}.example" for i in range(12)} | {None, "//x0"}
    assert qr.host_rates(out.where("host = 'symbols.example'")).first()["host_failed"] is False
    assert assert_same(qr.op9_quality_hosts(spark, str(tmp_path)), str(tmp_path), qr.SQL) == len(planted_hosts())


def test_same_as_sql(spark, sf):
    assert assert_same(qr.op9_quality_hosts(spark, sf), sf, qr.SQL) > 100
