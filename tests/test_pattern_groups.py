from inkweave.operators import narrative as na

SEGMENTS = [(g, k, f"line {k} of {g}, abcdef {k * 7}") for g in range(3) for k in range(30)] + [(1, 900, None), (1, 901, "")]
PATTERNS = [(g, p) for g in range(4) for p in ("a", "ab", "abcdef", f"of {g}", "line 1 ", "zzzz")[: 2 + 2 * g]]


def test_groups_of_few_and_of_many_patterns_are_held_alike(spark, monkeypatch):
    df, asked = spark.createDataFrame(SEGMENTS, "g int, k int, segment string"), spark.createDataFrame(PATTERNS, "g int, pattern string")
    want = sorted({(g, k, p) for g, k, s in SEGMENTS if s for h, p in PATTERNS if h == g and p in s})
    for few in (0, 3, 64):
        monkeypatch.setattr(na, "FEW", few)
        assert sorted(map(tuple, na.holding(df, asked, ["g", "k"], "g").collect())) == want


def test_no_pattern_goes_through_the_driver(spark):
    """Only the numbers of crowded groups may be broadcast."""
    df, asked = spark.createDataFrame(SEGMENTS, "g int, k int, segment string"), spark.createDataFrame(PATTERNS, "g int, pattern string")
    plan = na.holding(df, asked, ["g", "k"], "g")._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            assert "pattern" not in plan[i + 1].split("keys=")[0] and "LeftSemi" in "".join(plan[max(0, i - 12) : i]), plan[i + 1]
