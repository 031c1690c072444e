"""Stated cases: inputs and what must come of them."""

import pytest
from pyspark.sql import functions as F

from inkweave.functions import text as tx
from inkweave.operators import options as opt
from inkweave.operators import reports as rp
from inkweave.operators import rules
from inkweave.operators import verdicts as vd

CASES = []


def case(columns, rows):
    """Registers a function of a session whose rows must be these, in any order."""

    def add(fn):
        CASES.append((fn, columns.split(", "), rows))
        return fn

    return add


@pytest.mark.parametrize("n", range(16))
def test_case(spark, n):
    fn, columns, rows = CASES[n]
    got = sorted((tuple(r) for r in fn(spark).select(*columns).collect()), key=repr)
    assert got == sorted(map(tuple, rows), key=repr)


def test_all_cases():
    assert len(CASES) == 16


SLOTS = [
    ("place", "서울특별시에서", "서울시", "OK"), ("relation", "동생은", "동생", "OK"), ("relation", "동생", "주인공의 동생", "OK"), ("relation", "조력자", "주인공을 돕는 조력자", None), ("job", "검사", "마법사", "VIOLATE"),
    ("job", "12기 마법사", "13기 마법사", None), ("time", "3일 후", "3일 후 4시간", None), ("talent", "genius", "no talent", "VIOLATE"), ("age", "10", "10", "OK"), ("age", "10", "11", "VIOLATE"),
    ("death", "true", "false", "VIOLATE"), ("death", "true", "true", "OK"), ("affiliation", "사도련", "사도련 백전대 기사단", "OK"), ("age", "ten", "10", None),
]


@case("slot, claimed, fact, outcome", SLOTS)
def slot_comparison_cases(spark):
    given = spark.createDataFrame([r[:3] for r in SLOTS], "slot string, claimed string, fact string")
    return given.select("*", vd.compared(F.col("slot"), F.col("claimed"), F.col("fact")).alias("outcome"))


SENTENCES = [
    (1, "A. B!\nC?", ["A.", "B!", "C?"]), (2, 'Price is 3.14... "Really?" He nodded…\nNext line.', ["Price is 3.14...", '"Really?"', "He nodded…", "Next line."]),
    (3, "Dr. Kim arrived. Next scene.", ["Dr. Kim arrived.", "Next scene."]), (4, "He ranked 1st. in class. Final note.", ["He ranked 1st. in class.", "Final note."]), (5, "", []), (6, " \n ", []),
]


@case("id, idx, sentence", [(i, k, s) for i, _, ss in SENTENCES for k, s in enumerate(ss)])
def sentence_cases(spark):
    return tx.sentence_table(spark.createDataFrame([r[:2] for r in SENTENCES], "id int, text string"), "id").select("id", "idx", "sentence")


ALIASES = [("sailing scene", "AI", False), ("철은 도착했다.", "철", True), ("시로네는 웃었다.", "시로", False), ("AI는 왔다", "AI", True), ("시로네는 웃었다.", "시로네", False), ("그 시로네 가 웃었다.", "시로네", True), ("the iron gate", "iron gate", True)]


@case("text, alias, matched", ALIASES)
def alias_cases(spark):
    given = spark.createDataFrame([r[:2] for r in ALIASES], "text string, alias string")
    out = F.lit(None).cast("boolean")
    for alias in sorted({a for _, a, _ in ALIASES}):
        out = F.when(F.col("alias") == alias, tx.matches_alias(F.col("text"), alias)).otherwise(out)
    return given.select("*", out.alias("matched"))


#: (text, slots found)
STATED = [
    ("주인공은 14세였다.", {"age": "14"}), ("그의 나이는 14세였다.", {"age": "14"}), ("시로네는 올해 50세가 되었다.", {"age": "50"}), ("그는 17세기로 가는 길을 떠났다.", {}), ("“448살입니다.”", {}), ("그의 직업은 마법사다.", {"job": "마법사"}),
    ("이 사람. 요리사 클래스였구나.", {"job": "요리사"}), ("저는 황궁 소속의 시녀입니다.", {"affiliation": "황궁", "job": "시녀"}), ("라인시스 제국의 제1황녀이자, 제국의 유일한 희망이었던 자.", {"affiliation": "라인시스 제국"}),
    ("그는 사도련의 백전귀였다.", {}), ("소속: 사도련 백전귀(百戰鬼)", {"affiliation": "사도련"}), ("그녀의 정체는 고 유명찬 공의 손녀딸이었다.", {"relation": "고 유명찬 공의 손녀딸"}),
    ("포키온의 아들 포코스가 군세를 이끌고 도달했소이다!", {"relation": "포키온의 아들"}), ("저놈이 황제의 아들이다!", {}), ("오로트 왕 폼페의 딸, 루이사입니다.", {}), ("장소는 사천성 남단 덕창(德昌)이었다.", {"place": "사천성 남단 덕창(德昌)"}),
    ("현재 자리한 장소는 사천성 남단 덕창(德昌)이었다.", {}), ("[13:45경. 클로뎃 아르르크, …]", {"time": "13:45"}), ("[PM 5:31]", {}), ("시간은 25:30이다.", {}), ("그는 이미 사망했다.", {"death": "true"}), ("죽었어.", {}), ("그 소식을 시드는 죽었다고 알렸다.", {}),
    ("시온이 살아있다는 걸 알았다.", {}), ("시온은 아직 살아있다.", {"death": "false"}), ("그녀는 천재였다.", {}), ("재능: 천재", {"talent": "천재"}), ("시간은 12:30이다.", {"time": "12:30"}), ("Class: Arcane Engineer", {"job": "Arcane Engineer"}),
    ("시로네는 50세이며 9서클 마법사이자 천재였다.", {"age": "50", "job": "9서클 마법사"}), ("", {}),
]
MAPPINGS = (("job", r"Class:\s*([A-Za-z ]+)", "strip", 10),)


@case("id, slot, value", [(i, s, v) for i, (_, found) in enumerate(STATED) for s, v in found.items()])
def rule_cases(spark):
    given = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATED)], "id int, text string")
    return rules.slots_of(given, ["id"], mappings=MAPPINGS).select("id", "slot", "value")


@case("id, slot, value", [(1, "affiliation", "사도련"), (2, "affiliation", "황궁"), (2, "job", "시녀")])
def group_rule_cases(spark):
    """Plain narrative that names a group, let in on request."""
    given = spark.createDataFrame([(1, "그는 사도련의 백전귀였다."), (2, "저는 황궁 소속의 시녀입니다."), (3, "그는 바다의 사람이다.")], "id int, text string")
    return rules.slots_of(given, ["id"], any_group=True).select("id", "slot", "value")


SPANS = [("재능: 천재", "talent", "재능: 천재"), ("장소는 사천성 남단 덕창(德昌)이었다.", "place", "장소는 사천성 남단 덕창(德昌)이었다."), ("시간은 12:30이다.", "time", "12:30")]


@case("text, slot, claim", SPANS)
def claim_span_cases(spark):
    return rules.slots_of(spark.createDataFrame([(t,) for t, _, _ in SPANS], "text string"), ["text"]).select("text", "slot", "claim")


DOCS = [
    ("setting", "SETTING", "이름: 시로네\n나이: 14세\n직업: 노 클래스\n재능: 재능 없음"), ("world", "SETTING", "장소: 북쪽 탑"), ("ep1", "EPISODE", "시로네는 50세이며 9서클 마법사이자 천재였다."), ("ep2", "EPISODE", "시로네는 14세였다."), ("ep3", "EPISODE", "누군가는 30세였다."),
]


def _context(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, type string, text string")
    facts = rules.profile_facts(docs.where("type = 'SETTING'"), "doc_id")
    names = facts.where("entity_id is not null").select(F.col("entity_id").alias("name"), "entity_id").distinct()
    return docs, facts, names


@case("doc_id, entity_id, slot, value", [("setting", "시로네", "age", "14"), ("setting", "시로네", "job", "노 클래스"), ("setting", "시로네", "talent", "재능 없음"), ("world", None, "place", "북쪽 탑")])
def profile_fact_cases(spark):
    return _context(spark)[1].select("doc_id", "entity_id", "slot", "value")


@case("doc_id, slot, entity, value, verdict, reasons", [("ep1", "age", "시로네", "50", "VIOLATE", ""), ("ep1", "job", "시로네", "9서클 마법사", "UNKNOWN", "SLOT_UNCOMPARABLE"), ("ep2", "age", "시로네", "14", "OK", ""), ("ep3", "age", None, "30", "UNKNOWN", "ENTITY_UNRESOLVED")])
def global_context(spark):
    """Chapters' statements held against what the settings' profiles say about the same person."""
    docs, facts, names = _context(spark)
    claims = rules.claims_of(docs.where("type = 'EPISODE'"), ["doc_id"], names)
    return vd.judged(claims, facts, ["doc_id"]).select("doc_id", "slot", "entity", "value", "verdict", "reasons")


TIMES = [("그는 3일 후 떠났다. 다음 날 왔다", "3일 후|다음 날"), ("이튿날 2년 전 일", "2년 전|이튿날"), ("아무 말", ""), ("10개월 뒤 10개월 뒤", "10개월 뒤")]


@case("text, phrases", TIMES)
def time_phrase_cases(spark):
    return spark.createDataFrame([(t,) for t, _ in TIMES], "text string").select("text", F.array_join(tx.time_phrases(F.col("text")), "|").alias("phrases"))


CHANGED = [("strip", "  a B ", "a B"), ("lower", "AbC", "abc"), ("int", "약 14세", "14"), ("bool", " 사망 ", "true"), ("bool", "생존중", "false"), ("bool", "?", None), ("death_flag", "이미 죽었다", "true"), ("death_flag", "살아있다", "false"), ("identity", " x ", " x ")]


@case("kind, value, changed", CHANGED)
def transform_cases(spark):
    return spark.createDataFrame([r[:2] for r in CHANGED], "kind string, value string").select("*", tx.transformed(F.col("value"), F.col("kind")).alias("changed"))


PATTERNS = [("a(b)c", True), ("(.*)+", False), ("(?:.+)+", False), ("x" * 257, False), (r"\d+", True)]


@case("pattern, safe", PATTERNS)
def safe_pattern_cases(spark):
    """Which users' patterns the gate lets in."""

    def safe(p: str) -> bool:
        try:
            return bool(tx.checked_pattern(p))
        except ValueError:
            return False

    return spark.createDataFrame([(p, safe(p)) for p, _ in PATTERNS], "pattern string, safe boolean")


WORDS = [("사망", True), (" 죽었다 ", True), ("생존", False), ("살아있음", False), ("모름", None), ("", None)]


@case("text, flag", WORDS)
def bool_word_cases(spark):
    return spark.createDataFrame([(t,) for t, _ in WORDS], "text string").select("text", rp.bool_word(F.col("text")).alias("flag"))


GATES = [("job", "마법사", True), ("job", "그가 말하고", False), ("place", "북쪽 탑", True), ("talent", "x", False), ("relation", "저에게 동생", False), ("affiliation", "하나 둘 셋 넷 다섯 여섯 일곱", False), ("place", "강 건너는 마을", False), ("place", "왕의 마을", True), ("job", "", False)]


@case("slot, value, kept", GATES)
def value_gate_cases(spark):
    return spark.createDataFrame([r[:2] for r in GATES], "slot string, value string").select("*", (~rules.reads_like_clause(F.col("value"))).alias("kept"))


EVIDENCE = [(0, 20, 19, 25, False), (0, 20, 2, 12, True), (0, 20, 3, 6, False), (0, 10, 8, 30, False), (0, 10, 7, 30, True)]


@case("s, e, s2, e2, confirmed", EVIDENCE)
def evidence_span_cases(spark):
    from inkweave.operators import intervals as iv

    given = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(EVIDENCE)], "id int, s int, e int, s2 int, e2 int")
    found = iv.confirmed(given.select("id", "s", "e"), given.select("id", "s2", "e2"), ["id"], ["id"])
    return given.join(found, "id").select("s", "e", "s2", "e2", "confirmed")


REQUESTS = [
    (1, "{}"), (2, '{"evidence_link_policy": " CAP ", "evidence_link_cap": 0, "graph_max_hops": 2, "exclude_self_evidence": false, "triage": {"mode": "Embedding_Anomaly", "anomaly_threshold": 1.5}}'),
    (3, '{"evidence_link_policy": "none", "evidence_link_cap": "x", "graph_max_hops": 3, "verifier": {"mode": 7, "promote_ok_threshold": "0.5"}, "verification_loop": {"enabled": true, "max_rounds": -4}}'), (4, "not json"),
]
ASKED = ("evidence_link_policy", "evidence_link_cap", "graph_max_hops", "exclude_self_evidence", "triage_mode", "triage_threshold", "verifier_mode", "verifier_ok_threshold", "loop_enabled", "loop_max_rounds")
RESOLVED = {
    1: ("full", "20", "1", "true", "off", "0.65", "off", "0.95", "false", "2"), 2: ("cap", "1", "2", "false", "embedding_anomaly", "1.0", "off", "0.95", "false", "2"),
    3: ("full", "20", "1", "true", "off", "0.65", "off", "0.5", "true", "1"), 4: ("full", "20", "1", "true", "off", "0.65", "off", "0.95", "false", "2"),
}


@case("id, option, value", [(i, o, v) for i, vs in RESOLVED.items() for o, v in zip(ASKED, vs, strict=True)])
def request_options(spark):
    return opt.resolved_requests(spark.createDataFrame(REQUESTS, "id int, request string"), "id", "request", ASKED)


GUESSED = [
    ("그 소년은 겨우 13살, 직업은 사실 목수", [("age", "13", 0.55, "model"), ("job", "사실 목수", 0.85, "rule")]), ("나이: 14세, 다른 이는 20살", [("age", "14", 0.85, "rule")]), ("어쩌면 재능이 없다", [("talent", "재능 없음", 0.45, "model")]),
    ("아마 죽었을 것", [("death", "true", 0.55, "model")]), ("분명 생존, 12월 3일", [("death", "false", 0.45, "model"), ("time", "12월 3일", 0.5, "model")]), ("아마도 장소는 그가 말하고", []), ("아무 말", []),
]


@case("id, slot, value, confidence, source", [(i, *g) for i, (_, gs) in enumerate(GUESSED) for g in gs])
def guessed_cases(spark):
    return rules.slots_of(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GUESSED)], "id int, text string"), ["id"], guessed=True)
