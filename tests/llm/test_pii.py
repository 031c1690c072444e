import hashlib
import random
import re

from inkweave.llm import pii
from tests.oracle import assert_same

CASES = [
    "mail a.b+c@x-y.example.com, now", "a@b.c_d@e.f @x.y a@b a@.c aa@b.c@d.e", "1.2.3.4 1.2.3.4.5 256.1.1.1 1.2.3 000255.0.0.1 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 x 4111111111111111 9", "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8 +1.2 +49 30 123456789012345678",
    "iban GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432 GB83WEST12345698765432", "call me: (555) 123-4567 or 555.123.4567", "SSN 123-45-6789; 123-45-6780",
    "amex card 378282246310005 here", "378282246310005 alone", "é ñ 😀 1.2.3.4 ß a@b.co 😀 +1 234 567 8901", "", None, "9" * 5000, "1 " * 4000, "a" * 30_000 + "@b.c", "a@b.c " * 700, "1.1.1.1 " * 600,
]


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def base(text):
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = [(m.span(), re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out["card"] = [s for s, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def check(got, text):
    want = base(text)
    assert [got[f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE], text[:80]
    joined = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
    assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert got["spans"].startswith(joined)
    assert len(got["spans"].split(",")) == len(got["scores"].split(","))


def rows_of(spark, texts, tmp_path):
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as email", "2 as id")
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r.asDict() for r in pii.op3_pii(spark, str(tmp_path)).collect()}


def test_cases(spark, tmp_path):
    texts = [CASES[0], CASES[0], "twice", "no id 1.2.3.4", *CASES]
    got = rows_of(spark, texts, tmp_path)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        check(got[None if i == 3 else i], t)
    by = {t: got[i]["spans"] for i, t in enumerate(texts) if i != 3}
    assert by[CASES[5]].count("iban:") == 2 and "iban:5:32" in by[CASES[5]]
    assert by[CASES[6]] == "phone_local:9:23,phone_local:27:39"
    assert by[CASES[7]] == "national_id:4:15,national_id:17:28"
    assert by[CASES[8]] == "card_short:10:25" and by[CASES[9]] == ""


def test_account_numbers_by_country(spark, tmp_path):
    ibans = ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    texts = ["x"] * 4 + [f"{i}{word}" for i in ibans for word in (" BIC", " BANK ok", " EUR", "", ", then")] + [i.replace(" ", "") + " EUR" for i in ibans]
    texts += [f"example {i}" for i in ibans] + [f"example account {i}" for i in ibans] + [i[:-1] + str((int(i[-1]) + 1) % 10) for i in ibans]
    got = rows_of(spark, texts, tmp_path)
    spans = [got[k]["spans"] for k in range(4, len(texts))]
    n = len(ibans)
    assert spans[: 5 * n] == [f"iban:0:{len(i)}" for i in ibans for _ in range(5)]
    assert spans[5 * n : 6 * n] == [f"iban:0:{len(i.replace(' ', ''))}" for i in ibans]
    assert not any(spans[6 * n : 7 * n]) and all(spans[7 * n : 8 * n]) and not any(spans[8 * n :])


def test_context_moves_the_score_up_and_down(spark, tmp_path):
    texts = ["x"] * 4 + ["378282246310005", "card 378282246310005", "card of order 378282246310005", "call (555) 123-4567", "(555) 123-4567", "call about ticket (555) 123-4567", "ssn 123-45-6789", "ssn, sample 123-45-6789"]
    got = rows_of(spark, texts, tmp_path)
    assert [bool(got[k]["spans"]) for k in range(4, len(texts))] == [False, True, False, True, False, False, True, False]
    assert got[5]["scores"] == "0.85" and got[7]["scores"] == "0.6"


def test_random(spark, tmp_path):
    r = random.Random(1)
    texts = ["x"] * 4 + ["".join(r.choice(["1", "2", "41", "255", ".", ".", " ", "-", "+1", "(", ")", "@", "a", "é", "b.c", "_"]) for _ in range(r.randint(1, 70))) for _ in range(400)]
    got = rows_of(spark, texts, tmp_path)
    for i, t in enumerate(texts):
        check(got[None if i == 3 else i], t)


def test_empty_table(spark):
    assert pii.pii_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_as_sql(spark, sf, tmp_path):
    assert assert_same(pii.op3_pii(spark, sf), sf, pii.SQL) > 100
    run = rows_of
    r = random.Random(11)
    more = ["see " + "".join(r.choice("abcdefABCDEF0123456789+/XYZ") for _ in range(n)) + " x" for n in range(20, 90)]
    run(spark, ["a", "b", "c", "d", *[x for x in CASES if x is None or len(x) < 5000], *more], tmp_path)
    assert assert_same(pii.op3_pii(spark, str(tmp_path)), str(tmp_path), pii.SQL) > 50
