"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built from SQL functions only; a row is decided by itself, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.llm.spans import apart_from, chunks_of, cut, found, let, named
from inkweave.session import read_table

# Possessive forms match as the greedy ones do and can't run out of stack on long texts; a look
# behind keeps a long run from being tried from each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of IBANs and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A country's code, check digits, and as many characters as its numbers have, so no following word is taken in.
IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
LOCAL_PHONE = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
NATIONAL_ID = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: Score of a proposal by kind, what a passed checksum and a context word add, what a word against it takes away, and the least
#: score of a span that is added. One number in ten passes Luhn's check, so a short card needs a word for it besides; an account
#: number needs none, unless a word speaks against it; numbers without a checksum need a word for them and none against.
PROPOSED = {"email": 0.9, "ip": 0.7, "card": 0.3, "phone": 0.7, "card_short": 0.05, "iban": 0.3, "phone_local": 0.3, "national_id": 0.3}
CHECKSUM, CONTEXT, AGAINST, LEAST = 0.5, 0.3, 0.3, 0.6
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: Context words in four languages.
CONTEXT_WORDS = {
    "card": "card|credit|visa|mastercard|amex|carte|karte|kreditkarte|tarjeta",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "phone": "phone|call|tel|mobile|fax|telefon|anruf|appelez|portable|llame|movil",
    "id": "ssn|social security|national id|insurance number|ausweis|identidad",
    "email": "mail|contact|e-mail|courriel|correo",
    "ip": "ip|host|server|address|addr",
}
#: Words that say a number is something else, or made up.
OTHER_WORDS = "isbn|issn|order|invoice|tracking|serial|version|build|ticket|part|item|sku|example|sample|dummy|fake|placeholder|bestellung|rechnung|beispiel|commande|facture|exemple|pedido|factura|ejemplo"
WORDS_OF = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "card_short": "card", "iban": "iban", "phone_local": "phone", "national_id": "id"}
BASE = ("email", "ip", "card", "phone")
ADDED = ("card_short", "iban", "phone_local", "national_id")
#: Kinds with a checksum, without which there is no span of theirs.
CHECKED = ("card", "card_short", "iban")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            twice = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return twice - F.when(twice > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + value(i))

    return let(number, total) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN's remainder is one; letters count as 10 to 35."""

    def rest(s: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
            return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

        turned = F.concat(F.substring(s, 5, 1000), F.substring(s, 1, 4))
        return let(turned, lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1))), F.lit(0), step))

    return let(F.regexp_replace(m, r"\x20", ""), rest) == 1


def _near(chunks: Column, x: Column, words: str) -> Column:
    """Whether one of the words stands near span x."""
    near = F.concat(cut(chunks, F.greatest(x["s"] - BEFORE, F.lit(0)), x["s"]), F.lit(" "), cut(chunks, x["e"], x["e"] + AFTER))
    return F.lower(near).rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def score_of(chunks: Column, x: Column, kind: str) -> Column:
    """The score of span x of a kind, its checksum passed where the kind has one: up and down by context, from 0 to 1.

    Base kinds, which stay whatever stands near, go up alone. chunks is the text as chunks_of has it.
    """
    first = PROPOSED[kind] + (CHECKSUM if kind in CHECKED else 0)
    up = F.when(_near(chunks, x, CONTEXT_WORDS[WORDS_OF[kind]]), CONTEXT).otherwise(0.0)
    down = F.when(_near(chunks, x, OTHER_WORDS), AGAINST).otherwise(0.0) if kind in ADDED else F.lit(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(first) + up - down)), 2)


def _scored(spans: Column, kind: str) -> Column:
    """spans of a kind with their scores."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), score_of(F.col("chunks"), x, kind).alias("score")))


def _small_parts(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def _n_digits(m: Column, low: int, high: int) -> Column:
    return F.length(digits(m)).between(low, high)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, email, ip, card, phone, card_short, iban, phone_local, national_id) for each row.

    The first four are the base spans. Of the others those are added whose checksum holds, whose
    score reaches LEAST and that overlap no base span. Each is an array of (s, e, m, score) by start. Null
    counts as an empty text, which has no spans; rows without an id and repeated rows stay as
    they are; an empty table gives an empty one.
    """
    t = F.col("text")
    rows = docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text"))
    long_number = t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    rows = rows.select(
        "id",
        "text",
        found(t, EMAIL, t.contains("@")).alias("email"),
        F.filter(found(t, IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: _small_parts(x["m"])).alias("ip"),
        found(t, CARD, long_number).alias("numbers"),
        F.filter(found(t, PHONE, t.rlike(r"\+[0-9]")), lambda x: _n_digits(x["m"], 8, 15)).alias("phone"),
    )
    rows = rows.select(
        "id", "text", "email", "ip", "phone",
        F.filter("numbers", lambda x: F.when(_n_digits(x["m"], 16, 19), luhn(digits(x["m"]))).otherwise(False)).alias("card"),
        F.filter("numbers", lambda x: F.when(_n_digits(x["m"], 13, 15), luhn(digits(x["m"]))).otherwise(False)).alias("card_short"),
    )
    ibans = F.filter(found(t, IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10}")), lambda x: mod97(x["m"]))
    local = found(t, LOCAL_PHONE, t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"))
    nat = found(t, NATIONAL_ID, t.rlike(NATIONAL_ID))
    rows = rows.select("id", "text", *BASE, "card_short", ibans.alias("iban"), local.alias("phone_local"), nat.alias("national_id"), F.concat(*BASE).alias("base"))
    rows = rows.select("id", "text", *BASE, *[apart_from(F.col(k), F.col("base")).alias(k) for k in ADDED])
    many = sum((F.size(k) for k in BASE + ADDED), F.lit(0))
    rows = rows.withColumn("chunks", F.when(many > 0, chunks_of(t)))
    rows = rows.select("id", "text", *[_scored(F.col(k), k).alias(k) for k in BASE + ADDED])
    return rows.select("id", "text", *BASE, *[F.filter(k, lambda x: x["score"] >= LEAST).alias(k) for k in ADDED])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_spans(read_table(spark, sf_dir, "documents"))
    every = F.concat(*[named(k, F.col(k)) for k in BASE + ADDED])
    return spans.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*[named(k, F.col(k)) for k in BASE]), ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.array_join(F.concat(*[F.transform(k, lambda x: x["score"].cast("string")) for k in BASE + ADDED]), ",").alias("scores"),
    )


def _sql() -> str:
    """The same in SQL, with the patterns as the contract states them."""
    near = "lower(substr(text, greatest(s - {0}, 0) + 1, least(s, {0})) || ' ' || substr(text, e + 1, {1}))".format(BEFORE, AFTER)
    words_near = lambda words: f"regexp_matches({near}, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')"
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 AND CAST(substr(reverse({d}), i, 1) AS INT) > 4 THEN CAST(substr(reverse({d}), i, 1) AS INT) * 2 - 9"
        f" WHEN i % 2 = 0 THEN CAST(substr(reverse({d}), i, 1) AS INT) * 2 ELSE CAST(substr(reverse({d}), i, 1) AS INT) END)) % 10 = 0"
    )
    bare = "replace(m, ' ', '')"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    values = f"list_transform(range(1, length({turned}) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1)"
    mod = f"list_reduce({values}, lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
    n = f"length({d})"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 999) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"{n} BETWEEN 16 AND 19 AND {luhn}"), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"{n} BETWEEN 8 AND 15"),
        "card_short": (r"[0-9](?:[\x20-]?[0-9])+", f"{n} BETWEEN 13 AND 15 AND {luhn}"), "iban": (IBAN, mod),
        "phone_local": (LOCAL_PHONE, "true"), "national_id": (NATIONAL_ID, "true"),
    }
    out = ["WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for k, (kind, (pattern, test)) in enumerate(kinds.items()):
        out.append(f"h_{kind} AS (SELECT r, text, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS pieces FROM d WHERE regexp_matches(text, '{pattern}'))")
        out.append(
            f"p_{kind} AS (SELECT r, text, hits[i] AS m, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s"
            f" FROM h_{kind}, unnest(range(1, len(hits) + 1)) t(i))"
        )
        first = PROPOSED[kind] + (CHECKSUM if kind in CHECKED else 0)
        down = f"CASE WHEN {words_near(OTHER_WORDS)} THEN {AGAINST} ELSE 0.0 END" if kind in ADDED else "0.0"
        score = f"round(greatest(0.0, least(1.0, {first} + CASE WHEN {words_near(CONTEXT_WORDS[WORDS_OF[kind]])} THEN {CONTEXT} ELSE 0.0 END - {down})), 2)::DOUBLE"
        least = f" WHERE score >= {LEAST}" if kind in ADDED else ""
        out.append(f"k_{kind} AS (SELECT * FROM (SELECT {k} AS k, '{kind}' AS kind, r, s, e, {score} AS score FROM (SELECT *, s + length(m) AS e FROM p_{kind}) WHERE {test}){least})")
    base = " UNION ALL ".join(f"SELECT * FROM k_{kind}" for kind in BASE)
    added = " UNION ALL ".join(f"SELECT * FROM k_{kind}" for kind in ADDED)
    out.append(f"b AS MATERIALIZED ({base})")
    out.append(f"a AS (SELECT * FROM ({added}) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e))")
    out.append("every AS (SELECT * FROM b UNION ALL SELECT * FROM a)")
    joined = lambda what, where="true": f"coalesce(string_agg({what}, ',' ORDER BY k, s) FILTER (WHERE k IS NOT NULL AND {where}), '')"
    span = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    columns = f"{counts}, sha256({joined(span, 'k < 4')}) AS base_sha256, {joined(span)} AS spans, {joined('score::VARCHAR')} AS scores"
    return ",\n".join(out) + f"\nSELECT doc_id, {columns} FROM d LEFT JOIN every USING (r) GROUP BY d.r, doc_id"


SQL = _sql()
QUERIES = {"op3_pii": op3_pii}
ORACLES = {"op3_pii": SQL}
