"""Secrets: patterns for assignments, access keys and digests, and a randomness battery for other runs.

A candidate run's encoding is inferred from its characters. Three tests look at it: chi-squared
uniformity over the alphabet, runs above and below the alphabet's middle, and serial correlation.
Where one of them rules out an even draw the run is no secret. For the others the same three
statistics are set against what written text of the run's length and encoding has, and combined
to one p-value: how probable text is that looks as random as this. False discoveries are
controlled over the corpus by Benjamini and Hochberg's rule within strata of length. Built from
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.llm.common import as_row, whole_text
from inkweave.llm.spans import apart_from, found, let, replaced
from inkweave.session import cut_lineage, read_table

ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
#: What of an assignment stands before its value.
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: A candidate: 20 characters or more of one alphabet, up to where it changes, and padding at a run's end alone.
RUN = r"(?=[A-Za-z0-9+/]{20}|[A-Za-z0-9_-]{20})[A-Za-z0-9]*+(?:[+/][A-Za-z0-9+/]*+|[_-][A-Za-z0-9_-]*+)?(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
BASE = ("assign", "access", "hex")
#: Most standard deviations from an even draw by test; uniformity of few characters has a long upper tail.
MOST_Z = {"even": 4.0, "runs": 3.3, "serial": 3.3}
#: Weights of the tests in the combined p-value.
WEIGHTS = (2.0, 2.0, 1.0)
#: False discoveries among the spans that are added, at most this share.
FALSE_SHARE = 0.05
#: Lengths at which strata begin, and steps of -log10 p in which p-values are counted, to a most.
STRATA, STEP, MOST_LOG = (20, 28, 36, 48, 64, 128), 0.125, 9.0
#: The alphabets by encoding, in the order of their code points.
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: What written text has of each encoding: sums of squares and of cubes of its characters' shares, and the share of characters
#: above the alphabet's middle. Numbers for digits alone, capitals for base32, names and paths of words and numbers for the rest.
WRITTEN = {"hex": (0.1, 0.0125, 0.2), "HEX": (0.1, 0.0125, 0.2), "base32": (0.065, 0.006, 0.42), "alnum": (0.055, 0.0045, 0.85), "base64": (0.055, 0.0045, 0.85), "base64url": (0.055, 0.0045, 0.85)}


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (s, e, m) of the base kinds; failing matches are dropped and not tried again."""
    assign = F.filter(found(text, ASSIGN, text.rlike(ASSIGN)), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 6)
    access = F.filter(found(text, ACCESS, text.contains("AKIA")), lambda x: F.length(x["m"]) >= 20)
    return {"assign": assign, "access": access, "hex": found(text, HEX, text.rlike(HEX))}


def encoding_of(run: Column) -> Column:
    """The narrowest alphabet that has all characters of a run; null for plain numbers and for mixtures of two."""
    return (
        F.when(run.rlike("^[0-9]*$"), None)
        .when(run.rlike("^[0-9a-f]*$"), "hex").when(run.rlike("^[0-9A-F]*$"), "HEX").when(run.rlike("^[A-Z2-7]*$"), "base32")
        .when(run.rlike("^[0-9A-Za-z]*$"), "alnum").when(run.rlike("^[0-9A-Za-z+/]*$"), "base64").when(run.rlike("^[0-9A-Za-z_-]*$"), "base64url")
    )


def _of(encoding: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(encoding == name, value).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """struct(enc, n, pairs, turns, z_even, z_runs, z_serial) of a run without padding; null where no encoding fits.

    n is its length, pairs the sum of squared character counts, on which chi-squared depends, and
    turns its runs above and below the middle; the z are those of an even draw, by the exact mean
    and variance of pairs and turns. Every step is linear in n.
    """

    def tested(r: Column) -> Column:  # r: run, alphabet, places of its characters in it
        n, k = F.length(r["run"]).cast("double"), F.length(r["abc"]).cast("double")
        count = lambda c: (F.length(r["run"]) - F.length(F.replace(r["run"], c, F.lit("")))).cast("bigint")
        pairs = F.aggregate(F.split(r["abc"], ""), F.lit(0).cast("bigint"), lambda acc, c: acc + count(c) * count(c))
        z_even = (pairs - n - n * (n - 1) / k) / F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
        high = F.size(F.filter(r["at"], lambda p: p >= F.length(r["abc"]) / 2)).cast("double")
        turns = F.aggregate(r["at"], F.struct(F.lit(None).cast("boolean").alias("was"), F.lit(1).alias("n")), lambda acc, p: F.struct((p >= F.length(r["abc"]) / 2).alias("was"), (acc["n"] + F.when(acc["was"] != (p >= F.length(r["abc"]) / 2), 1).otherwise(0)).alias("n")), lambda acc: acc["n"])
        mid = 1 + 2 * high * (n - high) / n
        z_runs = F.when((high < 1) | (high > n - 1), F.sqrt(n)).otherwise((turns - mid) / F.sqrt(F.greatest((mid - 1) * (mid - 2) / (n - 1), F.lit(0.25))))
        moment = F.aggregate(
            r["at"], F.struct(F.lit(None).cast("double").alias("was"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("by")),
            lambda acc, p: F.struct((p - r["mean"]).alias("was"), (acc["sq"] + (p - r["mean"]) * (p - r["mean"])).alias("sq"), (acc["by"] + F.coalesce(acc["was"] * (p - r["mean"]), F.lit(0.0))).alias("by")),
            lambda acc: F.when(acc["sq"] > 0, acc["by"] / acc["sq"]).otherwise(1.0),
        )
        return F.struct(r["enc"].alias("enc"), n.alias("n"), pairs.alias("pairs"), turns.alias("turns"), z_even.alias("z_even"), z_runs.alias("z_runs"), (moment * F.sqrt(n)).alias("z_serial"))

    def placed(e: Column) -> Column:
        at = F.transform(F.split(e["run"], ""), lambda c: F.instr(e["abc"], c) - 1)
        own = lambda x: [x[c].alias(c) for c in ("enc", "run", "abc")]
        mean = lambda p: F.aggregate(p["at"], F.lit(0).cast("bigint"), lambda acc, q: acc + q) / F.length(p["run"])
        return let(F.struct(*own(e), at.alias("at")), lambda p: let(F.struct(*own(p), p["at"].alias("at"), mean(p).alias("mean")), tested))

    def known(e: Column) -> Column:
        whole = F.struct(e["enc"].alias("enc"), e["run"].alias("run"), _of(e["enc"], {k: F.lit(v) for k, v in ALPHABETS.items()}).alias("abc"))
        return F.when(e["enc"].isNotNull() & (F.length(e["run"]) >= STRATA[0]), let(whole, placed))

    return let(F.regexp_replace(run, "=+$", ""), lambda r: let(F.struct(r.alias("run"), encoding_of(r).alias("enc")), known))


def upper_tail(z: Column) -> Column:
    """Normal probability above z, for z of 0 or more (Abramowitz and Stegun 26.2.17)."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * z), poly)


def written_z(b: Column) -> Column:
    """How far the battery's statistics together lie above those of written text: about normal for such text.

    Text is taken as drawn from fixed shares, so pairs and turns have a mean and a variance by length;
    it repeats characters more than a key does, changes sides less, and its neighbours are more alike.
    """

    def against(c: Column) -> Column:
        n, sq, cube, a, w = b["n"], c["sq"], c["cube"], c["a"], WEIGHTS
        rare = (n + n * (n - 1) * sq - b["pairs"]) / (2 * F.sqrt(n * (n - 1) / 2 * (sq - sq * sq) + n * (n - 1) * (n - 2) * (cube - sq * sq)))
        changes = (b["turns"] - 1 - 2 * a * (n - 1)) / F.sqrt((n - 1) * (2 * a - 4 * a * a) + 2 * (n - 2) * (a - 4 * a * a))
        return (w[0] * rare + w[1] * changes - w[2] * b["z_serial"]) / (sum(x * x for x in w) ** 0.5)

    shares = {e: F.struct(F.lit(v[0]).alias("sq"), F.lit(v[1]).alias("cube"), F.lit(v[2] * (1 - v[2])).alias("a")) for e, v in WRITTEN.items()}
    return let(_of(b["enc"], shares), against)


def log_p(z: Column) -> Column:
    """-log10 of the normal probability above z; 0 below the mean, and never more than MOST_LOG."""
    tail = lambda v: let(F.least(F.greatest(v, F.lit(0.0)), F.lit(13.0)), upper_tail)
    return let(z, lambda v: F.when(v <= 0, 0.0).otherwise(F.least(F.lit(MOST_LOG), -F.log10(tail(v)))))


def stratum(n: Column) -> Column:
    """The number of a length's stratum; null for null."""
    out = F.when(n.isNotNull(), F.lit(0))
    for k, low in enumerate(STRATA):
        out = F.when(n >= low, k).otherwise(out)
    return out


def _judged(x: Column) -> Column:
    """A candidate (s, e, m) with its stratum and the bin of its p-value; bin is null if the battery fails it."""

    def with_tests(b: Column) -> Column:
        passed = (b["z_even"] <= MOST_Z["even"]) & (F.abs(b["z_runs"]) <= MOST_Z["runs"]) & (F.abs(b["z_serial"]) <= MOST_Z["serial"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), stratum(b["n"]).alias("stratum"), F.when(passed, F.floor(log_p(written_z(b)) / STEP).cast("int")).alias("bin"))

    return let(battery(x["m"]), with_tests)


def scanned(rows: DataFrame) -> DataFrame:
    """rows with a text column; adds assign, access, hex and candidates, all of them empty for an empty text. The text mustn't be null."""
    others = [c for c in rows.columns if c != "text"]
    t = F.col("text")
    kinds = base_spans(t)
    rows = rows.select(*others, "text", *[c.alias(k) for k, c in kinds.items()], found(t, RUN, t.rlike(RUN)).alias("runs"))
    rows = rows.select(*others, "text", *BASE, apart_from(F.col("runs"), F.concat(*BASE)).alias("runs"))
    return rows.select(*others, "text", *BASE, F.filter(F.transform("runs", _judged), lambda x: x["stratum"].isNotNull()).alias("candidates"))


def discovery_limits(candidates: DataFrame) -> DataFrame:
    """(stratum, least_bin): the candidates of a stratum from that bin on are discoveries.

    Of all limits that hold the expected share of false discoveries the widest one. At most
    one row for a stratum; counts are summed before they move, whatever the corpus holds.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    everyone = counts.groupBy("stratum").agg(F.sum("n").alias("all"))
    above = F.sum("n").over(Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.where("bin is not null").withColumn("found", above).join(everyone, "stratum")
    held = F.pow(F.lit(10.0), -F.col("bin") * STEP) * F.col("all") <= FALSE_SHARE * F.col("found")
    return ranked.where(held).groupBy("stratum").agg(F.min("bin").alias("least_bin"))


def _discovered(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with candidates replaced by random, those that are discoveries; limits has a row for a stratum at most."""
    found_at = {r["stratum"]: r["least_bin"] for r in limits.collect()}  # at most len(STRATA) rows

    def kept(x: Column) -> Column:
        out = F.lit(False)
        for k, least_bin in sorted(found_at.items()):
            out = out | ((x["stratum"] == k) & F.coalesce(x["bin"] >= least_bin, F.lit(False)))
        return out

    plain = F.transform(F.filter("candidates", kept), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return rows.withColumn("random", plain).drop("candidates")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, random) for each row of docs: arrays of (s, e, m) by start.

    random has what the battery adds; it overlaps no base span. Null counts as an empty text,
    which has no secrets; rows without an id and repeated rows are scanned as they stand, and
    count as often as they stand there for the false discoveries. An empty table gives an
    empty one. Texts are read whole.
    """
    rows = docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text"))
    spans = cut_lineage(scanned(rows).drop("text"))
    limits = discovery_limits(spans.select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin"))
    return _discovered(spans, limits)


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mask, and its length column set anew where a text changed.

    All rows and columns stay. The texts are read once to control false discoveries and once to
    mask, so none is shuffled.
    """
    limits = discovery_limits(scanned(docs.select(whole_text(docs[text_col]).alias("text"))).select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin"))
    rows = _discovered(scanned(as_row(docs, text=whole_text(docs[text_col]))), limits)
    every = F.concat(*BASE, "random")
    rows = rows.select("row", F.when(F.size(every) > 0, replaced(F.col("text"), every, mask)).alias("clean"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.coalesce("clean", F.col(f"row.{c}")).alias(c))
        elif c == length_col:
            out.append(F.coalesce(F.length("clean").cast(docs.schema[c].dataType), F.col(f"row.{c}")).alias(c))
        else:
            out.append(F.col(f"row.{c}").alias(c))
    return rows.select(*out)


def _by_start(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then by kind as listed."""

    def keyed(i: int) -> Column:
        return F.transform(F.col(kinds[i]), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e")))

    name = lambda x: F.element_at(F.array(*map(F.lit, kinds)), x["i"] + 1)
    return F.array_join(F.transform(F.sort_array(F.concat(*map(keyed, range(len(kinds))))), lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(read_table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_by_start(BASE), 256).alias("base_sha256"),
        _by_start((*BASE, "random")).alias("spans"),
    )


def _run_without_lookahead() -> str:
    """RUN, padding aside, for engines without looks ahead: 20 characters of one alphabet at least, by where the first sign is."""
    signs = [f"[A-Za-z0-9]{{{k}}}[{s}][A-Za-z0-9{s}]{{{19 - k},}}" for k in range(20) for s in ("+/", "_-")]
    return "|".join([r"[A-Za-z0-9]{20,}(?:[+/][A-Za-z0-9+/]*|[_-][A-Za-z0-9_-]*)?", *signs])


def _sql() -> str:
    """The same in SQL, over one row for each character of a candidate."""
    assign = ASSIGN.replace("'", "''")
    head = ASSIGN_HEAD.replace("'", "''")
    kinds = {"assign": (assign, f"length(regexp_replace(m, '{head}', '')) >= 6"), "access": (ACCESS, "length(m) >= 20"), "hex": (HEX, "true"), "random": (_run_without_lookahead(), "true")}
    pad = "CASE WHEN regexp_matches(pieces[i + 1], '^={1,2}[^A-Za-z0-9+/_=-]') OR i = len(hits) AND regexp_matches(pieces[i + 1], '^={1,2}$') THEN length(regexp_extract(pieces[i + 1], '^=+')) ELSE 0 END"
    out = ["WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for kind, (pattern, test) in kinds.items():
        out.append(f"h_{kind} AS (SELECT r, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS pieces FROM d WHERE regexp_matches(text, '{pattern}'))")
        out.append(
            f"p_{kind} AS (SELECT r, hits[i] AS m, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s"
            f", {pad} AS pad FROM h_{kind}, unnest(range(1, len(hits) + 1)) t(i))"
        )
        out.append(f"k_{kind} AS (SELECT r, s, s + length(m){' + pad' if kind == 'random' else ''} AS e, m FROM p_{kind} WHERE {test})")
    out.append("b AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, '{kind}' AS kind, r, s, e FROM k_{kind}" for k, kind in enumerate(BASE)) + ")")
    encoding = "CASE WHEN regexp_matches(x, '^[0-9]*$') THEN NULL " + " ".join(
        f"WHEN regexp_matches(x, '^[{letters}]*$') THEN '{name}'"
        for name, letters in (("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("base32", "A-Z2-7"), ("alnum", "0-9A-Za-z"), ("base64", "0-9A-Za-z+/"), ("base64url", "0-9A-Za-z_-"))
    ) + " END"
    abc = "CASE enc " + " ".join(f"WHEN '{name}' THEN '{letters}'" for name, letters in ALPHABETS.items()) + " END"
    strata = "CASE " + " ".join(f"WHEN n >= {low} THEN {k}" for k, low in reversed(list(enumerate(STRATA)))) + " ELSE 0 END"
    sq, cube, up = ("CASE enc " + " ".join(f"WHEN '{e}' THEN {v[i]}::DOUBLE" for e, v in WRITTEN.items()) + " END" for i in range(3))
    w = WEIGHTS
    t = "(1 / (1 + 0.2316419 * z))"
    tail = f"exp(-z * z / 2) * 0.3989422804014327 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    out += [
        "c0 AS (SELECT r, s, e, m AS x FROM k_random c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e))",
        f"c1 AS (SELECT *, {encoding} AS enc FROM c0 WHERE length(x) >= {STRATA[0]})",
        f"c AS MATERIALIZED (SELECT *, {abc} AS abc, length(x)::DOUBLE AS n, row_number() OVER () AS c FROM c1 WHERE enc IS NOT NULL)",
        "ch AS (SELECT c, n, length(abc)::DOUBLE AS k, i, instr(abc, substr(x, i, 1)) - 1 AS p FROM c, unnest(range(1, length(x) + 1)) u(i))",
        "pl AS (SELECT *, avg(p) OVER (PARTITION BY c) AS mean, count(*) OVER (PARTITION BY c, p) AS alike, lag(p) OVER (PARTITION BY c ORDER BY i) AS was FROM ch)",
        "st AS (SELECT c, any_value(n) AS n, any_value(k) AS k, sum(alike)::DOUBLE AS pairs, count(*) FILTER (WHERE p >= k / 2)::DOUBLE AS high, 1 + count(*) FILTER (WHERE (p >= k / 2) <> (was >= k / 2)) AS turns,"
        " sum((p - mean) * (p - mean)) AS sq, coalesce(sum((p - mean) * (was - mean)), 0) AS bys FROM pl GROUP BY c)",
        "z1 AS (SELECT *, (pairs - n - n * (n - 1) / k) / sqrt(2 * n * (n - 1) / k * (1 - 1 / k)) AS z_even, 1 + 2 * high * (n - high) / n AS mid FROM st)",
        "z2 AS (SELECT c, pairs, turns, z_even, CASE WHEN high < 1 OR high > n - 1 THEN sqrt(n) ELSE (turns - mid) / sqrt(greatest((mid - 1) * (mid - 2) / (n - 1), 0.25)) END AS z_runs,"
        " CASE WHEN sq > 0 THEN bys / sq ELSE 1.0 END * sqrt(n) AS z_serial FROM z1)",
        f"z3 AS (SELECT r, s, e, n, pairs, turns, z_even <= {MOST_Z['even']} AND abs(z_runs) <= {MOST_Z['runs']} AND abs(z_serial) <= {MOST_Z['serial']} AS passed, z_serial, {sq} AS sq, {cube} AS cube, {up} * (1 - {up}) AS a FROM c JOIN z2 ON c.c = z2.c)",
        f"z4 AS (SELECT *, ({w[0]} * (n + n * (n - 1) * sq - pairs) / (2 * sqrt(n * (n - 1) / 2 * (sq - sq * sq) + n * (n - 1) * (n - 2) * (cube - sq * sq)))"
        f" + {w[1]} * (turns - 1 - 2 * a * (n - 1)) / sqrt((n - 1) * (2 * a - 4 * a * a) + 2 * (n - 2) * (a - 4 * a * a)) - {w[2]} * z_serial) / {sum(x * x for x in w) ** 0.5} AS z FROM z3)",
        f"j AS MATERIALIZED (SELECT r, s, e, {strata} AS stratum, CASE WHEN NOT passed THEN NULL WHEN z <= 0 THEN 0 WHEN z > 13 THEN floor({MOST_LOG} / {STEP})::INT ELSE floor(least({MOST_LOG}, -log10({tail})) / {STEP})::INT END AS bin FROM z4)",
        "m AS (SELECT stratum, bin, count(*) AS n FROM j GROUP BY ALL), a AS (SELECT stratum, sum(n) AS everyone FROM m GROUP BY stratum)",
        "f AS (SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS found FROM m WHERE bin IS NOT NULL)",
        f"l AS (SELECT f.stratum, min(bin) AS least_bin FROM f JOIN a USING (stratum) WHERE pow(10.0, -bin * {STEP}) * everyone <= {FALSE_SHARE} * found GROUP BY f.stratum)",
        f"every AS (SELECT * FROM b UNION ALL SELECT {len(BASE)}, 'random', r, s, e FROM j JOIN l USING (stratum) WHERE bin >= least_bin)",
    ]
    joined = lambda where="true": f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k IS NOT NULL AND {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return ",\n".join(out) + f"\nSELECT doc_id, {counts}, sha256({joined(f'k < {len(BASE)}')}) AS base_sha256, {joined()} AS spans FROM d LEFT JOIN every USING (r) GROUP BY d.r, doc_id"


SQL = _sql()
QUERIES = {"op10_secret_randomness": op10_secret_randomness}
ORACLES = {"op10_secret_randomness": SQL}
