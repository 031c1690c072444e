"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The cells' weights are raked to the targets of
each margin in turn until all margins hold; a document is then kept with the probability that brings the expected
tokens of its cell to the cell's weight of the budget, and to all it has where that isn't
enough. Built from DataFrame functions only; what moves are cells, never documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.llm.common import as_row, whole_text, words_of
from inkweave.llm.spans import let
from inkweave.session import cut_lineage, read_table

DIMENSIONS = ("source", "lang", "topic")
#: The target of a value is in proportion to its tokens to this power, where no targets are given.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.5}
#: Raking ends when no margin is further from its targets than this, and goes on for so many rounds of all margins at most.
TOLERANCE, MOST_ROUNDS = 1e-9, 100
#: Rounds after which the margins are measured; the share of all tokens that is kept; what the draws depend on besides the id.
ROUNDS, BUDGET, SEED = 5, 0.5, "mix-1"
#: Most cells that are raked in one partition, and most cells that are broadcast to the documents; more are joined by a shuffle.
CELLS, BROADCAST_CELLS = 50_000, 200_000
NONE = "(none)"
#: Topics and words of theirs in four languages; a text is of the topic that most of its words name.
TOPIC_WORDS = {
    "contact": "mail call phone tel contact telefon anruf adresse appelez courriel llame correo", "legal": "license licensed copyright terms law lizenz recht gesetz licence droit loi licencia derecho ley",
    "software": "code token password secret key api server software file http https passwort datei fichier serveur archivo clave", "money": "card account bank price market money iban konto preis geld compte prix argent cuenta precio dinero",
    "science": "research study data theory science energy forschung studie wissenschaft recherche science ciencia estudio", "health": "health patient doctor medicine disease gesundheit arzt krankheit santé médecin maladie salud médico",
    "school": "school student teacher learn university schule lehrer lernen école élève apprendre escuela alumno", "public": "government minister election party state regierung wahl partei gouvernement parti gobierno partido",
}
GENERAL = "general"
ALL_WORDS = sorted({w for words in TOPIC_WORDS.values() for w in words.split()})


def topic_of(text: Column) -> Column:
    """A topic by content, for tables without one: that of which most words are there, the first named on ties, or general."""
    hits = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*ALL_WORDS))

    def named(own: Column, words: list[str]) -> Column:
        return F.size(F.filter(own, lambda w: w.isin(*words)))

    def best(own: Column) -> Column:
        # the greatest by count, then by the order of the topics
        counts = [F.struct(named(own, of.split()).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, (t, of) in enumerate(TOPIC_WORDS.items())]
        return F.when(F.size(own) > 0, F.greatest(*counts)["topic"]).otherwise(GENERAL)

    return let(hits, best)


def described(rows: DataFrame, text: Column, topic: Column | None = None) -> DataFrame:
    """rows with n_tokens (words, none for an empty text) and k_topic, for which null is a value; repeated rows stay."""
    topic = F.coalesce(topic, F.lit(NONE)) if topic is not None else topic_of(text)
    return rows.withColumns({"n_tokens": F.size(words_of(text)).cast("long"), "k_topic": topic})


def cell_sums(rows: DataFrame) -> DataFrame:
    """(k_source, k_lang, k_topic, tokens): the cells that have tokens; repeated rows count each, an empty table has none."""
    return rows.groupBy(*[f"k_{d}" for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def margin_targets(cells: DataFrame, dimension: str, given: DataFrame | None = None) -> DataFrame:
    """(key, target) of one margin, summing to one over the values that have tokens.

    given has (value, share), a value's repeated rows added up and null a value of its own; values
    without tokens are left out, values it lacks get nothing.
    """
    key = f"k_{dimension}"
    sums = cells.groupBy(key).agg(F.sum("tokens").alias("t"))
    if given is None:
        raw = sums.select(key, F.pow(F.col("t").cast("double"), TEMPER[dimension]).alias("raw"))
    else:
        shares = given.groupBy(F.coalesce(F.col("value"), F.lit(NONE)).alias(key)).agg(F.sum("share").cast("double").alias("raw"))
        raw = sums.join(shares, key, "left").select(key, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(key, (F.col("raw") / total).alias("target"))


def residual(cells: DataFrame) -> float:
    """How far the raked cells' margins are from their targets at most."""
    worst = [cells.groupBy(f"k_{d}").agg(F.sum("w").alias("have"), F.max(f"t_{d}").alias("t")).agg(F.max(F.abs(F.col("have") - F.col("t"))).alias("r")) for d in DIMENSIONS]
    return max(float(r[0] or 0.0) for df in worst for r in df.collect())  # a row for each dimension


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """cells with w, their weights: tokens' shares raked to each margin's targets in turn until all of them hold.

    Margins are measured every so many rounds. Targets that no weights fulfil, such as those of
    values that only occur together, never come within the tolerance: after most_rounds the weights
    stay as they are and a warning tells the residual. Null is a value like others, cells without
    tokens aren't there, an empty table gives an empty one.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    keys = [f"k_{d}" for d in DIMENSIONS]
    now = cells.select(*keys, "tokens", (F.col("tokens") / F.lit(total)).alias("w"))
    for d in DIMENSIONS:
        now = now.join(targets[d].withColumnRenamed("target", f"t_{d}"), f"k_{d}")
    few = cells.count() <= CELLS
    now = cut_lineage(now.coalesce(1) if few else now)
    done, left = 0, None
    while done < most_rounds and (left is None or left > tolerance):
        for _ in range(min(rounds, most_rounds - done)):
            for d in DIMENSIONS:
                if few:  # a bounded table in one partition: nothing moves
                    have = F.sum("w").over(Window.partitionBy(f"k_{d}"))
                    now = now.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{d}"), have), F.lit(0.0)))
                else:  # sums of each value are added up before they move, however many cells it has
                    sums = now.groupBy(f"k_{d}").agg(F.sum("w").alias("have"))
                    now = now.join(sums, f"k_{d}").withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{d}"), F.col("have")), F.lit(0.0))).drop("have")
                    now = cut_lineage(now)
            done += 1
        now = cut_lineage(now.coalesce(1)).coalesce(1) if few else now
        left = residual(now)
    if left is not None and left > max(tolerance, 1e-6):
        warnings.warn(f"margins are up to {left:.2g} from their targets after {done} rounds", stacklevel=2)
    return now.select(*keys, "tokens", "w")


def with_probability(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """raked cells with probability: min(1, level * w / tokens), level such that the budget's tokens are expected.

    The level rises as full cells drop out of it, until none is added: at most a step for every
    cell, a few in practice. Cells of one ratio of weight to tokens fill up together. Where weights
    don't reach the budget every cell with weight is taken whole; an empty table gives an empty one.
    """
    cells = cells.withColumn("r", F.col("w") / F.col("tokens"))
    aim = budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        whole = F.col("r") * level >= 1
        m = cells.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("held"), F.sum(F.when(whole, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if m["n"] is None or m["n"] == full or not m["open"]:
            break
        full, level = m["n"], max(level, (aim - float(m["held"] or 0)) / m["open"])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("r") * level)).drop("r")


def draw(key: Column) -> Column:
    """An even number from 0 to 1 that depends on a document's key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _keys(docs: DataFrame, topic_col: str | None) -> tuple[dict[str, Column], Column | None]:
    own = {f"k_{d}": F.coalesce(docs[d].cast("string"), F.lit(NONE)) for d in ("source", "lang")}
    return own, docs[topic_col].cast("string") if topic_col else None


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """(row, id, k_source, k_lang, k_topic, n_tokens, probability, kept) for each row of docs; row has all its columns.

    Null sources, languages and topics are values of their own. A document without words adds
    nothing to its cell and shares its probability, none where the cell has no words at all.
    Rows with one id are kept or dropped together; rows without an id are drawn by their text.
    An empty table gives an empty one. targets maps dimensions to (value, share) tables.
    """
    own, topic = _keys(docs, topic_col)
    given = targets or {}

    def rows(base: DataFrame) -> DataFrame:
        return described(base, F.col("text"), F.col("topic_given") if topic is not None else None)

    extra = dict(own, text=whole_text(docs[text_col])) | ({"topic_given": topic} if topic is not None else {})
    slim = docs.select(*[c.alias(n) for n, c in extra.items()])
    cells = cut_lineage(cell_sums(rows(slim)))
    fitted = raked(cells, {d: margin_targets(cells, d, given.get(d)) for d in DIMENSIONS})
    keys = [f"k_{d}" for d in DIMENSIONS]
    shares = cut_lineage(with_probability(fitted, budget).select(*keys, "probability"))
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_CELLS else shares
    full = rows(as_row(docs, id=docs[id_col], **extra))
    full = full.join(shares, keys, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    key = F.coalesce(F.col("id").cast("string"), F.md5(F.col("text").cast("binary")))
    return full.withColumn("kept", draw(key) < F.col("probability")).select("row", "id", *keys, "n_tokens", "probability", "kept")


def sampled_documents(docs: DataFrame, **more) -> DataFrame:
    """The rows of docs that are drawn, all columns as they are."""
    return mixed(docs, **more).where("kept").select("row.*")


def op7_mix_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("k_source").alias("source"), F.col("k_lang").alias("lang"), F.col("k_topic").alias("topic"),
        "n_tokens", F.round("probability", 6).alias("probability"), "kept",
    )


#: Rounds of the SQL twin, which can't measure: more than the test tables take.
SQL_ROUNDS = 25


def _sql() -> str:
    w = r"[\x20\x09-\x0D]+"
    quoted = lambda ws: ", ".join(f"'{x}'" for x in ws)
    words = quoted(ALL_WORDS)
    counts = ", ".join(f"len(list_filter(hits, lambda x: list_contains([{quoted(of.split())}], x))) AS c_{t}" for t, of in TOPIC_WORDS.items())
    topics = " ".join(f"WHEN c_{t} = most THEN '{t}'" for t in TOPIC_WORDS)
    out = [
        f"WITH d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,"
        f" len(list_filter(regexp_split_to_array(coalesce(text, ''), '{w}'), lambda x: x <> '')) AS n_tokens FROM documents)",
        f"h AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: list_contains([{words}], x)) AS hits FROM d)",
        f"t AS (SELECT *, CASE WHEN len(hits) = 0 THEN '{GENERAL}' {topics} END AS topic FROM (SELECT *, {counts}, greatest({', '.join(f'c_{t}' for t in TOPIC_WORDS)}) AS most FROM h))",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS w FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMENSIONS:
        out.append(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {TEMPER[d]}) / sum(pow(sum(tokens), {TEMPER[d]})) OVER () AS target FROM w0 GROUP BY {d})")
    n = 0
    for _ in range(SQL_ROUNDS):
        for d in DIMENSIONS:
            out.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * target / sum(w) OVER (PARTITION BY {d}) AS w FROM w{n} JOIN g_{d} USING ({d}))")
            n += 1
    out += [
        f"r AS MATERIALIZED (SELECT *, w / tokens AS r, row_number() OVER (ORDER BY w / tokens DESC, source, lang, topic) AS i FROM w{n})",
        f"levels AS (SELECT i, r, ({BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
        " / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r)",
        "chosen AS (SELECT level FROM levels WHERE level * r < 1 ORDER BY i LIMIT 1)",
        "p AS (SELECT source, lang, topic, least(1.0, r * coalesce((SELECT level FROM chosen), 1e300)) AS probability FROM r)",
        "j AS (SELECT t.*, coalesce(probability, 0.0) AS probability FROM t LEFT JOIN p USING (source, lang, topic))",
    ]
    u = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text))), 1, 13))::BIGINT / 4503599627370496.0"
    return ",\n".join(out) + f"\nSELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(probability, 6) AS probability, {u} < probability AS kept FROM j"


SQL = _sql()
QUERIES = {"op7_mix_ipf": op7_mix_ipf}
ORACLES = {"op7_mix_ipf": SQL}
