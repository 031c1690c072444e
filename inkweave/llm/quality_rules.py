"""Quality rules of documents and of the hosts that they come from.

A document fails by its own counts. Its failures of every rule are summed by host; a host's rate
of each rule is shrunk towards that of all hosts with a beta prior fitted to the hosts' own
rates, and a host of which one rate lies far above those of the others fails with all its
documents. Built from SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import SPACES, as_row, whole_text, words_of
from inkweave.llm.spans import let
from inkweave.session import cut_lineage, read_table

#: Fewest words, most per cent of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Most symbols to 100 characters of words, most repeats among 100 lines, least and most characters of a mean word.
MOST_SYMBOLS, MOST_REPEATED_LINES, WORD_LENGTHS = 10, 30, (2, 12)
#: A host fails where a shrunken rate is surely above this, and above the other hosts' mean by as many of their standard deviations.
LEAST_RATE, DEVIATIONS = 0.3, 2.0
#: Documents that the prior counts for at least, so that one document can't fail its host.
LEAST_STRENGTH = 5.0
#: The rules whose failures are summed by host: conditions on a document's counts. Only the first rejects a document by itself.
RULES = {
    "base": f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words", "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * word_chars",
    "lines": f"100 * n_dup_lines > {MOST_REPEATED_LINES} * n_lines", "word_length": f"word_chars < {WORD_LENGTHS[0]} * n_words OR word_chars > {WORD_LENGTHS[1]} * n_words",
}
#: The host in an address.
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[Ww][Ww][Ww]\.)?([^/?#:]+)"
#: Most hosts whose failures are broadcast; beyond that they are joined by a shuffle.
BROADCAST_HOSTS = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash is there twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda j, k: (F.get(s, k)["h"] == F.get(s, j)["h"])
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).cast("bigint").alias("n"))

    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(let(ordered, places), begin, step, lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the text, the first included.

    Windows are told apart by 64 bits, folded from those of their words.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    twice = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(words) > WINDOW, twice).otherwise(F.lit(0).cast("bigint"))


def counted_lines(text: Column) -> Column:
    """struct(n, twice): lines with a word, and those of them equal to an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    both = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("twice")))
    one = F.struct(F.when(text.rlike(f"[^{SPACES}]"), 1).otherwise(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("twice"))
    return F.when(text.contains("\n"), both).otherwise(one)


def host_of(value: Column) -> Column:
    """The domain of an address, in lower case and without www; other names as they are."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(value, ADDRESS, 1)), F.lit("")), value)


def _counted(rows: DataFrame) -> DataFrame:
    """rows with a text column; adds COUNTS, n_lines and failed, an array with a boolean for each of RULES."""
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", counted_lines(F.col("text")))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("words", "text", "lines")],
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.col("lines.twice").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
    )
    return rows.withColumn("failed", F.array(*map(F.expr, RULES.values()))).withColumn("base_failed", F.get("failed", F.lit(0)))


def host_rates(ruled: DataFrame, host: str = "host") -> DataFrame:
    """(host, n, rate_R and limit_R for each rule R, host_failed) of ruled(host, failed).

    A rule's prior has the mean of the hosts' rates and the variance that is left of theirs
    without what chance explains (method of moments); if none is left, every host has the mean
    rate. A limit is set by the shrunken rates of the other hosts, so a host can't raise its own;
    a single host has none. A host fails if its rate is above its limit by so many deviations of
    what its documents leave unsure; at the limit it passes. Rows without a host are a host of their
    own; an empty table gives an empty one.
    """
    hosts = ruled.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(F.get("failed", F.lit(i))).alias(f"failed_{r}") for i, r in enumerate(RULES)])
    hosts = cut_lineage(hosts)
    raw = {r: F.col(f"failed_{r}") / F.col("n") for r in RULES}
    m = hosts.agg(F.avg(1 / F.col("n")).alias("per"), *[f(raw[r]).alias(f"{k}_{r}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    for r in RULES:
        mean, var, per = (float(m[k] or 0.0) for k in (f"mean_{r}", f"var_{r}", "per"))
        spread = var - mean * (1 - mean) * per  # of the true rates
        strength = mean * (1 - mean) / spread - 1 if spread > 0 and 0 < mean < 1 else 1e9
        strength = min(max(strength, LEAST_STRENGTH), 1e9)
        rate = (F.col(f"failed_{r}") + mean * strength) / (F.col("n") + strength)
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(f"sure_{r}", rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1)))
    sums = hosts.agg(F.count("*").alias("n"), *[f.alias(f"{k}_{r}") for r in RULES for k, f in (("sum", F.sum(f"rate_{r}")), ("square", F.sum(F.col(f"rate_{r}") * F.col(f"rate_{r}"))))]).first()
    others = float(sums["n"] - 1)
    for r in RULES if others > 0 else ():
        rate = F.col(f"rate_{r}")
        mean = (F.lit(float(sums[f"sum_{r}"])) - rate) / others
        var = F.greatest((F.lit(float(sums[f"square_{r}"])) - rate * rate) / others - mean * mean, F.lit(0.0))
        hosts = hosts.withColumn(f"limit_{r}", F.greatest(F.lit(LEAST_RATE), mean + DEVIATIONS * F.sqrt(var)))
    if others <= 0:
        hosts = hosts.withColumns({f"limit_{r}": F.lit(1.0) for r in RULES})
    over = F.array(*[F.col(f"sure_{r}") > F.col(f"limit_{r}") for r in RULES])
    return hosts.select("host", "n", *[f"{k}_{r}" for r in RULES for k in ("rate", "limit")], F.array_contains(over, True).alias("host_failed"))


def _bad_hosts(rows: DataFrame) -> DataFrame:
    bad = cut_lineage(host_rates(rows).where("host_failed").select(F.col("host").alias("bad_host")))
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def ruled_rows(rows: DataFrame) -> DataFrame:
    """rows(host, failed, base_failed, ...) with host_failed and kept: neither the row nor its host failed."""
    bad = _bad_hosts(rows)
    joined = rows.join(bad.withColumn("host_failed", F.lit(True)), rows["host"].eqNullSafe(bad["bad_host"]), "left").drop("bad_host")
    joined = joined.withColumn("host_failed", F.col("host_failed").isNotNull())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, COUNTS, n_lines, failed, base_failed, host_failed, kept) for each row of docs.

    host_col has names or addresses. Null counts as an empty text, which fails; rows without a
    host share one; rows without an id and repeated rows are judged, and counted for their host,
    as they stand. An empty table gives an empty one. Texts are read whole.
    """
    rows = docs.select(docs[id_col].alias("id"), host_of(docs[host_col]).alias("host"), whole_text(docs[text_col]).alias("text"))
    return ruled_rows(cut_lineage(_counted(rows)))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that pass, all columns as they are.

    The texts are read once to sum failures by host and once to filter, so none is shuffled.
    """
    host = host_of(docs[host_col])
    bad = _bad_hosts(_counted(docs.select(host.alias("host"), whole_text(docs[text_col]).alias("text"))).select("host", "failed"))
    rows = _counted(as_row(docs, host=host, text=whole_text(docs[text_col]))).where(~F.col("base_failed"))
    return rows.join(bad, rows["host"].eqNullSafe(bad["bad_host"]), "left_anti").select("row.*")


def op9_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "host_failed")


HOST_SQL = f"coalesce(nullif(lower(regexp_extract(source, '{ADDRESS}', 1)), ''), source)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[{SPACES}]+'), lambda x: x <> '') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
windows AS (SELECT r, i, word, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS full_,
    list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM words),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows WHERE full_ = {WINDOW}),
marked AS (SELECT words.r, words.i, coalesce(max(twice.n) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) AS n
    FROM words LEFT JOIN twice USING (r, i)),
rep AS (SELECT r, count(*) FILTER (WHERE n > 1) AS n_repeat_words FROM marked GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^{SPACES}]') GROUP BY r),
counted AS (SELECT d.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
ruled AS (SELECT *, {HOST_SQL} AS host, {", ".join(f"({c}) AS {r}_failed" for r, c in RULES.items())} FROM counted),
hosts AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {r}_failed) AS {r}" for r in RULES)} FROM ruled GROUP BY host),
rates AS (SELECT {", ".join(f"avg({r} / n) AS m_{r}, var_pop({r} / n) - avg({r} / n) * (1 - avg({r} / n)) * avg(1 / n) AS s_{r}" for r in RULES)} FROM hosts),
fitted AS (SELECT *, {", ".join(f"CASE WHEN s_{r} > 0 AND m_{r} > 0 AND m_{r} < 1 THEN least(greatest(m_{r} * (1 - m_{r}) / s_{r} - 1, {LEAST_STRENGTH}), 1e9) ELSE 1e9 END AS k_{r}" for r in RULES)} FROM rates),
shrunk AS MATERIALIZED (SELECT host, {", ".join(f"({r} + m_{r} * k_{r}) / (n + k_{r}) AS {r}, n + k_{r} + 1 AS n_{r}" for r in RULES)} FROM hosts, fitted),
others AS (SELECT a.host, {", ".join(f"any_value(a.{r} - {DEVIATIONS} * sqrt(a.{r} * (1 - a.{r}) / a.n_{r})) AS {r}, greatest({LEAST_RATE}, avg(b.{r}) + {DEVIATIONS} * sqrt(var_pop(b.{r}))) AS l_{r}" for r in RULES)}
    FROM shrunk a JOIN shrunk b ON a.host IS DISTINCT FROM b.host GROUP BY a.host),
bad AS (SELECT host FROM others WHERE {" OR ".join(f"{r} > l_{r}" for r in RULES)})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed
FROM (SELECT *, EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM ruled.host) AS host_failed FROM ruled)
"""

QUERIES = {"op9_quality_hosts": op9_quality_hosts}
ORACLES = {"op9_quality_hosts": SQL}
