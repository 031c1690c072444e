"""Queries over texts: tokens, lines, sentences, chunks, lint, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.functions import lexicon as lx
from inkweave.functions import text as tx
from inkweave.operators import search as se
from inkweave.plans.retrieval import BM25
from inkweave.session import read_table

TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
LINES = (
    "WITH l AS (SELECT doc_id, length(text) AS length, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),"
    " o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM l),"
    " k AS (SELECT doc_id, length, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS idx, s AS start, (s + length(raw))::INTEGER AS \"end\", trim(raw) AS line FROM o WHERE trim(raw) <> '')"
)


@query("query_terms", f"SELECT item_id, array_to_string(list_slice(list_distinct_ordered, 1, 24), ' ') AS terms FROM (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT item_id, {TERMS.replace('lower({0})', 'strip_accents(lower({0}))').format('text')} AS t FROM benchmark))")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", F.array_join(tx.search_terms(F.col("text"), 24), " ").alias("terms"))


@query(
    "snippet_window",
    BM25 % "true" + f", j AS (SELECT r.item_id, r.doc_id, d.text, list_extract({TERMS.format('b.text')}, 3) AS term FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON r.item_id = b.item_id WHERE rank <= 5)"
    " SELECT item_id, doc_id, term, CASE WHEN instr(lower(text), term) > 0 THEN substr(text, greatest(1, instr(lower(text), term) - 50), 200) ELSE substr(text, 1, 200) END AS snippet FROM j",
)
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    """The passages of every item's five best documents."""
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "benchmark")
    found = se.bm25(docs, items, "doc_id", "item_id", 5).select("item_id", "doc_id")
    both = found.join(items.select("item_id", F.get(tx.terms(F.col("text")), F.lit(2)).alias("term")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return both.select("item_id", "doc_id", "term", tx.snippet(F.col("text"), F.col("term")).alias("snippet"))


@query("line_spans", LINES + ' SELECT doc_id, idx, start, "end", line FROM k')
def line_spans(spark: SparkSession, d: str) -> DataFrame:
    return tx.line_spans(read_table(spark, d, "documents"), "doc_id")


@query("boundary_spans", LINES + ", b AS (SELECT * FROM k WHERE length(line) >= 60) SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length)::INTEGER AS until FROM b")
def boundary_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    spans = tx.line_spans(docs, "doc_id").where("length(line) >= 60").join(docs.select("doc_id", F.length("text").alias("length")), "doc_id")
    return tx.next_boundaries(spans, "doc_id").select("doc_id", "start", "until")


@query(
    "profile_blocks",
    LINES + ", f AS (SELECT doc_id, idx, contains(line, ' | ') AS hit FROM k), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM f),"
    " r AS (SELECT doc_id, island, count(*) AS n, min(idx) AS first_line FROM g WHERE hit GROUP BY ALL) SELECT doc_id, n AS run_length, first_line, n >= 3 AS is_profile FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_line) = 1",
)
def profile_blocks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("idx")
    hit = F.col("line").contains(" | ")
    flagged = tx.line_spans(read_table(spark, d, "documents"), "doc_id").select("doc_id", "idx", hit.alias("hit"))
    islands = flagged.withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w)).where("hit")
    runs = islands.groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.min("idx").alias("first_line"))
    best = runs.groupBy("doc_id").agg(F.min_by(F.struct("n", "first_line"), F.struct(-F.col("n"), F.col("first_line"))).alias("b"))
    return best.select("doc_id", F.col("b.n").alias("run_length"), "b.first_line", (F.col("b.n") >= 3).alias("is_profile"))


def _sentences_sql() -> str:
    """Stops that end no sentence are masked, the rest is cut behind its enders and their closers."""
    mask, blanks = "\x01", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
    enders = lx.SENTENCE_ENDS.replace("\n", "")
    known = "|".join(a[:-1].replace(".", "\\.") for a in lx.ABBREVIATIONS)
    apart = rf"(^|[^\p{{L}}\p{{N}}_.{mask}])"
    closers = "".join("''" if c == "'" else f"\\{c}" if c in "]})" else c for c in dict.fromkeys(lx.SENTENCE_CLOSERS + enders))
    masked = "text"
    for _ in range(2):
        masked = rf"regexp_replace({masked}, '([0-9])\.([0-9])', '\1{mask}\2', 'g')"
    masked = rf"regexp_replace({masked}, '{apart}((?i:{known}|[0-9]+(?:st|nd|rd|th)))\.', '\1\2{mask}', 'g')"
    masked = rf"regexp_replace({masked}, '{apart}([A-Za-z])\.(\p{{Lu}})', '\1\2{mask}\3', 'g')"
    piece = rf"[^\n{enders}]*(?:\n|[{enders}][{closers}]{{0,{lx.MOST_CLOSERS}}})|[^\n{enders}]+$"
    return (
        f"WITH p AS (SELECT doc_id, text, regexp_extract_all({masked}, '{piece}') AS ps FROM documents),"
        " u AS (SELECT doc_id, text, unnest(ps) AS raw, unnest(range(1, len(ps) + 1)) AS i FROM p),"
        " o AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM u),"
        " c AS (SELECT doc_id, i, pos, substr(text, pos + 1, length(raw)) AS raw FROM o),"
        f" t AS (SELECT doc_id, i, pos + length(raw) - length(ltrim(raw, {blanks})) AS s, trim(raw, {blanks}) AS sentence FROM c WHERE trim(raw, {blanks}) <> '')"
        ' SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS idx, s::INTEGER AS start, (s + length(sentence))::INTEGER AS "end", sentence FROM t'
    )


@query("sentence_segments", _sentences_sql())
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return tx.sentence_table(read_table(spark, d, "documents"), "doc_id")


#: Blocks up to blank lines, cut one after the other at the last sentence end or line end of their first 1200 characters, then joined from the left.
CHUNKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:\n\s*\n|\n?\z)') AS ms FROM documents),
b AS (SELECT doc_id, i, ms[i] AS m, coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a FROM d, unnest(range(1, len(ms) + 1)) u(i)),
blocks AS (SELECT doc_id, i, a, a + length(m) - CASE WHEN m LIKE '%' || chr(10) AND NOT regexp_matches(m, '\n\s*\n\z') THEN 1 ELSE 0 END AS b FROM b WHERE trim(m, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
cut AS (SELECT doc_id, i, a, a AS s, NULL::BIGINT AS e, b FROM blocks
 UNION ALL SELECT doc_id, i, a, e0, CASE WHEN b - e0 > 1200 THEN e0 + coalesce(nullif(greatest(length(regexp_extract(w, '(?s)^(.*[.!?。！？]\s+)', 1)), length(regexp_extract(w, '(?s)^(.*\n)', 1))), 0), 1200) ELSE b END, b
  FROM (SELECT c.doc_id, i, a, b, coalesce(e, s) AS e0, substr(d.text, coalesce(e, s) + 1, 1200) AS w FROM cut c JOIN d ON d.doc_id = c.doc_id WHERE e IS NULL OR e < b)),
pieces AS (SELECT doc_id, list([[s, e]] ORDER BY s) AS ps FROM cut WHERE e IS NOT NULL GROUP BY doc_id),
merged AS (SELECT doc_id, list_reduce(ps, lambda o, x: CASE WHEN (x[1][2] - x[1][1] < 240 OR o[len(o)][2] - o[len(o)][1] < 240) AND x[1][2] - o[len(o)][1] <= 1600
 THEN list_concat(o[1:len(o) - 1], [[o[len(o)][1], x[1][2]]]) ELSE list_concat(o, x) END) AS ps FROM pieces)
SELECT doc_id, (j - 1)::INTEGER AS idx, ps[j][1]::INTEGER AS start, ps[j][2]::INTEGER AS "end" FROM (SELECT d.doc_id, coalesce(ps, [[0, length(text)]]) AS ps FROM d LEFT JOIN merged m ON m.doc_id = d.doc_id), unnest(range(1, len(ps) + 1)) u(j)
"""


@query("chunks", CHUNKS)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return tx.chunk_table(read_table(spark, d, "documents"), "doc_id")


COUNTED = {"double-space": " {2,}", "many-blank-lines": "\\n{3,}", "space-before-punct": "[\\t ]+[,.;:!?]", "repeated-punct": "!{2,}|[?]{2,}", "ellipsis": "\\.{4,}"}


@query(
    "proofread_lint",
    " UNION ALL ".join(f"SELECT '{r}' AS rule, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS docs FROM documents HAVING n > 0" for r, p in COUNTED.items()),
)
def proofread_lint(spark: SparkSession, d: str) -> DataFrame:
    found = tx.lint_table(read_table(spark, d, "documents"), "doc_id").where(F.col("rule").isin(*COUNTED))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(
    "header_classify",
    LINES + ", h AS (SELECT CASE WHEN length(line) > 120 THEN NULL WHEN regexp_matches(line, '^[0-9]{1,5}\\.([^0-9]|$)') THEN 'numbered_title' WHEN regexp_matches(line, '^[0-9]{1,5}$') THEN 'standalone'"
    " WHEN regexp_matches(line, '-[0-9]{1,5}$') THEN 'dash_number' WHEN length(line) <= 40 THEN 'short' END AS kind FROM k) SELECT kind, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY kind",
)
def header_classify(spark: SparkSession, d: str) -> DataFrame:
    lines = tx.line_spans(read_table(spark, d, "documents"), "doc_id")
    kind = F.coalesce(tx.header_kind(F.col("line")), F.when(F.length("line") <= 40, "short"))
    return lines.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("episode_number", "SELECT page_id, try_cast(nullif(regexp_extract(url, '[0-9]+'), '') AS INTEGER) AS episode FROM pages")
def episode_number(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", tx.episode_number(F.lit(None).cast("string"), F.col("url")).alias("episode"))


@query(
    "typed_validation",
    "SELECT p_partkey, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 'type' WHEN try_cast(v AS DOUBLE) < 2 THEN 'min' WHEN try_cast(v AS DOUBLE) > 40 THEN 'max' END AS error FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_size::VARCHAR END AS v FROM part)",
)
def typed_validation(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return read_table(spark, d, "part").select("p_partkey", tx.typed_error(v, F.lit("int"), F.lit(2.0), F.lit(40.0)).alias("error"))


@query(
    "source_header_stats",
    LINES + " SELECT source, count(*) AS lines, median(length(line)) AS median_length, max(length(line)) AS longest FROM k JOIN documents USING (doc_id) GROUP BY source",
)
def source_header_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    lines = tx.line_spans(docs, "doc_id").select("doc_id", F.length("line").alias("n")).join(docs.select("doc_id", "source"), "doc_id")
    return lines.groupBy("source").agg(F.count("*").alias("lines"), F.median("n").alias("median_length"), F.max("n").alias("longest"))
