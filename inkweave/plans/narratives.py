"""Queries around chapters and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.operators import narrative as na
from inkweave.operators import search as se
from inkweave.operators import vectors as ve
from inkweave.plans.retrieval import BM25, hashed_sql
from inkweave.plans.texts import LINES
from inkweave.session import cut_lineage, read_table


@query(
    "self_evidence_filter",
    "WITH r AS (SELECT a.conv_id, a.turn AS claim, b.turn AS other, length(b.text) AS e, b.turn * 40 AS s2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id),"
    " x AS (SELECT conv_id, claim, CASE WHEN conv_id % 2 = 0 THEN true ELSE s2 < e AND s2 < claim * 40 + 60 AND claim * 40 < e END AS removed FROM r) SELECT conv_id, claim, count(*) FILTER (WHERE NOT removed) AS kept, count(*) FILTER (WHERE removed) AS removed FROM x GROUP BY ALL",
)
def self_evidence_filter(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "conversations")
    claims = turns.select(F.col("conv_id").alias("claim_doc"), F.col("turn").alias("claim"), (F.col("turn") * 40).alias("cs"), (F.col("turn") * 40 + 60).alias("ce"))
    rows = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 40).alias("s"), F.length("text").cast("long").alias("e")).join(claims, F.col("doc_id") == F.col("claim_doc"))
    out = na.without_self_evidence(rows, F.when(F.col("claim_doc") % 2 == 0, "doc").otherwise("claim"))
    return out.groupBy(F.col("claim_doc").alias("conv_id"), "claim").agg(F.count_if(~F.col("removed")).alias("kept"), F.count_if("removed").alias("removed"))


@query(
    "doc_scope",
    "WITH x AS (SELECT doc_id, source AS project, CASE WHEN doc_id % 97 = 0 THEN 'SETTING' ELSE 'EPISODE' END AS type, n_chars // 10 AS episode FROM documents)"
    " SELECT i.doc_id AS input_id, count(DISTINCT o.doc_id) AS n_docs FROM x i JOIN x o ON i.project = o.project AND (i.doc_id = o.doc_id OR o.type = 'SETTING' OR (o.type = 'EPISODE' AND abs(i.episode - o.episode) <= 10)) GROUP BY i.doc_id",
)
def doc_scope(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 97 == 0, "SETTING").otherwise("EPISODE")
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("project"), kind.alias("type"), F.floor(F.col("n_chars") / 10).alias("episode"))
    return na.doc_scope_sizes(docs, docs.withColumnRenamed("doc_id", "input_id"))


@query("time_value_valid", "SELECT event_id, hh BETWEEN 0 AND 23 AND mm BETWEEN 0 AND 59 AS valid FROM (SELECT event_id, event_id % 30 AS hh, event_id % 70 AS mm FROM events)")
def time_value_valid(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat((F.col("event_id") % 30).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 70).cast("string"), 2, "0"))
    return read_table(spark, d, "events").select("event_id", na.time_value_valid(v).alias("valid"))


PHRASE = "[0-9]{2,}"


@query("timeline_events", LINES + f" SELECT doc_id, idx, line AS label, coalesce(nullif(regexp_extract(line, '{PHRASE}'), ''), substr(line, 1, 40)) AS time_key FROM k")
def timeline_events(spark: SparkSession, d: str) -> DataFrame:
    return na.timeline(read_table(spark, d, "documents"), "doc_id", PHRASE)


@query(
    "timeline_first_match",
    "WITH e AS (SELECT conv_id, turn AS idx, substr(text, 1, 2) AS time_key, text AS label FROM conversations) SELECT c.conv_id, c.turn, min(CASE WHEN contains(c.text, time_key) OR contains(c.text, label) THEN idx END) AS timeline_idx FROM conversations c LEFT JOIN e USING (conv_id) GROUP BY ALL",
)
def timeline_first_match(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "conversations")
    events = turns.select("conv_id", F.col("turn").alias("idx"), F.substring("text", 1, 2).alias("time_key"), F.col("text").alias("label"))
    return na.first_event(turns.select("conv_id", "turn", F.col("text").alias("segment")), events, ["conv_id", "turn"])


@query(
    "alias_join",
    "WITH a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS alias, p_type AS entity_id FROM part), w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS alias FROM part) SELECT p_partkey, entity_id, count(*) AS n FROM w JOIN a USING (alias) GROUP BY ALL",
)
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return na.aliases_in(part, part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("alias"), F.col("p_type").alias("entity_id")), "p_partkey", "p_name")


@query("probe_text", LINES + ', f AS (SELECT doc_id, min((start, "end")) AS a FROM k WHERE length(line) > 30 GROUP BY doc_id) SELECT doc_id, trim(substr(text, greatest(0, a[1] - 24) + 1, a[2] + 48 - greatest(0, a[1] - 24))) AS probe FROM f JOIN documents USING (doc_id)'.replace("a[1]", "struct_extract(a, 1)").replace("a[2]", "struct_extract(a, 2)"))
def probe_text(spark: SparkSession, d: str) -> DataFrame:
    from inkweave.functions.text import line_spans

    docs = read_table(spark, d, "documents")
    anchors = line_spans(docs, "doc_id").where("length(line) > 30").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    return na.probe_text(anchors, docs.select("doc_id", "text"), "doc_id")


@query(
    "graph_trigger",
    BM25 % "true" + ", t AS (SELECT item_id, count(*) AS n, max(1 / (1 + abs(score))) FILTER (WHERE sr = 1) AS top, max(1 / (1 + abs(score))) FILTER (WHERE sr = 2) AS next FROM"
    " (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY 1 / (1 + abs(score)) DESC, doc_id) AS sr FROM r WHERE rank <= 6) GROUP BY item_id) SELECT item_id, n, n < 4 OR top < 0.30 OR top - coalesce(next, 0) < 0.07 AS trigger FROM t",
)
def graph_trigger(spark: SparkSession, d: str) -> DataFrame:
    found = se.bm25(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), "doc_id", "item_id", 6)
    return na.graph_trigger(found.select("item_id", "doc_id", se.base_strength(F.col("score")).alias("strength")), "item_id")


@query("suggest_citations", BM25 % "lang = 'en'" + " SELECT item_id, count(*) AS n, string_agg('[' || rank || '] ' || doc_id, ' ' ORDER BY rank) AS citations FROM r WHERE rank <= 3 GROUP BY item_id")
def suggest_citations(spark: SparkSession, d: str) -> DataFrame:
    found = se.bm25(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), "doc_id", "item_id", 10, F.col("lang") == "en")
    return na.suggestions(found.drop("rank"), "item_id")


@query(
    "inject_text",
    "SELECT item_id, text || chr(10) || chr(10) || '[INJECT]' || chr(10) || CASE item_id % 4 WHEN 0 THEN 'He was ' || item_id || ' years old.' WHEN 1 THEN 'It happened in ' || item_id || '.' WHEN 2 THEN 'She worked as a ' || item_id || '.' ELSE 'He had died by then.' END AS injected FROM benchmark",
)
def inject_text(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, na.INJECTIONS)), (F.col("item_id") % 4 + 1).cast("int"))
    return read_table(spark, d, "benchmark").select("item_id", na.injected(F.col("text"), kind, F.col("item_id").cast("string")).alias("injected"))


@query(
    "episode_split",
    LINES + ", h AS (SELECT doc_id, start, length FROM k WHERE length(line) <= 120 AND (regexp_matches(line, '^[0-9]{1,5}\\.([^0-9]|$)') OR regexp_matches(line, '^[0-9]{1,5}$') OR regexp_matches(line, '-[0-9]{1,5}$'))),"
    " c AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length) AS until, true AS by_header FROM h), b AS (SELECT doc_id, n_chars, length(text) AS length FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)),"
    " p AS (SELECT doc_id, s AS start, least(length, s + 12000) AS until, false AS by_header FROM (SELECT doc_id, length, unnest(range(0, greatest(length, 1), 12000)) AS s FROM b)), e AS (SELECT * FROM c UNION ALL SELECT * FROM p)"
    " SELECT doc_id, start::INTEGER AS start, until::INTEGER AS until, by_header, row_number() OVER (PARTITION BY doc_id ORDER BY start)::INTEGER AS no FROM e",
)
def episode_split(spark: SparkSession, d: str) -> DataFrame:
    return na.episodes(read_table(spark, d, "documents"), "doc_id").select("doc_id", "start", "until", "by_header", "no")


@query("external_records", "SELECT 'ext:tpc:' || s_suppkey AS node_ref, 'ORG' AS node_type, s_name AS label, greatest(0.0, least(1.0, s_acctbal / 5000)) AS confidence FROM supplier")
def external_records(spark: SparkSession, d: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.lit("Supplier").alias("type"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 5000).alias("confidence"), F.lit(" ").alias("label")))
    return na.external_nodes(read_table(spark, d, "supplier").select(record.alias("json")), "tpc")


@query("preferred_cohort", "WITH f AS (SELECT source, doc_id, lang = 'es' AS f FROM documents), m AS (SELECT *, bool_or(f) OVER (PARTITION BY source) AS a FROM f) SELECT source, doc_id FROM m WHERE f OR NOT a")
def preferred_cohort(spark: SparkSession, d: str) -> DataFrame:
    return na.preferred_cohort(read_table(spark, d, "documents").select("source", "doc_id", "lang"), "source", F.col("lang") == "es").select("source", "doc_id")


@query(
    "vector_job_pages",
    BM25 % "lang = 'en'" + ", " + hashed_sql("hd", "doc_id", "documents") + ", " + hashed_sql("hq", "item_id", "benchmark")
    + ", hs AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM hqv q JOIN hdv d USING (b) GROUP BY ALL), hk AS (SELECT * FROM hs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10),"
    " v AS (SELECT item_id, doc_id, score, 'vector' AS source FROM hk JOIN documents USING (doc_id) WHERE lang = 'en'), b AS (SELECT * FROM v UNION ALL SELECT item_id, doc_id, -score, 'fts' FROM r WHERE rank <= 10 AND item_id NOT IN (SELECT item_id FROM v))"
    " SELECT item_id, doc_id, score, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1) // 5 AS page FROM b QUALIFY rank <= 10",
)
def vector_job_pages(spark: SparkSession, d: str) -> DataFrame:
    """Vector search, filtered to English afterwards, full-text results where nothing is left, in pages of five."""
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "benchmark")
    kept = docs.where("lang = 'en'").select("doc_id")
    near = cut_lineage(ve.nearest_texts(docs, items, "doc_id", "item_id", 10)).join(kept, "doc_id", "left_semi").select("item_id", "doc_id", "score", F.lit("vector").alias("source"))
    text = se.bm25(docs, items, "doc_id", "item_id", 10, F.col("lang") == "en").select("item_id", "doc_id", (-F.col("score")).alias("score"), F.lit("fts").alias("source"))
    both = near.unionByName(text.join(near.select("item_id").distinct(), "item_id", "left_anti"))
    return se.top_k(both, "item_id", [F.desc("score"), F.col("doc_id")], 10).withColumn("page", F.floor((F.col("rank") - 1) / 5))


@query(
    "slot_anchor_filter",
    "WITH x AS (SELECT p_partkey, p_name AS value, p_type || ' ' || lag(p_name, 1, '') OVER (PARTITION BY p_brand ORDER BY p_partkey) AS snippet FROM part),"
    " w AS (SELECT *, list_distinct(regexp_extract_all(lower(value), '[\\p{L}\\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(snippet), '[\\p{L}\\p{N}]+')) AS b FROM x)"
    " SELECT p_partkey, contains(replace(lower(snippet), ' ', ''), replace(lower(value), ' ', '')) OR len(list_intersect(a, b)) >= CASE WHEN len(a) <= 1 THEN 1 ELSE 2 END AS kept FROM w",
)
def slot_anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("p_name", 1, "").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("value"), F.concat_ws(" ", "p_type", before).alias("snippet"))
    return rows.select("p_partkey", na.anchored(F.lit("job"), F.col("value"), F.col("snippet")).alias("kept"))


@query(
    "fact_scope",
    "WITH v AS (SELECT c_nationkey AS project, c_mktsegment AS schema_ver, max(c_acctbal) AS created_at FROM customer GROUP BY ALL), n AS (SELECT project, max_by(schema_ver, (created_at, schema_ver)) AS schema_ver FROM v GROUP BY project)"
    " SELECT c_custkey FROM customer JOIN n ON project = c_nationkey AND schema_ver = c_mktsegment WHERE c_acctbal > 0",
)
def fact_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("schema_ver"), F.when(F.col("c_acctbal") > 0, "APPROVED").otherwise("PROPOSED").alias("status"), "c_acctbal")
    versions = rows.groupBy("project", "schema_ver").agg(F.max("c_acctbal").alias("created_at"))
    return na.facts_in_scope(rows, versions).select("c_custkey")


@query(
    "own_facts_excluded",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY l_orderkey",
)
def own_facts_excluded(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "lineitem").withColumn("fact_id", F.monotonically_increasing_id())
    facts = items.select("fact_id", F.col("l_orderkey").alias("evidence_eid"), F.when(F.col("l_returnflag") == "A", "AUTO").otherwise("USER").alias("source"), F.when(F.col("l_linestatus") == "O", "PROPOSED").otherwise("APPROVED").alias("status"))
    orders = read_table(spark, d, "orders")
    evidence = orders.select(F.col("o_orderkey").alias("eid"), F.col("o_orderpriority").alias("doc_id"))
    judged = spark.createDataFrame([("1-URGENT",)], "doc_id string")
    return na.without_own_facts(facts, evidence, judged).groupBy(F.col("evidence_eid").alias("l_orderkey")).agg(F.count("*").alias("n"))


CONFLICTS = {"age": "41", "place": "Harbour", "job": "smith", "death": ""}
SETS = """WITH f AS (SELECT *, md5('bench:' || sha256(trim(coalesce(text, '')))) AS m, min(doc_id) OVER (PARTITION BY trim(coalesce(text, ''))) AS earliest FROM documents),
 s AS (SELECT *, ('0x' || m[1:13])::BIGINT / 4503599627370496.0 AS share FROM f),
 t AS (SELECT doc_id, source, text, doc_id = earliest AS first, CASE WHEN share < 0.1 THEN 'inject' WHEN share < 0.1 + 0.1 THEN 'control' ELSE 'pool' END AS set, ['age', 'death', 'job', 'place'][('0x' || m[14:17])::INTEGER % 4 + 1] AS k FROM s),
 b AS (SELECT doc_id, source, first, set, CASE WHEN set = 'inject' THEN k END AS kind, CASE WHEN set = 'inject' THEN coalesce(text, '') || chr(10) || chr(10) || '[INJECT]' || chr(10)
  || CASE k WHEN 'age' THEN 'He was 41 years old.' WHEN 'place' THEN 'It happened in Harbour.' WHEN 'job' THEN 'She worked as a smith.' ELSE 'He had died by then.' END ELSE text END AS told FROM t)"""


@query("bench_sets", SETS + " SELECT doc_id, set, first, kind, sha256(coalesce(told, '')) AS checksum FROM b")
def bench_sets(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are told a contradiction, which are kept to compare with, and which repeat a text."""
    sets = na.bench_sets(read_table(spark, d, "documents"), "doc_id", "text", CONFLICTS)
    return sets.select("doc_id", "set", "first", "kind", F.sha2(F.coalesce("bench_text", F.lit("")), 256).alias("checksum"))


@query(
    "bench_manifest",
    SETS + " SELECT set, source, count(*) AS n, sum(length(coalesce(told, '')))::BIGINT AS n_chars, (sum(('0x' || md5(doc_id || '|' || sha256(coalesce(told, '')))[1:12])::BIGINT)::HUGEINT % 1000000007)::BIGINT AS checksum FROM b WHERE first GROUP BY ALL",
)
def bench_manifest(spark: SparkSession, d: str) -> DataFrame:
    return na.set_manifest(na.bench_sets(read_table(spark, d, "documents"), "doc_id", "text", CONFLICTS), "doc_id", "source")
