"""Queries of rules, facts and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.functions.text import slot_tokens
from inkweave.operators import relational as rel
from inkweave.operators import verdicts as vd
from inkweave.operators.search import reliability
from inkweave.session import cut_lineage, read_table

RULES = (
    vd.Rule("license", r"(?:Licensed|Released|licensed) under (?:the )?([A-Z][A-Za-z0-9 .-]*[A-Za-z0-9])", 20, "strip", ("icensed under", "Released under")),
    vd.Rule("address", r"([a-z0-9]+\.[0-9]+@mail[0-9]\.example\.com)", 12, "lower", ("@mail",)),
    vd.Rule("host", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 10, "strip", (".",)),
    vd.Rule("phone", r"\+1 \(([0-9]{3})\) 555", 9, "int", ("555",)),
)
VALUE = "nullif(regexp_extract(text, '{0}', 1), '')"
CLAIMS = "WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{r.slot}' AS slot, {'lower' if r.transform == 'lower' else 'trim'}({VALUE.format(r.pattern)}) AS value FROM documents" for r in RULES) + "), claims AS (SELECT * FROM c WHERE value IS NOT NULL)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return vd.extracted(read_table(spark, d, "documents"), RULES, ["doc_id", "source"])


@query("rule_extract", CLAIMS + " SELECT doc_id, slot, value, 0.85::DOUBLE AS confidence FROM claims")
def rule_extract(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("doc_id", "slot", "value", "confidence")


FACTS = ", n AS (SELECT source AS entity_id, slot, value, count(*) AS n FROM claims GROUP BY ALL), facts AS (SELECT entity_id, slot, value, n FROM n QUALIFY row_number() OVER (PARTITION BY entity_id, slot ORDER BY n DESC, value) = 1)"


def _facts(claims: DataFrame) -> DataFrame:
    counted = claims.groupBy(F.col("source").alias("entity_id"), "slot", "value").agg(F.count("*").alias("n"))
    best = rel.first_written(counted.withColumn("o", -F.col("n")), ["entity_id", "slot"], ["o", "value"]).drop("o")
    return best.withColumn("fact_id", F.concat_ws("/", "entity_id", "slot"))


@query("explicit_facts", CLAIMS + FACTS + " SELECT entity_id, slot, value, n FROM facts")
def explicit_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(_claims(spark, d)).select("entity_id", "slot", "value", "n")


TOK = "list_distinct(list_transform(regexp_extract_all(lower({0}), '[0-9A-Za-z가-힣]+'), lambda x: x))"
NORM = "regexp_replace(lower({0}), '[\\s\"''“”‘’]+', '', 'g')"
DIG = "list_sort(list_distinct(regexp_extract_all({0}, '[0-9]+')))"


def _compare_sql(rows: str, a: str, b: str) -> str:
    """Text slots without Korean suffixes, that aren't times or places."""
    ta, tb = TOK.format(a), TOK.format(b)
    return (
        f"SELECT *, CASE WHEN {NORM.format(a)} = '' OR {NORM.format(b)} = '' THEN NULL WHEN {NORM.format(a)} = {NORM.format(b)} THEN 'OK'"
        f" WHEN len({DIG.format(a)}) > 0 AND len({DIG.format(b)}) > 0 AND {DIG.format(a)} <> {DIG.format(b)} THEN NULL"
        f" WHEN len(list_intersect({ta}, {tb})) > 0 AND (len({ta}) = 1) <> (len({tb}) = 1) AND greatest(len({ta}), len({tb})) >= 2 THEN"
        f" CASE WHEN greatest(len({ta}), len({tb})) <= 3 AND CASE WHEN len({ta}) = 1 THEN list_extract(regexp_extract_all(lower({b}), '[0-9A-Za-z가-힣]+'), -1) = {ta}[1] ELSE list_extract(regexp_extract_all(lower({a}), '[0-9A-Za-z가-힣]+'), -1) = {tb}[1] END THEN 'OK' END"
        f" WHEN len(list_intersect({ta}, {tb})) > 0 AND len(list_intersect({ta}, {tb})) / greatest(least(len({ta}), len({tb})), 1) >= 0.85 THEN 'OK'"
        f" WHEN len(list_intersect({ta}, {tb})) = 0 AND (len({ta}) = 1 OR len({tb}) = 1) THEN 'VIOLATE' END AS outcome FROM {rows}"
    )


@query("compare_slots", "WITH p AS (SELECT p_partkey, p_name AS claimed, p_type || ' ' || split_part(p_name, ' ', 2) AS fact FROM part), o AS (" + _compare_sql("p", "claimed", "fact") + ") SELECT p_partkey, outcome FROM o")
def compare_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("claimed"), F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("fact"))
    return vd.with_outcome(rows, "job", "claimed", "fact").select("p_partkey", "outcome")


VERDICTS = (
    CLAIMS + FACTS + ", j AS (SELECT claims.*, f.value AS fact_value FROM claims JOIN facts f ON f.entity_id = claims.source AND f.slot = claims.slot), o AS (" + _compare_sql("j", "value", "fact_value") + "),"
    " v AS (SELECT o.doc_id, o.source, o.slot, o.value, CASE outcome WHEN 'OK' THEN 'OK' WHEN 'VIOLATE' THEN 'VIOLATE' ELSE 'UNKNOWN' END AS verdict, CASE WHEN outcome IS NULL THEN 'SLOT_UNCOMPARABLE' ELSE '' END AS reasons,"
    " n.evidence, s.confirmed FROM o JOIN (SELECT source, slot, count(*) AS evidence FROM claims GROUP BY ALL) n ON n.source = o.source AND n.slot = o.slot JOIN (SELECT source, slot, value, count(*) AS confirmed FROM claims GROUP BY ALL) s ON s.source = o.source AND s.slot = o.slot AND s.value = o.value),"
    " e AS (SELECT *, 0.45 * least(1.0, evidence / 3.0) + 0.25 * least(1.0, confirmed / evidence) + 0.20 * 0.5 AS ev FROM v),"
    " x AS (SELECT *, 0.65 * ev + 0.35 * CASE verdict WHEN 'UNKNOWN' THEN 0.10 + 0.30 * ev WHEN 'VIOLATE' THEN 0.55 + 0.45 * ev ELSE 0.50 + 0.45 * ev END AS r FROM e),"
    " verdicts AS (SELECT doc_id, slot, value, verdict, reasons, evidence, confirmed, round(CASE WHEN verdict = 'UNKNOWN' THEN least(r, 0.45) ELSE least(1.0, r) END + 1e-9, 6) AS reliability FROM x)"
)


def _claims_once(spark: SparkSession, d: str) -> DataFrame:
    """The claims for what needs them several times: texts are read and searched once."""
    return cut_lineage(_claims(spark, d).drop("confidence"))


def _verdicts(claims: DataFrame) -> DataFrame:
    facts = _facts(claims).select("slot", "entity_id", "value", "fact_id")
    found = vd.judged(claims.withColumnRenamed("source", "entity"), facts, ["doc_id"])
    evidence = claims.groupBy(F.col("source").alias("entity"), "slot").agg(F.count("*").alias("evidence"))
    confirmed = claims.groupBy(F.col("source").alias("entity"), "slot", "value").agg(F.count("*").alias("confirmed"))
    found = found.join(evidence, ["entity", "slot"]).join(confirmed, ["entity", "slot", "value"])
    score = reliability(F.col("verdict"), F.col("evidence"), F.col("confirmed"), F.lit(0.5), F.lit(0.0))
    return found.select("doc_id", "slot", "value", "verdict", "reasons", "evidence", "confirmed", F.round(score + 1e-9, 6).alias("reliability"))


@query("fact_verdicts", VERDICTS + " SELECT * FROM verdicts")
def fact_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What documents state, held against what most documents of their source state: facts alone, nothing is searched for."""
    return _verdicts(_claims_once(spark, d))


@query("consistency_loop", VERDICTS + " , u AS (SELECT * FROM verdicts WHERE verdict = 'UNKNOWN') SELECT doc_id, slot, value, evidence >= 3 AS wider FROM u")
def consistency_loop(spark: SparkSession, d: str) -> DataFrame:
    """Claims that facts leave open, and whether their source has enough evidence."""
    return _verdicts(_claims_once(spark, d)).where("verdict = 'UNKNOWN'").select("doc_id", "slot", "value", (F.col("evidence") >= 3).alias("wider"))


@query(
    "stored_verdicts",
    VERDICTS + ", k AS (SELECT *, 'v_' || substr(sha1(doc_id || '|' || slot), 1, 20) AS vid FROM verdicts) SELECT k.slot, k.verdict, count(*) AS n, count(*) FILTER (WHERE k.verdict <> 'UNKNOWN') AS linked, min(vid) AS first_vid FROM k GROUP BY ALL",
)
def stored_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and their links to facts, stored by slot and read again."""
    from inkweave.session import shared_folder

    claims = _claims_once(spark, d)
    path = f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex}"
    vd.store_verdicts(cut_lineage(_verdicts(claims)), claims.select("doc_id", F.concat_ws("/", "source", "slot").alias("fact_id"), "slot"), path)
    log, links = (spark.read.parquet(f"{path}/{t}") for t in ("verdict_log", "verdict_evidence_link"))
    linked = links.groupBy("vid").agg(F.count("*").alias("k"))
    return log.join(linked, "vid", "left").groupBy("slot", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 0).alias("linked"), F.min("vid").alias("first_vid"))


@query(
    "ingest_facts",
    "WITH a AS (SELECT p_name AS entity_id, 'attr/p_brand' AS tag_path, p_brand AS value, CASE WHEN p_partkey % 4 = 0 THEN 'USER' ELSE 'AUTO' END AS created_by FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_name AS entity_id, unnest(['attr/p_brand', 'attr/p_type']) AS tag_path, unnest([p_brand, p_type]) AS value FROM part),"
    " g AS (SELECT entity_id, tag_path, value, CASE WHEN created_by = 'USER' THEN 'APPROVED' ELSE 'PROPOSED' END AS status, CASE WHEN created_by = 'USER' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, 'assignment' AS source FROM a UNION ALL"
    " SELECT entity_id, tag_path, value, 'PROPOSED', 0.85, 'extracted' FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity_id = f.entity_id AND a.tag_path = f.tag_path) UNION ALL SELECT NULL, 'attr/mood', 'unknown', 'PROPOSED', 0.1, 'implicit')"
    " SELECT tag_path, status, source, count(*) AS n, count(DISTINCT value) AS n_values, round(avg(confidence), 6) AS confidence FROM g GROUP BY ALL",
)
def ingest_facts(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    given = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("entity_id"), F.lit("attr/p_brand").alias("tag_path"), F.col("p_brand").alias("value"), F.when(F.col("p_partkey") % 4 == 0, "USER").otherwise("AUTO").alias("created_by"))
    found = rel.attributes_as_facts(part, "p_name", ["p_brand", "p_type"]).withColumn("confidence", F.lit(0.85))
    tags = spark.createDataFrame([("attr/p_brand",), ("attr/p_type",), ("attr/mood",)], "tag_path string")
    out = vd.ingested(given, found, tags)
    return out.groupBy("tag_path", "status", "source").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("incremental_skip", "SELECT doc_id, sha256(text) AS checksum FROM documents WHERE NOT (doc_id % 3 = 0) OR doc_id % 5 = 0")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    current = read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    known = current.where("doc_id % 3 = 0").withColumn("checksum", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("checksum")))
    return vd.changed(current, known, "doc_id")


@query(
    "inject_quality",
    "WITH p AS (SELECT p_partkey, p_size AS original, (p_size * 7 + 3) % 50 AS injected, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS subject FROM part)"
    " SELECT p_partkey, CASE WHEN subject IS NULL THEN 'contextless_append' WHEN subject = p_name THEN 'ambiguous_subject' WHEN original = injected THEN 'no_conflict' ELSE 'clear_conflict' END AS label FROM p",
)
def inject_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select("p_partkey", F.col("p_size").alias("original"), ((F.col("p_size") * 7 + 3) % 50).alias("injected"), "p_name", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("subject"))
    outcome = vd.compared(F.lit("age"), F.col("original").cast("string"), F.col("injected").cast("string"))
    label = F.when(F.col("subject").isNull(), "contextless_append").when(F.col("subject") == F.col("p_name"), "ambiguous_subject").when(outcome == "OK", "no_conflict").otherwise("clear_conflict")
    return rows.select("p_partkey", label.alias("label"))


@query("slot_token_counts", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9A-Za-z가-힣]+'))), ' ') AS tokens FROM part")
def slot_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(slot_tokens(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("tokens"))
