"""Queries of gates, masks, keys, requests and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.functions import text as tx
from inkweave.operators import narrative as na
from inkweave.operators import options as opt
from inkweave.operators import reports as rp
from inkweave.operators import rules
from inkweave.operators.relational import top_rows
from inkweave.session import read_table
from inkweave.sources import files


@query("masked_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' WHEN event_id % 3 = 1 THEN substr(repeat(props, 90), 1, 240) ELSE substr(repeat(props, 90), 1, 800) END AS shown, 'ev_' || substr(sha1(event_type || '|' || user_id), 1, 16) AS stable FROM events")
def masked_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("Api_Key"), F.lit("snippet"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", tx.masked_key(name, F.repeat("props", F.lit(90))).alias("shown"), tx.stable_id("ev_", 16, F.col("event_type"), F.col("user_id").cast("string")).alias("stable"))


@query("memo_keys", "SELECT doc_id, trim(lower(regexp_replace(trim(nfc_normalize(text)), '\\s+', ' ', 'g'))) || '|{\"k\":' || doc_id % 3 || '}' AS key FROM documents")
def memo_keys(spark: SparkSession, d: str) -> DataFrame:
    """A key for each text, however its letters are composed."""
    rows = read_table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", rp.memo_key(F.col("text"), F.concat(F.lit('{"k":'), (F.col("doc_id") % 3).cast("string"), F.lit("}"))).alias("key"))


@query("target_order", "SELECT p_partkey FROM part ORDER BY p_size <= 45, p_size DESC, p_partkey LIMIT 7")
def target_order(spark: SparkSession, d: str) -> DataFrame:
    """The first targets by score; those over 45 come before others, and places among equals are drawn, so one a size is asked for."""
    parts = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 45, F.col("p_size") * 1e6 - F.col("p_partkey")).otherwise(0.0).alias("score"))
    return na.targets(parts, "p_partkey", "score", 7).select("p_partkey")


@query(
    "evidence_bundles",
    "WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rank, l_partkey, l_returnflag FROM lineitem) SELECT l_orderkey, count(*)::INTEGER AS n, '[' || string_agg('{\"doc_id\":\"' || l_partkey || '\",\"snapshot_id\":\"\",\"section_path\":\"\",\"tag_path\":\"\",\"snippet_text\":\"' || l_returnflag"
    " || '\",\"span_start\":0,\"span_end\":0,\"match_type\":\"FUZZY\",\"confirmed\":false}', ',' ORDER BY rank) || ']' AS bundle FROM r WHERE rank <= 3 GROUP BY l_orderkey",
)
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    rows = top_rows(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("doc_id"), F.col("l_returnflag").alias("snippet_text")), ["l_orderkey"], [F.col("l_linenumber"), F.col("doc_id"), F.col("snippet_text")], 3)
    return opt.evidence_bundles(rows, "l_orderkey", 3)


@query("docx_export", "SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS paragraphs, sha256(text) AS checksum FROM documents")
def docx_export(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as word-processor packages and read again."""
    back = files.from_docx(files.as_docx(read_table(spark, d, "documents"), "doc_id"), "doc_id")
    return back.select("doc_id", F.size(F.split("text", "\n", -1)).alias("paragraphs"), F.sha2("text", 256).alias("checksum"))


TOLD_TIME = "day(o_orderdate) || CASE o_orderstatus WHEN 'F' THEN '일 후' WHEN 'O' THEN '개월 뒤' ELSE ' 년 전' END"


@query(
    "time_phrases_told",
    f"SELECT o_orderkey, {TOLD_TIME} || CASE WHEN o_orderpriority[1] = '1' THEN '|다음 날' ELSE '' END AS phrases FROM orders",
)
def time_phrases_told(spark: SparkSession, d: str) -> DataFrame:
    """Relative times in a line that each order gives, a number and a unit twice and some fixed words."""
    phrase = F.concat(F.day("o_orderdate").cast("string"), F.expr("CASE o_orderstatus WHEN 'F' THEN '일 후' WHEN 'O' THEN '개월 뒤' ELSE ' 년 전' END"))
    text = F.concat(F.lit("그는 "), phrase, F.lit(" 떠났다. "), F.when(F.col("o_orderpriority").startswith("1"), "다음 날 왔다, ").otherwise("왔다, "), phrase)
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(tx.time_phrases(text), "|").alias("phrases"))


@query(
    "transformed_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS flag, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS bool_word, (o_orderkey % 90)::VARCHAR AS age, lower(o_orderpriority) AS lowered FROM orders",
)
def transformed_values(spark: SparkSession, d: str) -> DataFrame:
    """Rules' transforms: words for dead and alive, an age out of a phrase, lower case."""
    word = F.expr("CASE o_orderstatus WHEN 'F' THEN ' 사망' WHEN 'O' THEN '생존중 ' ELSE '모름' END")
    o = read_table(spark, d, "orders")
    age = F.format_string("약 %d세", F.col("o_orderkey") % 90)
    change = lambda value, kind: tx.transformed(value, F.lit(kind))
    return o.select("o_orderkey", change(word, "bool").alias("flag"), rp.bool_word(F.regexp_replace(word, "중", "")).alias("bool_word"), change(age, "int").alias("age"), change(F.col("o_orderpriority"), "lower").alias("lowered"))


@query(
    "value_gates",
    "SELECT p_partkey, p_type NOT IN ('PROMO', 'LARGE') AS kept, p_type = 'SMALL' AS is_group, CASE p_type WHEN 'SMALL' THEN p_name || ' 길드' WHEN 'MEDIUM' THEN p_name || ' 길드' ELSE p_name || CASE p_type WHEN 'PROMO' THEN ' 말하고' WHEN 'LARGE' THEN '는 마을' ELSE '' END END AS group_name FROM part",
)
def value_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which of the values that parts give read like a name, which like a group's, and a group's name without what follows it."""
    tail = F.expr("CASE p_type WHEN 'PROMO' THEN ' 말하고' WHEN 'LARGE' THEN '는 마을' WHEN 'SMALL' THEN ' 길드' WHEN 'MEDIUM' THEN ' 길드 시녀' ELSE '' END")
    value = F.concat("p_name", tail)
    return read_table(spark, d, "part").select("p_partkey", (~rules.reads_like_clause(value)).alias("kept"), rules.names_group(value).alias("is_group"), rules.group_name(value).alias("group_name"))


@query(
    "safe_patterns",
    "SELECT p_partkey, p_type NOT IN ('PROMO', 'LARGE', 'SMALL') AS safe FROM part",
)
def safe_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Which users' patterns the gate lets in: not those that repeat a repeat, nor long ones."""
    pattern = F.expr(r"CASE p_type WHEN 'PROMO' THEN concat(p_name, '(.*)+') WHEN 'LARGE' THEN concat('(?:.+)*', p_name) WHEN 'SMALL' THEN repeat(p_name, 60) ELSE concat('(', p_name, ')+ [0-9]+') END")
    return read_table(spark, d, "part").select("p_partkey", tx.pattern_is_safe(pattern).alias("safe"))


ASKED = ("evidence_link_cap", "graph_max_hops", "exclude_self_evidence", "loop_max_rounds")


@query(
    "request_options",
    "WITH r AS (SELECT event_id, (props::JSON->>'k')::INTEGER AS k, event_type FROM events) SELECT event_id, unnest(['evidence_link_cap', 'graph_max_hops', 'exclude_self_evidence', 'loop_max_rounds']) AS option,"
    " unnest([CASE WHEN event_type = 'click' THEN greatest(1, k) ELSE 20 END::VARCHAR, CASE k % 4 WHEN 2 THEN '2' ELSE '1' END, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN k > 90 THEN 2 ELSE greatest(1, k % 5) END::VARCHAR]) AS value FROM r",
)
def request_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of requests that events make, with what is missing or out of bounds put right."""
    k = F.get_json_object("props", "$.k").cast("int")
    loop = F.when(k <= 90, F.format_string(', "verification_loop": {"enabled": true, "max_rounds": %d}', k % 5)).otherwise(F.lit(""))
    cap = F.when(F.col("event_type") == "click", F.format_string(', "evidence_link_cap": %d', k)).otherwise(F.lit(', "evidence_link_cap": "many"'))
    request = F.concat(F.format_string('{"graph_max_hops": %d, "exclude_self_evidence": ', k % 4), F.when(k % 2 == 0, "true").otherwise("false"), cap, loop, F.lit("}"))
    return opt.resolved_requests(read_table(spark, d, "events").select("event_id", request.alias("request")), "event_id", "request", ASKED)


@query(
    "time_key_variants",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderstatus WHEN 'F' THEN '/rel: ' || day(o_orderdate) || ' day|' || day(o_orderdate) || ' day' WHEN 'O' THEN '/rel:' ELSE '' END AS variants FROM orders",
)
def time_key_variants(spark: SparkSession, d: str) -> DataFrame:
    """Times of orders, some told in relation to another, and the forms by which they are found."""
    key = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "F", F.format_string("/REL:  %d Day ", F.day("o_orderdate"))).when(F.col("o_orderstatus") == "O", "/rel: ").otherwise(""))
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(tx.time_key_variants(key), "|").alias("variants"))
