"""Queries of the relational core, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.operators import intervals as iv
from inkweave.operators import narrative as na
from inkweave.operators import relational as rel
from inkweave.session import read_table

DAY = "CAST(date_diff('day', DATE '1970-01-01', {0}::DATE) AS INTEGER)"


@query("doc_filtered_list", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND source = 'src3' AND lang <> 'fr'")
def doc_filtered_list(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return rel.matching(docs, {"source": "src3", "n_chars": None}, {"lang": ["en", "de", "en"], "doc_id": []}, {"lang": "fr"}).select("doc_id", "lang", "source", "n_chars").orderBy("doc_id")


@query("doc_in_list_semi", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def doc_in_list_semi(spark: SparkSession, d: str) -> DataFrame:
    wanted = read_table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return read_table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(wanted, "doc_id", "left_semi")


@query("job_cursor_scan", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 AND event_type = 'error'")
def job_cursor_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").where("event_id > 500 AND event_type = 'error'").select("event_id", "user_id", "event_type").orderBy("event_id")


@query("json_payload_parse", "SELECT event_type, count(*) AS n, sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS k_sum FROM events GROUP BY event_type")
def json_payload_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = read_table(spark, d, "events").select("event_type", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"}).alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"))


@query("upsert_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rel.latest(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("insert_ignore", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return rel.first_written(rows, ["user_id", "event_type"], ["event_id"])


@query(
    "upsert_merge",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'CHANGED', round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 7 = 0",
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    table = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = table.where("c_custkey % 7 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return rel.upsert(table, changes, ["c_custkey"])


@query("cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rel.cascade(read_table(spark, d, "lineitem").select("l_orderkey"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "snapshot_versions",
    "WITH v AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, 'sha256:' || sha256(text) AS checksum FROM documents)"
    " SELECT source, max(version) AS versions, max_by(doc_id, version) AS head_id, max_by(checksum, version) AS head_checksum FROM v GROUP BY source",
)
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    # the head is the row of the largest id, so neither a window nor the texts of older versions are needed
    docs = read_table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("versions"), F.max("doc_id").alias("head_id"), F.max_by(F.concat(F.lit("sha256:"), F.sha2("text", 256)), "doc_id").alias("head_checksum"))


@query("project_scoped_join", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang = 'en'")
def project_scoped_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    return docs.join(read_table(spark, d, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


def _days(column: str):
    return F.unix_date(F.col(column).cast("date"))


def _orders(spark: SparkSession, d: str, days: int) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), _days("o_orderdate").alias("s"), (_days("o_orderdate") + days).alias("e"))


def _items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), _days("l_shipdate").alias("s2"), (_days("l_shipdate") + 20).alias("e2"), *columns)


SPANS = (
    f"WITH o AS (SELECT o_orderkey AS key, {DAY.format('o_orderdate')} AS s, {DAY.format('o_orderdate')} + %d AS e FROM orders),"
    f" i AS (SELECT l_orderkey AS key, {DAY.format('l_shipdate')} AS s2, {DAY.format('l_shipdate')} + 20 AS e2, l_returnflag, l_suppkey FROM lineitem),"
    " j AS (SELECT o.key, s, e, s2, e2, l_returnflag, l_suppkey, least(e, e2) - greatest(s, s2) AS ov FROM o JOIN i ON o.key = i.key AND s < e2 AND s2 < e)"
)


@query(
    "interval_overlap_tags",
    SPANS % 400 + ", m AS (SELECT key, l_returnflag AS tag, max(ov) AS overlap FROM j GROUP BY ALL)"
    " SELECT key, tag, overlap FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY overlap DESC, tag) = 1",
)
def interval_overlap_tags(spark: SparkSession, d: str) -> DataFrame:
    found = iv.best_tags(_orders(spark, d, 400), _items(spark, d, F.col("l_returnflag").alias("tag")), ["key"], ["key"], "tag")
    return rel.first_written(found.withColumn("o", -F.col("overlap")), ["key"], ["o", "tag"]).drop("o")


@query("interval_semi", SPANS % 90 + " SELECT key FROM o WHERE EXISTS (SELECT 1 FROM i WHERE i.key = o.key AND s < e2 AND s2 < e)")
def interval_semi(spark: SparkSession, d: str) -> DataFrame:
    return iv.overlap_join(_orders(spark, d, 90), _items(spark, d), ["key"], "left_semi").select("key")


@query(
    "span_auto_filter",
    SPANS % 300 + ", v AS (SELECT o.key, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS one FROM o LEFT JOIN j ON o.key = j.key GROUP BY o.key)"
    " SELECT key, CASE WHEN n = 1 THEN one END AS filter_value, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS state FROM v",
)
def span_auto_filter(spark: SparkSession, d: str) -> DataFrame:
    both = iv.overlap_join(_orders(spark, d, 300), _items(spark, d, "l_suppkey"), ["key"], "left")
    value, state = iv.unique_or_ambiguous(F.col("values"))
    return both.groupBy("key").agg(F.collect_set("l_suppkey").alias("values")).select("key", value.alias("filter_value"), state.alias("state"))


@query("confirmed_evidence", SPANS % 60 + " SELECT key, bool_or(ov >= 3 AND ov / (e - s) >= 0.2) AS confirmed, count(*) FILTER (WHERE NOT (ov >= 3 AND ov / (e - s) >= 0.2)) AS rejected FROM j GROUP BY key")
def confirmed_evidence(spark: SparkSession, d: str) -> DataFrame:
    return iv.confirmed(_orders(spark, d, 60), _items(spark, d), ["key"], ["key"])


RANGES = [(1, 0, 2), (2, 1, 5), (3, 0, 9), (4, 4, 6), (5, 3, 3)]


@query(
    "episode_range_tightest",
    f"WITH r(range_id, start_n, end_m) AS (VALUES {', '.join(map(str, RANGES))})"
    " SELECT conv_id, turn, min_by(range_id, (end_m - start_n, range_id)) AS range_id FROM conversations LEFT JOIN r ON turn BETWEEN start_n AND end_m GROUP BY conv_id, turn",
)
def episode_range_tightest(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame(RANGES, "range_id int, start_n int, end_m int")
    return iv.tightest_range(read_table(spark, d, "conversations").select("conv_id", "turn"), ranges, ["conv_id", "turn"], "turn")


@query(
    "alias_unique_resolve",
    "WITH a AS (SELECT DISTINCT p_name || ' ' || p_size AS alias, p_brand AS entity FROM part WHERE p_type <> 'PROMO'), t AS (SELECT p_partkey, unnest([p_name || ' ' || p_size, p_name || ' ' || (p_size + 1)]) AS alias FROM part),"
    " r AS (SELECT p_partkey, min(entity) AS entity, count(DISTINCT entity) AS n FROM t LEFT JOIN a USING (alias) GROUP BY p_partkey)"
    " SELECT p_partkey, CASE WHEN n = 1 THEN entity END AS entity, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS state FROM r",
)
def alias_unique_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Whose aliases two names of each part are: that of one brand, of none or of several."""
    part = read_table(spark, d, "part")
    name = lambda size: F.concat_ws(" ", "p_name", size.cast("string"))
    aliases = part.where("p_type <> 'PROMO'").select(name(F.col("p_size")).alias("alias"), F.col("p_brand").alias("entity_id"))
    used = part.select("p_partkey", F.explode(F.array(name(F.col("p_size")), name(F.col("p_size") + 1))).alias("alias"))
    return na.by_unique_alias(used, aliases, "p_partkey")


TAGS = [("attr/p_size", "int"), ("attr/p_retailprice", "float"), ("attr/p_brand", "str")]


@query(
    "fact_tagdef_left",
    f"WITH t(tag_path, schema_type) AS (VALUES {', '.join(map(str, TAGS))}), f AS (SELECT p_partkey AS entity_id, unnest(['attr/p_size', 'attr/p_retailprice', 'attr/p_brand', 'attr/p_type']) AS tag_path,"
    " unnest([p_size::VARCHAR, p_retailprice::VARCHAR, p_brand, p_type]) AS value FROM part)"
    " SELECT entity_id, tag_path, coalesce(schema_type, 'unknown') AS schema_type, CASE schema_type WHEN 'int' THEN try_cast(value AS DOUBLE) WHEN 'float' THEN try_cast(value AS DOUBLE) END AS number"
    " FROM f LEFT JOIN t USING (tag_path) WHERE value IS NOT NULL",
)
def fact_tagdef_left(spark: SparkSession, d: str) -> DataFrame:
    facts = rel.attributes_as_facts(read_table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice", "p_brand", "p_type"])
    tags = spark.createDataFrame(TAGS, "tag_path string, schema_type string")
    number = F.when(F.col("schema_type").isin("int", "float"), F.expr("try_cast(value AS DOUBLE)"))
    return facts.join(tags, "tag_path", "left").select("entity_id", "tag_path", F.coalesce("schema_type", F.lit("unknown")).alias("schema_type"), number.alias("number"))


@query(
    "whitelist_exists_update",
    "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) OR EXISTS (SELECT 1 FROM benchmark b WHERE sha256(trim(b.text)) = sha256(trim(d.text))) AS whitelist_applied FROM documents d",
)
def whitelist_exists_update(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", rel.fingerprint(F.col("text")).alias("fp"))
    own = read_table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("own")).distinct()
    everywhere = read_table(spark, d, "benchmark").select(rel.fingerprint(F.col("text")).alias("fp"), F.lit(True).alias("all")).distinct()
    found = docs.join(own, "doc_id", "left").join(everywhere, "fp", "left")
    return found.select("doc_id", F.coalesce("own", "all", F.lit(False)).alias("whitelist_applied"))


@query("suppression_anti", "SELECT doc_id, 'sha256:' || sha256(trim(text)) AS fp FROM documents WHERE sha256(trim(text)) NOT IN (SELECT sha256(trim(text)) FROM documents WHERE doc_id % 10 = 0)")
def suppression_anti(spark: SparkSession, d: str) -> DataFrame:
    claims = read_table(spark, d, "documents").select("doc_id", rel.fingerprint(F.col("text")).alias("fp"))
    return claims.join(claims.where("doc_id % 10 = 0").select("fp"), "fp", "left_anti").select("doc_id", "fp")


@query(
    "verdict_preview_top2",
    "WITH t AS (SELECT l_orderkey, l_returnflag || '/' || l_linestatus AS tag, min((CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_shipdate)) AS o FROM lineitem GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, tag) AS rank FROM t) SELECT l_orderkey, tag, rank FROM r WHERE rank <= 2",
)
def verdict_preview_top2(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat_ws("/", "l_returnflag", "l_linestatus")
    first = read_table(spark, d, "lineitem").groupBy("l_orderkey", tag.alias("tag")).agg(F.min(F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1), "l_shipdate")).alias("o"))
    return rel.top_rows(first, ["l_orderkey"], [F.col("o"), F.col("tag")], 2).drop("o")


@query(
    "verdict_links_capped",
    "WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rank FROM lineitem),"
    " p AS (SELECT l_orderkey, unnest(['full', 'cap', 'contradict_only']) AS policy, rank, l_returnflag FROM r)"
    " SELECT policy, l_orderkey, count(*) AS links FROM p WHERE policy = 'full' OR (policy = 'cap' AND rank <= 3) OR (policy = 'contradict_only' AND l_returnflag = 'R') GROUP BY ALL",
)
def verdict_links_capped(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_returnflag") != "R", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")]
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", rank.alias("rank"))
    counts = rows.groupBy("l_orderkey").agg(F.count("*").alias("full"), F.count_if(F.col("rank") <= 3).alias("cap"), F.count_if(F.col("l_returnflag") == "R").alias("contradict_only"))
    return counts.unpivot("l_orderkey", ["full", "cap", "contradict_only"], "policy", "links").where("links > 0")


COUNTED = {"documents": "doc_id", "labels": "doc_id", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey"}


@query("source_counts", " UNION ALL ".join(f"SELECT '{t}' AS source_table, count(*) AS n, max({k})::BIGINT AS max_id FROM {t}" for t, k in COUNTED.items()))
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [read_table(spark, d, t).agg(F.lit(t).alias("source_table"), F.count("*").alias("n"), F.max(k).cast("long").alias("max_id")) for t, k in COUNTED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("status_histogram", "SELECT event_type AS status, count(*) AS n, count(*) FILTER (WHERE value > 50) AS running, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("running"), F.count_distinct("user_id").alias("users"))


@query("best_row_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def best_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "value", (-F.col("value")).alias("o"))
    return rel.first_written(rows, ["user_id", "event_type"], ["o", "event_id"]).drop("o")


@query(
    "conflict_groups",
    "WITH f AS (SELECT p_name || '/' || p_brand || '/' || p_type AS entity_id, unnest(['attr/p_brand', 'attr/p_type', 'attr/p_size']) AS tag_path, lower(trim(unnest([p_brand, p_type, p_size::VARCHAR]))) AS value FROM part)"
    " SELECT entity_id, tag_path, count(DISTINCT value) AS n_values, count(*) AS n_facts, CASE WHEN count(DISTINCT value) > 1 THEN 'PROPOSED' ELSE 'APPROVED' END AS status,"
    " CASE WHEN count(DISTINCT value) > 1 THEN 'unknown' ELSE min(value) END AS value FROM f GROUP BY ALL",
)
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part").withColumn("entity", F.concat_ws("/", "p_name", "p_brand", "p_type"))
    return rel.conflicts(rel.attributes_as_facts(parts, "entity", ["p_brand", "p_type", "p_size"]))


@query(
    "verdict_fold",
    "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'N') AND bool_or(l_returnflag = 'R') THEN 'UNKNOWN' WHEN bool_or(l_returnflag = 'R') THEN 'VIOLATE' WHEN bool_or(l_returnflag = 'N') THEN 'OK' END AS verdict,"
    " count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS support, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS contradict FROM lineitem GROUP BY l_orderkey",
)
def verdict_fold(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"
    distinct = lambda c: F.size(F.collect_set(F.when(c, F.col("l_suppkey")))).cast("long")
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(rel.folded_verdict(ok, bad).alias("verdict"), distinct(ok).alias("support"), distinct(bad).alias("contradict"))


@query(
    "percentiles_p95",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS low, max(value) AS high,"
    " CAST(floor(median(value)) AS BIGINT) AS mid, round(coalesce(stddev_pop(value) / nullif(avg(value), 0), 0), 6) AS cv FROM events GROUP BY event_type",
)
def percentiles_p95(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    sums = events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(rel.ratio(F.stddev_pop("value"), F.avg("value")), 6).alias("cv"))
    at = rel.percentiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return at.join(sums, "event_type").select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "low", "high", F.floor("p50").alias("mid"), "cv")


@query(
    "ratio_metrics",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS total, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failed_ratio,"
    " round(coalesce(sum(value) FILTER (WHERE event_type = 'error') / nullif(sum(value) FILTER (WHERE event_type = 'click'), 0), 0), 6) AS weight_ratio,"
    " round((max(value) - min(value)) / nullif(arg_min(value, event_id), 0), 6) AS drift FROM events GROUP BY 1",
)
def ratio_metrics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return read_table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("total"), F.round(rel.ratio(F.count_if(kind == "error"), F.count("*")), 6).alias("failed_ratio"),
        F.round(rel.ratio(F.sum(F.when(kind == "error", F.col("value"))), F.sum(F.when(kind == "click", F.col("value")))), 6).alias("weight_ratio"),
        F.round(F.try_divide(F.max("value") - F.min("value"), F.min_by("value", "event_id")), 6).alias("drift"),
    )


@query(
    "content_checksum",
    "WITH RECURSIVE t AS (SELECT 0 AS level, source, doc_id AS o, doc_id || ':' || n_chars || ':' || lang AS l FROM documents"
    " UNION ALL SELECT level + 1, source, o // 1024, sha256(string_agg(l, chr(10) ORDER BY o)) FROM t WHERE level < 1 OR (SELECT max(doc_id) FROM documents) >= 1024 ** level GROUP BY ALL)"
    " SELECT source, 'sha256:' || l AS checksum FROM t WHERE level = (SELECT max(level) FROM t)",
)
def content_checksum(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), "lang")
    return rel.content_checksum(read_table(spark, d, "documents").select("source", "doc_id", line.alias("line")), "source", F.col("line"), "doc_id")


@query(
    "prev_run_delta",
    "WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL),"
    " l AS (SELECT *, lag(p95) OVER (PARTITION BY event_type ORDER BY day) AS before FROM m), x AS (SELECT *, (p95 - before) / before * 100 AS delta FROM l)"
    " SELECT event_type, day, round(p95, 6) AS p95, round(delta, 6) AS delta_pct, CASE WHEN delta IS NULL THEN 'NO_BASELINE' WHEN delta > 20 THEN 'HARD_FAIL' WHEN delta > 5 THEN 'SOFT_WARNING' ELSE 'PASS' END AS status FROM x",
)
def prev_run_delta(spark: SparkSession, d: str) -> DataFrame:
    daily = rel.percentiles(read_table(spark, d, "events").withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], "value", {"p95": 0.95})
    before = F.lag("p95").over(Window.partitionBy("event_type").orderBy("day"))
    out = daily.withColumn("before", before).withColumn("delta", F.try_divide(F.col("p95") - F.col("before"), F.col("before")) * 100)
    return out.select("event_type", "day", F.round("p95", 6).alias("p95"), F.round("delta", 6).alias("delta_pct"), rel.trend_status(F.col("delta")).alias("status"))


@query(
    "round_robin_sample",
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))"
    " SELECT source, doc_id, rank FROM r JOIN s USING (source) ORDER BY rank, (place - 3 + n) % n LIMIT 50",
)
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return rel.round_robin(read_table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 50, 3).select("source", "doc_id", "rank")


@query(
    "uniform_sample",
    "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"
    " SELECT lang, doc_id FROM r WHERE n <= 16 OR r IN (SELECT CAST(floor(i * r.n / 16) AS BIGINT) FROM range(16) t(i))",
)
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return rel.uniform_sample(read_table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 16).select("lang", "doc_id")


@query(
    "union_distinct_limit",
    "WITH a AS (SELECT doc_id, n_chars, 0 AS priority FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, n_chars, 1 FROM documents WHERE n_chars > 1000),"
    " b AS (SELECT doc_id, n_chars, min(priority) AS priority FROM a GROUP BY ALL) SELECT * FROM b ORDER BY priority, n_chars DESC, doc_id LIMIT 200",
)
def union_distinct_limit(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    lists = [docs.where("lang = 'fr'").drop("lang"), docs.where("n_chars > 1000").drop("lang")]
    return rel.merged_lists(lists, ["doc_id"], [F.desc("n_chars"), F.col("doc_id")], 200)


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id").subtract(read_table(spark, d, "labels").select("doc_id"))


@query(
    "scope_preference",
    "SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) = 1",
)
def scope_preference(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("p"), (-F.col("c_acctbal")).alias("b"))
    return rel.first_written(rows, ["c_nationkey"], ["p", "b", "c_custkey"]).drop("p", "b")


@query(
    "verdict_evidence_join",
    "SELECT o_orderpriority, l_returnflag, count(*) AS n, count(DISTINCT p_brand) AS brands FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
def verdict_evidence_join(spark: SparkSession, d: str) -> DataFrame:
    links = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    rows = links.join(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read_table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("distinct_discovery", "SELECT DISTINCT event_type, user_id % 5 AS shard FROM events ORDER BY 1, 2 LIMIT 12")
def distinct_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The first values that a table has, as a listing shows them."""
    return read_table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("shard")).distinct().orderBy("event_type", "shard").limit(12)


@query("capped_lists", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def capped_lists(spark: SparkSession, d: str) -> DataFrame:
    """A listing asked for 5000 rows gets what its limit allows, the newest."""
    return rel.listed(read_table(spark, d, "events").select("event_id", "event_type"), [F.desc("event_id")], 5000, 1, 200)


@query("replaced_partitions", "SELECT p_brand, count(*) AS n, sum(CASE WHEN p_brand = 'Brand#1' THEN p_size + 1 ELSE p_size END)::BIGINT AS sizes FROM part GROUP BY p_brand")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table written by partition, one partition of it replaced, read again."""
    import uuid

    from inkweave.session import shared_folder
    from inkweave.sources import files

    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    part = read_table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    files.replace_partitions(part, path, "p_brand")
    files.replace_partitions(part.where("p_brand = 'Brand#1'").withColumn("p_size", F.col("p_size") + 1), path, "p_brand")
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("sizes"))
