"""Queries of slots, signatures, gates and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.functions import lexicon as lx
from inkweave.operators import reports as rp
from inkweave.session import read_table

_ANY = lambda x, words: " OR ".join(f"contains({x}, '{w}')" for w in words)


@query(
    "slot_keys",
    "WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' Age' WHEN 1 THEN 'job' WHEN 2 THEN 'other' END AS c, CASE p_size % 3 WHEN 0 THEN 'LOC' WHEN 1 THEN 'str' END AS k, lower(p_type || '/' || p_name || CASE WHEN p_size % 5 = 0 THEN '/소속' ELSE '' END) AS p FROM part)"
    f" SELECT p_partkey, CASE WHEN lower(trim(c)) IN ({', '.join(repr(s) for s in lx.SLOT_KEYWORDS)}) THEN lower(trim(c)) {' '.join(f'WHEN lower(k) = {a!r} THEN {b!r}' for a, b in lx.SCHEMA_SLOTS.items())}"
    f" {' '.join(f'WHEN {_ANY("p", words)} THEN {slot!r}' for slot, words in lx.SLOT_KEYWORDS.items())} END AS slot FROM t",
)
def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    given = F.when(size % 4 == 0, " Age").when(size % 4 == 1, "job").when(size % 4 == 2, "other")
    kind = F.when(size % 3 == 0, "LOC").when(size % 3 == 1, "str")
    path = F.concat("p_type", F.lit("/"), "p_name", F.when(size % 5 == 0, "/소속").otherwise(""))
    return read_table(spark, d, "part").select("p_partkey", rp.slot_key(given, kind, path).alias("slot"))


@query(
    "numeric_tokens",
    "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '-?\\d+'), lambda x: try_cast(x AS DECIMAL(38,0))), lambda x: x IS NOT NULL))), lambda x: x::VARCHAR), ',') AS numbers FROM documents",
)
def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = rp.numeric_tokens(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("numbers"))


@query("reason_signatures", "SELECT user_id, coalesce(string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (WHERE value > 90), '<none>') AS signature FROM events GROUP BY user_id")
def reason_signatures(spark: SparkSession, d: str) -> DataFrame:
    reasons = read_table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("r"))
    return reasons.select("user_id", rp.signature(F.col("r")).alias("signature"))


@query(
    "dataset_keys",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DS-DIVERSE-200' WHEN 2 THEN 'DS-400' WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN 'DS-800' END END AS dataset FROM events",
)
def dataset_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    path = F.when(k == 0, "data/ds_diverse_200.json").when(k == 1, "data/DS-DIVERSE-201").when(k == 2, "x/DSGROWTH400/").when(k == 3, "data/other-800")
    count = F.when(F.col("event_id") % 7 == 0, "800").otherwise("many")
    return read_table(spark, d, "events").select("event_id", rp.dataset_key(path, F.when(k == 4, count)).alias("dataset"))


@query(
    "attempt_status",
    "WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded ' WHEN 'O' THEN 'failed' END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE (o_orderkey % 3)::VARCHAR END AS b FROM orders)"
    " SELECT o_orderkey, coalesce(nullif(concat_ws(',', CASE WHEN upper(trim(a)) <> 'SUCCEEDED' THEN 'index_fts:' || upper(trim(a)) END, CASE WHEN b = 'x' THEN 'ingest_failures:INVALID' WHEN b <> '0' THEN 'ingest_failures:' || b END), ''), 'SUCCEEDED') AS status FROM t",
)
def attempt_status(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "succeeded ").when(F.col("o_orderstatus") == "O", "failed")
    failures = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise((F.col("o_orderkey") % 3).cast("string"))
    return read_table(spark, d, "orders").select("o_orderkey", rp.attempt_status({"index_fts": state}, {"ingest_failures": failures}).alias("status"))


USERS = "WITH u AS (SELECT user_id, count(*) FILTER (WHERE value > 60) AS a, count(*) FILTER (WHERE value > 75) AS b, count(*) FILTER (WHERE value > 95) AS c FROM events GROUP BY user_id)"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("value") > v).alias(n) for n, v in (("a", 60), ("b", 75), ("c", 95))])


@query(
    "actionability",
    USERS + " SELECT user_id, CASE WHEN b > 0 AND a >= b AND c = 0 THEN 'MAINLINE_ALL_UNKNOWN' WHEN b > 0 THEN 'MAINLINE_ACTIVE' WHEN user_id % 2 = 0 AND a > 0 AND user_id % 4 = 0 THEN 'SEPARATED_TO_SHADOW' WHEN user_id % 2 = 0 THEN 'MAINLINE_EMPTY_AFTER_SEPARATION' ELSE 'NO_MAINLINE_CLAIMS' END AS class FROM u",
)
def actionability(spark: SparkSession, d: str) -> DataFrame:
    lane = F.when(F.col("user_id") % 2 == 0, "mainline_excludes_local_profile_only")
    shadow = F.when(F.col("user_id") % 4 == 0, "shadow_local_profile_only")
    return _users(spark, d).select("user_id", rp.actionability(F.col("b"), F.col("a"), F.col("c"), lane, F.col("a"), shadow).alias("class"))


@query("layer_states", USERS + " SELECT user_id, CASE WHEN a = 0 THEN 'off' WHEN b > 0 OR c > 0 THEN 'active' ELSE 'inactive' END AS state FROM u")
def layer_states(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("user_id", rp.layer_state(F.col("a"), F.col("b"), F.lit(None).cast("long"), F.col("c")).alias("state"))


@query(
    "best_hypotheses",
    "WITH s AS (SELECT user_id, event_type AS label, floor(max(value) / 10) / 10 AS score FROM events GROUP BY ALL) SELECT user_id, CASE WHEN max(score) >= 0.5 THEN arg_max(label, (score, -length(label), -ascii(label))) ELSE '' END AS label, max(score) AS score FROM s GROUP BY user_id",
)
def best_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    scores = read_table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg((F.floor(F.max("value") / 10) / 10).alias("score"))
    return rp.best_hypothesis(scores.withColumn("place", F.length("label") * 1000 + F.ascii("label")), "user_id")


@query(
    "fuzzy_phrases",
    "WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, len(list_filter(a, lambda x: len(list_filter(b, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0 AS alike FROM t",
)
def fuzzy_phrases(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", rp.fuzzy_overlap(F.lower("p_name"), F.lower("p_type")).alias("alike"))


@query("signal_scores", "SELECT conv_id, sum(least(n, 3))::BIGINT AS score, min(f) AS first FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id")
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    return rp.signal_score(read_table(spark, d, "conversations").select("conv_id", F.col("role").alias("slot"), F.col("turn").alias("start")), "conv_id")


@query(
    "effective_policies",
    "WITH r AS (SELECT p_brand, CASE WHEN min(p_size) < 4 THEN 'manual' ELSE 'auto' END AS own, CASE WHEN max(p_size) > 47 THEN 'numbered' ELSE '' END AS pat FROM part GROUP BY p_brand)"
    " SELECT p_partkey, CASE WHEN own <> 'auto' OR pat <> '' THEN own ELSE 'profile' END AS policy, CASE WHEN own <> 'auto' OR pat <> '' THEN pat ELSE p_type END AS patterns, own <> 'auto' OR pat <> '' AS from_registry FROM part JOIN r USING (p_brand)",
)
def effective_policies(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    registry = part.groupBy("p_brand").agg(F.when(F.min("p_size") < 4, "manual").alias("policy"), F.when(F.max("p_size") > 47, F.array(F.lit("numbered"))).alias("patterns"))
    profiles = part.select("p_partkey", "p_brand", F.lit("profile").alias("policy"), F.array("p_type").alias("patterns"))
    return rp.effective_policy(profiles, registry, "p_brand").select("p_partkey", "policy", F.array_join("patterns", ",").alias("patterns"), "from_registry")


@query(
    "confidence_bands",
    "WITH v AS (SELECT event_type, coalesce(value, 0) AS x FROM events), l AS (SELECT event_type, list_sort(list(x)) AS xs, median(x) AS median FROM v GROUP BY event_type) SELECT event_type, xs[1] AS least, median, xs[round_even((len(xs) - 1) * 0.9, 0)::INT + 1] AS p90, xs[-1] AS most FROM l",
)
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return rp.confidence_band(read_table(spark, d, "events"), "event_type", "value")


@query(
    "graph_run_summaries",
    "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS applied, count(*) FILTER (WHERE value <= 50) AS skipped, coalesce(array_to_string((list(event_id ORDER BY event_id) FILTER (WHERE value > 50))[1:8], ','), '') AS sample FROM events GROUP BY user_id",
)
def graph_run_summaries(spark: SparkSession, d: str) -> DataFrame:
    runs = read_table(spark, d, "events").select("user_id", F.col("event_id").alias("query"), (F.col("value") > 50).alias("applied"))
    return rp.graph_run_summary(runs, "user_id").withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query(
    "probe_filters",
    """WITH f AS (SELECT DISTINCT user_id, '{"entity":"' || event_type || '"}' AS filter FROM events UNION SELECT DISTINCT user_id, '{"time":"' || hour(ts) || '"}' FROM events) SELECT user_id, filter FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY filter) <= 8""",
)
def probe_filters(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    return rp.probe_filters({"entity": events.select("user_id", F.col("event_type").alias("value")), "time": events.select("user_id", F.hour("ts").alias("value"))}, "user_id")


@query(
    "payload_metrics",
    "SELECT user_id, sum(greatest(0.0, floor(value) - 20)) AS claims_processed, sum(floor(value)) AS chunks_processed, 0.0::DOUBLE AS rows_scanned, max(floor(value)) AS rss_mb_peak FROM events GROUP BY user_id",
)
def payload_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor("value")
    payload = F.to_json(F.struct((v - 20).alias("claims_processed"), v.cast("string").alias("chunks_processed"), F.lit("none").alias("rows_scanned"), v.alias("rss_mb_peak")))
    return rp.payload_metrics(read_table(spark, d, "events").select("user_id", payload.alias("payload")), "user_id")


@query(
    "queued_jobs",
    "SELECT o_orderkey AS id, o_orderpriority AS type, o_orderkey % 7 AS priority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY priority DESC, o_orderdate, id LIMIT 20",
)
def queued_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE")
    jobs = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), status.alias("status"), (F.col("o_orderkey") % 7).alias("priority"), F.col("o_orderdate").alias("created_at"))
    return rp.queued(jobs, ["1-URGENT", "2-HIGH"]).select("id", "type", "priority")


@query(
    "review_reasons",
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),"
    f" h AS (SELECT doc_id, len(list_filter(ls[1:80], lambda x: {_ANY('lower(x)', lx.FRONT_MATTER)})) AS front, len(list_filter(ls, lambda x: {' OR '.join(f'regexp_matches(x, {p!r})' for p in lx.UNSUPPORTED_HEADERS)})) AS odd FROM l)".replace("\\\\", "\\")
    + " SELECT doc_id, front::INTEGER AS front_matter, odd::INTEGER AS unsupported, CASE WHEN front >= 2 THEN 'front_matter_dominant' WHEN odd >= 2 THEN 'unsupported_header_variant' ELSE 'no_repeated_markers' END AS reason FROM h",
)
def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "documents").select("doc_id", rp.line_hits(F.col("text")).alias("h")).select("doc_id", "h.*")
    none = F.lit(0)
    return hits.select("doc_id", "front_matter", "unsupported", rp.review_reason(none, none, F.col("front_matter"), none, F.col("unsupported")).alias("reason"))


@query(
    "model_candidates",
    "SELECT conv_id, turn, role AS slot_key, CASE WHEN turn % 3 = 0 THEN 0.5 ELSE least(1.0, turn - 1.5) END::DOUBLE AS confidence, greatest(0, turn - 2) AS s, turn + 4 AS e, 'v' AS matched_text FROM (SELECT * FROM conversations WHERE turn > 1) UNION ALL"
    " SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 0.5 ELSE greatest(0.0, turn - 1.5) END::DOUBLE, greatest(0, turn - 2), turn + 4, 'v' FROM conversations WHERE turn <= 1",
)
def model_candidates(spark: SparkSession, d: str) -> DataFrame:
    sure = F.when(F.col("turn") % 3 == 0, '"no"').otherwise((F.col("turn") - 1.5).cast("string"))
    raw = F.concat(F.lit('[{"slot_key":"'), "role", F.lit('","value":"v","confidence":'), sure, F.lit(',"span_start":'), F.col("turn") - 2, F.lit(',"span_end":"'), F.col("turn") + 4, F.lit('"},{"value":"no slot"}]'))
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", F.explode(rp.model_candidates(raw)).alias("c"))
    return rows.select("conv_id", "turn", "c.slot_key", "c.confidence", "c.s", "c.e", "c.matched_text")


@query(
    "token_neighbours",
    f"WITH t AS (SELECT conv_id, turn, regexp_extract(substr(text, 1, 10), '({rp.TOKEN}+)\\s*$', 1) AS before, regexp_extract(substr(text, 11), '^\\s*[,，]?\\s*({rp.TOKEN}{{1,16}})', 1) AS after FROM conversations)"
    f" SELECT *, NOT ends_with(before, '의') AND ({' OR '.join(f'ends_with(before, {s!r})' for s in lx.DESCRIPTIVE_SUFFIXES)}) AS descriptive FROM t",
)
def token_neighbours(spark: SparkSession, d: str) -> DataFrame:
    t, at = F.col("text"), F.lit(10)
    near = read_table(spark, d, "conversations").select("conv_id", "turn", rp.token_before(t, at).alias("before"), rp.token_after(t, at).alias("after"))
    return near.withColumn("descriptive", rp.is_descriptive(F.col("before")))
