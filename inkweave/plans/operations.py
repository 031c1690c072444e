"""Queries of event windows, sources and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.operators import relational as rel
from inkweave.session import cut_lineage, drop_folder, read_table, shared_folder
from inkweave.sources import files
from inkweave.streaming import events as ev


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ev.read_events(spark, f"{d}/events.parquet")


@query("queue_lag_windows", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS worst FROM events GROUP BY ALL")
def queue_lag_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.lag_windows(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("cooldown_dedupe", "SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) >= 15000000, true)")
def cooldown_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ev.cooled_down(_events(spark, d), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(
    "sliding_rate",
    "WITH w AS (SELECT user_id, time_bucket(INTERVAL '10 seconds', ts) - INTERVAL '10 seconds' * i AS start FROM events, range(6) t(i)) SELECT start, user_id, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1",
)
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding_counts(_events(spark, d)).where("n > 1").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "session_leases",
    "WITH l AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '5 minutes' AS fresh FROM events), s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM l)"
    " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '5 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, island",
)
def session_leases(spark: SparkSession, d: str) -> DataFrame:
    out = ev.sessions(_events(spark, d))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    "gate_eval",
    "WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, quantile_cont(value, 0.95) AS p95, count(*) AS n, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) AS slow FROM events GROUP BY ALL),"
    " b AS (SELECT *, first_value(p95) OVER (PARTITION BY event_type ORDER BY day) AS base FROM m)"
    " SELECT event_type, day, round(p95 / base, 6) AS ratio, CASE WHEN p95 / base > 1.8 THEN 'FAIL' WHEN slow > 0.2 THEN 'FAIL' WHEN p95 / base > 1.5 THEN 'WARN' ELSE 'PASS' END AS gate FROM b",
)
def gate_eval(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumn("day", F.col("ts").cast("date"))
    slow = events.groupBy("event_type", "day").agg(F.avg(F.when(F.col("value") > 60, 1.0).otherwise(0.0)).alias("slow"))
    daily = rel.percentiles(events, ["event_type", "day"], "value", {"p95": 0.95}).join(slow, ["event_type", "day"])
    base = daily.groupBy("event_type").agg(F.min_by("p95", "day").alias("base"))
    ratio = F.try_divide("p95", "base")
    gate = F.when((ratio > 1.8) | (F.col("slow") > 0.2), "FAIL").when(ratio > 1.5, "WARN").otherwise("PASS")
    return daily.join(base, "event_type").select("event_type", "day", F.round(ratio, 6).alias("ratio"), gate.alias("gate"))


@query("story_package", "SELECT item_id, 'obfuscated-v1:' || replace(replace(rtrim(base64(encode(text)), '='), '+', '-'), '/', '_') AS package, true AS same FROM benchmark")
def story_package(spark: SparkSession, d: str) -> DataFrame:
    made = read_table(spark, d, "benchmark").select("item_id", "text", files.packed(F.col("text"), True).alias("package"))
    return made.select("item_id", "package", (files.unpacked(F.col("package")) == F.col("text")).alias("same"))


@query("status_transitions", "SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id)[-3:], '>') AS last_three, count(*) AS n FROM events GROUP BY user_id")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    last = rel.top_rows(_events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">")
    counts = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return last.groupBy("user_id").agg(path.alias("last_three")).join(counts, "user_id")


@query("text_files", "SELECT item_id, sha256(text || chr(10)) AS checksum, length(text) + 1 AS n_chars FROM benchmark WHERE text IS NOT NULL")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files, one each, and read again whole."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    files.write_texts(read_table(spark, d, "benchmark"), path, "item_id")
    found = files.read_texts(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.sha2("text", 256).alias("checksum"), F.length("text").alias("n_chars"))
    out = cut_lineage(found)
    drop_folder(spark, path)
    return out


@query("decoded_texts", "SELECT item_id, text FROM benchmark")
def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come as UTF-8, with and without a mark, and as UTF-16."""
    i, plain = F.col("item_id") % 3, F.encode("text", "UTF-8")
    content = F.when(i == 0, plain).when(i == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).otherwise(F.encode("text", "UTF-16"))
    return files.decoded_texts(read_table(spark, d, "benchmark").select("item_id", content.alias("content")), "item_id")
