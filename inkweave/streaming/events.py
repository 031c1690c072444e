"""Event-log workloads, the same over a stream and over a table.

Every function takes a DataFrame of events (event_id, ts, user_id, event_type, value) that may
be streaming; the watermark matters only there.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, stream: bool = False, per_trigger: int = 1) -> DataFrame:
    """Events with ts as a timestamp; a stream replays from its checkpoint's cursor."""
    reader = spark.readStream.schema(SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", per_trigger) if stream else spark.read
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def lag_windows(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total, worst) over tumbling windows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("worst"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"), "worst")


def sliding_counts(events: DataFrame, size: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """(start, user_id, n) over sliding windows: what a rate limit looks at."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size, step).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): leases that end a gap after their last heartbeat."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cooled_down(events: DataFrame, keys: list[str], pause: str = "15 seconds", seconds: int = 15) -> DataFrame:
    """Events without those that follow another of their keys within the pause.

    Over a table an event is compared with the one before it, whether that one was kept or not;
    over a stream Spark drops repeats within the watermark.
    """
    if events.isStreaming:
        return events.withWatermark("ts", pause).dropDuplicatesWithinWatermark(keys)
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") >= seconds * 1_000_000)).drop("before")


def _fresh(keep_ms: int, columns: list[str]):
    """Lets each text of a document through once, as long as the document is remembered."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        for part in parts:
            new = part[~part["state_key"].isin(seen)].drop_duplicates("state_key")
            seen.update(new["state_key"])
            if len(new):
                yield new[columns]
        state.update((sorted(seen),))
        state.setTimeoutDuration(keep_ms)

    return run


def ingest_stream(documents: DataFrame, table: str, checkpoint: str, known: DataFrame | None = None, keep: timedelta = timedelta(days=7)):
    """Starts a query that appends documents to a Parquet table, each (doc_id, text) once.

    Repeats are known by the stream's own state, which forgets a document that wasn't seen for as
    long as keep says, so it doesn't grow with the table; known(doc_id, checksum), for example the
    table as it was, has those that came before. A batch that is done again gives the same rows: the
    file sink writes each batch once. A null text has a null checksum and counts as a text; so
    does a null id as an id.
    """
    rows = documents.withColumn("checksum", F.sha2("text", 256))
    if known is not None:
        there = known.select(F.col("doc_id").alias("known_id"), F.col("checksum").alias("known_checksum")).distinct()
        rows = rows.join(there, F.col("doc_id").eqNullSafe(F.col("known_id")) & F.col("checksum").eqNullSafe(F.col("known_checksum")), "left_anti")
    keyed = rows.withColumn("state_key", F.coalesce("checksum", F.lit("null")))
    run = _fresh(max(1, int(keep.total_seconds() * 1000)), rows.columns)
    fresh = keyed.groupBy("doc_id").applyInPandasWithState(run, rows.schema, "seen array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # what is forgotten needs no batch of its own; with them this query would never end
    try:
        return fresh.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
