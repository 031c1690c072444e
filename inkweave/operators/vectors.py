"""Hashed and dense vectors: embedding, brute-force search in blocks, anomalies."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.operators.search import in_slices, top_k
from inkweave.session import cut_lineage, folder_exists, shared_folder
from inkweave.sources.files import replace_partitions

WIDTH = 96
#: Query vectors that go to the rows together, about, and rows that they are compared with together.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
#: Texts whose vectors are compared together, and queries that these or rows are compared with at once.
TEXT_BLOCK, AT_ONCE = 2048, 64
WORDS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=200_000)
def bucket(token: str) -> tuple[int, int]:
    """(place, sign) of a token in a hashed embedding."""
    h = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(h[:4], "little") % WIDTH, 1 if h[4] % 2 == 0 else -1


def hashed_embedding(text: str | None) -> list[float]:
    """Signed counts of a text's tokens by bucket, scaled to length one; zeros for a text without tokens."""
    v = np.zeros(WIDTH)
    for token, n in Counter(WORDS.findall((text or "").lower())).items():
        at, sign = bucket(token)
        v[at] += sign * n
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).tolist()


def embedded(df: DataFrame, key: str, text: str = "text", embedding=hashed_embedding) -> DataFrame:
    """(key, vec) of hashed embeddings; embedding may be triage_embedding. Keys are integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            vec = pa.array([embedding(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.int64()), vec], ["key", "vec"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, vec array<double>").withColumnRenamed("key", key)


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) > 0, n, 1.0)


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(parts).sort_values(["query", "score", "key"], ascending=[True, False, True]).groupby("query").head(k)


def _closest(v: np.ndarray, own: np.ndarray, w: np.ndarray, names: np.ndarray, k: int) -> list[pd.DataFrame]:
    """The k best of rows v for each of queries w, and what ties with the last of them."""
    out = []
    for at in range(0, len(names), AT_ONCE):
        s = np.round(w[at : at + AT_ONCE] @ v.T, 6)
        many = min(k, len(own))
        floor = np.partition(s, len(own) - many, axis=1)[:, len(own) - many]
        i, j = np.nonzero(s >= floor[:, None])  # what ties with the last one stays, for the order by key
        out.append(_best([pd.DataFrame({"query": names[at + i], "key": own[j], "score": s[i, j]})], k))
    return out


def _scanned(rows: DataFrame, queries: pd.DataFrame, k: int, probed: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query, key, score): every task's k best rows for each query; with probed, rows of a cell meet the queries in these places alone."""
    w, names = _unit(queries["vec"].tolist()), queries["query"].to_numpy(np.int64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for p in parts:
            new = []
            for at in range(0, len(p), ROW_BLOCK):
                some = p.iloc[at : at + ROW_BLOCK]
                groups = some.groupby("cell") if probed is not None else [(None, some)]
                for cell, r in groups:
                    mine = slice(None) if probed is None else probed.get(cell, np.zeros(0, np.int64))
                    if len(names[mine]):
                        new += _closest(_unit(r["vec"].tolist()), r["key"].to_numpy(np.int64), w[mine], names[mine], k)
            if new:
                best = _best([*([best] if best is not None else []), *new], k)
        if best is not None and len(best):
            yield best

    return rows.mapInPandas(run, "query long, key long, score double")


def nearest(rows: DataFrame, queries: DataFrame, key: str, query: str, k: int, positive: bool = True) -> DataFrame:
    """(query, key, score, rank): the k rows of the largest cosine for each query vector; rows and queries have vec.

    Rows stay where they are. Queries go to them in blocks of about QUERY_BLOCK, one after the other
    through the driver, and every task sends on k rows a query at most: no row is copied or moved,
    and memory is bounded whatever either side holds. positive leaves out scores of zero and less.
    Null vectors are no rows and no queries; ids are integers.
    """
    mine = cut_lineage(rows.select(F.col(key).cast("long").alias("key"), "vec").where("key is not null and vec is not null"))  # vectors that have to be made first are made once
    return _by_blocks(queries, key, query, k, positive, lambda some: _scanned(mine, some, k))


def _scanned_texts(rows: DataFrame, queries: pd.DataFrame, k: int, embedding: Callable[[str | None], list[float]]) -> DataFrame:
    """As _scanned over rows(key, text): a text's vector is compared where it is made and goes nowhere."""
    w, names = _unit(queries["vec"].tolist()), queries["query"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pd.DataFrame | None = None
        own: list[int] = []
        made: list[np.ndarray] = []

        def compared() -> None:
            nonlocal best
            new = _closest(_unit(made), np.array(own, np.int64), w, names, k)
            best = _best([*([best] if best is not None else []), *new], k)
            own.clear()
            made.clear()

        for b in in_slices(batches):
            own += b.column("key").to_pylist()
            made += [np.asarray(embedding(t)) for t in b.column("text").to_pylist()]
            if len(own) >= TEXT_BLOCK:
                compared()
        if own:
            compared()
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best["query"], pa.int64()), pa.array(best["key"], pa.int64()), pa.array(best["score"], pa.float64())], ["query", "key", "score"])

    return rows.mapInArrow(run, "query long, key long, score double")


def nearest_texts(rows: DataFrame, queries: DataFrame, key: str, query: str, k: int, embedding: Callable[[str | None], list[float]] = hashed_embedding, positive: bool = True) -> DataFrame:
    """nearest of the embedded texts of rows and queries.

    Where queries are one block, vectors of rows are compared in the task that makes them: no more is sent on than k rows
    a query. Those of more blocks are made once and kept, as nearest has it.
    """
    asked = cut_lineage(embedded(queries, query, embedding=embedding))
    if asked.where(F.col(query).isNotNull()).count() > QUERY_BLOCK:
        return nearest(embedded(rows, key, embedding=embedding), asked, key, query, k, positive)
    texts = rows.select(F.col(key).cast("long").alias("key"), "text").where("key is not null")
    return _by_blocks(asked, key, query, k, positive, lambda some: _scanned_texts(texts, some, k, embedding))


def _by_blocks(queries: DataFrame, key: str, query: str, k: int, positive: bool, search) -> DataFrame:
    asked = cut_lineage(queries.select(F.col(query).cast("long").alias("query"), "vec").where("query is not null and vec is not null"))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(parts):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == b).toPandas()
        one = search(some).where("score > 0") if positive else search(some)
        one = top_k(one.withColumnsRenamed({"query": query, "key": key}), query, [F.desc("score"), F.col(key)], k)
        one = cut_lineage(one) if parts > 1 else one
        found = one if found is None else found.union(one)
    return found


#: Vectors from whose centres cells are made, at most; rounds of moving the centres.
SAMPLE, MOVES = 20_000, 10


def centres_of(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Up to n unit vectors, each in the middle of the vectors that are closest to it."""
    x = _unit(sample)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(MOVES):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def write_cells(vectors: DataFrame, path: str, key: str, cells: int, sample: int = SAMPLE) -> None:
    """Stores (key, vec) by cell, the number of the closest of as many centres, which are fitted on sample vectors of least hash of their key.

    Null vectors and keys are left out. A cell's vectors lie in as many files as tasks wrote them, so a
    large one is read by many tasks.
    """
    spark = vectors.sparkSession
    mine = cut_lineage(vectors.select(F.col(key).cast("long").alias("key"), "vec").where("key is not null and vec is not null"))
    few = mine.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()
    centres = centres_of(np.stack(few["vec"].map(np.asarray)), cells) if len(few) else np.zeros((0, 1))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(cell=(_unit(p["vec"].tolist()) @ centres.T).argmax(axis=1) if len(p) else [])

    mine.mapInPandas(run, "key long, vec array<double>, cell int").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def nearest_in_cells(spark: SparkSession, path: str, queries: DataFrame, key: str, query: str, k: int, probes: int, positive: bool = True) -> DataFrame:
    """As nearest, over vectors stored by write_cells, of which only the probes cells closest to each query are looked at.

    Scores are exact; rows in other cells are missed. With as many probes as cells it is nearest.
    """
    found = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])  # as many as there are cells
    centres = np.array([r["centre"] for r in found]) if found else np.zeros((0, 1))
    rows = spark.read.schema("key long, vec array<double>, cell int").parquet(f"{path}/vectors")

    def search(some: pd.DataFrame) -> DataFrame:
        if not len(centres) or not len(some):
            return _scanned(rows.limit(0), some, k)
        order = np.argsort(-(_unit(some["vec"].tolist()) @ centres.T), axis=1, kind="stable")[:, :probes]
        probed = {c: np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order).tolist()}
        return _scanned(rows.where(F.col("cell").isin(*probed)), some, k, probed)

    return _by_blocks(queries, key, query, k, positive, search)


#: Ways to search vectors, by name.
BACKENDS = ("exact", "cells")


def search_vectors(rows: DataFrame, queries: DataFrame, key: str, query: str, k: int, backend: str = "exact", path: str | None = None, cells: int = 64, probes: int = 16) -> DataFrame:
    """nearest by one of BACKENDS; cells stores rows under path first, unless they are there."""
    if backend not in BACKENDS:
        raise ValueError(f"{backend} is none of {BACKENDS}")
    if backend == "exact":
        return nearest(rows, queries, key, query, k)
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    if not folder_exists(spark, f"{path}/centres/_SUCCESS"):
        write_cells(rows, path, key, cells)
    return nearest_in_cells(spark, path, queries, key, query, k, probes)


def mean_vector(df: DataFrame, vec: str = "vec", by: str | None = None) -> DataFrame:
    """(by, dim, mean): the element-wise mean; summed before it moves."""
    keys = [by] if by else []
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def anomaly(vec: Column, world: Column) -> Column:
    """How far a vector points away from another, from zero to one."""
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(vec, world) + 1) / 2))


def triage_embedding(text: str | None) -> list[float]:
    """The other hashed embedding: SHA-1, two bytes for the place and the third's parity for the sign."""
    v = np.zeros(WIDTH)
    for token in re.findall(r"[0-9A-Za-z가-힣]+", (text or "").lower()):
        h = hashlib.sha1(token.encode()).digest()
        v[int.from_bytes(h[:2], "big") % WIDTH] += 1 if h[2] % 2 == 0 else -1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).tolist()


def write_shards(vectors: DataFrame, path: str, shard: str) -> None:
    """Stores vectors by shard, with a manifest (shard, n, width, checksum) that says what each holds.

    A shard that is written again replaces itself and its line of the manifest.
    """
    replace_partitions(vectors, f"{path}/vectors", shard)
    others = [c for c in vectors.columns if c not in (shard, "vec")]
    line = vectors.groupBy(shard).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.sum(F.xxhash64(*others, "vec").cast("decimal(38,0)")).cast("string").alias("checksum"))
    replace_partitions(line, f"{path}/manifest", shard)


def shards(spark: SparkSession, path: str, order: list[Column], most: int, at_least: int = 1) -> DataFrame:
    """The vectors of the first shards by an order over the manifest, at most so many; shards of fewer vectors are left out.

    Only their folders are read.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    shard = next(c for c in manifest.columns if c not in ("n", "width", "checksum"))
    kept = [r[0] for r in manifest.where(F.col("n") >= at_least).orderBy(*order).limit(most).select(shard).collect()]
    return spark.read.parquet(f"{path}/vectors").where(F.col(shard).isin(*kept) if kept else F.lit(False))
