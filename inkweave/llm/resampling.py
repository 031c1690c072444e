"""Importance resampling towards a target distribution, over hashed word runs.

A ring of running CRC-32 states goes along each text once: every word opens a state of its own
and extends the states of the last n - 1 starts by a space and itself; each state, read after
each word, names the bucket of one run of words. Bucket counts of the corpus and of the target
give a gain to every bucket; a document's weight is the mean gain of its features, and a Gumbel
variate drawn from its id by hash makes the highest scores a sample by those weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.llm.common import as_row, whole_text
from inkweave.session import cut_lineage, read_table

#: Words in a run at most; buckets; words that a document needs; per cent that are drawn; seed of the draw.
LONGEST, BUCKETS, LEAST_WORDS, PER_CENT, SEED = 1, 10_000, 20, 10, 2024
#: Byte by byte: A-Z to a-z; digits, letters and all beyond ASCII as they are; anything else to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words that are hashed at once.
CHUNK = 1 << 16


def words_in(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def ring_states(words: list[bytes], longest: int) -> Iterator[int]:
    """The CRC-32 of every run of 1 to longest consecutive words, in the order in which the runs end."""
    crc = zlib.crc32
    if longest == 1:  # the ring has one place, which every word takes anew
        yield from map(crc, words)
        return
    ring: list[int] = []
    for w in words:
        tail = b" " + w
        ring = [crc(w), *[crc(tail, state) for state in ring[: longest - 1]]]
        yield from ring


def buckets_of(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, in arrays of bounded size."""
    states = ring_states(words, longest)
    while len(part := np.fromiter(islice(states, CHUNK), np.int64)):
        yield part % buckets


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                for part in buckets_of(words_in(text), longest, buckets):
                    total += np.bincount(part, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows of texts by bucket, buckets without any left out.

    Every task sends one row a bucket at most. A null text has no words; an empty table has no rows.
    """
    each = texts.select(whole_text(texts[text_col]).alias("text")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """A whole number for each bucket: a thousand times the logarithm of its smoothed share in the target over that in the corpus."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(k, 0) + 1.0) * s_all / ((raw.get(k, 0) + 1.0) * t_all))) for k in range(buckets)], np.int64)


def gumbel_of(doc_id: int, seed: int) -> int:
    """A thousand times a Gumbel variate, floored, that depends on the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gains: np.ndarray, longest: int, seed: int):
    def one(text: bytes) -> tuple[int, int, int]:
        words, n, total = words_in(text), 0, 0
        for part in buckets_of(words, longest, len(gains)):
            n, total = n + len(part), total + int(gains[part].sum())
        return len(words), n, total // n if n else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            found = [one(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            scores = [None if k is None else w + gumbel_of(k, seed) for k, (_, _, w) in zip(ids, found, strict=True)]
            columns = [b.column("id"), *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)], pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight", "score"])

    return run


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) for every row of docs, by the counts of all rows of docs and of target (column text).

    One number a bucket reaches the driver and the tasks. A null text has no words and weight 0; a
    row whose id is null or no whole number has no score. Repeated rows count and stay repeated.
    """
    raw, wanted = (dict(bucket_counts(df, col, longest, buckets).toPandas().itertuples(index=False)) for df, col in ((docs, text_col), (target, "text")))
    rows = docs.select(docs[id_col].try_cast("long").alias("id"), whole_text(docs[text_col]).alias("text"))
    return rows.mapInArrow(_weighed(gains_of(raw, wanted, buckets), longest, seed), "id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """rows(id, n_words, score, ...) and rank: 1, 2, ... for the highest scores, ties to the smaller id; null where not drawn.

    Of the rows with a score and least_words words that many in a hundred are drawn, rounded down.
    No order over all rows is made: scores are whole numbers of some ten thousand values whatever
    the size of the corpus, so counts by score say how many rows stand before each, and only the
    drawn rows of one score are put in order among themselves. rows is read twice.
    """
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.select("score", "n", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before")))
    draw = (counts.agg(F.sum("n")).first()[0] or 0) * per_cent // 100
    first = counts.where(F.col("before") < draw).select("before", F.col("score").alias("of"))
    last = first.agg(F.min("of")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("*", none)
    upper = fit & (F.col("score") >= last)
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id", *[c for c in rows.columns if c not in ("id", "score")]))
    high = rows.where(upper).join(first, F.col("score") == F.col("of")).withColumn("place", place)
    high = high.select(*rows.columns, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return high.union(rows.where(~F.coalesce(upper, F.lit(False))).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of docs; rank is null where it isn't drawn.

    Each text is scanned once to count and once to weigh; the rows that are ranked hold numbers
    only. An empty docs gives an empty table, an empty target even shares.
    """
    return ranked(cut_lineage(weighed(docs, target, id_col, text_col, longest, buckets, seed)), least_words, per_cent)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns whatever their names; repeated rows of a drawn id all stay."""
    ids = resampled(docs, target, id_col, text_col, **how).where("rank is not null").select(F.col("id").alias("drawn"))
    return as_row(docs, id=docs[id_col].try_cast("long")).join(ids, F.col("id") == F.col("drawn"), "left_semi").select("row.*")


def op11_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The remainder of each distinct word goes byte by byte through a table that the polynomial gives.
SQL = r"""
WITH step AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
runs AS (SELECT row_number() OVER () AS row, id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
tokens AS MATERIALIZED (SELECT row, id, kind, unnest(words) AS w FROM runs),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM tokens),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
 FROM vocabulary, step),
counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM tokens JOIN crc USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT row, sum(gain)::BIGINT AS total FROM tokens JOIN crc USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
weights AS (SELECT id AS doc_id, len(words) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS weight
 FROM runs LEFT JOIN sums USING (row) WHERE kind = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights),
placed AS (SELECT *, CASE WHEN n_features >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(place) FROM placed) * 10 // 100 THEN place END AS rank FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_crc_ring": op11_crc_ring}
ORACLES = {"op11_crc_ring": SQL}
