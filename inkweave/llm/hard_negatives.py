"""Hard negatives by a pivot table: inner products bracketed by stored distances.

With M the greatest norm, a row x becomes (x, sqrt(M*M - x.x)) and an anchor q becomes (q, 0), so
that their squared distance is M*M + q.q - 2 q.x: the nearer, the higher the inner product. Every
row's distances to a few pivots are stored. By the triangle inequality the distance of an anchor
and a row lies between the greatest difference and the least sum of their distances to a pivot,
which brackets the inner product. Only rows whose bracket can matter are checked exactly: first
those that may be among an anchor's best rows of its own label, then those of other labels that
may lie in the score window of one of these positives and may be among its best so far.

Rows stay where they are. Anchors go to them in blocks of bounded size, each task keeps the best
few rows for every anchor (then for every positive), and only those few are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.session import cut_lineage, read_table

#: Positives of an anchor; negatives of a positive; the window of negative scores in per cent of the positive score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Pivots, and rows at most from which they are chosen.
PIVOTS, SAMPLE = 16, 2048
#: Anchors that go to the rows at once, about; anchors and rows that are bracketed at once.
BLOCK, SOME_ANCHORS, SOME_ROWS = 4096, 512, 1024
#: The greatest component: a hundred times the product of two vectors of 5000 of them is a 64-bit number.
LARGEST = 1 << 22
#: Found rows that are held before the best are chosen.
HELD = 1 << 18
NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """Every component times scale as a double, rounded down: array<int>, or null.

    Null for a null vector, for one with a null, infinite or undefined component, and for one with
    a component of LARGEST or more.
    """
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST))
    return F.when(sound, whole.cast("array<int>"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of doubles, shorter ones filled up with zeros."""
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with one more component, so that all have the squared norm top."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of every row to every pivot."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square))


def chosen_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of sample, each the farthest from those before."""
    if not len(sample):
        return sample
    picked = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def bracket(near_q: np.ndarray, near_x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that an anchor (row) and a row (column) can have.

    near_q and near_x are distances to the pivots, norms is M*M + q.q by anchor. What doubles
    round off is less than the slack added.
    """
    low, high = np.zeros((len(near_q), len(near_x))), np.full((len(near_q), len(near_x)), np.inf)
    for p in range(near_q.shape[1]):
        a, b = near_q[:, p, None], near_x[None, :, p]
        np.maximum(low, np.abs(a - b), out=low)
        np.minimum(high, a + b, out=high)
    slack = 1e-9 * norms[:, None] + 1e-6
    return (norms[:, None] - high * high) / 2 - slack, (norms[:, None] - low * low) / 2 + slack


class Best:
    """The k best rows of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, NONE)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.parts.append(np.stack([slot, score, row]))
        self.size += len(slot)
        if self.size > HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        """What is left, slot by slot in order, as slots, scores and ids; floor is the score that a full slot still takes."""
        found = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        found = found[:, np.lexsort((found[2], -found[1], found[0]))]
        place = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0])
        last = place == self.k - 1
        self.floor[found[0][last]] = found[1][last]
        found = found[:, place < self.k]
        self.parts, self.size = [found], 0
        return found


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        ids, labels = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("id", "label"))
        x, near = _matrix(b.column("v"), width), _matrix(b.column("near"), len(b.column("near")[0]) if len(b) else 0)
        for at in range(0, len(ids), SOME_ROWS):
            cut = slice(at, at + SOME_ROWS)
            yield ids[cut], labels[cut], x[cut], near[cut]


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by doubles if these hold them."""
    if not a.size or not x.size or np.abs(a).max() * np.abs(x).max() * a.shape[1] < 2.0**53:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _told(best: Best) -> Iterator[pa.RecordBatch]:
    found = best.settle()
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["slot", "score", "id"])


def _best_of_own_label(anchors: dict[str, np.ndarray], k: int):
    ids, labels, q, near_q, norms = (anchors[c] for c in ("id", "label", "v", "near", "norms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for rid, rlabel, x, near_x in _blocks(batches, q.shape[1]):
            for label in np.unique(rlabel):
                rows, mine = np.flatnonzero(rlabel == label), np.flatnonzero(labels == label)
                for at in range(0, len(mine), SOME_ANCHORS):
                    some = mine[at : at + SOME_ANCHORS]
                    _, high = bracket(near_q[some], near_x[rows], norms[some])
                    live = (high >= best.floor[some][:, None]) & (ids[some][:, None] != rid[rows][None, :])
                    left = live.any(axis=0)
                    score = _products(q[some], x[rows[left]])
                    a, r = np.nonzero(live[:, left] & (score >= best.floor[some][:, None]))
                    best.add(some[a], score[a, r], rid[rows[left]][r])
            best.settle()
        yield from _told(best)

    return run


def _best_in_window(anchors: dict[str, np.ndarray], slots: dict[str, np.ndarray], k: int):
    """slots: by positive, its anchor (in order) and a hundred times the least and the greatest score of a negative."""
    labels, q, near_q, norms = (anchors[c] for c in ("label", "v", "near", "norms"))
    used, first, many = np.unique(slots["anchor"], return_index=True, return_counts=True)
    least, most = (f.reduceat(slots[c], first) if len(first) else slots[c] for f, c in ((np.minimum, "low"), (np.maximum, "high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(slots["anchor"]), k)
        for rid, rlabel, x, near_x in _blocks(batches, q.shape[1]):
            for at in range(0, len(used), SOME_ANCHORS):
                part = slice(at, at + SOME_ANCHORS)
                some = used[part]
                low, high = bracket(near_q[some], near_x, norms[some])
                floor = np.minimum.reduceat(best.floor, first)[part]
                live = (100 * high >= np.maximum(least[part], 100.0 * floor)[:, None]) & (100 * low <= most[part][:, None]) & (labels[some][:, None] != rlabel[None, :])
                left = live.any(axis=0)
                score = _products(q[some], x[left])
                for j in range(int(many[part].max())):
                    has = np.flatnonzero(many[part] > j)
                    slot = first[part][has] + j
                    s = score[has]
                    a, r = np.nonzero(live[has][:, left] & (100 * s >= slots["low"][slot][:, None]) & (100 * s <= slots["high"][slot][:, None]) & (s >= best.floor[slot][:, None]))
                    best.add(slot[a], s[a, r], rid[left][r])
            best.settle()
        yield from _told(best)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of every slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pivot_table(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, float]:
    """rows(id, label, v) with near, the distances to the pivots; the lifted pivots; the greatest squared norm.

    Pivots are chosen from the sample rows of least hash of id. Partitions stay, their rows are put
    in the order of label and nearest pivot, so that rows that lie together are bracketed together.
    """
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    top, width = rows.agg(F.max(square), F.max(F.size("v"))).first()
    top, width = float(top or 0), width or 0
    few = rows.orderBy(F.xxhash64("id"), "id", "label").limit(sample).select("v").toArrow().column("v").combine_chunks()
    centres = chosen_pivots(lifted(_matrix(few, width), top), pivots) if len(few) else np.zeros((1, width + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = distances(lifted(_matrix(b.column("v"), width), top), centres)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * len(centres), pa.int32()), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "near"])

    table = rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<int>, near array<double>")
    nearest = F.array_position("near", F.array_min("near"))
    return cut_lineage(table.sortWithinPartitions("label", nearest)), centres, top


def _anchor_arrays(table: DataFrame, centres: np.ndarray, top: float) -> dict[str, np.ndarray]:
    got = table.select("id", "label", "v").toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
    q = _matrix(got.column("v").combine_chunks(), centres.shape[1] - 1)
    near = distances(np.hstack([q, np.zeros((len(q), 1))]), centres)
    return {"id": got.column("id").to_numpy(), "label": got.column("label").to_numpy(), "v": q, "near": near, "norms": top + (q * q).sum(axis=1)}


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(id, label, v), v whole numbers.

    Anchors are the rows where is_anchor holds. Rows with a null id, label or v take no part; rows
    are other than an anchor if their id is. A shorter vector counts as filled up with zeros. Equal
    scores go to the smaller id; repeated rows count each. A positive without negatives in its
    window, as one of a score below zero, gives no row; so does an empty table. Two passes over the
    rows for each block of anchors; a block's anchors and positives pass through the driver.
    """
    spark = rows.sparkSession
    table, centres, top = pivot_table(rows.where("id is not null and label is not null and v is not null"))
    anchors = table.where(is_anchor)
    parts = max(1, -(-anchors.count() // block))
    found = None
    for k in range(parts):
        some = _anchor_arrays(anchors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k), centres, top)
        form = "slot long, score long, id long"
        own = _first(table.mapInArrow(_best_of_own_label(some, positives), form), positives).toPandas().sort_values(["slot", "rank"])
        own = own[low * own.score <= high * own.score]
        slots = {"anchor": own.slot.to_numpy(np.int64), "low": low * own.score.to_numpy(np.int64), "high": high * own.score.to_numpy(np.int64)}
        names = pa.table({"slot": np.arange(len(own)), "anchor_id": some["id"][slots["anchor"]], "positive_id": own.id.to_numpy(np.int64), "positive_score": own.score.to_numpy(np.int64)})
        best = _first(table.mapInArrow(_best_in_window(some, slots, negatives), form), negatives)
        one = best.join(spark.createDataFrame(names), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        one = cut_lineage(one) if parts > 1 else one
        found = one if found is None else found.union(one)
    return found


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col("embedding")).alias("v"))
    return mined(rows, F.col("id") % 100 == 0)


#: Every anchor with every row.
SQL = """
WITH sound AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM sound a, sound r WHERE a.id % 100 = 0 AND a.id <> r.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

QUERIES = {"op13_pivot_negatives": op13_pivot_negatives}
ORACLES = {"op13_pivot_negatives": SQL}
