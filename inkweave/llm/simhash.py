"""SimHash near-duplicates by tiled exact comparison.

Fingerprints at most RADIUS bits apart agree on at least two of RADIUS + 2 blocks, so only those
that share two blocks are compared. Within such a bucket, tiles of bounded size are compared
whole with numpy's exclusive-or and bit count; a pair of tiles whose population counts differ
by more than the radius is never formed. Each comparison gives a star for every local component,
never its pairs, and the stars are joined to components across all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import as_row, whole_text
from inkweave.llm.components import connected_components
from inkweave.session import cut_lineage, read_table

RADIUS = 2
SHINGLE = 3
#: Fingerprints in a tile at most, about.
TILE = 1024
#: Rows of a tile that are compared at once.
STRIP = 128
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: A-Z to a-z, byte by byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text over its word shingles; without words, zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter((digest(g, 42) for g in islice(grams, CHUNK)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint_of(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row of docs; an id that is no whole number counts as none, a null text as an empty one."""
    rows = docs.select(docs[id_col].try_cast("long").alias("id"), whole_text(docs[text_col]).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _touching(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of a are at most radius bits from which of b; both sorted by population count."""
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    out = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), STRIP):
        for j in range(0, len(b), STRIP):
            x, y = slice(i, i + STRIP), slice(j, j + STRIP)
            if pa_[x][0] - pb[y][-1] <= radius and pb[y][0] - pa_[x][-1] <= radius:
                out[x, y] = np.bitwise_count(a[x, None] ^ b[None, y]) <= radius
    return out


def local_stars(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, least fingerprint) for each of more than one in a component of two tiles, or of one; tiles may be empty."""
    by_count = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    a = by_count(left.view(np.uint64))
    b = a if right is None else by_count(right.view(np.uint64))
    if len(a) == 2 and right is None:
        u, v = sorted(left.tolist())
        return [(v, u)] if int(a[0] ^ a[1]).bit_count() <= radius else []
    near = _touching(a, b, radius)
    ka, kb = a.view(np.int64).copy(), b.view(np.int64).copy()
    top = np.iinfo(np.int64).max
    while True:  # the least label spreads until nothing changes
        na = np.minimum(ka, np.where(near, kb[None, :], top).min(axis=1))
        nb = np.minimum(kb, np.where(near, na[:, None], top).min(axis=0))
        if (na == ka).all() and (nb == kb).all():
            break
        ka, kb = na, nb
    out = [(int(f), int(k)) for f, k in zip(a.view(np.int64), ka, strict=True) if f != k]
    if right is not None:
        out += [(int(f), int(k)) for f, k in zip(b.view(np.int64), kb, strict=True) if f != k]
    return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(b.column("left"), b.column("right"), strict=True):
                x, y = (np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64) for s in (left, right))
                if len(x) and (len(y) or len(x) > 1):
                    found += local_stars(x, y if len(y) else None, radius)
            u, v = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return run


def _bands(fp: Column, radius: int) -> Column:
    """For every two of radius + 2 blocks: their number and their bits."""
    parts, at, blocks = radius + 2, 0, []
    for k in range(parts):
        wide = 64 * (k + 1) // parts - at
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << wide) - 1)) if wide < 64 else fp)
        at += wide
    return F.array(*[F.struct(F.lit(n).alias("band"), F.struct(blocks[i].alias("x"), blocks[j].alias("y")).alias("key")) for n, (i, j) in enumerate(combinations(range(parts), 2))])


def near_edges(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Stars (u, v) that span, within each bucket, what lies at most radius bits apart.

    fps(fp) is distinct and not null; an empty table gives an empty one. A star's head is the least
    fingerprint of a local component, so equal distances need no choice.
    """
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(_bands(F.col("fp"), radius)).alias("b")).select("fp", "pop", "b.*")
    cells = rows.groupBy("band", "key", "pop").agg(F.count("*").alias("n"))
    # at most 65 cells to a bucket
    buckets = cells.groupBy("band", "key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("k"))).alias("cells")).where("total > 1")
    rows = rows.join(buckets, ["band", "key"])
    # a small bucket is one tile; in a larger one every cell of a population count is dealt out over tiles, and a row goes to
    # all pairs of its tile with one of at most radius more or fewer bits
    salt = F.pmod(F.xxhash64("fp"), F.element_at(F.filter("cells", lambda c: c["pop"] == F.col("pop")), 1)["k"].cast("long")).cast("int")
    own = F.struct(F.col("pop").alias("pop"), F.col("salt").alias("salt"))
    others = F.flatten(F.transform(F.filter("cells", lambda c: F.abs(c["pop"] - F.col("pop")) <= radius), lambda c: F.transform(F.sequence(F.lit(0), c["k"] - 1), lambda s: F.struct(c["pop"].alias("pop"), s.alias("salt")))))
    pairs = F.transform(others, lambda o: F.struct(F.least(o, own).alias("lo"), F.greatest(o, own).alias("hi"), (own > o).alias("second")))
    alone = F.struct(F.lit(-1).alias("pop"), F.lit(0).alias("salt"))
    rows = rows.withColumn("salt", salt).withColumn("pair", F.explode(F.when(F.col("total") <= tile, F.array(F.struct(alone.alias("lo"), alone.alias("hi"), F.lit(False).alias("second")))).otherwise(pairs)))
    tiles = rows.groupBy("band", "key", "pair.lo", "pair.hi").agg(
        F.collect_list(F.when(~F.col("pair.second"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("pair.second"), F.col("fp"))).alias("right")
    )
    return tiles.where("size(left) > 0 and size(left) + size(right) > 1 and (size(right) > 0 or lo = hi)").select("left", "right").mapInArrow(_compare(radius), "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for every row of docs; component_id is the least id of all rows linked to it.

    Null and empty texts have fingerprint zero, which links like any other. Rows without an id
    keep their place and lend none to their component (null if no row of it has one). Repeated
    rows stay repeated. Texts are read whole. An empty table gives an empty one.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_edges(nodes.select("fp"), radius, tile))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = cut_lineage(linked)
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(heads, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, prints.fp == named.of).select("id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: Callable[..., DataFrame] = simhash_components) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: that of the least id.

    components(docs, id_col, text_col) gives (id, component_id) and so says what a group is.

    Of repeated rows with that id one stays, the least by the hash of all its columns as JSON. Rows
    without an id (null, or no whole number) can't be named by a decision: they are held only
    against each other, by exact text (null is a text too), and of each text the least by the same
    hash stays. Columns, of any type, and their names stay as they are.
    """
    found = components(docs, id_col, text_col)
    firsts = found.where("id = component_id").select(F.col("id").alias("first"))
    rows = as_row(docs, id=docs[id_col].try_cast("long"), text=docs[text_col])
    least = F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
    kept = rows.join(firsts, F.col("id") == F.col("first"), "left_semi").groupBy("id").agg(least).select("row.*")
    return kept.union(rows.where("id is null").groupBy("text").agg(least).select("row.*"))


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_tiles": op4_simhash_tiles}
ORACLES: dict[str, str] = {}
