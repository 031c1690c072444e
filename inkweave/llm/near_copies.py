"""SimHash near-duplicates at a Jaccard similarity of word shingles.

Texts with one set of shingles are one node. Sets of similarity 0.8 differ in some 15 % of the bits
of a SimHash, more than blocks of 64 bits can bring together, so the fingerprint is made longer:
the shingles' hashes give its first word, their mixtures as many more as the blocks need. Nodes
that agree on a block meet in tiles of bounded size, where PRINTS words are compared by
exclusive-or and bit count and give the stars of their components, never their pairs; stars are
joined to components over all blocks. Within a component every two nodes are then held against
each other by their whole sets: few pair by pair, joined by Spark; many in tiles again.

A pair of similarity s agrees on no block with probability (1 - (1 - d)**wide)**bands, d its share
of unlike bits: at most MISS for sets of more than SHORT shingles. Sets of five and four, whose
majorities differ most, are linked by what five are without one, so none of these is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.llm.components import connected_components
from inkweave.llm.simhash import LOWER
from inkweave.session import cut_lineage

SHINGLE, LIKENESS = 5, 0.8
#: Bits by which sets of that similarity and more than SHORT shingles differ at most (12 shingles shared by 12 and 15; 0.1515 for large sets); what blocks may miss of such pairs.
APART, MISS = 0.162, 3e-6
#: Bits of a block at least, and nodes that share one by chance at most, about: blocks are longer where there are more.
WIDE, CROWD = 8, 1 << 14
#: Words of the fingerprint that are compared, and bits apart at most: pairs of APART lie further with probability 1e-6, unrelated ones nearer with 2e-8.
PRINTS, FAR = 3, 58
#: Bits apart at most, in the first word, to be checked by whole sets: sets of similarity 0.8 lie 9.7 apart in the mean with a deviation of 2.9, unrelated ones 32 with 4.
REACH = 26
#: Shingles of a set that is short, at most: the bits of such sets say too little.
SHORT = 5
#: Fingerprints in a tile at most, about, and crowded blocks that are broadcast at most; more are joined by a shuffle.
PRINT_TILE, BROADCAST_BLOCKS = 1 << 14, 200_000
PRINT_COLUMNS = [f"fp{k}" for k in range(PRINTS)]
#: Fingerprints of a tile that are compared at once, with as many others.
STRIP, REST = 128, 2048
#: Nodes of one component that are paired by Spark at most; nodes and shingles in a tile at most, about.
FEW, TILE, TILE_SHINGLES = 16, 1024, 1 << 18
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (256, 2), np.uint64) | np.uint64(1)


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a UTF-8 text's distinct word shingles in order; of fewer words, that of all of them."""
    words = text.translate(LOWER).split()
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def bits_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set, 64 bits a word: a bit is one if set in over half of what is counted, the hashes first, then mixtures of them."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        h = hashes[at : at + 255, None]
        x = (h ^ _SEEDS[1:words, 1]) * _SEEDS[1:words, 0]
        x ^= x >> np.uint64(32)
        x = np.hstack([h, x * _SEEDS[1:words, 1]])
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def words_of(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view(np.int64)


def bands_of(wide: int) -> int:
    """Blocks of wide bits that miss at most MISS of the pairs."""
    return math.ceil(math.log(MISS) / math.log(1 - (1 - APART) ** wide))


def wide_of(nodes: int) -> int:
    """Bits of a block for so many nodes."""
    return max(WIDE, math.ceil(math.log2(max(nodes, 1) / CROWD)))


def words_for(wide: int) -> int:
    """Words that hold all blocks and those that are compared; a block lies in one word."""
    return max(PRINTS, math.ceil(bands_of(wide) / (64 // wide)))


def block_keys(bits: np.ndarray, wide: int) -> np.ndarray:
    """One key for each block of a fingerprint: its number and its bits."""
    bands, per = bands_of(wide), 64 // wide
    blocks = bits.reshape(-1, 64)[:, : per * wide].reshape(-1, wide)[:bands]
    return blocks @ (1 << np.arange(wide)) + (np.arange(bands) << wide)


def block_column(words: Column, wide: int) -> Column:
    """The same of a column of words."""
    per, mask = 64 // wide, F.lit((1 << wide) - 1)
    return F.array(*[F.shiftrightunsigned(words[b // per], b % per * wide).bitwiseAND(mask) + F.lit(b << wide) for b in range(bands_of(wide))])


def short_keys(hashes: np.ndarray) -> list[int]:
    """Keys below zero: of four shingles one for all, of five one for all but each."""
    if len(hashes) not in (SHORT - 1, SHORT):
        return []
    left = [hashes] if len(hashes) < SHORT else [np.delete(hashes, k) for k in range(SHORT)]
    return [-1 - (xxhash.xxh3_64_intdigest(x.tobytes()) >> 1) for x in left]


def band_keys(hashes: np.ndarray, wide: int = WIDE) -> list[int]:
    """All keys of a set, one of which two sets share that are to be compared."""
    return block_keys(bits_of(hashes, words_for(wide)), wide).tolist() + short_keys(hashes)


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set in its first 64 bits."""
    return int(words_of(bits_of(hashes, 1))[0])


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def _printed(shingle: int, words: int):
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.binary()):
                s = shingles_of(t.as_py(), shingle)
                rows.append((_key(s), len(s), words_of(bits_of(s, words)), short_keys(s)))
            keys, sizes, prints, shorts = zip(*rows, strict=True) if rows else [()] * 4
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, longs) for x in (prints, shorts))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "key", "n", "words", "shorts"])

    return run


def _shingled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t.as_py(), shingle) for t in b.column("text").cast(pa.binary())]
            columns = [pa.array(map(_key, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "key", "many"])

    return run


def print_stars(prints: np.ndarray, sizes: np.ndarray, likeness: float, far: int = FAR) -> list[tuple[int, int]]:
    """(first word, first word of another) for each but one of every component of fingerprints at most far bits apart.

    prints holds a row of words for each; those whose sizes can't be of sets that alike are left apart.
    """
    order = np.argsort(sizes, kind="stable")
    p, n, root = prints[order], sizes[order], np.arange(len(order))
    for at in range(0, len(n), STRIP):
        last = min(at + STRIP, len(n)) - 1
        end = int(np.searchsorted(n, n[last] / likeness + 0.5, "right"))
        for begin in range(at, end, REST):
            these, those = slice(at, last + 1), slice(begin, min(begin + REST, end))
            apart = sum(np.bitwise_count(p[these, None, k] ^ p[None, those, k]) for k in range(p.shape[1]))
            i, j = np.nonzero((apart <= far) & (root[these, None] != root[None, those]))
            i, j = i + at, j + begin
            fit = (i < j) & (n[j] <= n[i] / likeness + 0.5)
            i, j = i[fit], j[fit]
            while (unlike := root[i] != root[j]).any():  # the least of the two spreads until all pairs have one root
                i, j = i[unlike], j[unlike]
                a, b = root[i], root[j]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := root[root], root):
                    root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    first = p[:, 0].view(np.int64)
    return list(zip(first[moved].tolist(), first[root[moved]].tolist(), strict=True))


def _met(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for rows in b.column("xs"):
                prints, n = (np.stack([rows.values.field(c).to_numpy(zero_copy_only=False) for c in cs], axis=1) for cs in (PRINT_COLUMNS, ["n"]))
                found += print_stars(np.ascontiguousarray(prints).view(np.uint64), n[:, 0], likeness)
            u, v = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return run


def print_edges(nodes: DataFrame, wide: int, likeness: float, tile: int = PRINT_TILE) -> DataFrame:
    """Stars (u, v) of first words that span, within each block, the fingerprints at most FAR bits apart, and those of short sets.

    nodes has words, n and shorts; an empty table gives an empty one.
    """
    rows = nodes.select(*(F.col("words")[k].alias(c) for k, c in enumerate(PRINT_COLUMNS)), "n", F.explode(block_column(F.col("words"), wide)).alias("block"))
    totals = rows.groupBy("block").agg(F.count("*").alias("total"))
    crowded = cut_lineage(totals.where(F.col("total") > tile).select(F.col("block").alias("of"), F.ceil(F.col("total") / tile).cast("int").alias("k")))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_BLOCKS else crowded
    # a small block is one tile, the rows of a larger one go to all pairs of their tile with another
    rows = rows.join(crowded, rows.block == crowded.of, "left")
    salt = F.pmod(F.xxhash64(*PRINT_COLUMNS, "n"), F.col("k").cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, salt).alias("lo"), F.greatest(o, salt).alias("hi")))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("k").isNull(), alone).otherwise(others)))
    tiles = rows.groupBy("block", "pair").agg(F.collect_list(F.struct(*PRINT_COLUMNS, "n")).alias("xs")).where("size(xs) > 1").select("xs")
    stars = tiles.mapInArrow(_met(likeness), "u long, v long")

    shorts = nodes.select(F.col("words")[0].alias("u"), F.explode("shorts").alias("short"))
    heads = shorts.groupBy("short").agg(F.min("u").alias("v"), F.count("*").alias("total")).where("total > 1").select("short", "v")
    return stars.union(shorts.join(heads, "short").select("u", "v")).distinct()


def local_components(keys: list[int], prints: np.ndarray, sets: list[np.ndarray], likeness: float, reach: int = REACH) -> list[tuple[int, int]]:
    """(key, least key) for each but the least of every component of sets at least that alike.

    Only sets whose fingerprints lie at most reach bits apart, or that are short, are compared.
    """
    sizes = np.array([len(s) for s in sets])
    if not len(sizes):
        return []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ordered = owner[np.argsort(token, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    fresh, out = np.ones(len(sets), bool), []
    for seed in sorted(range(len(sets)), key=keys.__getitem__):
        if not fresh[seed]:
            continue
        fresh[seed], queue = False, [seed]
        while queue and fresh.any():
            i = queue.pop()
            near = fresh & ((np.bitwise_count(prints ^ prints[i]) <= reach) | (np.minimum(sizes, sizes[i]) <= SHORT))
            if not near.any():
                continue
            held = [ordered[first[t] : first[t + 1]] for t in token[begin[i] : begin[i + 1]]]
            shared = np.bincount(np.concatenate(held), minlength=len(sets))
            for j in np.flatnonzero(near & (shared / (sizes[i] + sizes - shared) >= likeness)).tolist():
                fresh[j] = False
                queue.append(j)
                out.append((keys[j], keys[seed]))
    return out


def _compared(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for rows in b.column("sets"):
                keys = rows.values.field("key").to_pylist()
                sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in rows.values.field("many")]
                prints = np.asarray(rows.values.field("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
                found += local_components(keys, prints, sets, likeness)
            u, v = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS, few: int = FEW, tile: int = TILE) -> DataFrame:
    """(id, component_id) for every row of docs with an id; component_id is the least id of all rows linked to it.

    Two rows are linked if their sets of word shingles have a Jaccard similarity of at least
    likeness. Null counts as an empty text, which is like no other but empty ones. Rows without an id
    (null, or no whole number) link nothing; repeated rows stay repeated. Texts are read whole; an
    empty table gives an empty one.
    """
    rows = docs.where(docs[id_col].try_cast("long").isNotNull()).select(docs[id_col].try_cast("long").alias("id"), whole_text(docs[text_col]).alias("text"))
    wide = wide_of(rows.count())
    prints = cut_lineage(rows.mapInArrow(_printed(shingle, words_for(wide)), "id long, key long, n long, words array<long>, shorts array<long>"))
    nodes = cut_lineage(prints.groupBy("key").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", "words", "shorts"))))
    near = connected_components(print_edges(nodes, wide, likeness))
    nodes = nodes.select("key", "least", "n", F.col("words")[0].alias("fp"))
    # nodes of one first word are in one component
    members = nodes.join(near, nodes.fp == near.node, "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("near"))
    shared = members.groupBy("near").agg(F.count("*").alias("total"), F.sum("n").alias("size")).where("total > 1")
    members = cut_lineage(members.join(shared, "near"))
    lists = members.where(F.col("total") <= few).groupBy("near").agg(F.collect_list(F.struct("key", "fp", "n")).alias("xs"))
    close = lambda x, y: (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= REACH) | (F.least(x["n"], y["n"]) <= SHORT)
    over = lambda x: F.transform(F.filter("xs", lambda y: (y["key"] > x["key"]) & close(x, y) & (F.least(x["n"], y["n"]) >= likeness * F.greatest(x["n"], y["n"]) - 0.5)), lambda y: F.struct(x["key"].alias("u"), y["key"].alias("v")))
    pairs = cut_lineage(lists.select(F.explode(F.flatten(F.transform("xs", over))).alias("p")).select("p.*"))
    crowd = members.where(F.col("total") > few).withColumn("k", F.greatest(F.ceil(F.col("total") / tile), F.ceil(F.col("size") / TILE_SHINGLES)).cast("int"))

    wanted = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).union(crowd.select("key")).distinct().join(nodes.select("key", "least"), "key")
    wanted = wanted.select(F.col("key").alias("of"), "least")
    sets = rows.mapInArrow(_shingled(shingle), "id long, key long, many array<long>").join(wanted, (F.col("key") == F.col("of")) & (F.col("id") == F.col("least")))
    sets = cut_lineage(sets.groupBy("key").agg(F.first("many").alias("many")))

    side = lambda c, name: sets.select(F.col("key").alias(c), F.col("many").alias(name))
    both = F.size(F.array_intersect("a", "b"))
    alike = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(both / (F.size("a") + F.size("b") - both) >= likeness).select("u", "v")
    own = crowd.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("k").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    own = own.select("key", "fp", "near", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"))
    tiles = own.join(sets, "key").groupBy("near", "lo", "hi").agg(F.collect_list(F.struct("key", "fp", "many")).alias("sets")).select("sets")
    stars = tiles.mapInArrow(_compared(likeness), "u long, v long")

    roots = connected_components(alike.union(stars))
    linked = cut_lineage(nodes.join(roots, nodes.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(heads, "root").select(F.col("key").alias("of"), "component_id")
    return prints.join(named, prints.key == named.of).select("id", "component_id")
