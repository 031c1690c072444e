"""Near-duplicates at a Jaccard similarity of word shingles, found by SuperMinHash signatures.

Ertl, "SuperMinHash - A New Minwise Hashing Algorithm for Jaccard Similarity Estimation" (2017):
every element visits the places of the signature in a random order of its own and offers its
j-th place the rank j plus a fraction, so that no two places take the same rank of one element.
The least offer stays. A set is done as soon as no place holds more than the rank that is next,
which for large sets is after one or two ranks.

Bands of the signature bring sets together. In a bucket every set is first held against one
leader by their whole sets; what is linked is united, and only buckets in which sets of several
groups are left compare these with each other, again by whole sets, in tiles of bounded size
whose links are united on the spot. Groups across buckets are united by rounds over an edge
table. No link is lost but those that share no band: a pair at 0.85 shares none of BANDS with
probability (1 - 0.85**ROWS)**BANDS, 8e-7, and one of higher similarity with less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import as_row, whole_text
from inkweave.llm.components import connected_components
from inkweave.session import cut_lineage, read_table

#: Words in a shingle; per cent of the union that the intersection must reach.
SHINGLE, PER_CENT = 5, 85
BANDS, ROWS = 24, 5
PLACES = BANDS * ROWS
#: Elements whose ranks are drawn at once.
CHUNK = 1 << 15
#: Sets of one bucket that are paired by Spark at most; sets and shingles in a tile at most, about.
FEW, TILE, TILE_SHINGLES = 16, 512, 1 << 18
#: A-Z to a-z, byte by byte.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 0x9E3779B97F4A7C15  # the golden ratio in 64 bits


def _mixed(x: np.ndarray) -> np.ndarray:
    """x with all bits dependent on each other (an xor-shift-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a UTF-8 text's distinct word shingles, in order; of fewer words, that of all of them; without words, none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mixed((h + np.uint64(_STEP)) ^ of_word[k : k + len(h)])
    return np.unique(h)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A row of places for each set, each place the least of rank << 32 | fraction; an empty set has all bits set."""
    top = np.iinfo(np.uint64).max
    out = np.full((len(sets), places), top, np.uint64)
    begin = 0
    while begin < len(sets):  # as many sets as CHUNK elements fill, at least one
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= CHUNK:
            size, end = size + len(sets[end]), end + 1
        if end == begin + 1:
            for at in range(0, size, CHUNK):  # a large set in parts: the least offers of the parts
                _offer(sets[begin][at : at + CHUNK], np.zeros(min(CHUNK, size - at), np.int64), out[begin:end])
        else:
            _offer(np.concatenate(sets[begin:end]), np.repeat(np.arange(end - begin), [len(s) for s in sets[begin:end]]), out[begin:end])
        begin = end
    return out


def _offer(elements: np.ndarray, owner: np.ndarray, held: np.ndarray) -> None:
    """Lower held[owner, place] to what the elements offer, rank by rank, until no later rank can lower anything."""
    places, flat = held.shape[1], held.reshape(-1)
    order = np.broadcast_to(np.arange(places, dtype=np.int16), (len(elements), places)).copy()  # places to visit, from the rank on
    for rank in range(places):
        left = ((held >> np.uint64(32)).max(axis=1) >= rank)[owner]
        if not left.all():
            elements, owner, order = elements[left], owner[left], order[left]
        if not len(elements):
            return
        draw = _mixed(elements + np.uint64(_STEP * (rank + 1) % 2**64))
        pick = rank + ((draw >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(elements))
        place = order[rows, pick].astype(np.int64)
        order[rows, pick] = order[:, rank]
        np.minimum.at(flat, owner * places + place, np.uint64(rank << 32) | (draw & np.uint64(0xFFFFFFFF)))


def band_keys(signature: np.ndarray, bands: int = BANDS) -> list[int]:
    """One key for each band of a signature."""
    return [xxhash.xxh3_64_intdigest(part.tobytes(), k) - 2**63 for k, part in enumerate(signature.reshape(bands, -1))]


def _key(hashes: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63 if len(hashes) else None


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            bands = [band_keys(row) if len(s) else [] for s, row in zip(sets, signatures(sets), strict=True)]
            columns = [b.column("id"), pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "bands"])

    return run


def _whole_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "many"])

    return run


def local_links(keys: list[int], groups: list[int], sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that unite whatever is alike: each set found joins its group to the finder's.

    Pairs within a group, given or found, aren't compared.
    """
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    _, group = np.unique(groups, return_inverse=True)
    out = []
    for i in range(len(sets)):
        apart = group != group[i]
        apart &= 100 * np.minimum(sizes, sizes[i]) >= per_cent * np.maximum(sizes, sizes[i])
        if not apart.any():
            continue
        shared = np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in token[begin[i] : begin[i + 1]]]), minlength=len(sets))
        for j in np.flatnonzero(apart & (100 * shared >= per_cent * (sizes + sizes[i] - shared))).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((keys[i], keys[j]))
    return out


def _compared(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for rows in b.column("sets"):
                sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in rows.values.field("many")]
                found += local_links(rows.values.field("key").to_pylist(), rows.values.field("root").to_pylist(), sets, per_cent)
            u, v = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return run


def _fits(a: str, b: str, per_cent: int):
    """Whether sets of these sizes can be alike enough at all."""
    return f"100 * least({a}, {b}) >= {per_cent} * greatest({a}, {b})"


def _alike(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike enough."""
    side = lambda c, name: sets.select(F.col("key").alias(c), F.col("many").alias(name))  # noqa: E731
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
    return both.where(f"100 * shared >= {per_cent} * (size(a) + size(b) - shared)").select("u", "v")


def _rest_in_tiles(crowded: DataFrame, sets: DataFrame, per_cent: int, tile: int) -> DataFrame:
    """Links (u, v) between groups in buckets of many sets; crowded(band, key, n, root).

    The sets of a bucket's largest group meet the others only, the others meet all. Both sides are
    dealt out over tiles of bounded size, each pair of tiles is one row.
    """
    by_root = crowded.groupBy("band", "root").agg(F.count("*").alias("m"))
    large = by_root.groupBy("band").agg(F.max_by("root", F.struct("m", "root")).alias("large"))
    rows = crowded.join(large, "band").withColumn("big", F.col("root") == F.col("large"))
    tiles = lambda cond: F.greatest(F.lit(1), F.ceil(F.count_if(cond) / tile), F.ceil(F.sum(F.when(cond, F.col("n"))) / TILE_SHINGLES)).cast("int")  # noqa: E731
    many = rows.groupBy("band").agg(tiles(F.col("big")).alias("k_big"), tiles(~F.col("big")).alias("k_rest"))
    rows = rows.join(many, "band").withColumn("h", F.xxhash64("key", "band"))
    own = F.when(F.col("big"), F.col("k_rest") + F.pmod("h", "k_big")).otherwise(F.pmod("h", "k_rest")).cast("int")
    others = F.when(F.col("big"), F.sequence(F.lit(0), F.col("k_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("k_rest") + F.col("k_big") - 1))
    met = rows.withColumn("own", own).withColumn("other", F.explode(others)).select("key", "root", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = met.join(sets, "key").groupBy("band", "lo", "hi").agg(F.collect_list(F.struct("key", "root", "many")).alias("sets"))
    return full.select("sets").mapInArrow(_compared(per_cent), "u long, v long")


def near_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], per_cent: int = PER_CENT, few: int = FEW, tile: int = TILE) -> DataFrame:
    """(node, root) for all of nodes(key, n, bands) that are linked with another.

    sets_of(keys) gives (key, many), the whole sets of a table of keys, once each.
    """
    members = nodes.select("key", "n", F.explode("bands").alias("band"))
    leader = F.min(F.struct("key", "n")).alias("first")
    buckets = members.groupBy("band").agg(F.count("*").alias("total"), leader).where("total > 1")
    members = cut_lineage(members.join(buckets, "band").select("band", "key", "n", "total", "first"))
    sets = cut_lineage(sets_of(members.select("key").distinct()))

    stars = members.where("key <> first.key and " + _fits("n", "first.n", per_cent)).select(F.col("key").alias("u"), F.col("first.key").alias("v")).distinct()
    known = cut_lineage(connected_components(_alike(stars, sets, per_cent)))

    placed = members.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    placed = cut_lineage(placed.join(mixed, "band"))
    lists = placed.where((F.col("total") <= few) & (F.col("key") != F.col("first.key"))).groupBy("band").agg(F.collect_list(F.struct("key", "n", "root")).alias("xs"))
    fits = lambda x, y: (y["key"] > x["key"]) & (y["root"] != x["root"]) & (100 * F.least(x["n"], y["n"]) >= per_cent * F.greatest(x["n"], y["n"]))  # noqa: E731
    over = lambda x: F.transform(F.filter("xs", lambda y: fits(x, y)), lambda y: F.struct(x["key"].alias("u"), y["key"].alias("v")))  # noqa: E731
    pairs = lists.select(F.explode(F.flatten(F.transform("xs", over))).alias("p")).select("p.*").distinct()
    rest = _rest_in_tiles(placed.where(F.col("total") > few).select("band", "key", "n", "root"), sets, per_cent, tile)
    return connected_components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_alike(pairs, sets, per_cent)).union(rest))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT, few: int = FEW, tile: int = TILE) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; component_id is the least id of all rows linked to it.

    Rows are linked if their sets of distinct word shingles (of 64-bit hashes) intersect in at least
    per_cent of their union; texts of one set are linked by a hash of it. A text of fewer words is
    one shingle. Null and empty texts and those without words have no shingles and link nothing.
    Rows without an id (null, or no whole number) link nothing and have no component. Repeated rows
    stay repeated. Texts are read whole; an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].try_cast("long").alias("id"), whole_text(docs[text_col]).alias("text"))
    prints = cut_lineage(rows.mapInArrow(_signed(shingle), "id long, key long, n long, bands array<long>"))
    able = F.col("id").isNotNull() & F.col("key").isNotNull()
    nodes = cut_lineage(prints.where(able).groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    def sets_of(keys: DataFrame) -> DataFrame:
        ids = keys.join(nodes.select("key", "least"), "key").select(F.col("least").alias("id"))
        found = rows.join(ids, "id", "left_semi").select("text").mapInArrow(_whole_sets(shingle), "key long, many array<long>")
        return found.groupBy("key").agg(F.first("many").alias("many"))

    roots = near_links(nodes.select("key", "n", "bands"), sets_of, per_cent, few, tile)
    linked = cut_lineage(nodes.join(roots, nodes.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(heads, "root").select(F.col("key").alias("of"), "component_id")
    found = prints.where(able).join(named, F.col("key") == F.col("of")).select("id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(prints.where(~able).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of docs that are the first of their group, with all their columns whatever their names; rows without an id stay."""
    firsts = near_groups(docs, id_col, text_col, **how).where("id = component_id").select(F.col("id").alias("first"))
    rows = as_row(docs, id=docs[id_col].try_cast("long"))
    return rows.join(firsts, F.col("id") == F.col("first"), "left_semi").union(rows.where("id is null")).select("row.*")


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Every pair of texts that share a shingle, and what can be reached over links.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM words),
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, list(doc_id) AS ids, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS MATERIALIZED (SELECT node, n, hash(unnest(s)) AS h FROM nodes),
links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM tokens a JOIN tokens b ON a.h = b.h AND a.node <> b.node GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT node AS u, node AS v FROM nodes UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
named AS (SELECT u, min(v) AS component FROM reach GROUP BY u)
SELECT doc_id, n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM (
 SELECT unnest(ids) AS doc_id, n AS n_shingles, component AS component_id FROM nodes JOIN named ON node = u
 UNION ALL SELECT doc_id, 0, doc_id FROM sets WHERE len(s) = 0)
"""

QUERIES = {"op12_superminhash": op12_superminhash}
ORACLES = {"op12_superminhash": SQL}
