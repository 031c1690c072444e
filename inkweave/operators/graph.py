"""Knowledge graph: nodes, edges, adjacency of documents, seeded expansion and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import terms
from inkweave.operators.relational import top_rows
from inkweave.session import drop_folder
from inkweave.sources.files import replace_partitions

#: Rows that go to all tasks at most.
FEW = 100_000


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


SEED_WEIGHTS = {"filter": 1.0, "alias": 0.7, "time": 0.5, "term": 0.45}
DECAY = {1: 1.0, 2: 0.5}


def node_id(kind: str | Column, native: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, native.cast("string"))), 1, 24)


def edge_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", src, dst, kind)), 1, 32)


def nodes(parts: list[DataFrame], stubs: list[DataFrame]) -> DataFrame:
    """(node_id, node_type, label, confidence): the first part that has a node writes it; stubs fill gaps at half confidence."""
    full = [p.select("node_id", "node_type", "label", F.lit(1.0).alias("confidence"), F.lit(k).alias("p")) for k, p in enumerate(parts)]
    half = [p.select("node_id", "node_type", "label", F.lit(0.5).alias("confidence"), F.lit(len(parts) + k).alias("p")) for k, p in enumerate(stubs)]
    every = reduce(DataFrame.unionByName, full + half)
    best = every.groupBy("node_id").agg(F.min_by(F.struct("node_type", "label", "confidence"), F.struct("p", "label")).alias("n"))
    return best.select("node_id", "n.*")


def edges(parts: list[DataFrame], told_once: bool = False) -> DataFrame:
    """(edge_id, src, dst, edge_type), each once.

    told_once says that parts have no edge twice, so nothing moves: keys can be told apart before they become ids,
    which are several times as long.
    """
    every = reduce(DataFrame.unionByName, [p.select("src", "dst", "edge_type") for p in parts])
    every = every if told_once else every.distinct()
    return every.select(edge_id(F.col("src"), F.col("dst"), F.col("edge_type")).alias("edge_id"), "src", "dst", "edge_type")


def without_dangling(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    ids = nodes_.select("node_id")
    return edges_.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def expand(links: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """(doc, distance, weight) of seeds(doc, weight) and, with two hops, of documents that share a key with a seed.

    links has (doc, key). Keys of seeds are made distinct before they meet the links again, so
    no pairs of documents are formed. A document's weight is the largest of its seeds' keys'.
    """
    first = seeds.groupBy("doc").agg(F.max("weight").alias("weight")).withColumn("distance", F.lit(1))
    if hops >= 2:
        keys = links.join(first.select("doc", "weight"), "doc").groupBy("key").agg(F.max("weight").alias("weight"))
        near = links.join(keys, "key").groupBy("doc").agg(F.max("weight").alias("weight")).withColumn("distance", F.lit(2))
        both = first.unionByName(near)
        first = both.groupBy("doc").agg(F.min_by(F.struct("distance", "weight"), F.struct("distance", -F.col("weight"))).alias("b")).select("doc", "b.weight", "b.distance")
    out = first.select("doc", "distance", "weight")
    return out if limit is None else out.orderBy("distance", F.desc("weight"), "doc").limit(limit)


def placed(docs: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """expand for docs(doc) alone: a document's place follows from the links of its own keys."""
    keys = links.join(docs, "doc", "left_semi").select("key").distinct()
    near = links.join(F.broadcast(keys) if few(keys) else keys, "key", "left_semi")
    return expand(near, seeds.join(near.select("doc").union(docs.select("doc")).distinct(), "doc", "left_semi")).join(docs, "doc", "left_semi")


def boost(distance: Column, seed: Column, weight: float = 0.25) -> Column:
    """What a document's place in the graph adds to a higher-is-better score."""
    weight = max(0.0, min(0.5, weight))
    decay = F.when(distance == 1, DECAY[1]).when(distance == 2, DECAY[2]).otherwise(0.0)
    return F.coalesce(F.lit(weight) * decay * (0.6 + 0.4 * seed), F.lit(0.0))


def signal_index(labels: DataFrame, doc: str, text: str) -> DataFrame:
    """(token, signal): which whole signals have a token, to look up before they are verified."""
    return labels.select(F.lower(F.trim(text)).alias("signal")).distinct().select(F.explode(F.array_distinct(terms(F.col("signal")))).alias("token"), "signal")


def source_stamps(tables: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(source_table, n, stamp) of the tables that a graph is built from; a stamp doesn't depend on the rows' order."""
    hashed = lambda cs: F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cs]).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    stamp = lambda cs: F.pmod(F.coalesce(F.sum(hashed(cs)), F.lit(0).cast("decimal(38,0)")), F.lit(1000000007)).cast("long")
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n"), stamp(cs).alias("stamp")).select(F.lit(t).alias("source_table"), "n", "stamp") for t, df, cs in tables])


def stale_sources(now: DataFrame, kept: DataFrame) -> DataFrame:
    """now with stale: whether a table's stamp differs from the kept one or was never kept. A graph is rebuilt if any is."""
    old = kept.select("source_table", F.col("n").alias("_n"), F.col("stamp").alias("_stamp"))
    same = (F.col("n") == F.col("_n")) & (F.col("stamp") == F.col("_stamp"))
    return now.join(old, "source_table", "left").select("source_table", "n", "stamp", (~F.coalesce(same, F.lit(False))).alias("stale"))


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """The graph that is loaded: first, or second where first has no rows. Searches prefer the live tables, judgements the stored graph."""
    return second if first.isEmpty() else first


#: Parts of a stored graph, by document.
GRAPH_PARTS = 64


def _by_doc(links: DataFrame, parts: int) -> DataFrame:
    """links with their part, each once; a part's rows lie in one task, so that what follows by part moves nothing."""
    rows = links.select("doc", "src", "dst", "edge_type").withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))
    return rows.repartition("part").distinct()


def _stamps(links: DataFrame) -> DataFrame:
    """(part, doc, stamp): what the links of each document are, each told once, in whatever order."""
    return links.groupBy("part", "doc").agg(F.concat_ws("/", F.count("*").cast("string"), F.bit_xor(F.xxhash64("src", "dst", "edge_type")).cast("string")).alias("stamp"))


def stored_links(spark: SparkSession, path: str, key: str = "long", end: str = "string") -> DataFrame:
    """(doc, src, dst, edge_type, part) of a stored graph; key and end are the types of documents and of ends."""
    return spark.read.schema(f"doc {key}, src {end}, dst {end}, edge_type string, part int").parquet(f"{path}/links")


def _as_stored(links: DataFrame, path: str) -> DataFrame:
    return stored_links(links.sparkSession, path, links.schema["doc"].dataType.simpleString(), links.schema["src"].dataType.simpleString())


def write_graph(links: DataFrame, path: str, parts: int = GRAPH_PARTS) -> None:
    """Stores a graph's links(doc, src, dst, edge_type) by document, with a stamp of each document's.

    Ends are of one type, node ids or what these are made of. Links move once; stamps are those of what was stored.
    """
    _by_doc(links, parts).write.mode("overwrite").partitionBy("part").parquet(f"{path}/links")
    _stamps(_as_stored(links, path)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/stamps")


def refresh_graph(links: DataFrame, path: str, parts: int = GRAPH_PARTS) -> list[int]:
    """Brings a stored graph up to date with links(doc, src, dst, edge_type); the parts that were written.

    Documents whose stamp differs, that are new or gone, say which parts are touched; these are
    replaced, all others keep their files. A part that has become empty is removed.
    """
    spark = links.sparkSession
    now, kept = _by_doc(links, parts), spark.read.schema("doc long, stamp string, part int").parquet(f"{path}/stamps")
    kept = kept.withColumn("doc", F.col("doc").cast(links.schema["doc"].dataType))
    new, old = _stamps(now).alias("n"), kept.alias("o")
    both = new.join(old, (F.col("n.part") == F.col("o.part")) & F.col("n.doc").eqNullSafe(F.col("o.doc")), "full")
    differs, there = ~F.col("n.stamp").eqNullSafe(F.col("o.stamp")), F.col("n.part").isNotNull()
    seen = both.groupBy(F.coalesce("n.part", "o.part").alias("part")).agg(F.bool_or(differs).alias("touched"), F.bool_or(there).alias("left"))
    found = seen.where("touched").collect()  # as many as there are parts
    touched, left = sorted(r["part"] for r in found), sorted(r["part"] for r in found if r["left"])
    for part in set(touched) - set(left):
        for table in ("links", "stamps"):
            drop_folder(spark, f"{path}/{table}/part={part}")
    if left:
        replace_partitions(now.where(F.col("part").isin(*left)), f"{path}/links", "part")
        replace_partitions(_stamps(_as_stored(links, path).where(F.col("part").isin(*left))).repartition("part"), f"{path}/stamps", "part")
    return touched


def stored_edges(spark: SparkSession, path: str, key: str = "long") -> DataFrame:
    """The edges of a stored graph, each once."""
    return edges([stored_links(spark, path, key)])


def bundle_rows(bundles: DataFrame) -> DataFrame:
    """(source, kind, ref, type, label, aliases, src, dst) of foreign bundles(source, json), whichever of three shapes they have.

    {"nodes", "edges"} of a project's graph; a bundle of "entities", "relations" and "timeline"; and
    {"artifacts": {"nodes.json", "edges.jsonl", ...}}, lists by the role that their name gives. Kinds
    are node, edge and event. Ids are put under their source, edges without two different ends are
    left out, as is what has no id; an edge without an id is told by its ends and type. Records of
    several shapes in one bundle all count, a record told twice counts once.
    """
    v = F.try_parse_json("json")
    get = lambda x, *names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(x, f"$.{n}", "string")), F.lit("")) for n in names])
    roles = {
        "node": ("$.nodes", "$.entities", "$.artifacts['nodes.json']", "$.artifacts['entities.json']"), "edge": ("$.edges", "$.relations", "$.artifacts['edges.json']", "$.artifacts['relations.json']"),
        "event": ("$.timeline", "$.timeline.events", "$.artifacts['timeline.json']", "$.artifacts['events.json']"),
    }
    of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))
    lists = [F.transform(F.try_variant_get(v, path, "array<variant>"), of(kind)) for kind, paths in roles.items() for path in paths]
    none = F.array().cast("array<struct<kind:string,x:variant>>")
    x = bundles.select("source", F.explode(F.flatten(F.array(*[F.coalesce(y, none) for y in lists]))).alias("r")).select("source", "r.kind", "r.x")
    ref = lambda native: F.concat(F.lit("ext:"), F.col("source"), F.lit(":"), native)
    src, dst = get(F.col("x"), "source_id", "src_node_id", "source", "from", "subject_id"), get(F.col("x"), "target_id", "dst_node_id", "target", "to", "object_id")
    kind = F.when(F.col("kind") == "edge", F.coalesce(get(F.col("x"), "edge_type", "relation_type", "type"), F.lit("RELATED"))).when(F.col("kind") == "event", "EVENT").otherwise(F.upper(F.coalesce(get(F.col("x"), "node_type", "type", "kind"), F.lit("OBJ"))))
    native = F.coalesce(get(F.col("x"), "id", "native_id", "node_id", "edge_id", "event_id"), F.when(F.col("kind") == "edge", F.concat_ws("/", src, kind, dst)))
    aliases = F.coalesce(F.try_variant_get("x", "$.aliases", "array<string>"), F.array().cast("array<string>"))
    is_edge = F.col("kind") == "edge"
    out = x.select("source", "kind", ref(native).alias("ref"), kind.alias("type"), F.coalesce(get(F.col("x"), "label", "name", "title"), F.when(is_edge, kind), native).alias("label"), aliases.alias("aliases"), F.when(is_edge, ref(src)).alias("src"), F.when(is_edge, ref(dst)).alias("dst"))
    return out.where("ref is not null and (kind <> 'edge' or (src is not null and dst is not null and src <> dst))").distinct()


#: Terms that a foreign node brings to the documents that it is linked with, at most.
BRIDGE_TERMS = 30


def bridge_terms(rows: DataFrame, most: int = BRIDGE_TERMS) -> DataFrame:
    """(ref, place, term): what each foreign node of bundle_rows is known by, the first most terms.

    Its own label and aliases come first, then for each of its edges, by their ref, the edge's label
    and the label and aliases of the node at its other end. A term counts once, in lower case.
    """
    nodes_ = rows.where("kind = 'node'").select("ref", F.concat(F.array("label"), F.col("aliases")).alias("names"))
    edge = rows.where("kind = 'edge'").select(F.col("ref").alias("edge"), F.col("label").alias("said"), "src", "dst")
    ends = edge.select(F.col("src").alias("ref"), "edge", "said", F.col("dst").alias("other")).union(edge.select("dst", "edge", "said", "src"))
    near = ends.join(nodes_.select(F.col("ref").alias("other"), F.col("names").alias("theirs")), "other", "left")
    own = nodes_.select("ref", F.lit("").alias("edge"), F.posexplode("names").alias("i", "term"))
    theirs = near.select("ref", "edge", F.posexplode(F.concat(F.array("said"), F.coalesce("theirs", F.array().cast("array<string>")))).alias("i", "term"))
    every = own.union(theirs).where("trim(term) <> ''").select("ref", F.lower(F.trim("term")).alias("term"), F.struct("edge", "i").alias("at"))
    first = every.groupBy("ref", "term").agg(F.min("at").alias("at")).join(nodes_.select("ref"), "ref", "left_semi")
    return top_rows(first, ["ref"], [F.col("at"), F.col("term")], most).select("ref", F.col("rank").alias("place"), "term")
