"""Queries of full-text and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.catalogue import query
from inkweave.functions.text import search_terms
from inkweave.operators import postings as po
from inkweave.operators import search as se
from inkweave.operators import vectors as ve
from inkweave.session import cut_lineage, drop_folder, read_table, shared_folder

T = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
#: The same without marks, as full-text search has it.
TF = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
FIRST = f"list_slice(list_filter({TF.format('text')}, lambda x, i: list_position({TF.format('text')}, x) = i), 1, 24)"
BM25 = (
    f"WITH d AS (SELECT doc_id, lang, source, {TF.format('text')} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d), q AS (SELECT item_id, unnest({FIRST}) AS term FROM benchmark),"
    " p AS (SELECT doc_id, lang, source, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc_id, lang, source, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),"
    " df AS (SELECT term, count(*) AS n_t FROM tf GROUP BY term), w AS (SELECT term, CASE WHEN ln((n - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_t + 0.5) / (n_t + 0.5)) END AS idf, avgdl FROM df, st),"
    " s AS (SELECT item_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN w USING (term) JOIN tf USING (term) WHERE %s GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS rank FROM s)"
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark")


@query("bm25_topk", BM25 % "true" + " SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return se.bm25(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 3)


def _index(spark: SparkSession, d: str, **kinds: bool) -> str:
    """Documents as an index, each under its language."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    po.write_postings(_docs(spark, d).select(F.col("doc_id").alias("unit"), "text", F.array("lang").alias("tags")), path, **kinds)
    return path


STORED = " , f AS (SELECT r.item_id, r.doc_id, score, row_number() OVER (PARTITION BY r.item_id ORDER BY score, r.doc_id) AS in_lang FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE d.lang = 'en')"


@query("bm25_stored_index", BM25 % "true" + STORED + " SELECT item_id, 'all' AS searched, doc_id, score, rank FROM r WHERE rank <= 3 UNION ALL SELECT item_id, 'en', doc_id, score, in_lang FROM f WHERE in_lang <= 3")
def bm25_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of every item, of all and of one language, from one stored index."""
    path = _index(spark, d, places=False, by_tag=False)
    # both searches of an item in one pass over the index: even ones are for all documents
    both = F.explode(F.array(F.struct(F.lit(0).alias("odd"), F.lit(None).cast("string").alias("tag")), F.struct(F.lit(1).alias("odd"), F.lit("en").alias("tag"))))
    asked = _items(spark, d).select("item_id", "text", both.alias("s")).select((F.col("item_id") * 2 + F.col("s.odd")).alias("query"), "s.tag", "text")
    found = po.search_postings(spark, path, asked, 3)
    item = F.shiftright("query", 1).cast(dict(_items(spark, d).dtypes)["item_id"])
    out = cut_lineage(found.select(item.alias("item_id"), F.when(F.col("query") % 2 == 0, "all").otherwise("en").alias("searched"), F.col("unit").alias("doc_id"), "score", "rank"))
    drop_folder(spark, path)
    return out


@query("bm25_filtered", BM25 % "lang = 'en' AND source IN ('src1', 'src2', 'src3', 'src4')" + " SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = (F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3", "src4")
    return se.bm25(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 5, kept)


@query(
    "phrase_search",
    f"WITH c AS (SELECT item_id, CASE WHEN length(text) > 180 THEN regexp_replace(substr(text, 1, 181), '[\\p{{L}}\\p{{N}}]+$', '') ELSE text END AS beginning FROM benchmark),"
    f" q AS (SELECT item_id, ' ' || array_to_string({TF.format('beginning')}, ' ') || ' ' AS phrase FROM c WHERE len({TF.format('beginning')}) > 0),"
    f" d AS (SELECT doc_id, ' ' || array_to_string({TF.format('text')}, ' ') || ' ' AS flat FROM documents) SELECT item_id, doc_id FROM q JOIN d ON contains(flat, phrase)",
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return se.phrase_matches(_docs(spark, d), _items(spark, d), "doc_id", "item_id")


@query(
    "phrase_stored_index",
    f"WITH q AS (SELECT item_id, ' ' || array_to_string(list_slice({TF.format('text')}, 3, 12), ' ') || ' ' AS phrase FROM benchmark WHERE len({TF.format('text')}) > 2), d AS (SELECT doc_id, lang, ' ' || array_to_string({TF.format('text')}, ' ') || ' ' AS flat FROM documents)"
    " SELECT item_id, doc_id FROM q JOIN d ON contains(flat, phrase) WHERE item_id % 2 = 0 OR lang = 'en'",
)
def phrase_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold ten terms of an item in a row, by the index's places; items with an odd id ask for one language."""
    path = _index(spark, d, by_tag=False)
    phrases = _items(spark, d).select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 2 == 1, "en").alias("tag"), F.slice(search_terms(F.col("text")), 3, 10).alias("phrase"))
    out = cut_lineage(po.phrase_postings(spark, path, phrases).select(F.col("query").alias("item_id"), F.col("unit").alias("doc_id")))
    drop_folder(spark, path)
    return out


@query(
    "token_overlap",
    f"WITH q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({T.format('text')}) AS term FROM benchmark) GROUP BY ALL), d AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({T.format('text')}) AS term FROM documents) GROUP BY ALL),"
    " t AS (SELECT item_id, sum(n) AS total FROM q GROUP BY item_id), s AS (SELECT item_id, doc_id, round(sum(least(q.n, d.n)) / any_value(total), 6) AS score FROM q JOIN d USING (term) JOIN t USING (item_id) GROUP BY ALL)"
    " SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3",
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return se.overlap_scores(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 3)



def hashed_sql(n: str, key: str, table: str, text: str = "text") -> str:
    h = lambda *at: "('0x' || " + " || ".join(f"substr(h, {i}, 2)" for i in at) + ")::BIGINT"
    return (
        f"{n}t AS (SELECT {key} AS id, sha256(unnest({T.format(text)})) AS h FROM {table}),"
        f" {n}b AS (SELECT id, {h(7, 5, 3, 1)} % 96 AS b, sum(CASE WHEN {h(9)} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM {n}t GROUP BY ALL),"
        f" {n}v AS (SELECT id, b, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0) AS w FROM {n}b)"
    )


@query(
    "hashed_embed_search",
    "WITH " + hashed_sql("d", "doc_id", "documents") + ", " + hashed_sql("q", "item_id", "benchmark") + ", s AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (b) GROUP BY ALL)"
    " SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3",
)
def hashed_embed_search(spark: SparkSession, d: str) -> DataFrame:
    return ve.nearest_texts(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 3)


@query(
    "dense_knn",
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"
    " SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5",
)
def dense_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    found = ve.nearest(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", 6)
    return se.top_k(found.where("vec_id <> query_id").drop("rank"), "query_id", [F.desc("score"), F.col("vec_id")], 5)


@query("cell_knn")
def cell_knn(spark: SparkSession, d: str) -> DataFrame:
    """dense_knn by the other backend: vectors stored in 32 cells, of which every query looks at 20; tests measure what it misses."""
    rows = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = cut_lineage(ve.search_vectors(rows, asked, "vec_id", "query_id", 6, "cells", path, 32, 20))
    drop_folder(spark, path)
    return se.top_k(found.where("vec_id <> query_id").drop("rank"), "query_id", [F.desc("score"), F.col("vec_id")], 5)


@query("vector_mean", "SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return ve.mean_vector(rows, by="label").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query(
    "triage_anomaly",
    "WITH w AS (SELECT list(m ORDER BY i) AS world FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY i)),"
    " a AS (SELECT vec_id, label, round(1 - greatest(0, least(1, (list_cosine_similarity(embedding::DOUBLE[], world) + 1) / 2)), 6) AS anomaly FROM embeddings, w),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY anomaly DESC, vec_id) AS rank FROM a) SELECT * FROM r WHERE rank <= 8 AND (anomaly >= 0.5 OR rank = 1)",
)
def triage_anomaly(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    world = [r["mean"] for r in ve.mean_vector(rows).orderBy("dim").collect()]  # one vector
    scored = rows.select("vec_id", "label", F.round(ve.anomaly(F.col("vec"), F.array(*map(F.lit, world))), 6).alias("anomaly"))
    return se.top_k(scored, "label", [F.desc("anomaly"), F.col("vec_id")], 8).where("anomaly >= 0.5 or rank = 1")


@query(
    "fused_rerank",
    BM25 % "true" + ", c AS (SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 12), x AS (SELECT c.*, source, first_value(source) OVER (PARTITION BY item_id ORDER BY rank) AS top_source, lang FROM c JOIN documents USING (doc_id)),"
    " f AS (SELECT item_id, doc_id, round(0.60 / (1 + abs(score)) + 0.25 / rank + CASE WHEN source = top_source THEN 0.15 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.05 ELSE 0.0 END, 6) AS fused FROM x)"
    " SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM f QUALIFY rank <= 3",
)
def fused_rerank(spark: SparkSession, d: str) -> DataFrame:
    found = se.bm25(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 12).join(_docs(spark, d).select("doc_id", "source", "lang"), "doc_id")
    top = found.groupBy("item_id").agg(F.min_by("source", "rank").alias("top_source"))
    hop = F.when(F.col("source") == F.col("top_source"), 1).otherwise(9)
    fused = se.fused_score(se.base_strength(F.col("score")), F.col("rank"), hop, F.col("lang") == "en")
    scored = found.join(top, "item_id").select("item_id", "doc_id", F.round(fused, 6).alias("fused"))
    return se.top_k(scored, "item_id", [F.desc("fused"), F.col("doc_id")], 3)


CL = "greatest(0.0, least(1.0, {0}))"


@query(
    "reliability_score",
    "WITH o AS (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'VIOLATE' WHEN bool_or(l_returnflag = 'N') THEN 'OK' ELSE 'UNKNOWN' END AS verdict, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS c,"
    " avg(l_discount) * 10 AS fts, avg(l_tax) * 10 AS model FROM lineitem GROUP BY l_orderkey),"
    f" e AS (SELECT *, {CL.format('0.45 * least(1.0, n / 3.0) + 0.25 * least(1.0, c / n) + 0.20 * ' + CL.format('fts') + ' + 0.10 * ' + CL.format('model'))} AS ev FROM o),"
    " r AS (SELECT *, 0.65 * ev + 0.35 * CASE verdict WHEN 'UNKNOWN' THEN 0.10 + 0.30 * ev WHEN 'VIOLATE' THEN least(1.0, 0.55 + 0.45 * ev) ELSE least(1.0, 0.50 + 0.45 * ev) END AS x FROM e)"
    " SELECT l_orderkey, verdict, round(CASE WHEN verdict = 'UNKNOWN' THEN least(x, 0.45) ELSE least(1.0, x) END + 1e-9, 6) AS reliability FROM r",
)
def reliability_score(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    groups = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.when(F.bool_or(flag == "R"), "VIOLATE").when(F.bool_or(flag == "N"), "OK").otherwise("UNKNOWN").alias("verdict"), F.count("*").alias("n"), F.count_if(flag == "N").alias("c"),
        (F.avg("l_discount") * 10).alias("fts"), (F.avg("l_tax") * 10).alias("model"),
    )
    return groups.select("l_orderkey", "verdict", F.round(se.reliability(F.col("verdict"), F.col("n"), F.col("c"), F.col("fts"), F.col("model")) + 1e-9, 6).alias("reliability"))


NUM = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: ltrim(x, '0')))"


@query(
    "nli_heuristic",
    BM25 % "true" + f", j AS (SELECT r.item_id, r.doc_id, list_distinct({T.format('d.text')}) AS p, list_distinct({T.format('b.text')}) AS h, {NUM.format('d.text')} AS np, {NUM.format('b.text')} AS nh FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON r.item_id = b.item_id WHERE rank <= 3),"
    " c AS (SELECT *, len(list_intersect(p, h)) / greatest(len(h), 1) AS cov, len(list_intersect(p, h)) / greatest(len(p), 1) AS pre,"
    " (len(np) > 0 AND len(nh) > 0 AND NOT list_has_any(np, nh))::INT AS num, list_has_any(p, ['not', 'no', 'never', 'none', 'without', 'cannot', 'can''t', 'isnt', 'isn''t']) AS pn,"
    " list_has_any(h, ['not', 'no', 'never', 'none', 'without', 'cannot', 'can''t', 'isnt', 'isn''t']) AS hn, ("
    + " OR ".join(f"(list_contains(p, '{a}') AND list_contains(h, '{b}')) OR (list_contains(p, '{b}') AND list_contains(h, '{a}'))" for a, b in (("alive", "dead"), ("before", "after"), ("older", "younger"), ("inside", "outside"), ("same", "different")))
    + ")::INT AS opp FROM j), sg AS (SELECT *, num + opp + (pn <> hn AND cov > 0.25)::INT AS sig FROM c),"
    f" e AS (SELECT *, {CL.format('0.08 + 0.72 * cov + 0.20 * pre')} AS e0, CASE WHEN sig > 0 THEN {CL.format('0.35 + 0.22 * sig + 0.20 * (1 - cov)')} ELSE {CL.format('0.04 + 0.16 * (1 - cov)')} END AS con FROM sg),"
    f" f AS (SELECT *, CASE WHEN sig > 0 AND e0 > 0.2 THEN e0 * 0.7 ELSE e0 END AS ent FROM e), g AS (SELECT *, {CL.format('1 - greatest(ent, con)')} AS neu FROM f)"
    " SELECT item_id, doc_id, round(CASE WHEN len(p) = 0 OR len(h) = 0 THEN 0.0 WHEN cov >= 0.95 AND pre >= 0.55 AND sig = 0 THEN 0.96 ELSE ent / (ent + con + neu) END, 6) AS entail,"
    " round(CASE WHEN len(p) = 0 OR len(h) = 0 THEN 0.0 WHEN cov >= 0.95 AND pre >= 0.55 AND sig = 0 THEN 0.02 ELSE con / (ent + con + neu) END, 6) AS contradict FROM g",
)
def nli_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Entailment of every item by its three best documents."""
    found = se.bm25(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 3).select("item_id", "doc_id")
    both = found.join(_items(spark, d).withColumnRenamed("text", "hypothesis"), "item_id").join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return se.entailment(both, "text", "hypothesis").select("item_id", "doc_id", F.round("entail", 6).alias("entail"), F.round("contradict", 6).alias("contradict"))


def _triage(n: str, key: str, table: str) -> str:
    """The other hashed embedding, over terms of ASCII and Korean letters."""
    h = lambda at: f"('0x' || substr(h, {at}, 2))::BIGINT"
    return (
        f"{n}t AS (SELECT {key} AS id, sha1(unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'))) AS h FROM {table}),"
        f" {n}b AS (SELECT id, ({h(1)} * 256 + {h(3)}) % 96 AS b, sum(CASE WHEN {h(5)} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM {n}t GROUP BY ALL),"
        f" {n}v AS (SELECT id, b, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0) AS w FROM {n}b)"
    )


@query(
    "triage_embed_search",
    "WITH " + _triage("d", "doc_id", "documents") + ", " + _triage("q", "item_id", "benchmark") + ", s AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (b) GROUP BY ALL)"
    " SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3",
)
def triage_embed_search(spark: SparkSession, d: str) -> DataFrame:
    return ve.nearest_texts(_docs(spark, d), _items(spark, d), "doc_id", "item_id", 3, ve.triage_embedding)


@query(
    "vector_shard_search",
    "WITH m AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 3), e AS (SELECT * FROM embeddings WHERE label IN (SELECT label FROM m)),"
    " s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN e v ON q.vec_id % 100 = 0)"
    " SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 4",
)
def vector_shard_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored by shard; the manifest says which three shards, the largest, are searched."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    rows = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    ve.write_shards(rows, path, "label")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return ve.nearest(ve.shards(spark, path, [F.desc("n"), F.col("label")], 3), asked, "vec_id", "query_id", 4)
