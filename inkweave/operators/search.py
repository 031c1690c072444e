"""Ranked full-text search: BM25, phrases, overlap scores, fusion and reliability."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import lexicon as lx
from inkweave.functions.text import search_terms, terms
from inkweave.session import cut_lineage, drop_folder, shared_folder

K1, B = 1.2, 0.75
#: Texts that a task holds as Python's strings at once; a batch of Arrow has up to 10,000.
SLICE = 256


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches a few at a time, without copies: what a task makes of texts is as large as a slice, not a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def top_k(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Terms of queries that go to every task at most, all queries together; more queries are scored over an index. Queries whose
#: phrases are looked up in the tasks.
TASK_TERMS, TASK_QUERIES = 200_000, 20_000
#: Documents that are scored together, and scores that are held at once.
ROWS, SCORES = 256, 1 << 21


def _features(counts: Counter, place: dict[str, int], repeats: bool) -> list[tuple[int, int]]:
    """(place, count) of a text's known terms; with repeats the second and further ones of a term are terms of their own."""
    own = counts.keys() & place.keys()
    if not repeats:
        return [(place[w], counts[w]) for w in own]
    return [(place[w], 1) for w in own] + [(place[f], 1) for w in own for i in range(1, counts[w]) if (f := f"{w} {i}") in place]


def _weights_by_term(asked: dict[int, dict[str, float]]) -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, the terms' places, and for each term where its (query, weight) pairs begin, as one row after the other."""
    ids = sorted(asked)
    by_term: dict[str, list[tuple[int, float]]] = {}
    for j, q in enumerate(ids):
        for t, x in asked[q].items():
            by_term.setdefault(t, []).append((j, x))
    pairs = [p for ps in by_term.values() for p in ps]
    begins = np.concatenate([[0], np.cumsum([len(ps) for ps in by_term.values()])]).astype(np.int64)
    return np.array(ids, np.int64), {t: i for i, t in enumerate(by_term)}, begins, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], float)


def scored_in_place(docs: DataFrame, asked: dict[int, dict[str, float]], k: int, weight: tuple[float, float, float] | None, repeats: bool = False) -> DataFrame:
    """(query, doc, score): at most k best documents of each query and task, by a weighted sum over the terms they share.

    docs has (doc, words), its terms joined by blanks; asked has the terms' weights by query. Documents stay where they
    are: every task keeps k a query, so what is sent on grows with the tasks, never with pairs that share a term. weight
    is (k1, b, mean length) of BM25, or None for a plain sum. repeats has a term's further occurrences as "term 1" and on.
    Tasks get a number for each term of a query, no more.
    """
    names, place, begins, query, weights = _weights_by_term(asked)
    rows = max(1, min(ROWS, SCORES // max(1, len(names))))

    def block(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, queries and scores of what shares a term."""
        counts = [Counter(t.split(" ")) if t else Counter() for t in words]
        seen = [(i, f, n) for i, c in enumerate(counts) for f, n in _features(c, place, repeats)]
        if not seen:
            return (np.zeros(0, np.int64),) * 3
        row, term, tf = (np.array(x) for x in zip(*seen, strict=True))
        if weight:
            k1, b, mean = weight
            length = np.array([c.total() for c in counts], float)[row]
            tf = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        many = begins[term + 1] - begins[term]
        at = np.repeat(begins[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        raw = np.bincount(np.repeat(row, many) * len(names) + query[at], weights[at] * np.repeat(tf, many), minlength=len(words) * len(names)).reshape(len(words), -1)
        s = np.round(raw, 6)
        most = min(k, len(words))
        floor = np.partition(s, len(words) - most, axis=0)[len(words) - most]  # what ties with the last one stays, for the order by document
        i, j = np.nonzero((s >= floor) & (raw > 0))
        return i, j, s[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pd.DataFrame | None = None
        for b in in_slices(batches, rows):
            own = np.array(b.column("doc").to_pylist(), np.int64)
            i, j, s = block(b.column("words").to_pylist())
            new = pd.DataFrame({"query": names[j], "doc": own[i], "score": s})
            best = pd.concat([*([best] if best is not None else []), new]).sort_values(["query", "score", "doc"], ascending=[True, False, True]).groupby("query").head(k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best["query"], pa.int64()), pa.array(best["doc"], pa.int64()), pa.array(best["score"], pa.float64())], ["query", "doc", "score"])

    return docs.mapInArrow(run, "query long, doc long, score double") if asked else docs.sparkSession.createDataFrame([], "query long, doc long, score double")


def _by_query(asked: DataFrame) -> dict[int, Counter] | None:
    """The terms of each query of asked(query, ts), or None where they are more than TASK_TERMS."""
    if (asked.agg(F.sum(F.size("ts") + 1)).first()[0] or 0) > TASK_TERMS:
        return None
    return {r["query"]: Counter(r["ts"]) for r in asked.collect()}


def bm25(corpus: DataFrame, queries: DataFrame, doc: str, query: str, k: int, kept: Column | None = None, text: str = "text", most_terms: int = 24) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query; better scores are lower.

    Statistics are those of the whole corpus, kept only says which of its rows may be results. Queries
    of up to TASK_TERMS terms go to the documents, which are scored where they are; for more the
    corpus is indexed first. Query and document ids are integers.
    """
    able = kept if kept is not None else F.lit(True)
    asked = queries.select(F.col(query).alias("query"), search_terms(F.col(text), most_terms).alias("ts"))
    own = _by_query(asked)
    if own is None:
        scored = _bm25_by_index(corpus.select(F.col(doc).alias("unit"), F.col(text).alias("text"), F.when(able, F.array(F.lit("kept"))).alias("tags")), queries.select(F.col(query).alias("query"), F.lit("kept").alias("tag"), F.col(text).alias("text")), k, most_terms)
    else:
        scored = _bm25_in_place(corpus.select(F.col(doc).alias("doc"), search_terms(F.col(text)).alias("ts"), able.alias("kept")), own, k)
    return top_k(scored, "query", [F.col("score"), F.col("doc")], k).select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


def _idf(n: float, n_t: float) -> float:
    x = math.log((n - n_t + 0.5) / (n_t + 0.5))
    return x if x > 0 else 1e-6


def _bm25_in_place(docs: DataFrame, asked: dict[int, Counter], k: int) -> DataFrame:
    known = {t for q in asked.values() for t in q}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, length = Counter(), 0, 0
        for b in in_slices(batches):
            for t in b.column("words").to_pylist():
                words = t.split(" ") if t else []
                found.update(known.intersection(words))
                n, length = n + 1, length + len(words)
        yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([n, *found.values()], pa.int64()), pa.array([length, *[0] * len(found)], pa.int64())], ["term", "n", "length"])

    flat = docs.select("doc", "kept", F.array_join("ts", " ").alias("words"))
    sums = {r["term"]: r for r in flat.select("words").mapInArrow(count, "term string, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}  # a row for each term of the queries
    if not sums or not sums[""]["n"]:
        return docs.sparkSession.createDataFrame([], "query long, doc long, score double")
    n, mean = sums[""]["n"], (sums[""]["length"] / sums[""]["n"]) or 1.0
    weights = {q: {t: _idf(n, sums[t]["n"]) for t in ts if t in sums} for q, ts in asked.items()}
    found = scored_in_place(flat.where("kept").select("doc", "words"), weights, k, (K1, B, mean))
    return found.select("query", "doc", (-F.col("score")).alias("score"))


def _bm25_by_index(units: DataFrame, queries: DataFrame, k: int, most_terms: int) -> DataFrame:
    """(query, doc, score) by an index that is stored for this search."""
    from inkweave.operators.postings import search_postings, write_postings

    spark = units.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    write_postings(units, path)
    found = cut_lineage(search_postings(spark, path, queries, k, most_terms))
    drop_folder(spark, path)
    return found.select("query", F.col("unit").alias("doc"), "score")


#: Characters of a query that are its phrase, and terms whose run is looked up before the whole phrase is compared.
PHRASE_CHARS, RUN = 180, 6


def phrase_of(text: Column, compat: bool = False) -> Column:
    """The terms that lie whole in a text's first PHRASE_CHARS characters; as first written, a term cut in two counts as it is cut."""
    cut = F.regexp_replace(F.substring(text, 1, PHRASE_CHARS + 1), r"[\p{L}\p{N}]+$", "")
    return search_terms(F.substring(text, 1, PHRASE_CHARS) if compat else F.when(F.length(text) > PHRASE_CHARS, cut).otherwise(text))


def phrase_matches(corpus: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", compat: bool = False) -> DataFrame:
    """(query, doc): documents that hold the terms of a query's beginning (phrase_of) in a row.

    A query is looked up by the hash of its first RUN terms, or of all it has if they are fewer, among
    the documents' runs of that many; where the hash is met, the whole phrase is compared. Hashes of
    up to TASK_QUERIES queries go to the documents, of which only places that meet one are sent on;
    those of more are joined. Queries without terms match nothing.
    """
    asked = queries.select(F.col(query).alias("query"), phrase_of(F.col(text), compat).alias("phrase")).where("size(phrase) > 0")
    asked = asked.withColumn("n", F.least(F.size("phrase"), F.lit(RUN))).withColumn("h", F.xxhash64(F.slice("phrase", 1, F.col("n"))))
    rows = asked.select("n", "h", F.size("phrase").alias("size")).limit(TASK_QUERIES + 1).collect()
    few = len(rows) <= TASK_QUERIES
    sizes = sorted({r["n"] for r in rows}) if few else list(range(1, RUN + 1))
    longest = max((r["size"] for r in rows), default=0) if few else PHRASE_CHARS
    docs = corpus.select(F.col(doc).alias("doc"), search_terms(F.col(text)).alias("ts"))

    def places(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("ts") - n + 1), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("ts", i, F.lit(n))).alias("h")))
        own = [r["h"] for r in rows if r["n"] == n]
        runs = F.filter(runs, lambda x: x["h"].isin(*own)) if few else runs
        return F.transform(F.when(F.size("ts") >= n, runs), lambda x: F.struct(F.lit(n).alias("n"), x["h"].alias("h"), F.slice("ts", x["at"], F.lit(longest)).alias("here")))

    if not sizes:
        return asked.join(docs.limit(0).select("doc"), F.lit(False)).select(F.col("query").alias(query), F.col("doc").alias(doc))
    every = F.flatten(F.array(*[F.coalesce(places(n), F.array().cast("array<struct<n:int,h:bigint,here:array<string>>>")) for n in sizes]))
    met = docs.select("doc", F.explode(every).alias("x")).select("doc", "x.*").join(asked, ["n", "h"]).where(F.slice("here", 1, F.size("phrase")) == F.col("phrase"))
    return met.select(F.col("query").alias(query), F.col("doc").alias(doc)).distinct()


def overlap_scores(corpus: DataFrame, queries: DataFrame, doc: str, query: str, k: int, text: str = "text") -> DataFrame:
    """(query, doc, score, rank): shared terms as multisets, over the query's number of terms.

    As in bm25, queries of up to TASK_TERMS terms go to the documents; more are joined by term, the corpus
    cut to the queries' terms first.
    """
    asked = queries.select(F.col(query).alias("query"), terms(F.col(text)).alias("ts"))
    own = _by_query(asked)
    if own is not None:
        weights = {q: {t if i == 0 else f"{t} {i}": 1.0 for t, n in ts.items() for i in range(n)} for q, ts in own.items() if ts}
        flat = corpus.select(F.col(doc).cast("long").alias("doc"), F.array_join(terms(F.col(text)), " ").alias("words"))
        # counts are whole, so the k best of a query by count are those by share
        found = scored_in_place(flat, weights, k, None, repeats=True)
        totals = corpus.sparkSession.createDataFrame([(q, sum(ts.values())) for q, ts in own.items()], "query long, total long")
        scored = found.join(F.broadcast(totals), "query").select("query", "doc", F.round(F.col("score") / F.col("total"), 6).alias("score"))
    else:
        count = lambda df, key: df.select(key, F.explode("ts").alias("term")).groupBy(key, "term").agg(F.count("*").alias(f"n_{key}"))
        wanted = count(asked, "query")
        total = wanted.groupBy("query").agg(F.sum("n_query").alias("total"))
        theirs = corpus.select(F.col(doc).alias("doc"), F.explode(terms(F.col(text))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
        theirs = theirs.groupBy("doc", "term").agg(F.count("*").alias("n_doc"))
        shared = wanted.join(theirs, "term").groupBy("query", "doc").agg(F.sum(F.least("n_query", "n_doc")).alias("shared"))
        scored = shared.join(total, "query").select("query", "doc", F.round(F.col("shared") / F.col("total"), 6).alias("score"))
    return top_k(scored, "query", [F.desc("score"), F.col("doc")], k).select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


def base_strength(score: Column, full_text: bool = True) -> Column:
    """Strength of a retrieval score; as first written, a better BM25 score gives a lower one."""
    return 1 / (1 + F.abs(score)) if full_text else clamp(score)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fused_score(base: Column, rank: Column, hop: Column, filtered: Column) -> Column:
    graph = F.when(hop <= 1, 0.15).when(hop == 2, 0.08).otherwise(0.0)
    return 0.60 * base + 0.25 / rank + graph + F.when(filtered, 0.05).otherwise(0.0)


def reliability(verdict: Column, n: Column, confirmed: Column, fts: Column, model: Column) -> Column:
    """How far a verdict can be relied on, by evidence, confirmations and scores."""
    evidence = clamp(0.45 * clamp(n / 3.0) + 0.25 * clamp(confirmed / F.greatest(n, F.lit(1))) + 0.20 * F.when(n > 0, clamp(fts)).otherwise(0.0) + 0.10 * clamp(model))
    unknown = F.when(n == 0, 0.03).otherwise(clamp(0.10 + 0.30 * evidence))
    decision = F.when(verdict == "UNKNOWN", unknown).when(verdict == "VIOLATE", clamp(0.55 + 0.45 * evidence)).otherwise(clamp(0.50 + 0.45 * evidence))
    out = clamp(0.65 * evidence + 0.35 * decision)
    return F.when(verdict == "UNKNOWN", F.least(out, F.lit(0.45))).otherwise(out)


def _numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0"))))


def entailment(df: DataFrame, premise: str, hypothesis: str) -> DataFrame:
    """df with entail, contradict and neutral for two texts, from shared terms, numbers, negations and opposites.

    Terms and numbers are columns of their own step, so each text is taken apart once.
    """
    kept = df.columns
    words = F.array(*map(F.lit, lx.NEGATIONS))
    step = df.select(*kept, F.array_distinct(terms(F.col(premise))).alias("_p"), F.array_distinct(terms(F.col(hypothesis))).alias("_h"), _numbers(F.col(premise)).alias("_np"), _numbers(F.col(hypothesis)).alias("_nh"))
    p, h = F.col("_p"), F.col("_h")
    told = F.array(*map(F.lit, dict.fromkeys(w for pair in lx.OPPOSITES for w in pair)))
    numbers = (F.size("_np") > 0) & (F.size("_nh") > 0) & ~F.arrays_overlap("_np", "_nh")
    # a step for what the next one mentions more than once: written out, these sums are code that is too long to be compiled
    step = step.select(
        *kept, F.size(p).alias("_np_"), F.size(h).alias("_nh_"), F.size(F.array_intersect(p, h)).alias("_shared"),
        (F.arrays_overlap(p, words) != F.arrays_overlap(h, words)).alias("_negated"), numbers.alias("_numbers"), F.array_intersect(p, told).alias("_p"), F.array_intersect(h, told).alias("_h"),
    )
    opposed = F.lit(False)
    for a, b in lx.OPPOSITES:
        opposed = opposed | (F.array_contains(p, a) & F.array_contains(h, b)) | (F.array_contains(p, b) & F.array_contains(h, a))
    step = step.select(*kept, "_np_", "_nh_", "_negated", (F.col("_numbers").cast("int") + ((F.size(p) > 0) & (F.size(h) > 0) & opposed).cast("int")).alias("_signals"), (F.col("_shared") / F.greatest("_nh_", F.lit(1))).alias("_coverage"), (F.col("_shared") / F.greatest("_np_", F.lit(1))).alias("_precision"))
    c = F.col
    step = step.withColumn("_signals", c("_signals") + (c("_negated") & (c("_coverage") > 0.25)).cast("int"))
    entail = clamp(0.08 + 0.72 * c("_coverage") + 0.20 * c("_precision"))
    against = F.when(c("_signals") > 0, clamp(0.35 + 0.22 * c("_signals") + 0.20 * (1 - c("_coverage")))).otherwise(clamp(0.04 + 0.16 * (1 - c("_coverage"))))
    empty = (c("_np_") == 0) | (c("_nh_") == 0)
    sure = (c("_coverage") >= 0.95) & (c("_precision") >= 0.55) & (c("_signals") == 0)
    step = step.select(*kept, "_signals", entail.alias("_entail"), against.alias("_against"), empty.alias("_empty"), sure.alias("_sure"))
    step = step.select(*kept, F.when((c("_signals") > 0) & (c("_entail") > 0.2), c("_entail") * 0.7).otherwise(c("_entail")).alias("_entail"), "_against", "_empty", "_sure")
    step = step.withColumn("_rest", clamp(1 - F.greatest("_entail", "_against")))
    step = step.withColumn("_total", c("_entail") + c("_against") + c("_rest"))
    pick = lambda x, if_sure, if_empty: F.when(c("_empty"), if_empty).when(c("_sure"), if_sure).otherwise(clamp(c(x) / c("_total")))
    return step.select(*kept, pick("_entail", 0.96, 0.0).alias("entail"), pick("_against", 0.02, 0.0).alias("contradict"), pick("_rest", 0.02, 1.0).alias("neutral"))


def pair_score(query: Column, snippet: Column) -> Column:
    """Lexical score of a snippet for a query: coverage, precision and a bonus for the whole phrase."""
    q, s = F.array_distinct(terms(query)), F.array_distinct(terms(snippet))
    shared = F.size(F.array_intersect(q, s))
    flat = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    score = 0.10 + 0.60 * shared / F.greatest(F.size(q), F.lit(1)) + 0.20 * shared / F.greatest(F.size(s), F.lit(1)) + F.when(F.contains(flat(snippet), flat(query)), 0.25).otherwise(0.0)
    return F.when(shared == 0, 0.0).otherwise(clamp(score))
