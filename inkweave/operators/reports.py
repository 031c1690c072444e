"""Slots, signatures, gates and summaries of runs: what reports and checks are made from.

Column functions work row by row. Tables are summed before they move; where a few rows of a key
are wanted, no key's rows are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import lexicon as lx
from inkweave.functions.text import nfkc, squeezed
from inkweave.operators.relational import top_rows

TOKEN = "[0-9A-Za-z가-힣]"
PHRASE_BREAKS = r"""[\s,./;:()\[\]{}<>|"'“”‘’]+"""
CANDIDATES = "array<struct<slot_key:string,value:string,confidence:string,span_start:string,span_end:string,matched_text:string>>"
METRICS = ("claims_processed", "chunks_processed", "rows_scanned", "rss_mb_peak")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


# slots and values


def slot_key(constraint: Column, schema_type: Column, tag_path: Column) -> Column:
    """The slot that a tag's constraint names, else its schema type's, else that of a keyword in its path, else null."""
    named, path = F.lower(F.trim(constraint)), F.lower(nfkc(F.coalesce(tag_path, F.lit(""))))
    out = F.when(named.isin(*lx.SLOT_KEYWORDS), named)
    for kind, slot in lx.SCHEMA_SLOTS.items():
        out = out.when(F.lower(F.trim(schema_type)) == kind, slot)
    for slot, words in lx.SLOT_KEYWORDS.items():
        out = out.when(_any([path.contains(w) for w in words]), slot)
    return out


def numeric_tokens(text: Column) -> Column:
    """The distinct whole numbers in a text, by size; those of over 38 digits are left out."""
    found = F.regexp_extract_all(nfkc(F.coalesce(text, F.lit(""))), F.lit(r"-?\d+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda t: t.try_cast("decimal(38,0)")))))


def bool_word(text: Column) -> Column:
    """True for a word of death, false for one of life, else null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*lx.DEAD_WORDS), True).when(word.isin(*lx.ALIVE_WORDS), False)


def token_before(text: Column, start: Column) -> Column:
    """The word that ends before place start, or an empty string."""
    return F.regexp_extract(F.substring(text, F.lit(1), F.greatest(start, F.lit(0))), rf"({TOKEN}+)\s*$", 1)


def token_after(text: Column, end: Column) -> Column:
    """The word after place end, a comma between them allowed, at most 16 characters; or an empty string."""
    return F.regexp_extract(F.substring(text, F.greatest(end, F.lit(0)) + 1, F.length(text)), rf"^\s*[,，]?\s*({TOKEN}{{1,16}})", 1)


def is_descriptive(token: Column) -> Column:
    """Whether a word ends as an attributive form does."""
    return ~token.endswith("의") & _any([token.endswith(s) for s in lx.DESCRIPTIVE_SUFFIXES])


def phrase_tokens(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), PHRASE_BREAKS), lambda t: F.regexp_replace(t, f"[^{TOKEN[1:-1]}]+", ""))
    return F.filter(parts, lambda t: t != "")


def fuzzy_overlap(a: Column, b: Column) -> Column:
    """Whether a word of one phrase holds a word of the other."""
    return F.exists(phrase_tokens(a), lambda x: F.exists(phrase_tokens(b), lambda y: x.contains(y) | y.contains(x)))


def memo_key(text: Column, filters: Column | None = None) -> Column:
    """One key for texts that differ in spaces, case and compatible forms alone, with their filters' JSON."""
    key = F.trim(squeezed(nfkc(F.coalesce(text, F.lit("")))))
    return key if filters is None else F.concat(key, F.when(filters.isNotNull(), F.concat(F.lit("|"), filters)).otherwise(""))


def model_candidates(raw: Column) -> Column:
    """Candidates that a model gave as JSON: confidence between 0 and 1 (else 0.5), places of 0 or more; those without a slot go."""

    def place(x: Column) -> Column:
        return F.greatest(F.lit(0), F.coalesce(x.try_cast("double").try_cast("long"), F.lit(0)))

    def clean(c: Column) -> Column:
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c["confidence"].try_cast("double"), F.lit(0.5))))
        return F.struct(
            c["slot_key"].alias("slot_key"), c["value"].alias("value"), sure.alias("confidence"), place(c["span_start"]).alias("s"), place(c["span_end"]).alias("e"),
            F.coalesce(c["matched_text"], c["value"], F.lit("")).alias("matched_text"),
        )

    return F.transform(F.filter(F.from_json(raw, CANDIDATES), lambda c: c["slot_key"].isNotNull()), clean)


# signatures and classes


def signature(reasons: Column) -> Column:
    """Distinct reasons in order, parted by bars; <none> without any."""
    clean = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))
    return F.when(F.size(clean) > 0, F.array_join(F.array_sort(F.array_distinct(clean)), "|")).otherwise("<none>")


def dataset_key(path: Column, doc_count: Column) -> Column:
    """The data set that a path names, else the one of so many documents; null for any other."""
    path = F.coalesce(path, F.lit(""))
    size = lambda name: F.regexp_extract(path, rf"(?i)DS[-_]?{name}[-_]?(\d+)", 1)
    known = lambda n: n.try_cast("int").isin(200, 400, 800)
    count = lambda n: n.try_cast("int").cast("string")
    diverse, growth = size("DIVERSE"), size("GROWTH")
    return (
        F.when((diverse != "") & known(diverse), F.concat(F.lit("DS-DIVERSE-"), count(diverse)))
        .when(diverse != "", None)
        .when((growth != "") & known(growth), F.concat(F.lit("DS-"), count(growth)))
        .when((path == "") & known(doc_count), F.concat(F.lit("DS-"), count(doc_count)))
    )


def attempt_status(states: dict[str, Column], failures: dict[str, Column]) -> Column:
    """Stages that didn't succeed and counts that aren't zero, or SUCCEEDED."""
    parts = []
    for name, state in states.items():
        word = F.upper(F.trim(F.coalesce(state, F.lit(""))))
        parts.append(F.when((word != "") & (word != "SUCCEEDED"), F.concat(F.lit(f"{name}:"), word)))
    for name, count in failures.items():
        n = count.try_cast("long")
        parts.append(F.when(count.isNotNull() & n.isNull(), f"{name}:INVALID").when(n != 0, F.concat(F.lit(f"{name}:"), n.cast("string"))))
    text = F.concat_ws(",", *parts)
    return F.when(text == "", "SUCCEEDED").otherwise(text)


def actionability(claims: Column, unknown: Column, violated: Column, lane: Column, shadow_claims: Column, shadow_lane: Column) -> Column:
    """What a run's claims, or those set apart in its shadow, leave to act on."""
    n, u, v, s = (F.coalesce(c, F.lit(0)) for c in (claims, unknown, violated, shadow_claims))
    apart = F.coalesce(lane == "mainline_excludes_local_profile_only", F.lit(False))
    return (
        F.when((n > 0) & (u >= n) & (v == 0), "MAINLINE_ALL_UNKNOWN").when(n > 0, "MAINLINE_ACTIVE")
        .when(apart & (s > 0) & F.coalesce(shadow_lane == "shadow_local_profile_only", F.lit(False)), "SEPARATED_TO_SHADOW").when(apart, "MAINLINE_EMPTY_AFTER_SEPARATION")
        .otherwise("NO_MAINLINE_CLAIMS")
    )


def layer_state(enabled: Column, capable: Column, reranked: Column, promoted: Column) -> Column:
    """off where no job enables the layer, active where it had an effect, else inactive."""
    return F.when(F.coalesce(enabled, F.lit(0)) <= 0, "off").when(_any([F.coalesce(c, F.lit(0)) > 0 for c in (capable, reranked, promoted)]), "active").otherwise("inactive")


def review_reason(standalone: Column, boundaries: Column, front_matter: Column, gated: Column, unsupported: Column) -> Column:
    """Why a source's episodes have to be looked at by hand."""
    return (
        F.when((standalone >= 2) & (boundaries == standalone), "ambiguous_standalone_numbers").when((front_matter >= 2) & (boundaries == 0), "front_matter_dominant")
        .when((gated >= 2) & (boundaries <= 1), "blank_line_gate_filtered_candidates").when((unsupported >= 2) & (boundaries == 0), "unsupported_header_variant")
        .when(boundaries == 0, "no_repeated_markers").when(boundaries == 1, "single_detected_marker").otherwise("insufficient_repeated_markers")
    )


def line_hits(text: Column, head: int = 80) -> Column:
    """struct(front_matter, unsupported): lines with words of front matter among the first, and lines like headers of no known form."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    front = F.filter(F.slice(lines, 1, head), lambda x: _any([F.lower(x).contains(w) for w in lx.FRONT_MATTER]))
    odd = F.filter(lines, lambda x: _any([x.rlike(p) for p in lx.UNSUPPORTED_HEADERS]))
    return F.struct(F.size(front).alias("front_matter"), F.size(odd).alias("unsupported"))


# tables


def queued(jobs: DataFrame, kinds: list[str], most: int = 20) -> DataFrame:
    """The jobs(id, type, status, priority, created_at) that wait, the most urgent and then the oldest first: a report of most rows."""
    return jobs.where((F.col("status") == "QUEUED") & F.col("type").isin(kinds)).orderBy(F.desc("priority"), "created_at", "id").limit(most)


def best_hypothesis(scores: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, label, score) of the best of each key's scores(key, label, place, score), the first of ties; label is empty below least."""
    best = scores.groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select(key, F.when(F.col("b.score") >= least, F.col("b.label")).otherwise("").alias("label"), F.col("b.score").alias("score"))


def signal_score(hits: DataFrame, key: str, cap: int = 3) -> DataFrame:
    """(key, score, first) of hits(key, slot, start): hits of each slot up to cap, summed, and where the first one is."""
    slots = hits.groupBy(key, "slot").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    return slots.groupBy(key).agg(F.sum(F.least("n", F.lit(cap))).alias("score"), F.min("first").alias("first"))


def effective_policy(profiles: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """profiles(key, policy, patterns, ...) with those of the registry in their place where it says anything."""
    given = registry.select(F.col(key).alias("of"), F.coalesce("policy", F.lit("auto")).alias("own"), F.coalesce("patterns", F.array().cast("array<string>")).alias("own_patterns"))
    says = (F.col("own") != "auto") | (F.size("own_patterns") > 0)
    joined = profiles.join(given.where(says), profiles[key] == F.col("of"), "left")
    rest = [c for c in profiles.columns if c not in ("policy", "patterns")]
    return joined.select(*rest, F.coalesce("own", "policy").alias("policy"), F.coalesce("own_patterns", "patterns").alias("patterns"), F.col("of").isNotNull().alias("from_registry"))


def confidence_band(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, median, p90, most) of a value, null as zero; p90 is the value at nine tenths of the way, rounded to a place.

    Equal values are counted before they move, so a key's window is as long as its distinct values.
    """
    counts = rows.groupBy(key, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("x")
    placed = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    return placed.groupBy(key).agg(F.min("x").alias("least"), ((at(low) + at(high)) / 2).alias("median"), at(F.bround((F.col("all") - 1) * 0.9)).alias("p90"), F.max("x").alias("most"))


def graph_run_summary(runs: DataFrame, key: str, samples: int = 8) -> DataFrame:
    """(key, n, applied, skipped, sample) of runs(key, query, applied): counts and the first samples queries that it applied to."""
    sums = runs.groupBy(key).agg(F.count("*").alias("n"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"))
    some = top_rows(runs.where("applied").select(key, "query"), [key], [F.asc("query")], samples).groupBy(key).agg(F.array_sort(F.collect_list("query")).alias("sample"))
    return sums.join(some, key, "left").withColumn("sample", F.coalesce("sample", F.array().cast(some.schema["sample"].dataType)))


def probe_filters(kinds: dict[str, DataFrame], key: str, most: int = 8) -> DataFrame:
    """(key, filter) from tables (key, value) of entities, times and timelines: each filter once, most for a key."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.to_json(F.create_map(F.lit(kind), F.col("value").cast("string"))).alias("filter")) for kind, df in kinds.items()])
    return top_rows(rows.dropDuplicates([key, "filter"]), [key], [F.asc("filter")], most).select(key, "filter")


def payload_metrics(jobs: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Sums of what jobs' payloads (JSON) say they did, and their largest memory; what is no positive number counts as none."""
    x = lambda m: F.greatest(F.lit(0.0), F.coalesce(F.get_json_object(payload, f"$.{m}").try_cast("double"), F.lit(0.0)))
    return jobs.groupBy(key).agg(*[(F.max(x(m)) if m == "rss_mb_peak" else F.sum(x(m))).alias(m) for m in METRICS])
