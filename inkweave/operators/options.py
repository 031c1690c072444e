"""Requests' options: each resolved from a JSON text to a value that is allowed, whatever was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Option -> (place in the request, kind, default, allowed choices). A count is at least 1, a share between 0 and 1.
OPTIONS = {
    "evidence_link_policy": ("evidence_link_policy", "choice", "full", ("full", "cap", "contradict_only")), "evidence_link_cap": ("evidence_link_cap", "count", 20, ()),
    "exclude_self_evidence": ("exclude_self_evidence", "flag", True, ()), "self_evidence_scope": ("self_evidence_scope", "choice", "claim", ("claim", "range", "doc")),
    "graph_expand_enabled": ("graph_expand_enabled", "flag", False, ()), "graph_max_hops": ("graph_max_hops", "hops", 1, (1, 2)), "graph_doc_cap": ("graph_doc_cap", "count", 200, ()),
    "layer3_promotion": ("layer3_verdict_promotion", "flag", False, ()), "layer3_min_fts": ("layer3_min_fts_for_promotion", "share", 0.25, ()), "layer3_max_claim_chars": ("layer3_max_claim_chars", "count", 260, ()),
    "layer3_ok_threshold": ("layer3_ok_threshold", "share", 0.92, ()), "layer3_contradict_threshold": ("layer3_contradict_threshold", "share", 0.85, ()),
    "verifier_mode": ("verifier.mode", "choice", "off", ("off", "conservative_nli")), "verifier_ok_threshold": ("verifier.promote_ok_threshold", "share", 0.95, ()),
    "verifier_alert_threshold": ("verifier.contradict_alert_threshold", "share", 0.70, ()), "verifier_max_claim_chars": ("verifier.max_claim_chars", "count", 220, ()),
    "triage_mode": ("triage.mode", "choice", "off", ("off", "embedding_anomaly")), "triage_threshold": ("triage.anomaly_threshold", "share", 0.65, ()), "triage_max_segments": ("triage.max_segments_per_run", "count", 8, ()),
    "loop_enabled": ("verification_loop.enabled", "flag", False, ()), "loop_max_rounds": ("verification_loop.max_rounds", "count", 2, ()), "loop_timeout_ms": ("verification_loop.round_timeout_ms", "count", 250, ()),
}


def resolved(request: Column, option: str) -> Column:
    """The value of an option in a request's JSON text; its default where it is absent, null, of another kind or not allowed."""
    place, kind, default, allowed = OPTIONS[option]
    raw = F.get_json_object(request, f"$.{place}")
    if kind == "choice":
        word = F.lower(F.trim(raw))
        return F.when(word.isin(*allowed), word).otherwise(default)
    if kind == "flag":
        return F.when(raw.isNull(), default).otherwise(~F.lower(raw).isin("false", "0", "0.0", "", "[]", "{}"))
    number = raw.try_cast("double")
    if kind == "share":
        return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    if kind == "hops":
        return F.when(whole.isin(*allowed), whole.cast("long")).otherwise(F.lit(default).cast("long"))
    return F.when(whole.isNull(), F.lit(default).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), whole.cast("long")))


def resolved_requests(requests: DataFrame, key: str, request: str, options: tuple[str, ...] = tuple(OPTIONS)) -> DataFrame:
    """(key, option, value) of each request's options, values as text."""
    pairs = [F.struct(F.lit(o).alias("option"), resolved(F.col(request), o).cast("string").alias("value")) for o in options]
    return requests.select(key, F.explode(F.array(*pairs)).alias("o")).select(key, "o.*")


def evidence_bundles(rows: DataFrame, claim: str, most: int) -> DataFrame:
    """(claim, n, bundle): a claim's best evidence as a JSON list for a model; missing texts are empty, missing numbers 0, no match type is FUZZY.

    rows have (claim, rank, doc_id, snippet_text) and may have the other columns of evidence. Only
    the first ranks are gathered, so a bundle is bounded however many rows a claim has.
    """
    texts = ("doc_id", "snapshot_id", "section_path", "tag_path", "snippet_text")
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    item = F.struct(
        F.col("rank").alias("rank"),
        *[F.coalesce(have(c).cast("string"), F.lit("")).alias(c) for c in texts],
        have("chunk_id").cast("string").alias("chunk_id"),
        *[F.coalesce(have(c).cast("int"), F.lit(0)).alias(c) for c in ("span_start", "span_end")],
        F.coalesce(have("match_type").cast("string"), F.lit("FUZZY")).alias("match_type"),
        F.coalesce(have("confirmed").cast("boolean"), F.lit(False)).alias("confirmed"),
    )
    best = rows.where(F.col("rank") <= most).groupBy(claim).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return best.select(claim, F.size("items").alias("n"), F.to_json(F.transform("items", lambda x: x.dropFields("rank"))).alias("bundle"))
