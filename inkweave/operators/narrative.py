"""Operators around chapters and claims: scopes, self-evidence, timelines, probes, suggestions, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import lexicon as lx
from inkweave.functions.text import WORD, header_kind, line_spans
from inkweave.operators.search import top_k

#: Characters of an episode that no header ends, and words that name world documents.
FALLBACK_CHARS, WORLD_TYPES = 12_000, ("SETTING", "CHAR", "PLOT")
#: Aliases that go to the segments at most, and segments of a task, about, where these are dealt out.
FEW_ALIASES, TASK_SEGMENTS = 100_000, 65_536
#: Templates by conflict kind, appended under their own heading.
INJECTIONS = {"age": "He was {0} years old.", "place": "It happened in {0}.", "job": "She worked as a {0}.", "death": "He had died by then."}


def without_self_evidence(rows: DataFrame, scope: Column) -> DataFrame:
    """Retrieved rows(doc_id, s, e, claim_doc, cs, ce) without those of the claim itself, and how many were left out by claim.

    Scope doc leaves out all rows of the claim's document, scope claim those whose span
    overlaps the claim's; rows with an empty span stay.
    """
    own = F.col("doc_id") == F.col("claim_doc")
    clash = (F.col("s") < F.col("e")) & (F.col("s") < F.col("ce")) & (F.col("cs") < F.col("e"))
    return rows.withColumn("removed", own & F.when(scope == "doc", True).otherwise(clash))


def doc_scope(docs: DataFrame, inputs: DataFrame, window: int = 10) -> DataFrame:
    """(input_id, doc_id): for each input document itself, the world's documents and episodes at most window apart.

    docs and inputs have (doc_id or input_id, project, type, episode). Episodes meet by blocks of
    window numbers, so the join has an equi-key.
    """
    ask = inputs.select("input_id", "project", F.col("episode").alias("at"))
    itself = ask.select("input_id", F.col("input_id").alias("doc_id"))
    world = docs.where(F.col("type").isin(*WORLD_TYPES)).join(ask, "project").select("input_id", "doc_id")
    blocks = ask.where("at is not null").withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / window) + k for k in (-1, 0, 1)])))
    episodes = docs.where("type = 'EPISODE' and episode is not null").withColumn("block", F.floor(F.col("episode") / window))
    near = episodes.join(blocks, ["project", "block"]).where(F.abs(F.col("episode") - F.col("at")) <= window).select("input_id", "doc_id")
    return itself.union(world).union(near).distinct()


def doc_scope_sizes(docs: DataFrame, inputs: DataFrame, window: int = 10) -> DataFrame:
    """(input_id, n_docs): how many documents are in each input's scope, without listing them.

    Documents are counted by project and by episode before they meet, so a project's size shows
    in its counts alone. inputs have (input_id, project, type, episode) and are among docs.
    """
    world_type = F.col("type").isin(*WORLD_TYPES)
    episodic = (F.col("type") == "EPISODE") & F.col("episode").isNotNull()
    world = docs.where(world_type).groupBy("project").agg(F.count("*").alias("n_world"))
    counts = docs.where(episodic).groupBy("project", "episode").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("episode") / window))
    asked = inputs.where("episode is not null").select("project", F.col("episode").alias("at")).distinct()
    asked = asked.withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / window) + k for k in (-1, 0, 1)])))
    near = counts.join(asked, ["project", "block"]).where(F.abs(F.col("episode") - F.col("at")) <= window).groupBy("project", F.col("at").alias("episode")).agg(F.sum("n").alias("n_near"))
    n = lambda c: F.coalesce(c, F.lit(0))
    itself = F.when(F.coalesce(F.col("project").isNotNull() & (world_type | episodic), F.lit(False)), 0).otherwise(1)
    both = inputs.join(world, "project", "left").join(near, ["project", "episode"], "left")
    return both.select("input_id", (n(F.col("n_world")) + n(F.col("n_near")) + itself).alias("n_docs"))


def time_value_valid(v: Column) -> Column:
    """Whether a time is one: hours and minutes, or month and day, in range; other texts pass."""
    hour, minute = (F.regexp_extract(v, r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    month, day = (F.regexp_extract(v, r"(\d{1,2})월\s*(\d{1,2})일", k).try_cast("int") for k in (1, 2))
    return F.when(v.rlike(r"^\d{1,2}:\d{2}$"), hour.between(0, 23) & minute.between(0, 59)).when(v.rlike(r"\d{1,2}월\s*\d{1,2}일"), month.between(1, 12) & day.between(1, 31)).otherwise(True)


def timeline(df: DataFrame, key: str, phrase: str, text: str = "text") -> DataFrame:
    """(key, idx, label, time_key): an event for each line that isn't blank; its key is its first time phrase or its beginning."""
    lines = line_spans(df, key, text)
    first = F.regexp_extract("line", phrase, 0)
    return lines.select(key, F.col("idx"), F.col("line").alias("label"), F.when(first != "", first).otherwise(F.substring("line", 1, 40)).alias("time_key"))


#: Characters of the piece by which a pattern is looked up, and patterns of a group that are compared without.
GRAM, FEW = 4, 64


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, each once; linear in the text."""
    pieces = lambda cs: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)])))
    return F.when(F.length(text) >= n, F.element_at(F.transform(F.array(F.split(text, "")), pieces), 1))


def holding(segments: DataFrame, patterns: DataFrame, keys: list[str], group: str, text: str = "segment") -> DataFrame:
    """(keys, pattern) for the segments(keys, text) that hold a pattern of their group; patterns has (group, pattern), group is one of keys.

    Where a group has FEW patterns at most, they come to its segments as they are. In other groups a
    pattern is looked up by the rarest of its runs of GRAM characters, or by itself if it is shorter,
    among the runs of the segments; only where that is met is the pattern compared. So the work is
    linear in the text, and a segment never meets all patterns of a large group. Empty and null
    patterns are in no segment; keys name a segment. No pattern or text is broadcast: they may be long.
    """
    own = patterns.where("pattern <> ''").select(F.col(group).alias("_group"), "pattern").distinct()
    sizes = own.groupBy("_group").agg(F.count("*").alias("n"))
    small, crowded = sizes.where(F.col("n") <= FEW).select("_group"), sizes.where(F.col("n") > FEW).select("_group")
    few = own.join(small.hint("merge"), "_group", "left_semi").groupBy("_group").agg(F.collect_list("pattern").alias("patterns"))
    each = segments.select(*keys, F.col(text).alias("_text")).join(few.hint("merge"), F.col(group) == F.col("_group"))
    direct = each.select(*keys, F.explode(F.filter("patterns", lambda p: F.contains("_text", p))).alias("pattern"))

    many = own.join(crowded, "_group", "left_semi")
    rest = segments.select(*keys, F.col(text).alias("_text")).join(crowded, F.col(group) == F.col("_group"), "left_semi")
    runs = many.select("_group", "pattern", F.explode(F.coalesce(_grams(F.col("pattern"), GRAM), F.array("pattern"))).alias("gram"))
    counts = runs.groupBy("_group", "gram").agg(F.count("*").alias("n"))
    anchors = runs.join(counts.hint("merge"), ["_group", "gram"]).groupBy("_group", "pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    every = F.flatten(F.array_compact(F.array(*[_grams(F.col("_text"), n) for n in range(1, GRAM + 1)])))
    met = rest.select(*keys, F.explode(every).alias("_gram")).join(anchors.hint("merge"), (F.col(group) == F.col("_group")) & (F.col("_gram") == F.col("gram"))).select(*keys, "pattern")
    looked_up = met.join(rest.hint("merge"), keys).where(F.contains("_text", F.col("pattern"))).select(*keys, "pattern")
    return direct.union(looked_up)


def first_event(segments: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, timeline_idx): the first event of a segment's own timeline whose key or label it holds; null if none.

    Segments and events share the keys' first column, the timeline; keys name a segment.
    """
    words = events.select(keys[0], "idx", F.explode(F.array("time_key", "label")).alias("pattern"))
    first = words.groupBy(keys[0], "pattern").agg(F.min("idx").alias("event_idx"))
    found = holding(segments, words, keys, keys[0]).join(first.hint("merge"), [keys[0], "pattern"]).groupBy(*keys).agg(F.min("event_idx").alias("timeline_idx"))
    return segments.select(*keys).join(found.hint("merge"), keys, "left")


def named_in(segments: DataFrame, aliases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity_id) for the entities whose aliases(alias, entity_id) a segment names, each once.

    An alias of up to two characters is named by a word that is it, or it and a particle; a longer one
    if all its words are among the segment's. Aliases are looked up by a word: short ones by each
    form, longer ones by their rarest word, whose other words are then asked for. Aliases
    without a word name nothing.
    """
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    words = segments.select(F.col(key).alias("_key"), tokens.alias("tokens"))
    own = aliases.where("alias <> '' and entity_id is not null").select("alias", "entity_id").distinct().withColumn("parts", F.array_distinct(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0)))).where("size(parts) > 0")
    forms = F.array(*[F.concat("alias", F.lit(p)) for p in ("", *lx.ALIAS_PARTICLES)])
    short = own.where("length(alias) <= 2").select("entity_id", F.explode(forms).alias("word"), F.array().cast("array<string>").alias("parts"))
    long = own.where("length(alias) > 2").select("entity_id", "alias", "parts", F.explode("parts").alias("word"))
    rare = long.groupBy("word").agg(F.count("*").alias("n"))
    long = long.join(rare, "word").groupBy("entity_id", "alias", "parts").agg(F.min_by("word", F.struct("n", "word")).alias("word")).select("entity_id", "word", "parts")
    met = words.select("_key", F.explode("tokens").alias("word")).join(short.union(long).distinct(), "word").select("_key", "entity_id", "parts")
    whole = met.where("size(parts) <= 1").select("_key", "entity_id")
    more = met.where("size(parts) > 1").join(words, "_key").where(F.size(F.array_except("parts", "tokens")) == 0).select("_key", "entity_id")
    return whole.union(more).distinct().withColumnRenamed("_key", key)


def aliases_in(segments: DataFrame, aliases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity_id, n): entities whose one-word alias is a word of the text; aliases shared by entities count for each."""
    own = aliases.select(F.lower("alias").alias("alias"), "entity_id").distinct()
    own = F.broadcast(own) if own.limit(FEW_ALIASES + 1).count() <= FEW_ALIASES else own
    # a key's rows lie in one task, which holds the counts of so many segments, whatever their number
    dealt = segments.select(key, text).repartition(max(1, -(-segments.count() // TASK_SEGMENTS)), key)
    words = dealt.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("alias"))
    return words.join(own, "alias").groupBy(key, "entity_id").agg(F.count("*").alias("n"))


def by_unique_alias(used: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, entity, state) for used(key, alias): the entity that all aliases of a key name, none, or null and ambiguous if they name several.

    aliases has (alias, entity_id); an alias that several entities have makes its keys ambiguous. Only
    the least and the greatest entity of an alias and of a key are kept, so no set is gathered.
    """
    ends = aliases.where("entity_id is not null").groupBy("alias").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    found = used.join(ends, "alias", "left").groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("entity"), F.when(F.col("lo").isNull(), "none").when(F.col("lo") == F.col("hi"), "one").otherwise("ambiguous").alias("state"))


def probe_text(anchors: DataFrame, texts: DataFrame, key: str, before: int = 24, after: int = 48) -> DataFrame:
    """(key, probe): the text around each key's earliest anchor; anchors have (key, s, e)."""
    first = anchors.groupBy(key).agg(F.min(F.struct("s", "e")).alias("a")).select(key, "a.*")
    begin = F.greatest(F.lit(0), F.col("s") - before)
    return texts.join(first, key).select(key, F.trim(F.substring("text", begin + 1, F.col("e") + after - begin)).alias("probe"))


def graph_trigger(rows: DataFrame, claim: str) -> DataFrame:
    """(claim, trigger): whether a claim's results are so few, weak or close together that the graph is asked."""
    w = Window.partitionBy(claim).orderBy(F.desc("strength"), "doc_id")
    two = rows.withColumn("i", F.row_number().over(w)).groupBy(claim).agg(F.count("*").alias("n"), F.max(F.when(F.col("i") == 1, F.col("strength"))).alias("top"), F.max(F.when(F.col("i") == 2, F.col("strength"))).alias("next"))
    weak = (F.col("n") < 4) | (F.col("top") < 0.30) | (F.col("top") - F.coalesce("next", F.lit(0.0)) < 0.07)
    return two.select(claim, "n", weak.alias("trigger"))


def suggestions(results: DataFrame, query: str, k: int = 3) -> DataFrame:
    """(query, n, citations): the best results of each query as a line of numbered citations; k is held between 1 and 10."""
    best = top_k(results, query, [F.col("score"), F.col("doc_id")], max(1, min(10, k)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["doc_id"].cast("string")))
    return best.groupBy(query).agg(F.count("*").alias("n"), F.array_join(F.slice(lines, 1, 5), " ").alias("citations"))


def injected(text: Column, kind: Column, value: Column) -> Column:
    """A text with a contradicting statement of a kind under its own heading."""
    out = F.lit("")
    for name, template in INJECTIONS.items():
        head, _, tail = template.partition("{0}")
        out = F.when(kind == name, F.concat(F.lit(head), value if "{0}" in template else F.lit(""), F.lit(tail))).otherwise(out)
    return F.concat(text, F.lit("\n\n[INJECT]\n"), out)


def episodes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, no, start, until, by_header): spans between header lines; a text without any is cut every FALLBACK_CHARS."""
    marks = line_spans(df, key, text).where(header_kind(F.col("line")).isNotNull()).select(key, "start")
    sized = df.select(key, F.length(text).alias("length"))
    ends = F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start")), F.col("length"))
    cut = sized.join(marks, key).select(key, "start", "length").withColumn("until", ends).select(key, "start", "until", F.lit(True).alias("by_header"))
    bare = sized.join(marks.select(key).distinct(), key, "left_anti")
    steps = bare.select(key, "length", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(FALLBACK_CHARS))).alias("start"))
    plain = steps.select(key, "start", F.least("length", F.col("start") + FALLBACK_CHARS).alias("until"), F.lit(False).alias("by_header"))
    every = cut.union(plain)
    return every.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("start")))


#: Synonyms of node types in foreign records.
NODE_TYPES = {"person": "CHAR", "character": "CHAR", "place": "LOC", "location": "LOC", "nation": "LOC", "organization": "ORG", "supplier": "ORG", "item": "OBJ", "object": "OBJ", "scene": "EVENT", "event": "EVENT"}


def external_nodes(records: DataFrame, source: str) -> DataFrame:
    """(node_ref, node_type, label, confidence) of foreign records(json): the first key that is filled counts, ids are put under their source, confidence is held between 0 and 1."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object("json", f"$.{n}")), F.lit("")) for n in names])
    kind = F.lower(first("type", "kind", "node_type"))
    named = F.lit("OBJ")
    for word, name in NODE_TYPES.items():
        named = F.when(kind == word, name).otherwise(named)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(first("confidence", "score").try_cast("double"), F.lit(1.0))))
    native = first("id", "node_id", "key")
    return records.select(F.concat(F.lit(f"ext:{source}:"), native).alias("node_ref"), named.alias("node_type"), F.coalesce(first("label", "name", "title"), native).alias("label"), confidence.alias("confidence")).where("node_ref is not null")


def preferred_cohort(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """The rows of each group with the flag, or all of a group that has none."""
    return df.withColumn("f", flag).withColumn("any", F.max("f").over(Window.partitionBy(group))).where(F.col("f") | ~F.col("any")).drop("f", "any")


def self_evidence_scope(line: Column, slot: Column) -> Column:
    """doc for a slot bound to a person on a line that states a profile, else claim."""
    profile = line.rlike(r"^\s*[0-9A-Za-z가-힣]{1,12}\s*[::]\s*\S")
    return F.when(profile & slot.isin("age", "death", "relation", "affiliation", "job", "talent"), "doc").otherwise("claim")


def anchored(slot: Column, value: Column, snippet: Column) -> Column:
    """Whether a snippet bears on a claim's value: it holds it without blanks, or shares a word (two, for values of several); blank snippets and other slots pass."""
    flat = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    shared = F.size(F.array_intersect(words(value), words(snippet)))
    enough = shared >= F.when(F.size(words(value)) <= 1, 1).otherwise(2)
    other = ~slot.isin("relation", "affiliation", "job", "talent")
    # one after the other, as an "or" takes the words of all rows apart first
    return F.when(other, True).when(F.trim(snippet) == "", True).when(F.contains(flat(snippet), flat(value)), True).otherwise(other | enough)


def facts_in_scope(facts: DataFrame, versions: DataFrame, scope: str = "latest_approved") -> DataFrame:
    """Facts to judge by: explicit ones that aren't rejected, or the approved ones of each project's newest version, the larger id on ties."""
    if scope == "explicit_only":
        return facts.where("layer = 'explicit' and status <> 'REJECTED'")
    newest = versions.groupBy("project").agg(F.max_by("schema_ver", F.struct("created_at", "schema_ver")).alias("schema_ver"))
    return facts.where("status = 'APPROVED'").join(newest, ["project", "schema_ver"], "left_semi")


def without_own_facts(facts: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts without the automatic, unreviewed ones whose evidence lies in the documents that are being judged."""
    own = evidence.join(documents.select("doc_id"), "doc_id", "left_semi").select(F.col("eid").alias("evidence_eid"))
    automatic = facts.where("source = 'AUTO' and status = 'PROPOSED'").join(own, "evidence_eid", "left_semi").select("fact_id")
    return facts.join(automatic, "fact_id", "left_anti")


def plausible_value(slot: Column, value: Column) -> Column:
    """Whether a text slot's value reads like a name: up to four words, none of them a clause's ending; other slots pass."""
    words = F.split(F.trim(value), r"\s+")
    clause = F.exists(words, lambda w: w.rlike("(?:하고|하며|했지만|이라고|라는|하면서|때문에)$"))
    return ~slot.isin("relation", "affiliation", "job", "talent") | ((F.size(words) <= 4) & (F.length(F.trim(value)) >= 2) & ~clause)


def targets(scored: DataFrame, key: str, score: str, n: int, seed: int = 0) -> DataFrame:
    """n rows to look at first: positive scores before others, larger ones first, then in an order drawn by the seed."""
    return scored.orderBy(F.col(score) <= 0, F.desc(score), F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


#: Shares of the texts that get a conflict injected and that are kept as they are to compare with; the rest is a pool.
INJECT, CONTROL = 0.1, 0.1


def bench_sets(docs: DataFrame, key: str, text: str, values: dict[str, str], seed: str = "bench", inject: float = INJECT, control: float = CONTROL) -> DataFrame:
    """docs with set (inject, control or pool), first (whether no earlier row has the text), kind and bench_text.

    A row's set depends on its trimmed text alone: copies are on one side, and new rows change no
    other's. Texts of the inject set are told a contradiction, of a kind of values (kind to its value)
    that the text decides, too; only the first row of each text, by key, is to be used. Null texts
    are one text; keys name a row.
    """
    fp = F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256)
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), fp).cast("binary"))
    share = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    kinds = sorted(values)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.conv(F.substring(drawn, 14, 4), 16, 10).cast("int") % len(kinds) + 1).cast("int"))
    value = F.lit("")
    for k, v in values.items():
        value = F.when(F.col("kind") == k, v).otherwise(value)
    rows = docs.withColumn("_fp", fp).withColumn("set", F.when(share < inject, "inject").when(share < inject + control, "control").otherwise("pool"))
    rows = rows.withColumn("kind", F.when(F.col("set") == "inject", kind))
    firsts = rows.groupBy("_fp").agg(F.min(key).alias("_first"))
    rows = rows.join(firsts, "_fp").withColumn("first", F.col(key) == F.col("_first"))
    told = F.when(F.col("set") == "inject", injected(F.coalesce(text, F.lit("")), F.col("kind"), value)).otherwise(F.col(text))
    return rows.withColumn("bench_text", told).drop("_fp", "_first")


def set_manifest(sets: DataFrame, key: str, by: str) -> DataFrame:
    """(set, by, n, n_chars, checksum): what each set holds of each group, rows that repeat a text left out.

    A checksum doesn't depend on the rows' order, so nothing is gathered.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.sha2(F.coalesce("bench_text", F.lit("")), 256)).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = sets.where("first").groupBy("set", by)
    return rows.agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("bench_text", F.lit("")))).alias("n_chars"), F.pmod(F.sum(digest), F.lit(1000000007)).cast("long").alias("checksum"))
