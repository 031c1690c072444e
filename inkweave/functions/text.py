"""Scalar and table functions over text. Spans are code points, half-open, from zero."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import lexicon as lx

WORD = r"[0-9A-Za-z가-힣]+"
TERM = r"[\p{L}\p{N}]+"
SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"


def terms(text: Column, most: int | None = None) -> Column:
    """Lower-case terms of letters and numbers; with most, the first distinct ones up to that many."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return found if most is None else F.slice(F.array_distinct(found), 1, most)


def _folding() -> tuple[str, str]:
    """Latin letters with marks and the letters below them; marks that stand alone come last, with nothing for them."""
    bases = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    marked = {c: b for c, b in bases.items() if b != c and b.isascii()}
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(marked.values())


MARKED, BARE = _folding()


def folded(text: Column) -> Column:
    """A text without the marks on its Latin letters; plain ASCII is left as it is."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, MARKED, BARE))


def search_terms(text: Column, most: int | None = None) -> Column:
    """Terms as full-text search has them: lower-case, without marks; with most, the first distinct ones up to that many."""
    return terms(folded(F.lower(text)), most)


#: What compatibility composition may change: all but ASCII and Latin letters, which stay as they are where nothing else is among them.
COMPOSABLE = r"[^\x00-\x9f\xc0-\xff]"


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks: only texts that it may change go to Python."""

    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.coalesce(F.pandas_udf(composed, "string")(F.when(text.rlike(COMPOSABLE), text)), text)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def snippet(text: Column, term: Column, width: int = 200, before: int = 50) -> Column:
    """A window of text from before the first place of term, or the text's beginning."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, F.lit(width))).otherwise(F.substring(text, 1, width))


#: Lengths that are summed in one go; a fold's output is copied as it grows, so it is kept short.
FOLD = 256


def running_starts(lengths: Column) -> Column:
    """Where each of consecutive pieces begins, from their lengths: linear in their number but for its 256th part."""
    fold = lambda xs, at: F.aggregate(xs, F.struct(at.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, n: a + n)
    blocks = lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(ls), F.lit(1)) - 1) / FOLD).cast("int")), lambda b: F.slice(ls, b * FOLD + 1, FOLD))
    return once(lengths, lambda ls: once(blocks(ls), lambda bs: once(fold(F.transform(bs, total), F.lit(0)), lambda at: F.flatten(F.zip_with(bs, at, fold)))))


def line_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, start, end, line) of the lines that aren't blank, idx by their order.

    A line's start is the running sum of lengths inside its document; no line leaves its row.
    """
    lines = F.split(F.col(text), "\n", -1)
    starts = running_starts(F.transform(lines, lambda x: (F.length(x) + 1).cast("bigint")))
    both = F.zip_with(lines, starts, lambda x, s: F.struct(s.cast("int").alias("s"), x.alias("l")))
    kept = F.filter(both, lambda x: F.trim(x["l"]) != "")
    out = df.select(key, F.posexplode(kept).alias("idx", "x"))
    return out.select(key, "idx", F.col("x.s").alias("start"), (F.col("x.s") + F.length("x.l")).alias("end"), F.trim("x.l").alias("line"))


def next_boundaries(spans: DataFrame, key: str, start: str = "start", last: str = "length") -> DataFrame:
    """spans with until: where the next one of the key begins, or the text ends."""
    return spans.withColumn("until", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), F.col(last)))


#: Characters of the longest token that is looked at before a stop.
LONGEST_TOKEN = 64


def is_abbreviation(text: str, at: int) -> bool:
    """Whether the stop at this place ends a known abbreviation or an ordinal number, or an initial with a capital right behind it."""
    begin = at
    while begin and at - begin < LONGEST_TOKEN and (text[begin - 1] in "._" or text[begin - 1].isalnum()):
        begin -= 1
    token = text[begin : at + 1].lower()
    if token in lx.ABBREVIATIONS or re.fullmatch(r"\d+(?:st|nd|rd|th)\.", token):
        return True
    return bool(re.fullmatch(r"[a-z]\.", token)) and text[at + 1 : at + 2].isalpha() and text[at + 1].isupper()


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Trimmed spans of sentences: ended by terminators with their closers, or by a line's end."""
    out, start, i, n = [], 0, 0, len(text)

    def close(end: int) -> None:
        raw = text[start:end]
        left = len(raw) - len(raw.lstrip())
        kept = raw.strip()
        if kept:
            out.append((start + left, start + left + len(kept), kept))

    while i < n:
        c = text[i]
        if c not in lx.SENTENCE_ENDS:
            i += 1
            continue
        if c == "." and 0 < i < n - 1 and text[i - 1].isdigit() and text[i + 1].isdigit() or c == "." and is_abbreviation(text, i):
            i += 1
            continue
        end = i + 1
        if c != "\n":
            stop = min(n, end + lx.MOST_CLOSERS)
            while end < stop and (text[end] in lx.SENTENCE_CLOSERS or text[end] in lx.SENTENCE_ENDS and text[end] != "\n"):
                end += 1
        close(end)
        start = i = end
    close(n)
    return out


def chunks(text: str, target: int = 1200, least: int = 240) -> list[tuple[int, int]]:
    """Spans of blank-line blocks, long ones cut at sentence ends, short ones merged to the left."""
    blocks = [(m.start(), m.end()) for m in re.finditer(r".+?(?:\n\s*\n|$)", text, re.S) if m[0].strip()]
    pieces: list[tuple[int, int]] = []
    for a, b in blocks:
        while b - a > target:
            cuts = [m.end() for m in re.finditer(r"[.!?。！？]\s+|\n", text[a : a + target])]
            cut = a + (cuts[-1] if cuts else target)
            pieces.append((a, cut))
            a = cut
        pieces.append((a, b))
    out: list[tuple[int, int]] = []
    most = target + max(200, target // 3)
    for a, b in pieces:
        if out and (b - a < least or out[-1][1] - out[-1][0] < least) and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out or [(0, len(text))]


#: rule -> (pattern, severity)
LINT_RULES = {
    "double-space": (r" {2,}", "WARN"), "trailing-whitespace": (r"[\t ]+(?=\r?\n)", "INFO"), "many-blank-lines": (r"\n{3,}", "INFO"), "space-before-punct": (r"[\t ]+([,.;:!?])", "WARN"),
    "repeated-punct": (r"([!?])\1+", "INFO"), "ellipsis": (r"\.{4,}", "INFO"),
}
#: The same as they were first written, with doubled backslashes, for those who rely on it.
LINT_RULES_COMPAT = {
    "double-space": (r" {2,}", "WARN"), "trailing-whitespace": (r"[\\t ]+(?=\\r?\\n)", "INFO"), "many-blank-lines": (r"\\n{3,}", "INFO"), "space-before-punct": (r"[\\t ]+([,.;:!?])", "WARN"),
    "repeated-punct": (r"([!?])\\1{1,}", "INFO"), "ellipsis": (r"\\.{4,}", "INFO"),
}


def lint(text: str, compat: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, rule, severity) of every proofreading match, by place."""
    rules = LINT_RULES_COMPAT if compat else LINT_RULES
    return sorted((m.start(), m.end(), rule, severity) for rule, (pattern, severity) in rules.items() for m in re.finditer(pattern, text))


def _over_texts(df: DataFrame, key: str, text: str, fn, schema: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, i, *r) for k, t in zip(p["key"], p["text"], strict=True) for i, r in enumerate(fn(t or ""))]
            yield pd.DataFrame(rows, columns=["key", "idx", *[c.split()[0] for c in schema.split(", ")]])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, idx int, {schema}").withColumnRenamed("key", key)


def sentence_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _over_texts(df, key, text, sentences, "start int, end int, sentence string")


def chunk_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _over_texts(df, key, text, chunks, "start int, end int")


def lint_table(df: DataFrame, key: str, text: str = "text", compat: bool = False) -> DataFrame:
    return _over_texts(df, key, text, lambda t: lint(t, compat), "start int, end int, rule string, severity string")


def header_kind(line: Column) -> Column:
    """The first of the episode-header patterns that a trimmed line of at most 120 characters fits, or null."""
    number = r"\d{1,5}"
    kinds = [
        ("bracketed", rf"^\[{number}\]"), ("angle", rf"^[<＜]\s*{number}\s*화\s*[>＞]$"), ("episode", rf"^{number}\s*화(?:\s|[-.:]|$)"), ("ep", rf"^(?:EP|Ep|ep)\.?\s*{number}(?:\s|$)"),
        ("section", rf"^제\s*{number}\s*조"), ("chapter", rf"^제\s*{number}\s*장"), ("chapter_latin", rf"^(?i:chapter|ch\.?)\s*{number}\b"), ("numbered_title", rf"^{number}\.(?:[^0-9]|$)"), ("prologue", r"^프롤로그$"),
        ("title_number", rf"^[0-9A-Za-z가-힣 _-]{{2,100}}\s{number}\s*화$"), ("title_paren", rf"^[^()0-9][^()]{{0,100}}\({number}\)$"), ("standalone", rf"^{number}$"), ("dash_number", rf"-{number}$"),
    ]
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return F.when(F.length(line).between(1, 120), out)


def episode_number(metadata: Column, title: Column) -> Column:
    """A whole number in metadata, else the first one in the title."""
    own = F.when(metadata.rlike(r"^\s*\d{1,9}\s*$"), F.trim(metadata).cast("int"))
    return F.coalesce(own, F.when(title.rlike(r"\d"), F.substring(F.regexp_extract(title, r"\d+", 0), 1, 9).cast("int")))


def time_phrases(text: Column, compat: bool = False) -> Column:
    """Relative-time phrases in a text: numbers with a unit, then the fixed ones it contains."""
    pattern = r"\\\d+\\s*(?:일|달|개월|년)\\s*(?:후|뒤|전)" if compat else r"\d+\s*(?:일|달|개월|년)\s*(?:후|뒤|전)"
    fixed = F.filter(F.array(*map(F.lit, lx.RELATIVE_TIMES)), lambda x: text.contains(x))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fixed))


def time_key_variants(key: Column) -> Column:
    """The forms by which a time key is known: itself, lower-case with single blanks, and what follows its first "/rel:"; none for an empty one."""
    own = squeezed(key)
    rest = F.trim(F.when(F.contains(own, F.lit("/rel:")), F.substring(own, F.instr(own, "/rel:") + 5, F.length(own))))
    return F.array_distinct(F.filter(F.array(own, rest), lambda x: x.isNotNull() & (x != "")))


def matches_alias(text: Column, alias: str) -> Column:
    """Whether a text names an alias: short ones as a token, with a particle at most; longer ones between boundaries or token by token."""
    tokens = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if len(alias) <= 2:
        return F.arrays_overlap(tokens, F.array(*[F.lit(alias + p) for p in ("", *lx.ALIAS_PARTICLES)]))
    edge = "[0-9A-Za-z가-힣]"
    whole = text.rlike(f"(?<!{edge}){re.escape(alias)}(?!{edge})")
    parts = re.findall(WORD, alias)
    return whole | F.size(F.array_except(F.array(*map(F.lit, parts)), tokens)).eqNullSafe(F.lit(0)) if parts else whole


def _without_suffix(text: Column, suffixes: tuple[str, ...]) -> Column:
    longest = "|".join(sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(text, f"(?<=.)(?:{longest})$", "")


def slot_text(text: Column, place: bool = False) -> Column:
    """A slot's value for comparison: lower case, no blanks or quotes, one postposition off, for places a suffix too."""
    out = F.regexp_replace(F.lower(text), "[\\s\"'“”‘’]+", "")
    for a, b in lx.STRING_EQUIVALENTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = _without_suffix(out, lx.POSTPOSITIONS)
    return _without_suffix(out, lx.PLACE_SUFFIXES) if place else out


def slot_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: _without_suffix(x, lx.POSTPOSITIONS)), lambda x: x != ""))


def transformed(value: Column, transform: Column) -> Column:
    """A rule's value after its transform: identity, strip, lower, int, bool or death flag."""
    flag = F.when(value.rlike("사망|죽"), "true").when(value.rlike("살아|생존"), "false")
    return (
        F.when(transform == "lower", F.lower(value)).when(transform == "strip", F.trim(value)).when(transform == "int", F.nullif(F.regexp_extract(value, r"\d+", 0), F.lit("")))
        .when(transform == "bool", F.when(F.lower(F.trim(value)).isin("true", "yes", "1", *lx.DEAD_WORDS), "true").when(F.lower(F.trim(value)).isin("false", "no", "0", *lx.ALIVE_WORDS), "false"))
        .when(transform == "death_flag", flag).otherwise(value)
    )


def typed_error(value: Column, kind: Column, low: Column, high: Column) -> Column:
    """Why a value doesn't fit its type and bounds, or null."""
    number = value.try_cast("double")
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "empty").when(kind.isin("int", "float") & number.isNull(), "type").when((kind == "int") & (number != F.floor(number)), "type")
        .when(number < low, "min").when(number > high, "max")
    )


#: Characters of a user's pattern at most, and a repeat without bound that is repeated without bound.
MOST_PATTERN, REPEATED = 256, r"\((?:\?:)?\.[*+]\)[*+]"


def pattern_is_safe(pattern: Column) -> Column:
    """Whether a user's pattern passes the gate of checked_pattern, but for whether it compiles."""
    return (F.length(pattern) <= MOST_PATTERN) & ~F.replace(pattern, F.lit(" "), F.lit("")).rlike(REPEATED)


def checked_pattern(pattern: str) -> str:
    """A user's pattern if it is safe: short, compiling, without nested unbounded repeats."""
    if len(pattern) > MOST_PATTERN:
        raise ValueError("pattern is too long")
    if re.search(REPEATED, pattern.replace(" ", "")):
        raise ValueError("pattern repeats a repeat without bound")
    re.compile(pattern)
    return pattern


def masked_key(name: Column, value: Column) -> Column:
    """A payload value, hidden under keys that name secrets, cut to 240 characters under quoting keys and else to 800."""
    return F.when(F.lower(name).rlike("secret|api_?key|token|password"), "[REDACTED]").when(F.lower(name).rlike("quote|text|content|snippet"), F.substring(value, 1, 240)).otherwise(F.substring(value, 1, 800))


def stable_id(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n))
