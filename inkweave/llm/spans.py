"""Pattern matches with their places, from built-in functions only.

Spark gives the matches of a pattern and the pieces between them, but not where they are; the
places are the running sums of both lengths, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches in a block whose places are summed together; a block's output is copied as it grows, a text's is not.
BLOCK = 256
#: Code points in a piece of a text that is cut for its parts.
CHUNK = 256


def no_spans() -> Column:
    return F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once: a function's other operands are computed for each element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _running(block: Column, at: Column) -> Column:
    """The (p, n, m) of a block, p before and n long, with their places from at on."""
    none = no_spans()

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _starts(sizes: Column) -> Column:
    """Where each block begins."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def found(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (s, e, m): the leftmost matches that don't overlap, with start, end and text.

    No match of pattern is empty. hint is a cheap condition without which there is no match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(
        F.split(text, pattern, -1), hits, lambda p, h: F.when(h.isNotNull(), F.struct(F.length(p).cast("bigint").alias("p"), F.length(h).cast("bigint").alias("n"), h.alias("m")))
    )

    def placed(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: let(_starts(F.transform(bs, _size)), lambda at: F.flatten(F.zip_with(bs, at, _running))))

    return F.when(hint, let(F.filter(zipped, lambda x: x.isNotNull()), placed)).otherwise(no_spans())


def _size(block: Column) -> Column:
    return F.aggregate(block, F.lit(0).cast("bigint"), lambda acc, x: acc + x["p"] + x["n"])


def _counted(others: Column, spans: Column, first: bool) -> Column:
    """For each of spans, given by a position in order, how many of others' positions lie before it, or at it if first.

    Both are put in one order; the place of the k-th span there is k more than that number.
    """
    mark = lambda k: lambda p: F.struct(p.alias("p"), F.lit(k).alias("k"))
    together = F.sort_array(F.concat(F.transform(others, mark(0 if first else 1)), F.transform(spans, mark(1 if first else 0))))
    places = F.filter(F.transform(together, lambda v, i: F.when(v["k"] == (1 if first else 0), i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i, k: i - k)


def apart_from(spans: Column, others: Column) -> Column:
    """spans, which don't overlap each other and are in order, without those that overlap one of others; n log n."""

    def kept(both: Column) -> Column:
        x, o = both["x"], both["o"]
        begun = _counted(F.transform(o, lambda v: v["s"]), F.transform(x, lambda v: v["e"]), False)
        ended = _counted(F.transform(o, lambda v: v["e"]), F.transform(x, lambda v: v["s"]), True)
        free = F.zip_with(begun, ended, lambda a, b: a == b)  # as many have ended before a span as have begun before its end
        return F.transform(F.filter(F.zip_with(x, free, lambda v, f: F.struct(v.alias("v"), f.alias("f"))), lambda v: v["f"]), lambda v: v["v"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.struct(spans.alias("x"), others.alias("o")), kept)).otherwise(spans)


def chunks_of(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that parts of it are reached without counting from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, which may lie beyond its own."""
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor(F.greatest(end - 1, start) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, many), ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """text with each stretch that spans cover replaced; spans may overlap and need no order."""

    def rebuilt(t: Column) -> Column:
        # the i-th start opens a stretch if as many spans have ended by then as have begun; so with the ends
        opened = F.filter(t["s"], lambda s, i: (i == 0) | (F.get(t["e"], i - 1) <= s))
        closed = F.filter(t["e"], lambda e, i: (i == F.size(t["e"]) - 1) | (F.get(t["s"], i + 1) >= e))
        pieces = lambda p: F.zip_with(p["from"], p["to"], lambda a, b: cut(t["chunks"], a, b))
        ends = F.struct(F.concat(F.array(F.lit(0).cast("bigint")), closed).alias("from"), F.concat(opened, F.array(t["n"])).alias("to"))
        return F.array_join(let(ends, pieces), by)

    sides = lambda side: F.sort_array(F.transform(spans, lambda x: x[side].cast("bigint")))
    return F.when(F.size(spans) > 0, let(F.struct(sides("s").alias("s"), sides("e").alias("e"), chunks_of(text).alias("chunks"), F.length(text).cast("bigint").alias("n")), rebuilt)).otherwise(text)


def named(kind: str, spans: Column) -> Column:
    """kind:start:end for each span."""
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
