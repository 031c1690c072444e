"""Row selection, upserts, folds and windows: the relational core."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.session import cut_lineage

def matching(df: DataFrame, equal: dict | None = None, within: dict | None = None, excluded: dict | None = None) -> DataFrame:
    """Rows that meet a conjunction built from mappings: column = value, column IN values, column <> value.

    Absent and empty conditions are left out, and values of a list count once, so that one
    call serves every combination of filters. The whole predicate reaches the scan.
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c).isin(sorted(set(v))) for c, v in (within or {}).items() if v]
    tests += [F.col(c) != v for c, v in (excluded or {}).items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row with the largest order columns: an upsert read back. Combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def first_written(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row with the least order columns: insert-or-ignore."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes in place of those with their keys; changes has a key once."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_ignored(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it lacks, each key once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children without those of deleted parents."""
    return children.join(gone.select(key), key, "left_anti")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merged_lists(lists: list[DataFrame], identity: list[str], order: list[Column], limit: int) -> DataFrame:
    """Ordered union of result lists, earlier lists first, each identity once, at most limit rows."""
    ranked = reduce(DataFrame.unionByName, [x.withColumn("priority", F.lit(k)) for k, x in enumerate(lists)])
    once = top_rows(ranked, identity, [F.col("priority"), *order], 1).drop("rank")
    return once.orderBy("priority", *order).limit(limit)


def round_robin(df: DataFrame, source: str, order: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken from the sources in turn, the first source rotated by seed.

    Only each source's first n rows are ever candidates.
    """
    own = top_rows(df, [source], [F.col(order)], n)
    names = df.select(source).distinct()
    ranked = names.withColumn("place", F.row_number().over(Window.orderBy(source)) - 1)
    total = F.count("*").over(Window.partitionBy())
    turn = ranked.withColumn("turn", F.pmod(F.col("place") - F.lit(seed), total)).select(source, "turn")
    return own.join(turn, source).orderBy("rank", "turn").limit(n)


def uniform_sample(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group at an even stride, rows floor(i * n / k); all rows of a smaller group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(group))
    # row r is taken if some i has floor(i * n / k) = r
    i = F.ceil(F.col("r") * k / F.col("n"))
    return df.withColumn("r", at).withColumn("n", n).where((F.col("n") <= k) | (F.floor(i * F.col("n") / k) == F.col("r")) & (i < k))


def conflicts(facts: DataFrame, entity: str = "entity_id", tag: str = "tag_path", value: str = "value") -> DataFrame:
    """facts with status and value resolved by group: groups of more than one distinct value are PROPOSED and unknown.

    Entities compare null-safely, as grouping does.
    """
    norm = F.lower(F.trim(value))
    groups = facts.groupBy(entity, tag).agg(F.count_distinct(norm).alias("n_values"), F.count("*").alias("n_facts"), F.min(norm).alias("one"))
    many = F.col("n_values") > 1
    return groups.select(entity, tag, "n_values", "n_facts", F.when(many, "PROPOSED").otherwise("APPROVED").alias("status"), F.when(many, "unknown").otherwise(F.col("one")).alias("value"))


def folded_verdict(ok: Column, violate: Column) -> Column:
    """The verdict of a group of comparisons: both kinds conflict and stay UNKNOWN."""
    any_ok, any_bad = F.bool_or(ok), F.bool_or(violate)
    return F.when(any_ok & any_bad, "UNKNOWN").when(any_bad, "VIOLATE").when(any_ok, "OK")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, zero where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def trend_status(delta: Column) -> Column:
    """PASS up to 5 per cent, then SOFT_WARNING, HARD_FAIL above 20; NO_BASELINE without a value before."""
    return F.when(delta.isNull(), "NO_BASELINE").when(delta > 20, "HARD_FAIL").when(delta > 5, "SOFT_WARNING").otherwise("PASS")


#: Rows, or digests, that are joined in one digest at most.
FAN = 1024


def content_checksum(df: DataFrame, key: str, line: Column, order: str) -> DataFrame:
    """(key, checksum): a tree of SHA-256 digests of a group's lines in order, whatever its size.

    order is a whole number from zero on that names a line in its group. The lines of each FAN numbers
    are joined by newlines and digested, then the digests of each FAN blocks in the same way, until a
    group is one block: no task gathers more than FAN lines of a group. Null lines count as absent.
    """
    now = df.select(key, F.col(order).cast("long").alias("_o"), line.alias("_l")).where("_l is not null")
    most = df.agg(F.max(F.col(order).cast("long"))).first()[0] or 0
    while True:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"])
        now = now.groupBy(key, F.floor(F.col("_o") / FAN).alias("_b")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("_l")).withColumnRenamed("_b", "_o")
        most //= FAN
        if not most:
            return now.select(key, F.concat(F.lit("sha256:"), F.col("_l")).alias("checksum"))


def listed_by_parts(df: DataFrame, key: str, value: str, size: int = FAN) -> DataFrame:
    """(key, part, n, values): the distinct whole numbers of each key in order, in parts of numbers that share value // size.

    A part holds at most size numbers, however many the key has.
    """
    rows = df.select(key, F.col(value).alias("_v")).where("_v is not null").distinct()
    return rows.groupBy(key, F.floor(F.col("_v") / size).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_v")).alias("values"))


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.trim(text), 256))


def attributes_as_facts(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(entity_id, tag_path, value): one row for each attribute that isn't null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f"attr/{c}").alias("tag_path"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(entity).alias("entity_id"), pairs.alias("p")).select("entity_id", "p.*").where("value is not null")


def listed(df: DataFrame, order: list[Column], asked: int, least: int, most: int) -> DataFrame:
    """The first rows in an order, as many as are asked for within a listing's own bounds."""
    return df.orderBy(*order).limit(max(least, min(most, asked)))


#: Bins into which the range of a percentile is cut in each pass, and values of a bin that are put in order at most.
BINS, ORDERED = 1024, 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each share): exact percentiles of each group, between two values in proportion.

    No group is gathered: each pass counts the values of a group by bins of the range in which a rank
    lies, which are summed before they move, and goes on with the bin that holds it, until that has one
    value or few enough to order. Nulls and NaN don't count; a group without values has no row.
    Passes over df grow with the logarithm of a group's size, four are enough for a trillion values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    groups = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    places = [fn(F.lit(q) * (F.col("n") - 1)) for q in shares.values() for fn in (F.floor, F.ceil)]
    ranks = groups.select("*", F.explode(F.array_distinct(F.array(*places))).alias("rank")).select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), "n").distinct()
    open_, done = cut_lineage(ranks), None
    while True:
        found = open_.where("lo = hi or n <= 0").select(*keys, "rank", F.col("lo").alias("value"))
        done = found if done is None else done.union(found)
        few = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= ORDERED))
        ordered = rows.alias("r").join(few.alias("t"), same("r", "t") & F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*[F.col(f"t.{k}") for k in keys], "rank", "before").agg(F.array_sort(F.collect_list("_v")).alias("vs"))
        done = done.union(ordered.select(*keys, "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("value")))
        open_ = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > ORDERED))
        if open_.isEmpty():
            break
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).cast("int")
        counts = rows.alias("r").join(open_.alias("t"), same("r", "t") & F.col("_v").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"t.{k}") for k in keys], "rank", "before", bin_.alias("bin"), "_v")
        counts = counts.groupBy(*keys, "rank", "before", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # at most BINS rows
        counts = counts.withColumn("upto", F.col("before") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        open_ = cut_lineage(counts.select(*keys, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"), "n"))
        done = cut_lineage(done)
    values = cut_lineage(done)
    out = groups.alias("g").join(values.alias("v"), same("g", "v"))
    by_rank = out.groupBy(*[F.col(f"g.{k}") for k in keys], F.col("g.n")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks for each share

    def share(q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(at)], F.col("at")[F.ceil(at)]
        return low + (high - low) * (at - F.floor(at))

    return by_rank.select(*keys, *[share(q).alias(name) for name, q in shares.items()])
