"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that part words, as a class for Java and RE2 patterns.
SPACES = r"\x20\x09-\x0D"


def whole_text(col: str | Column = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_row(df: DataFrame, **more: Column) -> DataFrame:
    """All of df's columns in one struct named row, beside more: names can't clash then."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six space characters."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")
