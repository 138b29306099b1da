"""Projections: name tables, nested records to flat ones, arrays with gaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_table(df: DataFrame, id_: str, name_of: Callable[[DataFrame], Column]) -> DataFrame:
    """(id, name) by id; rows without a name are dropped."""
    return df.select(F.col(id_).alias("id"), name_of(df).alias("name")).where(F.col("name").isNotNull()).orderBy("id")


def until_null(values: Column) -> Column:
    """The leading elements of an array, up to its first null."""
    gap = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    return F.when(gap > 0, F.slice(values, 1, F.greatest(gap - 1, F.lit(0)).cast("int"))).otherwise(values)


def null_if_all_empty(parts: dict[str, Column]) -> Column:
    """A struct of arrays, or null if every one of them is empty or null."""
    some = F.lit(False)
    for c in parts.values():
        some = some | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return F.when(some, F.struct(*[c.alias(n) for n, c in parts.items()]))


def first_number(values: Column) -> Column:
    """The first element of a text array that reads as a number."""
    return F.get(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull()), 0)


def any_element(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def ordered_ranges(value: Column, ranges: Sequence[tuple[str, int, int]]) -> Column:
    """The name of the first range (inclusive) that holds the value."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(ranges):
        out = F.when(value.between(low, high), name).otherwise(out)
    return out


def expand_template(template: Column, low: Column, high: Column) -> Column:
    """The template with %d replaced by each number from low to high; the
    template alone unless both are known."""
    many = F.transform(F.sequence(low, high), lambda i: F.replace(template, F.lit("%d"), i.cast("string")))
    return F.when(low.isNotNull() & high.isNotNull(), many).otherwise(F.array(template))


def distinct_elements(arrays: Column) -> Column:
    """The distinct elements of an array of arrays, in order of appearance; null
    arrays hold none."""
    return F.array_distinct(F.flatten(F.filter(arrays, lambda a: a.isNotNull())))


def draws_nothing(alphas: Column) -> Column:
    """Whether there are layers and every one of them is fully transparent."""
    return (F.size(alphas) > 0) & ~any_element(alphas, lambda a: a != 0)


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose ``column`` holds the pattern anywhere, in any case."""
    return df.where(F.col(column).rlike(f"(?i){pattern}"))


def code_unit_key(text: Column) -> Column:
    """Orders texts by UTF-16 code units, so that supplementary characters stand
    before U+E000 to U+FFFF."""
    return F.encode(text, "UTF-16BE")
