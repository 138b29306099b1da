"""One row per key, by an explicit total order.

Ties are always broken by the columns given, never by arrival: ``max_by`` and
``dropDuplicates`` leave the winner of a tie open, a ranked window does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = str | Sequence[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def keep_ranked(df: DataFrame, key: Key, order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    over = Window.partitionBy(*_names(key)).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(over)).where("__rank = 1").drop("__rank")


def keep_largest(df: DataFrame, key: Key, size: str, ties: Sequence[str]) -> DataFrame:
    """The largest copy of each key wins; of equals, the first by ``ties``."""
    return keep_ranked(df, key, [F.col(size).desc_nulls_last(), *[F.col(t).asc() for t in ties]])


def keep_first(df: DataFrame, key: Key, ordinal: Key) -> DataFrame:
    return keep_ranked(df, key, [F.col(c).asc() for c in _names(ordinal)])


def keep_last(df: DataFrame, key: Key, ordinal: Key) -> DataFrame:
    return keep_ranked(df, key, [F.col(c).desc_nulls_last() for c in _names(ordinal)])


def lowest_id(df: DataFrame, name: str, id_: str) -> DataFrame:
    """(name, id): the reverse of a lookup, where the lowest id of a name wins."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(id_).alias(id_))


def first_appearance(df: DataFrame, group: Key, value: str, ordinal: str, out: str) -> DataFrame:
    """Number the distinct values of a group from 0 in order of first appearance."""
    keys = _names(group)
    first = df.groupBy(*keys, value).agg(F.min(ordinal).alias("__first"))
    over = Window.partitionBy(*keys).orderBy("__first")
    return df.join(first.withColumn(out, F.row_number().over(over) - 1).drop("__first"), [*keys, value])
