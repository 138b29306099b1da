"""Lookups with stated misses, priorities and ambiguity; suffix and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.dedupe import keep_ranked

#: Rows up to which a lookup side that has been counted may be broadcast.
BROADCAST_ROWS = 500_000


def lookup(df: DataFrame, side: DataFrame, on: str | Sequence[str], rows: int | None = None) -> DataFrame:
    """Left lookup that keeps the driving row. ``rows`` is the side's known
    size; without it, or beyond BROADCAST_ROWS, Spark chooses."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(F.broadcast(side) if rows is not None and rows <= BROADCAST_ROWS else side, keys, "left")


def matched(df: DataFrame, side: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): an inner join and the rows that found nothing."""
    return df.join(side, on), df.join(side.select(on), on, "left_anti")


def membership(df: DataFrame, side: DataFrame, on: str, flag: str) -> DataFrame:
    """``df`` with a flag for whether its key is in ``side``; nulls are not."""
    known = side.select(on).where(F.col(on).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(known, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exactly_one(df: DataFrame, a: DataFrame, b: DataFrame, on: str, out: str) -> DataFrame:
    """Which of two tables has the key, if exactly one of them has: 'a', 'b' or null."""
    both = membership(membership(df, a, on, "__a"), b, on, "__b")
    kind = F.when(F.col("__a") & ~F.col("__b"), "a").when(F.col("__b") & ~F.col("__a"), "b")
    return both.withColumn(out, kind).drop("__a", "__b")


def universe(a: DataFrame, b: DataFrame, on: str, in_a: str, in_b: str) -> DataFrame:
    """Full outer union of two id universes with where each id comes from."""
    x = a.select(on).distinct().withColumn(in_a, F.lit(True))
    y = b.select(on).distinct().withColumn(in_b, F.lit(True))
    both = x.join(y, on, "full_outer")
    return both.select(on, F.coalesce(in_a, F.lit(False)).alias(in_a), F.coalesce(in_b, F.lit(False)).alias(in_b))


def priority(candidates: Sequence[DataFrame], key: str, ties: Sequence[str]) -> DataFrame:
    """The row of the first candidate table that has the key; of several, the
    first by ``ties``. All tables have the same columns."""
    every = None
    for rank, c in enumerate(candidates):
        c = c.withColumn("prio", F.lit(rank))
        every = c if every is None else every.unionByName(c)
    assert every is not None, "no candidates"
    return keep_ranked(every, key, [F.col("prio").asc(), *[F.col(t).asc() for t in ties]])


def unique_or_none(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that have exactly one row: ambiguity is no match."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count("*").alias("__n")).where("__n = 1").drop("__n")


def suffix_join(df: DataFrame, text: str, wanted: DataFrame, suffix: str, rows: int | None = None) -> DataFrame:
    """Rows whose ``text`` ends with a wanted suffix, the empty one included. Each
    text is expanded to its suffixes of the lengths that occur, which come from a
    join, so the plan is two equi-joins and not a nested loop over rows x suffixes.
    The expanded texts are many times as large as Spark's estimate of them, so
    they are never the side that is broadcast: the lengths are (n different ones
    take n * n / 2 characters of suffixes), and ``wanted`` is if its known size
    ``rows`` is at most BROADCAST_ROWS; else both sides are shuffled."""
    lengths = wanted.select(F.length(suffix).alias("__n")).where("__n is not null").distinct()
    each = df.withColumn("__n", F.explode(F.sequence(F.lit(0), F.length(text)))).join(F.broadcast(lengths), "__n")
    side = F.broadcast(wanted) if rows is not None and rows <= BROADCAST_ROWS else wanted.hint("merge")
    return each.withColumn(suffix, F.right(F.col(text), F.col("__n"))).drop("__n").join(side, suffix)


def nearest_within(df: DataFrame, points: DataFrame, xy: tuple[str, str], pxy: tuple[str, str], radius: float, row: str, ordinal: str) -> DataFrame:
    """The nearest point within ``radius`` of each row, the first by ``ordinal``
    of equals. Points are dealt into cells of the radius; a row meets the points
    of its own and the eight cells around it."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    probe = df.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    probe = probe.withColumn("__cx", cell(xy[0]) + F.col("__dx")).withColumn("__cy", cell(xy[1]) + F.col("__dy")).drop("__dx", "__dy")
    held = points.withColumn("__cx", cell(pxy[0])).withColumn("__cy", cell(pxy[1]))
    d2 = (F.col(xy[0]) - F.col(pxy[0])) ** 2 + (F.col(xy[1]) - F.col(pxy[1])) ** 2
    near = probe.join(held, ["__cx", "__cy"]).drop("__cx", "__cy").withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return keep_ranked(near, row, [F.col("d2").asc(), F.col(ordinal).asc()])


def next_row(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Each row with the value of the row that follows it in its group."""
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*group).orderBy(*order)))


def segment_scan(df: DataFrame, group: Sequence[str], order: Sequence[str], is_key: Column, wanted: Column, value: str, out: str) -> DataFrame:
    """For each key row, the first wanted value before the next key row (null if
    there is none). Rows before the first key row belong to no segment."""
    over = Window.partitionBy(*group).orderBy(*order)
    seg = df.withColumn("segment", F.sum(F.when(is_key, 1).otherwise(0)).over(over).cast("int"))
    hit = F.min(F.when(wanted, F.struct(*order, F.col(value)))).alias("__hit")
    return seg.where("segment > 0").groupBy(*group, "segment").agg(hit).select(*group, "segment", F.col(f"__hit.{value}").alias(out))


def positional_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Rows numbered into groups of ``size`` by position; a last group that is
    not full is dropped."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    placed = df.withColumn("__rn", rn - 1).withColumn("grp", F.floor(F.col("__rn") / size).cast("int"))
    full = F.count("*").over(Window.partitionBy(*group, "grp"))
    return placed.withColumn("place", (F.col("__rn") % size).cast("int")).withColumn("__n", full).where(F.col("__n") == size).drop("__n", "__rn")


def names_of(df: DataFrame, id_: str, name: str, out: str) -> DataFrame:
    """The reverse of a table of constants: (id, its names in order). Several
    names may stand for one id; rows without an id or a name count for nothing."""
    known = df.where(F.col(id_).isNotNull() & F.col(name).isNotNull())
    return known.groupBy(id_).agg(F.array_sort(F.collect_set(name)).alias(out))


def named_or_real(df: DataFrame, id_: str, names: DataFrame, real: DataFrame, out: str) -> DataFrame:
    """``df`` with the name of its id, else of the real id that stands behind it,
    else ``_`` and that id. ``names`` is (id, name) and ``real`` (id, real_id),
    one row for each id; an empty name is none."""
    some = names.where("name <> ''")
    own = some.select(F.col("id").alias(id_), F.col("name").alias("__own"))
    other = real.select(F.col("id").alias(id_), F.col("real_id").alias("__real"))
    step = lookup(lookup(df, own, id_), other, id_).withColumn("__real", F.coalesce("__real", id_))
    wide = lookup(step, some.select(F.col("id").alias("__real"), F.col("name").alias("__other")), "__real")
    name = F.coalesce("__own", "__other", F.concat(F.lit("_"), F.col("__real").cast("string")))
    return wide.withColumn(out, name).drop("__own", "__other", "__real")
