"""Weighted modes, trimmed means, boxes, histograms and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.dedupe import keep_ranked


def weighted_mode(df: DataFrame, group: Sequence[str], bin_: Column, weight: Column, out: str = "bin", total: str = "weight") -> DataFrame:
    """The bin of greatest total weight of each group; of equals the lowest."""
    sums = df.withColumn(out, bin_).groupBy(*group, out).agg(F.sum(weight).alias(total))
    return keep_ranked(sums, list(group), [F.col(total).desc(), F.col(out).asc()])


def trimmed_band_mean(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, low: float, high: float, out: str, scale: int = 6) -> DataFrame:
    """Mean of the values whose rank falls in [floor(low*n), max(1, ceil(high*n)))."""
    over = Window.partitionBy(*group)
    ranked = df.withColumn("__rank", F.row_number().over(over.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(over))
    band = ranked.where((F.col("__rank") >= F.floor(low * F.col("__n"))) & (F.col("__rank") < F.greatest(F.lit(1), F.ceil(high * F.col("__n")))))
    return band.groupBy(*group).agg(F.round(F.avg(value), scale).alias(out))


def bounding_box(df: DataFrame, group: Sequence[str], x: Column, y: Column, scale: int = 6) -> DataFrame:
    rounded = lambda c: F.round(c.cast("double"), scale)
    return df.groupBy(*group).agg(
        rounded(F.min(x)).alias("min_x"), rounded(F.min(y)).alias("min_y"), rounded(F.max(x)).alias("max_x"), rounded(F.max(y)).alias("max_y")
    )


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)


def coverage(condition: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("double") / F.count("*")


def ordered_concat(value: str, order: Sequence[str], separator: str = "\n") -> Column:
    """The group's texts in order; nulls are left out. Sorted inside the
    aggregate, so the order does not depend on how the rows arrive."""
    rows = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value)))))
    return F.array_join(F.transform(rows, lambda r: r[value]), separator)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    six = F.when(top == r, ((g - b) / span) % 6).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    degrees = F.when(span == 0, 0.0).otherwise(six * 60)
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def swatch(entries: DataFrame, reference: int = 0, distance: int = 48, chroma_floor: int = 25) -> DataFrame:
    """(pal, r, g, b): the colour that tells each palette apart, null if fewer
    than two palettes are given or nothing differs.

    ``entries`` has (pal, idx, r, g, b). Places where any palette differs from
    the reference one by more than ``distance`` count, except place 0 and the
    transparency key. Of these, chroma votes for a 30 degree bin of hue (the
    first bin on a tie); the swatch is the mean over the middle of that bin by
    luminance, or over the greys if no entry has chroma.
    """
    keyed = entries.where("idx > 0").where(~((F.col("r") > 250) & (F.col("g") < 5) & (F.col("b") > 250)))
    base = keyed.where(F.col("pal") == reference).select("idx", F.col("r").alias("r0"), F.col("g").alias("g0"), F.col("b").alias("b0"))
    apart = F.abs(F.col("r") - F.col("r0")) + F.abs(F.col("g") - F.col("g0")) + F.abs(F.col("b") - F.col("b0")) > distance
    places = keyed.join(base, "idx").where(apart).select("idx").distinct()
    used = keyed.join(places, "idx")
    chroma = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    used = used.withColumn("chroma", chroma).withColumn("lum", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    coloured = used.where(F.col("chroma") >= chroma_floor).withColumn("bin", F.floor(hue(F.col("r"), F.col("g"), F.col("b")) / 30).cast("int"))
    seen = coloured.groupBy("pal", "bin").agg(F.sum("chroma").alias("w"), F.min("idx").alias("first"))
    top = keep_ranked(seen, "pal", [F.col("w").desc(), F.col("first").asc()]).select("pal", "bin")
    band = coloured.join(top, ["pal", "bin"]).select("pal", "idx", "r", "g", "b", "lum", F.lit(True).alias("c"))
    grey = used.join(top.select("pal"), "pal", "left_anti").select("pal", "idx", "r", "g", "b", "lum", F.lit(False).alias("c"))
    over = Window.partitionBy("pal")
    ranked = band.union(grey).withColumn("k", F.row_number().over(over.orderBy("lum", "idx")) - 1).withColumn("n", F.count("*").over(over))
    low = F.floor(F.col("n") * F.when(F.col("c"), 0.30).otherwise(0.35))
    high = F.greatest(F.lit(1), F.ceil(F.col("n") * F.when(F.col("c"), 0.85).otherwise(0.80)))
    mean = ranked.where((F.col("k") >= low) & (F.col("k") < high)).groupBy("pal").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"])
    pals = entries.select("pal").distinct()
    return pals.join(mean, "pal", "left")


def highest(df: DataFrame, group: Sequence[str], index: str, out: str) -> DataFrame:
    """The highest index that a group has, such as that of its palettes or of the
    frames of its layers."""
    return df.groupBy(*group).agg(F.max(index).alias(out))


def named_or_largest(df: DataFrame, scope: str, table: str, ordinal: str, wanted: str, skip: str) -> DataFrame:
    """(scope, table, n, fallback): the table called ``wanted`` of each scope, or
    else its largest one but ``skip``, of equals the first by ``ordinal``. Rows of
    ``df`` are entries; ``fallback`` says that the name was not found."""
    sizes = df.groupBy(scope, table).agg(F.count("*").alias("n"), F.min(ordinal).alias("__at"))
    sizes = sizes.withColumn("fallback", F.col(table) != wanted).where(F.col(table).isNotNull() & (~F.col("fallback") | (F.col(table) != skip)))
    best = keep_ranked(sizes, scope, [F.col("fallback").asc(), F.col("n").desc(), F.col("__at").asc()])
    return best.select(scope, table, "n", "fallback")
