"""Two sources of one truth: field-wise differences, a ledger of known ones, and
merges that keep unknown apart from zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, key: str, fields: Sequence[str], value: str) -> DataFrame:
    """(key, field, value): every field as text, nulls kept."""
    return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, list(fields), "field", value)


def differences(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, a, b) where both sides know a field and their texts differ."""
    x, y = long_form(a, key, fields, "a"), long_form(b, key, fields, "b")
    return x.join(y, [key, "field"]).where("a <> b")


def against_ledger(diff: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Differences with ``status``: 'ack' while the ledger's recorded values are
    still those of both sides, 'stale' if they are not, 'open' without an entry.
    ``ledger`` has (key, field, led_a, led_b)."""
    both = diff.join(ledger, [key, "field"], "left")
    same = F.col("a").eqNullSafe(F.col("led_a")) & F.col("b").eqNullSafe(F.col("led_b"))
    known = F.col("led_a").isNotNull() | F.col("led_b").isNotNull()
    return both.withColumn("status", F.when(~known, "open").when(same, "ack").otherwise("stale")).drop("led_a", "led_b")


def merge_outcome(found: Column, missing: Column, untrusted: Column) -> Column:
    """What became of a row of the primary source."""
    return F.when(untrusted, "untrusted").when(found, "merged").when(missing, "absent").otherwise("uncovered")


def merge(primary: DataFrame, secondary: DataFrame, key: str, fields: Sequence[str], missing: DataFrame, untrusted: DataFrame) -> DataFrame:
    """Fill ``fields`` of the primary rows from the secondary source, with the
    outcome of each row. A row that is not merged keeps unknown fields as null:
    nothing is ever filled with zero."""
    side = secondary.select(key, F.lit(True).alias("__found"), *[F.col(f).alias(f"__{f}") for f in fields])
    gone = missing.select(key).distinct().withColumn("__missing", F.lit(True))
    bad = untrusted.select(key).distinct().withColumn("__bad", F.lit(True))
    wide = primary.join(side, key, "left").join(gone, key, "left").join(bad, key, "left")
    yes = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("__found", "__missing", "__bad")}
    out = wide.withColumn("outcome", merge_outcome(yes["__found"], yes["__missing"], yes["__bad"]))
    merged = F.col("outcome") == "merged"
    kept = [c for c in primary.columns if c not in fields]
    return out.select(*kept, *[F.when(merged, F.col(f"__{f}")).alias(f) for f in fields], "outcome")


class GateError(ValueError):
    """A publish was refused; nothing has been written."""


def gate(df: DataFrame, rules: dict[str, Column]) -> dict[str, bool]:
    """Check aggregate rules in one pass before anything is written; raise
    GateError that names the rules which fail."""
    row = df.agg(*[rule.cast("boolean").alias(name) for name, rule in rules.items()]).first()
    said = {name: bool(row[name]) for name in rules}
    if bad := sorted(name for name, ok in said.items() if not ok):
        raise GateError(f"refused: {', '.join(bad)}")
    return said


def shrinks(before: int, after: int, share: float = 0.1) -> bool:
    """Whether a table lost more than ``share`` of its rows; such a loss is only a warning."""
    return before > 0 and after < before * (1 - share)
