"""Staged sinks: nothing is visible before every table passed its gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import content_address
from skarn.operators.reconcile import gate, shrinks


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, a: str, b: str) -> None:
    source, fs = _fs(spark, a)
    target, _ = _fs(spark, b)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"can't move {a} to {b}")


def publish(tables: dict[str, DataFrame], rules: dict[str, dict[str, Column]], out: str, previous: dict[str, int] | None = None) -> dict[str, dict]:
    """Write JSON tables to ``out``, all or none: each is staged, its rules are
    checked on what was staged, and only if all pass are the stages moved into
    place. Returns rows and whether a table shrank by more than a tenth."""
    report, moves = {}, []
    for name, df in tables.items():
        spark, stage = df.sparkSession, f"{out.rstrip('/')}/_stage/{name}"
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(stage)
        staged = spark.read.schema(df.schema).json(stage)
        gate(staged, {"not_empty": F.count("*") > 0, **rules.get(name, {})})
        n = staged.count()
        report[name] = {"rows": n, "shrank": shrinks((previous or {}).get(name, 0), n)}
        moves.append((spark, stage, f"{out.rstrip('/')}/{name}"))
    for move in moves:
        _move(*move)
    return report


def blobs(df: DataFrame, content: str, folder: str, extension: str) -> DataFrame:
    """(folder, address, ext, content): content-addressed, each content once."""
    named = df.select(F.col(folder).alias("folder"), content_address(F.col(content)).alias("address"), F.col(extension).alias("ext"), F.col(content).alias("content"))
    return named.dropDuplicates(["folder", "address", "ext"])


def index(names: DataFrame, column: str, previous: DataFrame | None = None) -> DataFrame:
    """Sorted distinct names, merged with those of an earlier run."""
    every = names.select(column)
    if previous is not None:
        every = every.union(previous.select(column))
    return every.where(F.col(column).isNotNull()).distinct().orderBy(column)


def manifest(children: dict[str, DataFrame], key: str, parts: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """(key, document): one JSON document per key with an array of each child
    table's rows; the array's order is that of its sorted values."""
    out = None
    for name, df in children.items():
        one = df.groupBy(key).agg(F.sort_array(F.collect_list(parts[name](df))).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    assert out is not None, "no children"
    return out.select(key, F.to_json(F.struct(*children), {"ignoreNullFields": "false"}).alias("document"))


def dictionary(rows: DataFrame, id_: str, value: str) -> DataFrame:
    """One JSON object of id -> value, the lowest value of an id."""
    one = rows.groupBy(id_).agg(F.min(value).alias(value))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(id_).cast("string"), F.col(value)))))
    return one.agg(F.to_json(pairs).alias("document"))
