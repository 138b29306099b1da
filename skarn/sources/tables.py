"""Text tables of clients and crawls as DataFrames."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import hex_color
from skarn.operators import dedupe, joins


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos) of one text file, pos from 0 in file order, whatever the split."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _only(c: Column, characters: str) -> Column:
    """Whether there is nothing but these characters, and one of them at least."""
    return (c != "") & (F.translate(c, characters, "") == "")


def numbered_names(rows: DataFrame) -> DataFrame:
    """(id, name) of lines '<id><tab>... // name' whose comment is an identifier
    with an underscore or a capital letter; the last line of an id wins."""
    column = F.split("line", "\t", 2)
    out = rows.select("pos", F.trim(column[0]).alias("id"), F.get(F.split(F.get(column, 1), "//", 2), 1).alias("name"))
    out = out.withColumn("name", F.btrim("name", F.lit(string.whitespace)))
    mixed = F.contains("name", F.lit("_")) | (F.col("name") != F.lower("name"))
    out = out.where(_only(F.col("id"), string.digits) & _only(F.col("name"), string.ascii_letters + string.digits + "_") & ~F.startswith("name", F.lit("_")) & mixed)
    return dedupe.keep_last(out.withColumn("id", F.col("id").cast("long")), "id", "pos").select("id", "name")


def fog(rows: DataFrame) -> DataFrame:
    """(map, near, far, color, factor) of '#'-ended fields in groups of five over
    all lines; comments are left out, a bad group is skipped and shifts nothing,
    a last short group is dropped. The last record of a map wins."""
    clean = F.regexp_replace("line", "//.*$", "")
    text = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", clean.alias("line")))), lambda r: r["line"]), "\n").alias("t"))
    token = F.filter(F.transform(F.split("t", "#"), lambda t: F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))), lambda t: t != "")
    each = text.select(F.posexplode(token).alias("at", "token")).withColumn("k", F.lit(0))
    grouped = joins.positional_groups(each, ["k"], ["at"], 5)
    wide = grouped.groupBy("grp").pivot("place", [0, 1, 2, 3, 4]).agg(F.first("token"))
    number = lambda c: F.regexp_extract(F.col(c), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")
    out = wide.select(
        "grp", F.lower(F.regexp_replace("0", r"(?i)\.(rsw|gat|gnd)$", "")).alias("map"), number("1").alias("near"), number("2").alias("far"), hex_color(F.col("3")).alias("color"), number("4").alias("factor")
    )
    out = out.where("map <> '' and near is not null and far is not null and color is not null and factor is not null")
    return dedupe.keep_last(out, "map", "grp").drop("grp")


def tracks(rows: DataFrame) -> DataFrame:
    """(map, file) of lines of two fields that '#' ends: a map's file and a music
    file below the bgm folder; the last line of a map wins."""
    field = F.split(F.lower("line"), "#")
    folder = F.split(F.btrim(F.get(field, 1), F.lit(string.whitespace)), r"[/\\\\]+")
    out = rows.where(F.size(field) > 2).select("pos", F.btrim(field[0], F.lit(string.whitespace)).alias("map"), F.get(folder, 0).alias("top"), F.element_at(folder, -1).alias("file"))
    out = out.where(F.endswith("map", F.lit(".rsw")) & (F.col("top") == "bgm") & F.endswith("file", F.lit(".mp3")) & (F.length("file") > 4))
    out = out.withColumn("map", F.left("map", F.length("map") - 4)).where(_only(F.col("map"), string.ascii_lowercase + string.digits + "_@-"))
    return dedupe.keep_last(out, "map", "pos").select("map", "file")


def message_names(rows: DataFrame, prefix: str, preferred: int, other: int) -> DataFrame:
    """(key, name) of comma-separated base64 fields: the key without its prefix,
    and the preferred column's text or else the other's."""
    cols = rows.where("line <> ''").select("pos", F.split("line", ",").alias("c"))
    text = lambda i: F.nullif(F.trim(F.expr(f"try_to_binary(get(c, {i}), 'base64')").cast("string")), F.lit(""))
    out = cols.select("pos", text(0).alias("k"), F.coalesce(text(preferred), text(other)).alias("name"))
    out = out.where(F.col("k").startswith(prefix) & F.col("name").isNotNull()).withColumn("key", F.substring(F.col("k"), F.lit(len(prefix) + 1), F.length("k")))
    return dedupe.keep_last(out.where("key <> ''"), "key", "pos").select("key", "name")


def constant_ids(constants: DataFrame, prefix: str) -> DataFrame:
    """(key, id): a string constant with the prefix that is followed by a number;
    the first id of a key wins. ``constants`` has (pos, type, s, n)."""
    both = joins.next_row(joins.next_row(constants.withColumn("g", F.lit(0)), ["g"], ["pos"], "type", "t2"), ["g"], ["pos"], "n", "id")
    hit = both.where((F.col("type") == "string") & F.col("s").startswith(prefix) & (F.col("t2") == "number"))
    return dedupe.keep_first(hit, "s", "pos").select(F.col("s").alias("key"), F.col("id").cast("long").alias("id"))


def constant_labels(constants: DataFrame, prefix: str, skipped: list[str]) -> DataFrame:
    """(key, label): the first string after a key that is no key and not skipped,
    before the next key; the last key of a name with a label wins."""
    text = constants.where("type = 'string'").withColumn("g", F.lit(0)).withColumn("label", F.col("s"))
    is_key = F.col("s").startswith(prefix)
    seg = joins.segment_scan(text, ["g"], ["pos"], is_key, ~is_key & ~F.col("s").isin(skipped), "label", "label")
    keys = text.where(is_key).withColumn("segment", F.row_number().over(joins.Window.partitionBy("g").orderBy("pos")))
    out = keys.select("g", "segment", "pos", F.col("s").alias("key")).join(seg, ["g", "segment"]).where("label is not null")
    return dedupe.keep_last(out, "key", "pos").select("key", "label")


def replay(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The latest row of each key of an append-only JSON-lines log; lines that
    do not parse (a torn last one) are left out."""
    rows = lines(spark, path).select("pos", F.from_json("line", schema).alias("r"), "line").where(f"r.{key} is not null")
    return dedupe.keep_last(rows.select("pos", "r.*"), key, "pos").drop("pos")
