"""Published tables, composed of sources, codecs and operators; each returns
DataFrames and leaves writing to ``operators.publish``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import dedupe, joins, project
from skarn.sources import archive


def asset_index(listing: DataFrame, prefix: str, extension: str) -> DataFrame:
    """(path, pos, offset...) of the largest copy of each normalised path."""
    files = archive.files(listing).withColumn("path", T.normalize_path(F.col("filename")))
    files = files.where(F.col("path").startswith(prefix) & F.col("path").endswith(extension))
    return dedupe.keep_largest(files, "path", "uncomp_size", ["pos"])


def best_entries(listing: DataFrame, wanted: DataFrame, suffix: str) -> DataFrame:
    """For each wanted path suffix the largest entry that ends with it."""
    files = archive.files(listing).withColumn("path", T.normalize_path(F.col("filename")))
    hit = joins.suffix_join(files, "path", wanted.withColumn(suffix, T.normalize_path(F.col(suffix))), suffix)
    return dedupe.keep_largest(hit, suffix, "uncomp_size", ["pos"])


def items(table: DataFrame, names: DataFrame, views: DataFrame) -> DataFrame:
    """Items by id with their internal names and views; items without a name stay.
    ``table`` has (id, identified, unidentified, slots, resource, lines)."""
    wide = table.join(names.select("id", F.col("name").alias("aegisName")), "id", "left").join(views, "id", "left")
    return wide.select(
        "id",
        F.coalesce("identified", "unidentified").alias("name"),
        "slots",
        "aegisName",
        T.normalize_resource(F.col("resource")).alias("resourceName"),
        T.join_lines(F.col("lines")).alias("description"),
        *[c for c in views.columns if c != "id"],
    ).orderBy("id")


def named(table: DataFrame, id_: str, name_of: Callable[[DataFrame], Column]) -> DataFrame:
    return project.name_table(table, id_, name_of)


def skills(names: DataFrame, descriptions: DataFrame, delays: DataFrame, info: DataFrame, fields: list[str]) -> DataFrame:
    """(id, name, maxLevel, description, delay) by three left joins; a delay whose
    arrays are all empty is null. ``delays`` has an array column per field."""
    delay = project.null_if_all_empty({f: project.until_null(F.col(f)) for f in fields})
    wide = names.join(descriptions, "id", "left").join(info, "id", "left").join(delays, "id", "left")
    return wide.where(F.col("name").isNotNull()).select("id", "name", "maxLevel", "description", delay.alias("delay")).orderBy("id")


def jobs(ids: DataFrame, labels: DataFrame, icons: DataFrame) -> DataFrame:
    """(id, key, name, hasIcon): keyed names joined with the ids that have icons,
    whichever side knows them. Per id the first key wins."""
    keyed = dedupe.keep_ranked(ids.join(labels, "key", "left"), "id", [F.col("key").asc()])
    have = icons.select("id").distinct().withColumn("hasIcon", F.lit(True))
    return keyed.join(have, "id", "full_outer").select("id", "key", F.col("label").alias("name"), F.coalesce("hasIcon", F.lit(False)).alias("hasIcon")).orderBy("id")


def monster_ids(ids: DataFrame, prefix: str, least: int = 1000) -> DataFrame:
    """(id, aegisId) of constants from ``least`` on, without the prefix; the first
    constant of an id wins. ``ids`` has (key, id, pos)."""
    kept = ids.where(F.col("id") >= least).withColumn("aegisId", F.regexp_replace("key", f"^{prefix}", ""))
    return dedupe.keep_first(kept, "id", "pos").select("id", "aegisId").orderBy("id")


def monster_record(raw: DataFrame) -> DataFrame:
    """A flat record of a nested one: mvp by type 301, mvp experience, or a boss
    with an mvp drop; boss by class or mvp. ``raw`` has (id, type, class,
    mvpExp, drops array<struct<isMvpDrop boolean>>)."""
    boss = F.coalesce(F.col("class") == "Boss", F.lit(False))
    drop = project.any_element(F.col("drops"), lambda d: F.coalesce(d["isMvpDrop"], F.lit(False)))
    mvp = F.coalesce(F.col("type").try_cast("int") == 301, F.lit(False)) | F.coalesce(F.col("mvpExp") > 0, F.lit(False)) | (boss & drop)
    return raw.withColumn("mvp", mvp).withColumn("boss", boss | F.col("mvp")).drop("class", "drops")


def music(tracks: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): map tracks by the files on disk, in any case of letters."""
    held = disk.select(F.lower("file").alias("low"), F.col("file").alias("path"))
    held = dedupe.keep_ranked(held, "low", [F.col("path").asc()])
    wide = tracks.withColumn("low", F.lower("file"))
    found, missing = joins.matched(wide, held, "low")
    return found.select("map", F.col("path").alias("file")).orderBy("map"), missing.select("map", "file").orderBy("map")


def place_effects(placed: DataFrame, strings: DataFrame, sprites: DataFrame, silent: DataFrame, emitters: DataFrame) -> DataFrame:
    """The class of each placed effect by its id, the first table that has it:
    'str', 'sprite', 'none' (drawn by code), 'emitter', else 'drop'."""
    out = placed
    for side, flag in ((strings, "__str"), (sprites, "__sprite"), (silent, "__none"), (emitters, "__emitter")):
        out = joins.membership(out, side, "effect", flag)
    kind = F.when(F.col("__str"), "str").when(F.col("__sprite"), "sprite").when(F.col("__none"), "none").when(F.col("__emitter"), "emitter").otherwise("drop")
    return out.withColumn("kind", kind).drop("__str", "__sprite", "__none", "__emitter")


def effect_files(table: DataFrame) -> DataFrame:
    """(effect, file) of effect templates, their %d expanded, each file of an
    effect once, in order of first appearance. ``table`` has (effect, pos,
    template, low, high)."""
    each = table.select("effect", "pos", F.posexplode(project.expand_template(F.col("template"), F.col("low"), F.col("high"))).alias("k", "file"))
    return dedupe.keep_first(each, ["effect", "file"], ["pos", "k"]).select("effect", "file")
