"""Column functions on names, paths and small markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(c: Column) -> Column:
    """Runs of slashes of either kind become one /, letters are lowered."""
    return F.lower(F.regexp_replace(c, r"[\\/]+", "/"))


def normalize_resource(c: Column) -> Column:
    """Backslashes become slashes, one leading underscore goes, letters are lowered; null is ''."""
    return F.coalesce(F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^_", "")), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Backslashes become slashes, leading slashes go, letters are lowered."""
    return F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", ""))


def sanitize_path(c: Column) -> Column:
    """A relative path without drive letter; null if a part is . or .. ."""
    p = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^[A-Za-z]:", ""), "^/+", "")
    return F.when(~F.exists(F.split(p, "/"), lambda s: s.isin(".", "..")), p)


def collapse_dots(c: Column) -> Column:
    """Fold . and .. parts; a .. at the top goes."""
    fold = F.aggregate(
        F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(fold, "/")


def base_name(c: Column, extension: str) -> Column:
    """The last part of a path without its extension (in any case)."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), f"(?i){extension.replace('.', '[.]')}$", "")


def slug(c: Column, fallback: Column) -> Column:
    """``c`` if it is a lower-case ASCII slug, else the fallback."""
    return F.when(c.rlike("^[a-z0-9_-]+$"), c).otherwise(fallback)


def drop_color_codes(c: Column) -> Column:
    """Text without ^rrggbb markers."""
    return F.regexp_replace(c, r"\^[0-9a-fA-F]{6}", "")


def equip_slots(lines: Column, label: str, names: list[str]) -> Column:
    """Those of ``names``, in that order, that the first line with the label mentions."""
    line = F.get(F.filter(F.transform(lines, drop_color_codes), lambda x: F.contains(x, F.lit(label))), 0)
    return F.coalesce(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(line, n)), F.array().cast("array<string>"))


def join_lines(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def number(c: Column) -> Column:
    """Digits with thousands commas as a double, null if they are none or not finite."""
    x = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def strip_tags(html: Column) -> Column:
    """Markup becomes a space, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def cells(html: Column, tag: str) -> Column:
    """The bodies of all elements of a tag that holds no element of its own kind."""
    return F.regexp_extract_all(html, F.lit(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>"), 1)


def stat_cell(c: Column) -> Column:
    """A cell's label (from its first letter on, without a share in brackets at
    the end), and the one or two numbers before it, as a struct; null numbers if
    there are none."""
    at = F.regexp_instr(c, F.lit(r"\p{L}"))
    has = at > 0
    values = F.transform(F.split(F.when(has, F.left(c, at - 1)).otherwise(c), "-"), number)
    label = F.when(has, F.substr(c, at))
    share = F.length(F.substring_index(label, "(", -1)) + 1
    label = F.trim(F.when(F.endswith(F.rtrim(label), F.lit("%)")), F.left(label, F.length(label) - share)).otherwise(label))
    return F.struct(label.alias("label"), values[0].alias("low"), F.element_at(values, -1).alias("high"))


def hex_color(c: Column) -> Column:
    """6 or 8 hex digits as three shares of one (the last six digits), else null."""
    digits = F.regexp_extract(c, "^(?:#|0x|0X)?(?:[0-9a-fA-F]{2})?([0-9a-fA-F]{6})$", 1)
    n = F.conv(digits, 16, 10).cast("long")
    return F.when(digits != "", F.array(*[F.shiftright(n, k).bitwiseAND(255) / F.lit(255.0) for k in (16, 8, 0)]))


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """Lower-cased, with aliases resolved."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[low], low)


def canonical_query(url: Column) -> Column:
    """SHA-256 of a URL's parameters, sorted, empty ones dropped, one to a line."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+$")))
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("\n"))), ""), 256)


def content_address(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def split_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_bool(c: Column) -> Column:
    """true, t, yes, 1 and their opposites in any case, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "t", "true", "yes"), True).when(low.isin("0", "f", "false", "no"), False)


def parse_enum(c: Column, names: list[str]) -> Column:
    """The number of a name (any case), or a number in range; else null."""
    low = F.lower(F.trim(c))
    at = F.array_position(F.array(*[F.lit(n.lower()) for n in names]), low).cast("int")
    n = low.try_cast("int")
    return F.when(at > 0, at - 1).when(n.between(0, len(names) - 1), n)


def parse_canvas(c: Column) -> Column:
    """'WxH+X+Y' (offsets signed) as a struct, null if it is something else."""
    pattern = r"^(\d+)x(\d+)([+-]\d+)([+-]\d+)$"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("int")
    return F.when(c.rlike(pattern), F.struct(part(1).alias("width"), part(2).alias("height"), part(3).alias("x"), part(4).alias("y")))


def round_half_up(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def round_half_away(c: Column) -> Column:
    return F.round(c)


def packed_color(c: Column) -> Column:
    """0xAABBGGRR as a struct."""
    return F.struct(*[F.shiftright(c, k).bitwiseAND(255).cast("int").alias(n) for n, k in (("r", 0), ("g", 8), ("b", 16), ("a", 24))])


def frame_delay_centis(numerator: Column, denominator: Column) -> Column:
    """A frame's delay in hundredths of a second, at least 2; denominator 0 is 100."""
    den = F.when(denominator == 0, 100).otherwise(denominator)
    return F.greatest(F.lit(2), F.floor(numerator * 100 / den)).cast("int")


def action_family(action: Column, known: list[int]) -> Column:
    """The action without its direction (its last three bits), 255 if unknown."""
    family = action - action % 8
    return F.when(family.isin(known), family).otherwise(255)
