"""Statistics pages: one stat block out of a page, by its element id.

The page is read as a stream of markup events. A block is open from the div with
its id until the depth of divs falls back, so an empty block never reads its
sibling's numbers. A page without the block is classified; one that is neither
known to be missing nor to lack data is an error, so that a new layout is not
taken for unknown values.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Block(HTMLParser):
    """The texts of the table cells in the first div that has the id; ``found``
    tells whether the page has one."""

    def __init__(self, id_: str):
        super().__init__(convert_charrefs=True)
        self.id, self.found, self.depth = id_, False, 0
        self.cells: list[str] = []
        self.rows, self.part = 0, None  # rows that are open; pieces of the open cell

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "div" and (self.depth or not self.found and ("id", self.id) in attrs):
            self.found, self.depth = True, self.depth + 1
        elif self.depth and tag == "tr":
            self.rows += 1
        elif self.rows and tag == "td":
            self.part = []
        elif self.part is not None:
            self.part.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.part is not None:
            if tag in ("td", "tr"):
                self.cells.append(" ".join("".join(self.part).split()))
                self.part = None
            else:
                self.part.append(" ")
        if self.depth:
            self.depth -= tag == "div"
            self.rows = 0 if not self.depth else max(0, self.rows - (tag == "tr"))

    def handle_data(self, data: str) -> None:
        if self.part is not None:
            self.part.append(data)


def number(s: str) -> float | None:
    try:
        return float(s.replace(",", ""))
    except ValueError:
        return None


def stat(cell: str) -> tuple[str, float, float] | None:
    """(label, low, high) of a cell: a value or two with a dash between, a label
    from its first letter on, and perhaps a share in brackets, which is left out."""
    begin = next((i for i, c in enumerate(cell) if c.isalpha()), 0)
    values, label = [number(v) for v in cell[:begin].split("-")], cell[begin:]
    if label.endswith("%)"):
        label = label[: label.rindex("(")] if "(" in label else label
    if not begin or not cell[begin - 1].isspace() or len(values) > 2 or None in values:
        return None
    return label.strip(), values[0], values[-1]


def block(html: str, id_: str) -> dict[str, tuple[float, float]] | None:
    """label (lower) -> (low, high) of the stat cells of a block; null without it."""
    reader = Block(id_)
    reader.feed(html)
    reader.close()
    return {s[0].lower(): s[1:] for s in map(stat, reader.cells) if s} if reader.found else None


def parse(pages: DataFrame, html: str, id_: str, fields: Sequence[str], missing: str, no_data: str) -> DataFrame:
    """``pages`` with ``stats`` (field -> low value) and ``outcome``: ok,
    empty-block (level and hp are both 0), no-page, no-data, holes (a required
    field is missing) or unexpected. ``missing`` and ``no_data`` are the markers
    of the two known kinds of pages without a block, as regular expressions."""

    @F.pandas_udf("map<string, double>")
    def stats(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None or (b := block(h, id_)) is None else {k: v[0] for k, v in b.items()})

    out = pages.withColumn("stats", stats(html))
    value = lambda k: F.col("stats")[k]
    holes = F.lit(False)
    for f in fields:
        holes = holes | value(f).isNull()
    outcome = (
        F.when(F.col("stats").isNull() & F.col(html).rlike(missing), "no-page")
        .when(F.col("stats").isNull() & F.col(html).rlike(no_data), "no-data")
        .when(F.col("stats").isNull(), "unexpected")
        .when((value("level") == 0) & (value("hp") == 0), "empty-block")
        .when(holes, "holes")
        .otherwise("ok")
    )
    return out.withColumn("outcome", outcome)
