"""Repair of texts whose charset is not known: Arrow-batched, never by row.

``client_text`` tries ASCII, strict UTF-8, then Windows-949 against Windows-1252
by plausibility. ``file_name`` has only Windows-949 and Windows-1252.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes that Windows-1252 leaves open become C1 controls, as browsers have it.
_OPEN = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def cp1252(raw: bytes) -> str:
    return "".join(chr(b) if b in _OPEN else bytes([b]).decode("cp1252") for b in raw)


def strict(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def latin_plausible(text: str) -> bool:
    """Every non-ASCII character is a letter and no three of them stand together."""
    run = 0
    for ch in text:
        if ord(ch) < 128:
            run = 0
            continue
        run += 1
        if run >= 3 or not unicodedata.category(ch).startswith("L"):
            return False
    return True


def decode_client(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    if raw.isascii():
        return raw.decode("ascii")
    if (text := strict(raw, "utf-8")) is not None:
        return text
    korean, latin = strict(raw, "cp949"), cp1252(raw)
    if korean is None or latin_plausible(latin):
        return latin
    return korean


def decode_file_name(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    korean = strict(raw, "cp949")
    return cp1252(raw) if korean is None else korean


def reinterpret(text: str | None) -> str | None:
    """A name that was read as Latin-1, read as Windows-949; null if it can't be."""
    if text is None or any(ord(c) > 255 for c in text):
        return None
    return strict(text.encode("latin-1"), "cp949")


@F.pandas_udf(StringType())
def client_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: decode_client(None if b is None else bytes(b)))


@F.pandas_udf(StringType())
def file_name(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: decode_file_name(None if b is None else bytes(b)))


@F.pandas_udf(StringType())
def reinterpreted(text: pd.Series) -> pd.Series:
    return text.map(reinterpret)
