"""Packed asset archives as a Spark data source.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").load("/data/client.grf")

gives a row per entry: its place in the table, name and where its bytes are.
The table is read once for planning; its entries are dealt into partitions, and
``contents`` reads and inflates them where they are needed, by offset, so an
archive is never read as a whole. Names are kept as text by the file-name
charset rule. Encrypted entries need a ``decrypt`` function of (bytes, entry).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skarn.functions.charset import decode_file_name

HEADER = 46
FILE, ENCRYPTED = 1, 6
SCHEMA = "pos long, filename string, comp_size long, comp_size_aligned long, uncomp_size long, flags int, offset long"
#: Entries of one partition.
ENTRIES = 20_000


class ArchiveError(ValueError):
    pass


def entries(path: str) -> Iterator[tuple]:
    """Rows of SCHEMA, in table order."""
    with open(path, "rb") as f:
        head = f.read(HEADER)
        if len(head) < HEADER:
            raise ArchiveError("too short for an archive")
        table, seed, count, version = struct.unpack_from("<IIII", head, 30)
        if version in (0x200, 0x300):
            f.seek(HEADER + table + (4 if version == 0x300 else 0))
            packed, size = struct.unpack("<II", f.read(8))
            body = zlib.decompress(f.read(packed))
            if len(body) != size:
                raise ArchiveError(f"table of {len(body)} bytes, {size} told")
            yield from _named(body, wide=version == 0x300)
        elif version in (0x101, 0x103):
            f.seek(HEADER + table)
            yield from _counted(f.read(), count - seed - 7)
        else:
            raise ArchiveError(f"archive version {version:#x}")


def _named(body: bytes, wide: bool) -> Iterator[tuple]:
    trailer = struct.Struct("<IIIBII" if wide else "<IIIBI")
    at = pos = 0
    while (end := body.find(b"\0", at)) >= 0 and end + 1 + trailer.size <= len(body):
        packed, aligned, size, flags, low, *high = trailer.unpack_from(body, end + 1)
        yield pos, decode_file_name(body[at:end]), packed, aligned, size, flags, low + ((high[0] << 32) if high else 0)
        at, pos = end + 1 + trailer.size, pos + 1


def _counted(body: bytes, count: int) -> Iterator[tuple]:
    at = 0
    for pos in range(count):
        if at + 4 > len(body):
            return
        (n,) = struct.unpack_from("<I", body, at)
        name, at = body[at + 6 : at + n], at + 4 + n
        if at + 17 > len(body):
            return
        packed, aligned, size, flags, offset = struct.unpack_from("<IIIBI", body, at)
        yield pos, decode_file_name(name), packed, aligned, size, flags, offset
        at += 17


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        n = sum(1 for _ in entries(self.path))
        return [_Part(k, min(n, k + ENTRIES)) for k in range(0, max(n, 1), ENTRIES)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for row in entries(self.path):
            if row[0] >= partition.high:
                return
            if row[0] >= partition.low:
                yield row


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not (path := self.options.get("path")):
            raise ArchiveError("an archive needs a path")
        return _Reader(path)


def payload(f, entry: dict, decrypt: Callable[[bytes, dict], bytes] | None) -> bytes:
    f.seek(HEADER + entry["offset"])
    raw = f.read(entry["comp_size_aligned"])
    if entry["flags"] & ENCRYPTED:
        if decrypt is None:
            raise ArchiveError(f"{entry['filename']} is encrypted")
        raw = decrypt(raw, entry)
    return raw[: entry["uncomp_size"]] if entry["comp_size"] == entry["uncomp_size"] else zlib.decompressobj().decompress(raw)


def contents(listing: DataFrame, path: str, decrypt: Callable[[bytes, dict], bytes] | None = None) -> DataFrame:
    """``listing`` with ``content`` (binary) and ``error`` (null if it was read)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                got, bad = [], []
                for entry in b.to_pylist():
                    try:
                        got.append(payload(f, entry, decrypt))
                        bad.append(None)
                    except (ArchiveError, zlib.error) as e:
                        got.append(None)
                        bad.append(str(e))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()), pa.array(bad, pa.string())], names=[*b.schema.names, "content", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)
    return listing.mapInArrow(read, f"{fields}, content binary, error string")


def files(listing: DataFrame) -> DataFrame:
    """Only file entries, without directories."""
    return listing.where(F.col("flags").bitwiseAND(FILE) != 0)


def encrypted(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("flags").bitwiseAND(ENCRYPTED) != 0)
