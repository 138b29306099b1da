import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from skarn.codecs import sprites  # noqa: F401  the codecs must import without Spark
from skarn.plans import pipelines
from skarn.render import compose
from skarn.sources import archive, pages, tables
from tests.test_codecs import action_file, sprite_file


def make_archive(path, files, version=0x200):
    body, table = b"", b""
    for name, content, flags in files:
        packed = zlib.compress(content)
        entry = struct.pack("<IIIBI", len(packed), len(packed), len(content), flags, len(body)) + (struct.pack("<I", 0) if version == 0x300 else b"")
        raw = name.encode("cp949")
        table += (raw + b"\0" + entry) if version >= 0x200 else struct.pack("<I", len(raw) + 6) + b"\0\0" + raw + bytes(4) + entry
        body += packed
    gap = bytes(4) if version == 0x300 else b""
    packed = zlib.compress(table)
    tail = gap + struct.pack("<II", len(packed), len(table)) + packed if version >= 0x200 else table
    head = b"Master of Magic".ljust(30, b"\0") + struct.pack("<IIII", len(body), 0, len(files) + 7, version)
    path.write_bytes(head + body + tail)


FILES = [("data\\A.txt", b"first", 1), ("data\\a.TXT", b"longer", 1), ("data", b"", 0), ("data\\사과.txt", b"apple", 1), ("data\\enc.txt", b"secret", 3)]


@pytest.mark.parametrize("version", [0x200, 0x300, 0x103])
def test_archive(spark, tmp_path, version):
    make_archive(tmp_path / "x.grf", FILES, version)
    spark.dataSource.register(archive.ArchiveSource)
    listing = spark.read.format("archive").load(str(tmp_path / "x.grf"))
    assert listing.count() == 5
    index = pipelines.asset_index(listing, "data/", ".txt")
    got = archive.contents(index, str(tmp_path / "x.grf"))
    rows = {r["path"]: (None if r["content"] is None else bytes(r["content"]), r["error"]) for r in got.collect()}
    assert rows["data/a.txt"] == (b"longer", None) and rows["data/사과.txt"] == (b"apple", None)
    assert rows["data/enc.txt"][0] is None and "encrypted" in rows["data/enc.txt"][1]
    wanted = spark.createDataFrame([("과.txt",), ("none",)], "w string")
    assert [r["path"] for r in pipelines.best_entries(listing, wanted, "w").collect()] == ["data/사과.txt"]


def test_archive_errors(tmp_path):
    (tmp_path / "bad").write_bytes(b"x")
    with pytest.raises(archive.ArchiveError):
        list(archive.entries(str(tmp_path / "bad")))
    make_archive(tmp_path / "odd", FILES, 0x999)
    with pytest.raises(archive.ArchiveError):
        list(archive.entries(str(tmp_path / "odd")))


def text_rows(spark, tmp_path, text):
    (tmp_path / "t.txt").write_text(text)
    return tables.lines(spark, str(tmp_path / "t.txt"))


def test_numbered_names(spark, tmp_path):
    rows = text_rows(spark, tmp_path, "501\t1\t// Red_Potion\n502\t1\t// potion\r\n503\t1\t// Some prose here\nx\t// A_B\n501\t2 // Blue_Potion")
    assert sorted(map(tuple, tables.numbered_names(rows).collect())) == [(501, "Blue_Potion")]


def test_fog(spark, tmp_path):
    rows = text_rows(spark, tmp_path, "// c\nA.rsw#\n0.1#\n0.9# // x\n0xFF102030#\n0.5#\nb.gat#x#1#ffffff#1#c.rsw#1#2#010203#1#d#1#")
    got = {r["map"]: r for r in tables.fog(rows).collect()}
    assert set(got) == {"a", "c"} and got["a"]["near"] == 0.1 and [round(v * 255) for v in got["a"]["color"]] == [16, 32, 48]


def test_tracks_and_music(spark, tmp_path):
    rows = text_rows(spark, tmp_path, "Prontera.rsw#bgm\\\\08.mp3#\n// x.rsw#bgm\\\\1.mp3#\nizlude.rsw#bgm\\sub\\26.MP3#\nprontera.rsw#bgm\\\\09.mp3#")
    tr = tables.tracks(rows)
    assert sorted(map(tuple, tr.collect())) == [("izlude", "26.mp3"), ("prontera", "09.mp3")]
    found, missing = pipelines.music(tr, spark.createDataFrame([("09.MP3",)], "file string"))
    assert [tuple(r) for r in found.collect()] == [("prontera", "09.MP3")] and [tuple(r) for r in missing.collect()] == [("izlude", "26.mp3")]


def test_message_names(spark, tmp_path):
    e = lambda s: base64.b64encode(s.encode()).decode()
    cols = lambda k, en, pt: ",".join([e(k), "", e(en), "", "", "", "", e(pt)])
    rows = text_rows(spark, tmp_path, "\n".join([cols("MSI_JOB_A", "Knight", "Cavaleiro"), cols("MSI_JOB_B", "Mage", " "), cols("OTHER", "x", "y"), "!!!"]))
    assert sorted(map(tuple, tables.message_names(rows, "MSI_JOB_", 7, 2).collect())) == [("A", "Cavaleiro"), ("B", "Mage")]


def test_constants(spark):
    rows = [("string", "JT_A", None), ("number", None, 4001.0), ("string", "JT_A", None), ("number", None, 5.0), ("string", "Tab", None), ("string", "JT_B", None), ("string", "skip", None), ("string", "label", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, type string, s string, n double")
    assert [tuple(r) for r in tables.constant_ids(df, "JT_").collect()] == [("JT_A", 4001)]
    assert sorted(map(tuple, tables.constant_labels(df, "JT_", ["skip"]).collect())) == [("JT_A", "Tab"), ("JT_B", "label")]


def test_replay_tolerates_a_torn_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id":1,"v":"a"}\n{"id":2,"v":null}\n{"id":1,"v":"b"}\n{"id":3,"v":"x')
    got = tables.replay(spark, str(tmp_path / "log.jsonl"), "id long, v string", "id")
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, None)]


PAGE = '<div id="other"><table><tr><td>9 Hp</td></tr></table></div><div id="stats"><div><table><tr><td>1,200 Hp</td><td>7 Level</td><td>205 Res (-27.11%)</td></tr></table></div></div>'


def test_pages(spark):
    rows = [(1, PAGE), (2, "<h1>not found</h1>"), (3, "no data yet"), (4, "<html>login</html>"), (5, '<div id="stats"><td>0 Hp</td></div>'), (6, None), (7, '<div id="stats"><tr><td>0 Hp</td><td>0 Level</td></tr></div>')]
    df = spark.createDataFrame(rows, "id int, html string")
    got = {r["id"]: r for r in pages.parse(df, "html", "stats", ["hp", "level", "res"], "not found", "no data").collect()}
    assert [got[i]["outcome"] for i in range(1, 8)] == ["ok", "no-page", "no-data", "unexpected", "holes", "unexpected", "empty-block"]
    assert got[1]["stats"] == {"hp": 1200.0, "level": 7.0, "res": 205.0}


def test_render_isolates_errors(spark):
    import numpy as np

    good = sprite_file(np.full((2, 2, 4), 255, np.uint8))
    df = spark.createDataFrame([(1, bytearray(good), bytearray(action_file([(0, 0, 0)])), 0, 0), (2, bytearray(b"bad"), bytearray(action_file([(0, 0, 0)])), 0, 0)], "id int, sprite binary, animation binary, action int, frame int")
    got = {r["id"]: r for r in compose.render(df).collect()}
    assert got[1]["error"] is None and bytes(got[1]["png"][:4]) == b"\x89PNG" and got[2]["png"] is None and got[2]["error"]


def test_jobs_and_monsters(spark):
    ids = spark.createDataFrame([("JT_A", 1, 0), ("JT_P", 1001, 1), ("JT_Q", 1001, 2)], "key string, id long, pos int")
    labels = spark.createDataFrame([("JT_A", "Novice")], "key string, label string")
    icons = spark.createDataFrame([(1,), (77,)], "id long")
    got = [tuple(r) for r in pipelines.jobs(ids, labels, icons).collect()]
    assert got == [(1, "JT_A", "Novice", True), (77, None, None, True), (1001, "JT_P", None, False)]
    assert [tuple(r) for r in pipelines.monster_ids(ids, "JT_").collect()] == [(1001, "P")]


def test_streams(spark, tmp_path):
    from skarn.streaming import latest

    schema = "event_id long, ts timestamp, user_id long"
    spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "event_id long, user_id long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).select("event_id", "ts", "user_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = latest.first_per_key(stream, ["event_id"], "ts", "1 hour").writeStream.format("memory").queryName("first").start()
    try:
        q.processAllAvailable()
        assert spark.table("first").count() == 2
    finally:
        q.stop()
