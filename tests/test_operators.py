import pytest
from pyspark.sql import functions as F

from skarn.functions import charset, text
from skarn.operators import dedupe, joins, project, publish, reconcile, stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_largest_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 0, 5), ("a", 2, 4), ("b", 0, None)], "k string, pos int, size int")
    assert rows(dedupe.keep_largest(df, "k", "size", ["pos"])) == [("a", 0, 5), ("b", 0, None)]


def test_lookup_keeps_driving_rows_and_nulls_never_match(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    side = spark.createDataFrame([(1, "x"), (None, "y")], "id int, v string")
    assert rows(joins.lookup(df, side, "id", 2)) == sorted([(1, "x"), (2, None), (None, None)], key=repr)
    assert rows(joins.membership(df, side, "id", "f")) == sorted([(1, True), (2, False), (None, False)], key=repr)


def test_suffixes_need_not_begin_at_a_part(spark):
    df = spark.createDataFrame([("data/icon.bmp",), ("bmp",), ("x",)], "path string")
    wanted = spark.createDataFrame([("con.bmp",), ("bmp",), ("zzz",)], "w string")
    got = joins.suffix_join(df, "path", wanted, "w").select("path", "w")
    assert rows(got) == [("bmp", "bmp"), ("data/icon.bmp", "bmp"), ("data/icon.bmp", "con.bmp")]
    assert joins.suffix_join(df, "path", wanted.limit(0), "w").count() == 0


def test_suffix_join_never_broadcasts_the_expanded_texts(spark, tmp_path):
    spark.createDataFrame([(i, f"{i % 7}icon.bmp") for i in range(100)], "id int, path string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")  # its size is known and small, that of ``wanted`` is not
    wanted = spark.createDataFrame([("con.bmp",), ("3icon.bmp",), ("",), ("zzz",)], "w string")
    for known in ({}, {"rows": 4}):
        got = joins.suffix_join(df, "path", wanted, "w", **known)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        joined = [x for x in plan.splitlines() if "HashJoin" in x]
        assert len(joined) == 1 + len(known) and all("BuildRight" in x for x in joined), plan
        assert got.where("w = 'con.bmp'").count() == 100 and got.where("w = ''").count() == 100
        assert got.where("w = '3icon.bmp'").count() == sum(i % 7 == 3 for i in range(100))


def test_nearest_is_first_of_equals_and_within_radius(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "r int, x double, y double")
    pts = spark.createDataFrame([(7, 3.0, 0.0), (5, 0.0, 3.0), (9, 106.0, 0.0)], "p int, px double, py double")
    got = joins.nearest_within(df, pts, ("x", "y"), ("px", "py"), 5.0, "r", "p")
    assert [(r["r"], r["p"]) for r in got.collect()] == [(1, 5)]


def test_segments_stop_at_the_next_key(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(["w", "K1", "T", "a", "b", "K2", "K3", "c"])], "g int, pos int, s string")
    got = joins.segment_scan(df.withColumn("v", F.col("s")), ["g"], ["pos"], F.col("s").startswith("K"), ~F.col("s").startswith("K") & (F.col("s") != "T"), "v", "label")
    assert rows(got) == [(0, 1, "a"), (0, 2, None), (0, 3, "c")]


def test_positional_groups_drop_the_partial_one(spark):
    df = spark.range(12).withColumn("g", F.lit(0))
    assert joins.positional_groups(df, ["g"], ["id"], 5).count() == 10


def test_unknown_is_not_zero(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, None, "y"), (3, 5, "z")], "id int, res int, race string")
    b = spark.createDataFrame([(1, 0, "x"), (2, 0, "q"), (3, 6, "z")], "id int, res int, race string")
    assert rows(reconcile.differences(a, b, "id", ["res", "race"])) == [(2, "race", "y", "q"), (3, "res", "5", "6")]


def test_ledger_is_stale_when_a_side_moved(spark):
    diff = spark.createDataFrame([(1, "f", "a", "b"), (2, "f", "a", "c"), (3, "f", "x", "y")], "id int, field string, a string, b string")
    led = spark.createDataFrame([(1, "f", "a", "b"), (2, "f", "a", "b")], "id int, field string, led_a string, led_b string")
    assert [r[-1] for r in rows(reconcile.against_ledger(diff, led, "id"))] == ["ack", "stale", "open"]


def test_merge_has_four_outcomes(spark):
    p = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "id int, name string")
    s = spark.createDataFrame([(1, 0), (4, 9)], "id int, res int")
    got = reconcile.merge(p, s, "id", ["res"], spark.createDataFrame([(2,)], "id int"), spark.createDataFrame([(4,)], "id int"))
    assert rows(got) == [(1, "n1", 0, "merged"), (2, "n2", None, "absent"), (3, "n3", None, "uncovered"), (4, "n4", None, "untrusted")]


def test_publish_is_all_or_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/pub"
    good, empty = spark.range(3), spark.range(0)
    with pytest.raises(reconcile.GateError):
        publish.publish({"a": good, "b": empty}, {}, out)
    assert not (tmp_path / "pub" / "a").exists()
    report = publish.publish({"a": good}, {"a": {"few": F.count("*") < 10}}, out, {"a": 100})
    assert report == {"a": {"rows": 3, "shrank": True}}
    assert spark.read.json(f"{out}/a").count() == 3


def test_blobs_and_index(spark):
    df = spark.createDataFrame([("t", bytearray(b"x"), "png"), ("t", bytearray(b"x"), "png"), ("u", bytearray(b"x"), "png")], "f string, c binary, e string")
    assert publish.blobs(df, "c", "f", "e").count() == 2
    a = spark.createDataFrame([("b",), ("a",), (None,)], "n string")
    assert [r[0] for r in publish.index(a, "n", spark.createDataFrame([("c",)], "n string")).collect()] == ["a", "b", "c"]


def test_arrays_end_at_the_first_gap(spark):
    df = spark.createDataFrame([([1, 2, None, 4],), ([None, 1],), ([1],), (None,)], "v array<int>")
    assert [r[0] for r in df.select(project.until_null(F.col("v"))).collect()] == [[1, 2], [], [1], None]
    df = spark.createDataFrame([([1], []), ([], [])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(project.null_if_all_empty({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got[0]["a"] == [1] and got[1] is None


def test_swatches(spark):
    pals = [(p, i, *((200 - 100 * p, 30, 30) if i in (3, 4, 5) else (90, 90, 90))) for p in range(2) for i in range(8)]
    df = spark.createDataFrame(pals, "pal int, idx int, r int, g int, b int")
    assert rows(stats.swatch(df)) == [(0, 200, 30, 30), (1, 100, 30, 30)]
    assert rows(stats.swatch(df.where("pal = 0"))) == [(0, None, None, None)]


def test_paths_and_values(spark):
    df = spark.createDataFrame([("C:\\A\\\\b/..\\C.BMP", "7,076 - 10,373 Attack (-2%)", "#80ff0000", "0x10")], "p string, s string, c string, q string")
    got = df.select(
        text.normalize_path(F.lit("A\\\\b//C")), text.sanitize_path(F.col("p")), text.collapse_dots(F.lit("a/./b/../c")), text.stat_cell(F.col("s")), text.hex_color(F.col("c")),
        text.round_half_up(F.lit(-2.5)), text.parse_bool(F.lit("Yes")), text.parse_enum(F.lit("b"), ["A", "B"]), text.parse_canvas(F.lit("10x20+1-2")), text.frame_delay_centis(F.lit(1), F.lit(100)),
    ).first()
    assert got[0] == "a/b/c" and got[1] is None and got[2] == "a/c"
    assert tuple(got[3]) == ("Attack", 7076.0, 10373.0) and got[4] == [1.0, 0.0, 0.0]
    assert got[5] == -2 and got[6] is True and got[7] == 1 and tuple(got[8]) == (10, 20, 1, -2) and got[9] == 2


def test_charsets(spark):
    korean, latin = "사과", "Poção"
    assert charset.decode_client(korean.encode("cp949")) == korean
    assert charset.decode_client(latin.encode("cp1252")) == latin
    assert charset.decode_client(korean.encode("utf-8")) == korean
    assert charset.decode_client(b"\x81 ascii") == "\x81 ascii"
    assert charset.decode_file_name(korean.encode("cp949")) == korean
    assert charset.reinterpret(korean.encode("cp949").decode("latin-1")) == korean
    df = spark.createDataFrame([(bytearray(korean.encode("cp949")),), (None,)], "b binary")
    assert [r[0] for r in df.select(charset.client_text("b")).collect()] == [korean, None]


def test_names_come_from_the_real_id_behind_an_id(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id int")
    names = spark.createDataFrame([(1, "sword"), (2, ""), (7, "bow")], "id int, name string")
    real = spark.createDataFrame([(1, 7), (2, 7), (3, 9)], "id int, real_id int")
    assert rows(joins.named_or_real(df, "id", names, real, "n")) == sorted([(1, "sword"), (2, "bow"), (3, "_9"), (4, "_4"), (None, None)], key=repr)
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "c"), (2, None)], "id int, name string")
    assert rows(joins.names_of(twice, "id", "name", "names")) == [(1, ["a", "b"])]


def test_largest_table_stands_in_for_a_missing_one(spark):
    rows_of = lambda scope, name, n, at: [(scope, name, at + i) for i in range(n)]
    data = rows_of("a", "T", 1, 50) + rows_of("a", "big", 4, 0) + rows_of("b", "x", 2, 9) + rows_of("b", "y", 2, 3) + rows_of("b", "skip", 9, 20) + [("c", "skip", 0)]
    df = spark.createDataFrame(data, "scope string, name string, at int")
    assert rows(stats.named_or_largest(df, "scope", "name", "at", "T", "skip")) == [("a", "T", 1, False), ("b", "y", 2, True)]
    assert rows(stats.highest(df, ["scope"], "at", "top")) == [("a", 50), ("b", 28), ("c", 0)]


def test_layers_elements_and_code_units(spark):
    df = spark.createDataFrame([(1, [0, 0]), (2, [0, 5]), (3, []), (4, None)], "id int, a array<int>")
    assert [bool(r[0]) for r in df.orderBy("id").select(project.draws_nothing(F.col("a"))).collect()] == [True, False, False, False]
    nested = spark.createDataFrame([([["b", "a"], None, ["a", "c"]],)], "x array<array<string>>")
    assert nested.select(project.distinct_elements(F.col("x"))).first()[0] == ["b", "a", "c"]
    names = spark.createDataFrame([("\ufb01",), ("\U0001f600",), ("Ab",)], "n string")
    assert [r[0] for r in names.orderBy(project.code_unit_key(F.col("n"))).collect()] == ["Ab", "\U0001f600", "\ufb01"]
    assert rows(project.matching(names, "n", "^ab$")) == [("Ab",)]
