"""The registered queries of the library's own operators and their SQL.

Every query runs over whole tables; its SQL says the same in another dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import dedupe, joins, project, reconcile, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def keep_largest(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dedupe.keep_largest(li, "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")


@query("""
    SELECT event_type, user_id, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1""")
def keep_first(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", "value")
    return dedupe.keep_first(e, ["event_type", "user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_name IS NOT NULL GROUP BY p_name")
def lowest_id_per_name(spark, sf_dir):
    return dedupe.lowest_id(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""
    WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY first) - 1)::INT AS seq FROM f""")
def first_appearance(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedupe.first_appearance(e, "user_id", "event_type", "event_id", "seq").select("user_id", "event_type", "seq").distinct()


@query("""
    SELECT coalesce(c.id, s.id) AS id, c.id IS NOT NULL AS in_customer, s.id IS NOT NULL AS in_supplier
    FROM (SELECT DISTINCT c_custkey AS id FROM customer) c FULL JOIN (SELECT DISTINCT s_suppkey AS id FROM supplier) s ON c.id = s.id""")
def full_outer_universe(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return joins.universe(c, s, "id", "in_customer", "in_supplier")


@query("SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def next_row_pairing(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return joins.next_row(e, ["user_id"], ["ts", "event_id"], "event_type", "next_type").drop("ts")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<li\b[^>]*>([\s\S]*?)</li>', 1))::INT AS n_cells FROM pages")
def html_cells(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(T.cells(F.col("html"), "li")).alias("n_cells"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@query("SELECT left(sha256(text), 16) AS address, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_address(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.content_address(F.col("text")).alias("address"))
    return d.groupBy("address").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
    WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
    n AS (SELECT a.vec_id, b.vec_id AS near_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
          FROM v a JOIN v b ON a.label % 2 = 0 AND b.label % 2 = 1)
    SELECT vec_id, near_id, round(d2, 9) AS d2 FROM n WHERE d2 <= 0.05 * 0.05
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, near_id) = 1""")
def nearest_within(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    probes = v.where(F.col("label") % 2 == 0).select("vec_id", "x", "y")
    points = v.where(F.col("label") % 2 == 1).select(F.col("vec_id").alias("near_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = joins.nearest_within(probes, points, ("x", "y"), ("px", "py"), 0.05, "vec_id", "near_id")
    return out.select("vec_id", "near_id", F.round("d2", 9).alias("d2"))


@query("""
    SELECT l_suppkey, bin, weight FROM (SELECT l_suppkey, floor(l_quantity / 5)::INT AS bin, count(*) AS weight FROM lineitem GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, bin) = 1""")
def weighted_mode_bin(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return stats.weighted_mode(li, ["l_suppkey"], F.floor(F.col("l_quantity") / 5).cast("int"), F.lit(1))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT doc_id, md5(lower(text)) AS lower_md5 FROM documents")
def unicode_lower(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text")).alias("lower_md5"))


@query("""
    SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def left_lookup_chain(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = read(spark, sf_dir, "region").where("r_regionkey < 3").select("r_regionkey", "r_name")
    return joins.lookup(joins.lookup(c, n, "n_nationkey"), r, "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders")
def semi_anti_flags(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.membership(o, li, "o_orderkey", "has_lines")


@query("""
    SELECT p_partkey, p_name, prio FROM (
        SELECT p_partkey, p_name, 0 AS prio FROM part WHERE p_size <= 10
        UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_retailprice > 1500
        UNION ALL SELECT p_partkey, p_name, 2 FROM part WHERE p_brand LIKE '%1')
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY prio, p_name) = 1""")
def priority_fallback(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    branches = [p.where("p_size <= 10"), p.where("p_retailprice > 1500"), p.where("p_brand like '%1'")]
    return joins.priority([b.select("p_partkey", "p_name") for b in branches], "p_partkey", ["p_name"])


@query("SELECT concat(p_name, '|', p_brand) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1")
def unique_or_none(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit("|"), "p_brand").alias("name"), "p_partkey")
    return joins.unique_or_none(p, "name", "p_partkey")


SUFFIXES = ("ring", "widget", "dget", "zzz")


@query("SELECT p_partkey, w AS suffix FROM part JOIN (VALUES ('ring'), ('widget'), ('dget'), ('zzz')) s(w) ON p_name LIKE concat('%', w)")
def suffix_match(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    return joins.suffix_join(p, "p_name", wanted, "suffix", len(SUFFIXES)).select("p_partkey", "suffix")


@query("""
    SELECT o_orderkey, count(l_partkey) AS n_lines, count(l_partkey) - count(p_partkey) AS n_missed
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY 1""")
def two_hop(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    p = read(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    wide = o.join(li, "o_orderkey", "left").join(p, F.col("p_partkey") == F.col("l_partkey"), "left")
    n = F.count("l_partkey")
    return wide.groupBy("o_orderkey").agg(n.alias("n_lines"), (n - F.count("p_partkey")).alias("n_missed"))


def _altered(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    off = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 3, "X").otherwise(F.col("o_orderstatus")))
    off = off.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 7, F.lit(None)).when(F.col("o_orderkey") % 100 == 9, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return o, off


FIELDS = ["o_orderstatus", "o_orderpriority", "o_custkey"]
_ALTERED = """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
          CASE WHEN o_orderkey % 100 = 7 THEN NULL WHEN o_orderkey % 100 = 9 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders),
    diff AS (SELECT o_orderkey, 'o_orderstatus' AS field, a.o_orderstatus AS a, b.o_orderstatus AS b FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus
        UNION ALL SELECT o_orderkey, 'o_orderpriority', a.o_orderpriority, b.o_orderpriority FROM a JOIN b USING (o_orderkey) WHERE a.o_orderpriority <> b.o_orderpriority
        UNION ALL SELECT o_orderkey, 'o_custkey', a.o_custkey::VARCHAR, b.o_custkey::VARCHAR FROM a JOIN b USING (o_orderkey) WHERE a.o_custkey <> b.o_custkey)"""


@query(_ALTERED + " SELECT * FROM diff")
def reconcile_unpivot(spark, sf_dir):
    a, b = _altered(spark, sf_dir)
    return reconcile.differences(a, b, "o_orderkey", FIELDS)


@query(_ALTERED + """, led AS (SELECT o_orderkey, field, a AS led_a, CASE WHEN o_orderkey % 3 = 0 THEN b ELSE 'was' END AS led_b FROM diff WHERE o_orderkey % 3 < 2)
    SELECT o_orderkey, field, a, b, CASE WHEN led_a IS NULL AND led_b IS NULL THEN 'open' WHEN a = led_a AND b = led_b THEN 'ack' ELSE 'stale' END AS status
    FROM diff LEFT JOIN led USING (o_orderkey, field)""")
def ledger_gate(spark, sf_dir):
    a, b = _altered(spark, sf_dir)
    diff = reconcile.differences(a, b, "o_orderkey", FIELDS)
    ledger = diff.where("o_orderkey % 3 < 2").select("o_orderkey", "field", F.col("a").alias("led_a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("b")).otherwise("was").alias("led_b"))
    return reconcile.against_ledger(diff, ledger, "o_orderkey")


@query("""
    SELECT CASE WHEN d.doc_id % 10 = 9 THEN 'untrusted' WHEN l.doc_id IS NOT NULL THEN 'merged' WHEN d.doc_id % 10 = 1 THEN 'absent' ELSE 'uncovered' END AS outcome,
        count(*) AS n, count(CASE WHEN d.doc_id % 10 <> 9 THEN l.quality END) AS n_known
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def merge_outcomes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    out = reconcile.merge(d, labels, "doc_id", ["quality"], d.where("doc_id % 10 = 1"), d.where("doc_id % 10 = 9"))
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.count("quality").alias("n_known"))


@query("""
    WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice) - 1 AS k,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, round(avg(l_extendedprice), 3) AS mean FROM r WHERE k >= floor(0.3 * n) AND k < greatest(1, ceil(0.85 * n)) GROUP BY 1""")
def trimmed_band_mean(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.trimmed_band_mean(li, ["l_suppkey"], ["l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice", 0.3, 0.85, "mean", 3)


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5, count(*) AS n_turns FROM conversations GROUP BY 1")
def ordered_concat(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.groupBy("conv_id").agg(F.md5(stats.ordered_concat("text", ["turn"])).alias("text_md5"), F.count("*").alias("n_turns"))


@query("""
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)
    SELECT user_id, (rn // 5)::INT AS grp, round(max(value), 6) AS top FROM r GROUP BY 1, 2 HAVING count(*) = 5""")
def positional_group(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    placed = joins.positional_groups(e, ["user_id"], ["ts", "event_id"], 5)
    return placed.groupBy("user_id", "grp").agg(F.round(F.max("value"), 6).alias("top"))


@query("""
    WITH s AS (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS segment FROM conversations)
    SELECT conv_id, segment, min(CASE WHEN role = 'assistant' THEN turn END) AS answer FROM s WHERE segment > 0 GROUP BY 1, 2""")
def segment_scan(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    c = c.withColumn("at", F.col("turn"))
    return joins.segment_scan(c, ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") == "assistant", "at", "answer")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return dedupe.keep_last(e, "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    newest = e.agg(F.max("ts").alias("newest")).scalar()
    return e.where(F.col("ts") > newest - F.expr("interval '7' day")).select("event_id", "user_id")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def format_histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "documents"), "lang", "source")


@query("""
    SELECT count(l.doc_id)::DOUBLE / count(*) AS labelled, count(*) FILTER (lang = 'en')::DOUBLE / count(*) AS english
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def coverage_gate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    flagged = joins.membership(d, read(spark, sf_dir, "labels"), "doc_id", "has")
    return flagged.agg(stats.coverage(F.col("has")).alias("labelled"), stats.coverage(F.col("lang") == "en").alias("english"))


@query("""
    SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 8 AND 30 THEN 'middle' WHEN p_size BETWEEN 25 AND 45 THEN 'large' END AS kind FROM part""")
def range_class(spark, sf_dir):
    ranges = [("small", 1, 10), ("middle", 8, 30), ("large", 25, 45)]
    return read(spark, sf_dir, "part").select("p_partkey", project.ordered_ranges(F.col("p_size"), ranges).alias("kind"))


@query("""
    SELECT o_orderkey, o_orderstatus = 'P' OR bool_or(l_returnflag = 'R') AS special
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def any_element_flag(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    wide = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return wide.select("o_orderkey", ((F.col("o_orderstatus") == "P") | project.any_element(F.col("flags"), lambda x: x == "R")).alias("special"))


@query("SELECT p_partkey, unnest(range(1, p_size + 1))::INT AS n FROM part")
def expand_sequence(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(F.sequence(F.lit(1), "p_size")).alias("n"))


@query("""
    SELECT page_id, sha256(coalesce(array_to_string(list_transform(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
        lambda p: regexp_matches(p, '^[^=]+=.+$'))), lambda p: concat(p, chr(10))), ''), '')) AS etag FROM pages""".replace("\\\\", "\\"))
def etag_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.canonical_query(F.col("url")).alias("etag"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_stable(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""
    SELECT label, round(min(embedding[1]::DOUBLE), 6) AS min_x, round(min(embedding[2]::DOUBLE), 6) AS min_y,
        round(max(embedding[1]::DOUBLE), 6) AS max_x, round(max(embedding[2]::DOUBLE), 6) AS max_y FROM embeddings GROUP BY 1""")
def bbox_union(spark, sf_dir):
    return stats.bounding_box(read(spark, sf_dir, "embeddings"), ["label"], F.col("embedding")[0], F.col("embedding")[1])


@query("""
    SELECT p_partkey, CASE WHEN p_size <= 25 AND p_retailprice <= 1400 THEN NULL WHEN p_size <= 25 THEN 'a' WHEN p_retailprice <= 1400 THEN 'b' END AS kind FROM part""")
def exactly_one_table(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return joins.exactly_one(p.select("p_partkey"), p.where("p_size <= 25"), p.where("p_retailprice <= 1400"), "p_partkey", "kind")


@query("""
    SELECT id, name FROM (SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN upper(p_name) END AS name FROM part) WHERE name IS NOT NULL""")
def name_projection(spark, sf_dir):
    return project.name_table(read(spark, sf_dir, "part"), "p_partkey", lambda df: F.when(df["p_size"] % 3 != 0, F.upper(df["p_name"])))


@query("""
    SELECT o_orderkey, floor(o_totalprice / 1000 - 200 + 0.5)::BIGINT AS half_up, round(o_totalprice / 1000 - 200) + 0.0 AS half_away, trunc(o_totalprice / 1000 - 200)::BIGINT AS cut FROM orders""")
def three_roundings(spark, sf_dir):
    x = F.col("o_totalprice") / 1000 - 200
    return read(spark, sf_dir, "orders").select("o_orderkey", T.round_half_up(x).alias("half_up"), (T.round_half_away(x) + F.lit(0.0)).alias("half_away"), x.cast("long").alias("cut"))


@query(r"""
    SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[\\/]+', '/', 'g')) AS path FROM pages""")
def path_normalised(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normalize_path(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("path"))


@query("""
    SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey)) AS nations, count(*) AS n FROM customer GROUP BY 1""")
def distinct_set_per_key(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).alias("nations"), F.count("*").alias("n"))


@query("""
    SELECT id FROM (SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier)
    WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def todo_minus_done(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    done = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return c.union(s).distinct().join(done, "id", "left_anti")


@query("""
    SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names FROM part WHERE p_brand IS NOT NULL AND p_name IS NOT NULL GROUP BY 1""")
def names_per_id(spark, sf_dir):
    return joins.names_of(read(spark, sf_dir, "part"), "p_brand", "p_name", "names")


@query("""
    SELECT c.c_custkey, coalesce(s.s_name, p.s_name, '_' || coalesce(o.real_id, c.c_custkey)) AS name FROM customer c
    LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
    LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS real_id FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
    LEFT JOIN supplier p ON p.s_suppkey = coalesce(o.real_id, c.c_custkey)""")
def named_or_real(spark, sf_dir):
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    real = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("real_id"))
    return joins.named_or_real(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", names, real, "name")


@query("SELECT p_brand, p_type, max(p_size) AS top FROM part GROUP BY 1, 2")
def highest_index(spark, sf_dir):
    return stats.highest(read(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size", "top")


@query("""
    SELECT user_id, event_type, n, fallback FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fallback, n DESC, pos) AS rn FROM (
            SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos, event_type <> 'purchase' AS fallback FROM events
            WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE NOT fallback OR event_type <> 'click') WHERE rn = 1""")
def named_or_largest(spark, sf_dir):
    return stats.named_or_largest(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "purchase", "click")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'eco[a-z]+y$|^small', 'i')")
def matching_names(spark, sf_dir):
    return project.matching(read(spark, sf_dir, "part"), "p_type", "(?:eco[a-z]+y$|^small)").select("p_partkey")


@query("""
    SELECT l_orderkey, count(*) > 0 AND bool_and(round(l_discount * 100) = 0) AS nothing FROM lineitem GROUP BY 1""")
def draws_nothing(spark, sf_dir):
    layers = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.round(F.col("l_discount") * 100)).alias("alphas"))
    return layers.select("l_orderkey", project.draws_nothing(F.col("alphas")).alias("nothing"))


@query("""
    SELECT p_partkey, [p_brand, p_type] || CASE WHEN p_size > 25 THEN [p_name] ELSE [] END AS names FROM part""")
def flat_distinct(spark, sf_dir):
    more = F.when(F.col("p_size") > 25, F.array("p_brand", "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", project.distinct_elements(F.array(F.array("p_brand", "p_type"), more)).alias("names"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey)::INT AS place FROM part")
def code_unit_order(spark, sf_dir):
    over = Window.partitionBy("p_brand").orderBy(project.code_unit_key(F.col("p_name")), "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.row_number().over(over).alias("place"))
