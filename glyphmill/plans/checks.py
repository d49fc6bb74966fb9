"""Queries over lookups, reconciliations and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import checks
from glyphmill.plans.registry import inline, query, values
from glyphmill.sources.tables import runs, table

CHARS = [(c, "n" + c) for c in "abcdefghijklmnopqrstuvwxyz .,éèöü"]
PRESENT = [("n" + c,) for c in "abcdefghijklmnoprstuvwxyz .,é"]


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS text FROM documents), n AS (SELECT * FROM (VALUES {values(CHARS)}) t(ch, name)), p AS (SELECT * FROM (VALUES {values(PRESENT)}) t(name)),
c AS (SELECT doc_id, unnest(range(0, length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM t WHERE text <> ''),
s AS (SELECT doc_id, pos, CASE WHEN n.name IS NULL THEN 'no name: ' || c.ch WHEN p.name IS NULL THEN 'character_has_no_glyph_in_bundled_font: ' || c.ch END AS said FROM c LEFT JOIN n USING (ch) LEFT JOIN p ON p.name = n.name),
m AS (SELECT doc_id, arg_min(said, pos) AS reason FROM s WHERE said IS NOT NULL GROUP BY doc_id)
SELECT t.doc_id, reason FROM t LEFT JOIN m USING (doc_id)""")
def glyph_coverage(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return checks.coverage_refusal(texts, "doc_id", inline(spark, "ch, name", CHARS), inline(spark, "name", PRESENT))


FAMILIES = [("Brand#1", "Sans", "Regular"), ("Brand#2", "Sans", "Bold"), ("Brand#3", "Serif", "Regular")]


@query(f"""WITH f AS (SELECT * FROM (VALUES {values(FAMILIES)}) t(base_font, family, variant)), r AS (SELECT p_partkey, p_brand[1:7] AS base_font FROM part)
SELECT p_partkey, base_font, family, variant, CASE WHEN family IS NULL THEN 'no mapping table entry for BaseFont ' || base_font END AS reason FROM r LEFT JOIN f USING (base_font)""")
def font_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.left("p_brand", F.lit(7)).alias("base_font"))
    return checks.family(rows, inline(spark, "base_font, family, variant", FAMILIES)).select("p_partkey", "base_font", "family", "variant", "reason")


@query("""WITH b AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 13 <> 0)
SELECT k, CASE WHEN a.k IS NULL THEN 'gone' WHEN b.k IS NULL THEN 'new' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'kept' ELSE 'changed' END AS change FROM b FULL JOIN a USING (k)""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return checks.snapshot_changes(rows.where("k % 11 <> 0"), rows.where("k % 13 <> 0").withColumn("s", F.expr("if(k % 7 = 0, null, s)")), ["k"], "s")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag <> 'R' AS ok FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT l_orderkey, count(*) AS n, bool_and(ok) AS ok FROM r GROUP BY 1)
SELECT o_orderkey, coalesce(n = 1 AND ok, false) AS ok FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def pair_verification(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") != "R").alias("ok"))
    return checks.verified(table(spark, d, "orders"), results, "o_orderkey")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, bool_and(a.f IS NOT NULL AND b.f IS NOT NULL) AS same FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.f = b.f GROUP BY 1""")
def covered_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return checks.same_sets(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"), ["l_orderkey"], "l_returnflag")


@query("SELECT s_suppkey, 'Field' || s_suppkey AS name, s_suppkey % 3 = 0 AND s_suppkey <= 60 AS clashes FROM supplier")
def field_collisions(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Field"), F.col("s_suppkey").cast("string")).alias("name"))
    return checks.collisions(new.where("s_suppkey % 3 = 0 AND s_suppkey <= 60"), new, "name").select("s_suppkey", "name", "clashes")


@query("""WITH u AS (SELECT l_orderkey, l_quantity AS y, l_linenumber AS n, 'block' AS kind FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, l_quantity, l_linenumber, 'image' FROM lineitem WHERE l_linenumber > 3)
SELECT l_orderkey, n, kind, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, kind, n) - 1 AS INTEGER) AS place FROM u""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), F.col("l_linenumber").alias("n"))
    return checks.interleaved(rows.where("n <= 3"), rows.where("n > 3"), ["l_orderkey"])


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey % 50 AS ty FROM orders), b AS (SELECT l_orderkey AS k, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem)
SELECT t.k, coalesce(min(n) FILTER (y > ty), count(n)) AS position FROM t LEFT JOIN b USING (k) GROUP BY t.k""")
def table_position(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey", "l_suppkey")) - 1
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("y"), n.cast("long").alias("n"))
    return checks.insert_position(blocks, table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("y")), ["k"])


@query("""WITH r AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS id, unnest(string_split(text, chr(10))) AS text FROM documents), x AS (SELECT doc_id, id, text, id * 50 AS x0, id * 50 + length(text) % 60 AS x1, length(text) % 4 + 8 AS size FROM r)
SELECT doc_id, CAST(id AS INTEGER) AS run_id, coalesce((x0 - lag(x1) OVER w) > least(size, lag(size) OVER w) * 0.15 AND NOT regexp_matches(lag(text) OVER w, '[ \\n]$') AND NOT regexp_matches(text, '^[ \\n]'), false) AS space FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY x0, id)""")
def span_spaces(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    rows = runs(table(spark, d, "documents")).select("doc_id", F.col("run_order").alias("run_id"), "text", (F.col("run_order") * 50).alias("x0"), (F.col("run_order") * 50 + n % 60).alias("x1"), (n % 4 + 8).alias("size"))
    return checks.spaced(rows, ["doc_id"]).select("doc_id", "run_id", "space")


#: Boxes, turns and units: some boxes are empty, some turns no quarters, some units zero.
BOXES_SQL = "SELECT p_partkey AS id, p_partkey % 7 * 1.0 AS a, p_partkey % 5 * 1.0 AS b, p_size * 1.0 AS c, p_size + 2.5 AS d, CAST((p_partkey % 13 - 4) * 45 AS INTEGER) AS rot, p_partkey % 4 * 0.5 AS unit FROM part"


@query(f"""WITH b AS ({BOXES_SQL}), k AS (SELECT *, (rot % 360 + 360) % 360 AS r, rot % 90 = 0 AND unit > 0 AND c > a AND d > b AS ok FROM b)
SELECT id, CASE WHEN ok THEN (CASE WHEN r % 180 = 90 THEN d - b ELSE c - a END)::DOUBLE * unit::DOUBLE END AS width, CASE WHEN ok THEN (CASE WHEN r % 180 = 90 THEN c - a ELSE d - b END)::DOUBLE * unit::DOUBLE END AS height, CAST(CASE WHEN ok THEN r END AS INTEGER) AS rotation FROM k""")
def page_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*BOXES_SQL.removeprefix("SELECT ").removesuffix(" FROM part").split(", "))
    box = F.array(*[F.col(c).cast("double") for c in "abcd"])
    out = rows.select("id", checks.page_geometry(box, F.col("rot"), F.col("unit").cast("double")).alias("g"))
    return out.select("id", "g.width", "g.height", "g.rotation")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> o_custkey % 5 AND o_custkey % 4 = 0 THEN 'stale' WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'signature_would_break' WHEN o_totalprice > 100000 THEN 'history_full' END AS reason FROM orders""")
def transaction_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 5 AS expected", "if(o_custkey % 4 = 0, o_custkey % 5, o_orderkey % 5) AS version", "o_orderstatus = 'F' AS signed", "o_custkey % 2 <> 0 AS confirmed", "o_totalprice AS bytes", "100000 AS free")
    return rows.select("o_orderkey", checks.transaction_gate().alias("reason"))


@query("""WITH c AS (SELECT event_type AS name, count(*) AS counted FROM events GROUP BY 1), r AS (SELECT event_type AS name, count(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS claimed FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT name, coalesce(claimed, 0) AS claimed, coalesce(counted, 0) AS counted, coalesce(claimed, 0) = coalesce(counted, 0) AS agrees FROM r FULL JOIN c USING (name)""")
def report_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "events").select(F.col("event_type").alias("name"))
    claimed = results.where("name <> 'view'").groupBy("name").agg((F.count("*") + F.max(F.expr("if(name = 'click', 1, 0)"))).alias("claimed"))
    return checks.reconciled(claimed, results)
