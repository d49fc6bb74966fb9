"""Queries over the editing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.operators import editing, layout
from glyphmill.plans.registry import query
from glyphmill.sources.tables import runs, table


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), t AS (SELECT doc_id, a, list_filter([doc_id % 5, doc_id % 5 + 2, doc_id % 5 + 3], lambda i: i < len(a)) AS hit FROM w)
SELECT doc_id, array_to_string(CASE WHEN len(hit) = 0 THEN a ELSE list_concat(list_concat(list_slice(a, 1, hit[1]), ['NEW']), list_filter(list_slice(a, hit[1] + 1, len(a)), lambda x, i: NOT list_contains(hit, i - 1 + hit[1]))) END, ' ') AS text FROM t""")
def splice_instructions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("a"))
    hit = F.filter(F.array(*[(F.col("doc_id") % 5 + k).cast("int") for k in (0, 2, 3)]), lambda i: i < F.size("a"))
    return rows.select("doc_id", F.array_join(editing.splice(F.col("a"), hit, F.array(F.lit("NEW"))), " ").alias("text"))


PAGES_SQL = "SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderkey % 3 = 0 AS gone FROM orders"


@query(f"""WITH p AS ({PAGES_SQL}), l AS (SELECT doc, page AS target FROM p)
SELECT doc, CAST(target AS INTEGER) AS target, CAST(coalesce((SELECT min(page) FROM p WHERE p.doc = l.doc AND NOT gone AND page >= target), (SELECT max(page) FROM p WHERE p.doc = l.doc AND NOT gone AND page <= target)) AS INTEGER) AS redirected FROM l""")
def deletion_redirect(spark: SparkSession, d: str) -> DataFrame:
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), (F.col("o_orderkey") % 3 == 0).alias("gone"))
    return editing.redirect(pages, pages.select("doc", F.col("page").alias("target")), ["doc"]).select("doc", "target", "redirected")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity + (l_partkey % 3 - 1) * 0.5 END AS b, l_quantity AS oe, l_quantity + l_suppkey % 3 - 1 AS ne FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false ELSE abs(a - b) <= 1e-6 END THEN 'replacement_anchor_shifted' WHEN ne > oe + 1e-6 THEN 'replacement_exceeds_visible_extent' END AS reason FROM r""")
def replacement_geometry(spark: SparkSession, d: str) -> DataFrame:
    q, p, s = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    old, new = F.when(p % 9 != 0, q), F.when(s % 9 != 0, q + (p % 3 - 1) * 0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", editing.geometry_refusal(old, new, q, q + s % 3 - 1).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity - (l_partkey % 200) / 1000.0 * 12 - (l_suppkey % 50) / 1000.0 * 12, 9) AS advance FROM lineitem""")
def kerned_advance(spark: SparkSession, d: str) -> DataFrame:
    kerns = F.array((F.col("l_partkey") % 200).cast("double"), (F.col("l_suppkey") % 50).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(editing.advance_with_kerns(F.col("l_quantity"), kerns, F.lit(12.0)), 9).alias("advance"))


SHARED = {3: 2, 7: 5, 11: 43}


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, [l_partkey % 13, l_suppkey % 13, l_linenumber] AS path FROM lineitem), f AS (SELECT *, list_filter(path, lambda x: x IN (3, 7, 11)) AS hit FROM p)
SELECT l_orderkey, l_linenumber, CAST(hit[1] AS BIGINT) AS object, CAST(CASE hit[1] WHEN 3 THEN 2 WHEN 7 THEN 5 WHEN 11 THEN 43 END AS INTEGER) AS n_pages FROM f""")
def shared_in_path(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(v).cast("bigint") if i % 2 == 0 else F.lit(v) for pair in SHARED.items() for i, v in enumerate(pair)])
    path = F.array((F.col("l_partkey") % 13).cast("bigint"), (F.col("l_suppkey") % 13).cast("bigint"), F.col("l_linenumber").cast("bigint"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", editing.first_shared(path, known).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s.object", "s.n_pages")


@query("""WITH r AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
c AS (SELECT doc_id, line, unnest(range(0, length(text))) AS ord, unnest(string_split(text, '')) AS ch FROM r WHERE text <> ''),
g AS (SELECT *, ord * 110 AS x FROM c), l AS (SELECT *, lead(ch) OVER w AS n1, lead(ch, 2) OVER w AS n2, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM g WINDOW w AS (PARTITION BY doc_id, line ORDER BY ord)),
b AS (SELECT doc_id, CASE WHEN ch = ' ' THEN NULL WHEN n1 = ' ' AND n2 <> ' ' THEN 'boundary' WHEN n1 <> ' ' THEN 'intra' END AS label, CASE WHEN n1 = ' ' THEN x2 ELSE x1 END - x - 100 AS gap FROM l)
SELECT doc_id, label, count(*) AS n, CAST(sum(gap) AS BIGINT) AS gaps FROM b WHERE label IS NOT NULL GROUP BY ALL""")
def gap_labels(spark: SparkSession, d: str) -> DataFrame:
    chars = runs(table(spark, d, "documents")).select("doc_id", F.col("run_order").alias("line"), F.posexplode(F.split("text", "")).alias("ord", "ch")).where("ch <> ''")
    placed = chars.withColumn("x", F.col("ord") * 110).withColumn("advance", F.lit(100))
    return editing.gap_labels(placed, ["doc_id", "line"]).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"))


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents), y AS (SELECT doc_id, line, line * 30 + length(text) % 40 AS y, length(text) % 11 = 0 AS heading FROM l),
s AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR heading OR lag(heading) OVER w OR y - lag(y) OVER w > 36 THEN 1 ELSE 0 END AS new FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY y, line))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY y, line) AS BIGINT) AS band FROM s""")
def vertical_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents")).select("doc_id", F.col("run_order").alias("line_id"), F.expr("run_order * 30 + length(text) % 40").alias("y"), F.expr("length(text) % 11 = 0").alias("heading"))
    return layout.vertical_bands(rows, ["doc_id"], 12.0).select("doc_id", F.col("line_id").alias("line"), "band")


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents), y AS (SELECT doc_id, list_sort(list(line * 7 + length(text) % 13)) AS v FROM l GROUP BY doc_id),
f AS (SELECT doc_id, v, list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 4 THEN list_concat(a, b) ELSE a END) AS firsts FROM y)
SELECT doc_id, CAST(len(firsts) AS INTEGER) AS n_bands, CAST(list_sum(firsts) AS DOUBLE) AS first_sum FROM f""")
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("run_order") * 7 + F.length("text") % 13
    grouped = runs(table(spark, d, "documents")).groupBy("doc_id").agg(layout.anchored(F.array_sort(F.collect_list(y)), 4).alias("firsts"))
    return grouped.select("doc_id", F.size("firsts").alias("n_bands"), F.aggregate("firsts", F.lit(0.0), lambda a, v: a + v).alias("first_sum"))


@query("""WITH r AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS run_order, unnest(string_split(text, chr(10))) AS text, lang FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(length(text), 80) DESC, run_order) AS k FROM r WHERE lang = 'en' AND length(regexp_replace(text, '\\s', '', 'g')) >= 2 AND NOT regexp_matches(text, '[\\x00-\\x1F\\x7F-\\x{9F}]'))
SELECT doc_id, CAST(run_order AS INTEGER) AS run_order FROM k WHERE k <= 3""")
def audit_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en'")
    fit = (F.length(F.regexp_replace("text", r"\s", "")) >= 2) & ~F.col("text").rlike(r"\p{Cc}")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.least(F.length("text"), F.lit(80)).desc(), "run_order"))
    return runs(docs).where(fit).withColumn("k", rank).where("k <= 3").select("doc_id", "run_order")


#: Nodes are parts below that of half their number; some are roots, and two hang below each other.
TREE_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 1 THEN NULL WHEN p_partkey = 6 THEN 7 WHEN p_partkey = 7 THEN 6 ELSE CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) END AS parent FROM part"


@query(f"""WITH RECURSIVE n AS ({TREE_SQL}), r(root, id) AS (SELECT id, id FROM n WHERE parent IS NULL UNION SELECT root, n.id FROM r JOIN n ON n.parent = r.id)
SELECT root, count(*) AS n FROM r GROUP BY root""")
def outline_count(spark: SparkSession, d: str) -> DataFrame:
    columns = TREE_SQL.removeprefix("SELECT ").removesuffix(" FROM part").split(", ")
    return editing.tree_counts(table(spark, d, "part").selectExpr(*columns))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part""")
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    facts = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, d, "part").select("p_partkey", F.sha2(facts.cast("binary"), 256).alias("digest"))


@query("""WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'forms' WHEN 'R' THEN 'scans' ELSE 'tables' END AS c FROM lineitem UNION SELECT l_orderkey, 'large' FROM lineitem WHERE l_quantity > 45)
SELECT l_orderkey, list_sort(list(DISTINCT c)) AS categories FROM s GROUP BY l_orderkey""")
def category_union(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "forms").when(F.col("l_returnflag") == "R", "scans").otherwise("tables")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(kind).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 45, "large")).alias("b"))
    return rows.select("l_orderkey", F.array_sort(F.array_union("a", "b")).alias("categories"))


@query("""WITH b AS (SELECT p_size AS font, p_partkey AS code, p_brand AS name FROM part WHERE p_partkey % 4 <> 0), c AS (SELECT p_size AS font, p_partkey AS code, p_type AS name FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT font, code, coalesce(c.name, b.name) AS name FROM b FULL JOIN c USING (font, code)) SELECT font, name, min(code) AS code FROM m GROUP BY ALL""")
def encoding_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_size").alias("font"), F.col("p_partkey").alias("code"), "p_brand", "p_type")
    base, changes = rows.where("code % 4 <> 0").select("font", "code", F.col("p_brand").alias("name")), rows.where("code % 3 = 0").select("font", "code", F.col("p_type").alias("changed"))
    merged = base.join(changes, ["font", "code"], "full").select("font", "code", F.coalesce("changed", "name").alias("name"))
    return merged.groupBy("font", "name").agg(F.min("code").alias("code"))  # the lowest code of a name wins on the way back


@query()
def text_state_replay(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("q", "Tc", "Tw", "Tz", "Q", "Tj"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    ops = table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("doc"), (F.col("l_orderkey") % 100).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), kind.alias("op"), F.col("l_quantity").alias("operand"))
    return editing.replay_text_state(ops)
