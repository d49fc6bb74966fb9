"""Queries over the other tables and over small fixed rows that reach every branch of a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.functions import text as textual
from glyphmill.operators import clustering, docx, joins, layout, measures, pages, recipes, verdicts
from glyphmill.plans.registry import inline, query, values
from glyphmill.sources.tables import html_blocks, table, transcript


def _micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY ALL""")
def gap_islands_events(spark: SparkSession, d: str) -> DataFrame:
    rows = clustering.gap_islands(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], _micros("ts"), 3_600_000_000)
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH p AS (SELECT user_id, ts, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE max(event_id) END AS set_by FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, p.set_by AS as_of_set_by FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_state(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    last = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("m"))
    right = last.select("user_id", "ts", F.expr("if(m % 3 = 0, null, m)").alias("set_by"))
    return joins.as_of(events.drop("event_type"), right, ["user_id"], "ts", "set_by", "event_id").drop("ts")


WIDTHS = [(1, 0, 49, 500), (2, 40, 120, 610), (3, 200, 200, 250), (4, 150, 320, 333), (5, 300, 400, 720), (6, 90, 95, 1)]


@query(f"""WITH r AS (SELECT * FROM (VALUES {values(WIDTHS)}) t(ord, first, last, width)),
k AS (SELECT DISTINCT l_suppkey % 7 AS font, l_partkey % 500 AS cid FROM lineitem), f AS (SELECT font, cid, arg_min(width, ord) + font AS width FROM k LEFT JOIN r ON cid BETWEEN first + font AND last + font GROUP BY font, cid)
SELECT l_orderkey, l_linenumber, CAST(coalesce(width, 1000) AS INTEGER) AS width FROM lineitem JOIN f ON f.cid = l_partkey % 500 AND f.font = l_suppkey % 7""")
def range_width_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 7).alias("font"))
    fonts = rows.select("font").distinct().crossJoin(F.broadcast(inline(spark, "ord, first, last, width", WIDTHS)))  # six rows a font
    ranges = fonts.select("font", "ord", (F.col("first") + F.col("font")).alias("first"), (F.col("last") + F.col("font")).alias("last"), (F.col("width") + F.col("font")).cast("int").alias("width"))
    return joins.range_lookup(rows, ranges, ["font"], F.col("l_partkey") % 500, 1000).select("l_orderkey", "l_linenumber", "width")


CELLS = [(r, c, c * 1000.0, r * 10.0, c * 1000.0 + 1000.0, r * 10.0 + 10.0) for r in range(5) for c in range(12)]


@query(f"""WITH c AS (SELECT * FROM (VALUES {values(CELLS)}) t(r, c, cx0, cy0, cx1, cy1)),
b AS (SELECT row_number() OVER () AS rid, l_orderkey % 40 AS page, l_orderkey * 10 + l_linenumber AS box_id, l_partkey % 9000 AS x0, l_partkey % 9000 + l_suppkey % 50 AS x1, l_quantity AS y0, l_quantity + 1 AS y1 FROM lineitem),
m AS (SELECT rid, page, box_id, count(r) AS n, min(r) AS r, min(c) AS c FROM b LEFT JOIN c ON page % 10 <> 0 AND x0 > cx0 + page + 0.5 AND x1 < cx1 + page - 0.5 AND y0 > cy0 + 0.5 AND y1 < cy1 - 0.5 GROUP BY rid, page, box_id)
SELECT page, box_id, CASE WHEN n = 1 THEN r END AS row, CASE WHEN n = 1 THEN c END AS col FROM m""")
def grid_containment(spark: SparkSession, d: str) -> DataFrame:
    page = (F.col("l_orderkey") % 40).alias("page")
    boxes = table(spark, d, "lineitem").select(page, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_partkey") % 9000).alias("x0"), (F.col("l_partkey") % 9000 + F.col("l_suppkey") % 50).alias("x1"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 1).alias("y1"))
    pages_with_grids = boxes.select("page").distinct().where("page % 10 <> 0").crossJoin(F.broadcast(inline(spark, "row, col, cx0, cy0, cx1, cy1", CELLS)))  # sixty rows a page
    cells = pages_with_grids.select("page", "row", "col", (F.col("cx0") + F.col("page")).alias("cx0"), "cy0", (F.col("cx1") + F.col("page")).alias("cx1"), "cy1")
    return joins.containment(boxes, cells, ["page"], 0.5)


@query("""WITH b AS (SELECT l_orderkey % 500 AS page_id, (l_partkey % 97) * 8.0 - 50 AS x0, (l_suppkey % 89) * 8.0 - 50 AS y0, l_quantity * 6 AS w, l_linenumber * 20.0 AS h FROM lineitem),
p AS (SELECT DISTINCT page_id, CASE WHEN page_id % 50 = 0 THEN 0 ELSE 640 END AS pw, 480 AS ph FROM b),
k AS (SELECT page_id, greatest(x0, 0) AS ax, greatest(y0, 0) AS ay, least(x0 + w, pw) AS bx, least(y0 + h, ph) AS by_, pw, ph FROM b JOIN p USING (page_id) WHERE pw > 0),
v AS (SELECT page_id, least(79, floor(ax / pw * 80)) AS c0, least(80, ceil(bx / pw * 80)) AS c1, least(79, floor(ay / ph * 80)) AS r0, least(80, ceil(by_ / ph * 80)) AS r1 FROM k WHERE bx > ax AND by_ > ay),
u AS (SELECT DISTINCT page_id, c, unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT))) AS r FROM (SELECT page_id, r0, r1, unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT))) AS c FROM v)),
n AS (SELECT page_id, count(*) AS covered FROM u GROUP BY page_id)
SELECT p.page_id, coalesce(covered, 0) AS covered, coalesce(covered, 0) / 6400 AS coverage FROM p LEFT JOIN n USING (page_id)""")
def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("l_orderkey") % 500
    lines = table(spark, d, "lineitem")
    boxes = lines.select(page.alias("page_id"), ((F.col("l_partkey") % 97) * 8.0 - 50).alias("x0"), ((F.col("l_suppkey") % 89) * 8.0 - 50).alias("y0"), "l_quantity", "l_linenumber")
    boxes = boxes.select("page_id", "x0", "y0", (F.col("x0") + F.col("l_quantity") * 6).alias("x1"), (F.col("y0") + F.col("l_linenumber") * 20.0).alias("y1"))
    crop = lines.select(page.alias("page_id")).distinct().select("page_id", F.lit(0).alias("px0"), F.lit(0).alias("py0"), F.expr("if(page_id % 50 = 0, 0, 640)").alias("px1"), F.lit(480).alias("py1"))
    return measures.coverage(boxes, crop)


@query("""WITH g AS (SELECT l_orderkey AS page_id, count(*) FILTER (l_returnflag = 'A') AS visible, count(*) FILTER (l_returnflag = 'R') AS invisible, sum(l_quantity) / 250 AS coverage, max(l_partkey) AS paths FROM lineitem GROUP BY 1)
SELECT page_id, CASE WHEN visible > 0 THEN CASE WHEN coverage >= 0.5 AND invisible >= 3 * visible THEN 'mixed_degraded' ELSE 'editable' END
  WHEN coverage >= 0.5 THEN CASE WHEN invisible > 0 THEN 'ocr_scan' ELSE 'scan_no_text' END WHEN paths >= 200 THEN 'vector_outlined' ELSE 'empty' END AS bucket FROM g""")
def page_bucket(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("visible"), F.count_if(F.col("l_returnflag") == "R").alias("invisible"), (F.sum("l_quantity") / 250).alias("coverage"), F.max("l_partkey").alias("paths"))
    return seen.select("page_id", measures.page_bucket(F.col("visible"), F.col("invisible"), F.col("coverage"), F.col("paths")).alias("bucket"))


@query("""SELECT l_partkey, l_shipdate, count(DISTINCT l_orderkey) AS sharers FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1""")
def shared_operator(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.countDistinct("l_orderkey").alias("sharers")).where("sharers > 1")


#: Objects are parts: most refer to the one of half their number, some back up, some to themselves.
EDGES_SQL = "SELECT p_partkey AS parent, CASE p_partkey % 10 WHEN 0 THEN p_partkey WHEN 9 THEN p_partkey * 2 ELSE (p_partkey - p_partkey % 2) / 2 END AS child FROM part"


@query(f"""WITH RECURSIVE e AS (SELECT parent, CAST(child AS BIGINT) AS child FROM ({EDGES_SQL})), r(page, obj) AS (SELECT s_suppkey % 50, CAST(s_suppkey * 3 AS BIGINT) FROM supplier UNION SELECT page, child FROM r JOIN e ON parent = obj)
SELECT obj AS object, count(DISTINCT page) AS n_pages FROM r GROUP BY obj HAVING count(DISTINCT page) > 1""")
def shared_object_census(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "part").selectExpr("p_partkey AS parent", EDGES_SQL.partition("parent, ")[2].partition(" AS child")[0] + " AS child").select("parent", F.col("child").cast("long").alias("child"))
    return joins.shared_objects(edges, table(spark, d, "supplier").selectExpr("s_suppkey % 50 AS page", "s_suppkey * 3 AS object"))


#: Fonts of all kinds: each order line's numbers choose a subtype, what is embedded, its encoding, cmap and descendant.
FONTS_SQL = {
    "subtype": "CASE l_partkey % 7 WHEN 0 THEN '/Type0' WHEN 1 THEN '/Type0' WHEN 2 THEN '/Type3' WHEN 3 THEN '/TrueType' WHEN 4 THEN '/Type1' WHEN 5 THEN '/MMType1' ELSE '/Odd' END",
    "symbolic": "l_suppkey % 2 = 0", "embedded": "l_linenumber % 3 <> 0", "has_encoding": "l_quantity % 4 = 1", "has_charproc": "l_partkey % 3 = 0", "standard_14": "l_suppkey % 5 < 2",
    "cmap": "CASE l_orderkey % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'none' WHEN 2 THEN 'only_31' ELSE 'ok' END",
    "n_codespace": "CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END",
    "descendant": "CASE l_suppkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '/Other' WHEN 2 THEN '/CIDFontType0' ELSE '/CIDFontType2' END",
    "gid_map_ok": "l_quantity % 3 <> 0", "gid_map_reason": "CASE WHEN l_quantity % 3 = 0 THEN 'bad map' END",
}


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{e} AS {n}" for n, e in FONTS_SQL.items())} FROM lineitem),
k AS (SELECT *, subtype IN ('/Type1', '/MMType1') AS t1, subtype = '/TrueType' AS tt, subtype = '/Type0' AS t0 FROM f),
v AS (SELECT *, CASE WHEN t0 AND descendant IS NULL THEN 'NODESC' WHEN t0 AND n_codespace IS NULL THEN 'C-1' WHEN t0 AND n_codespace <> 1 THEN 'C-6' WHEN t0 AND NOT embedded THEN 'NOEMB'
  WHEN t0 AND descendant = '/CIDFontType0' THEN 'C-3b' WHEN t0 AND descendant = '/CIDFontType2' THEN 'C-3a' WHEN t0 THEN 'C-3' WHEN subtype = '/Type3' THEN 'T3-a' WHEN NOT (t1 OR tt) THEN 'UNKNOWN'
  WHEN tt AND NOT symbolic THEN 'TT-a' WHEN symbolic AND NOT embedded THEN 'NOEMB' WHEN tt AND has_encoding THEN 'TT-c' WHEN tt THEN CASE cmap WHEN 'unreadable' THEN 'TT-f' WHEN 'none' THEN 'TT-e' WHEN 'only_31' THEN 'TT-d' ELSE 'TT-b' END
  WHEN NOT embedded THEN CASE WHEN standard_14 THEN 'T1-c' ELSE 'T1-d' END WHEN symbolic AND has_encoding THEN 'T1-b' ELSE 'T1-a' END AS branch_id FROM k)
SELECT l_orderkey, l_linenumber, branch_id, CASE branch_id WHEN 'C-3a' THEN gid_map_ok WHEN 'T3-a' THEN has_charproc ELSE branch_id IN ('C-3b', 'TT-a', 'TT-b', 'T1-a', 'T1-b', 'T1-c', 'T1-d') END AS editable FROM v""")
def font_verdict_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in FONTS_SQL.items()])
    return rows.select("l_orderkey", "l_linenumber", verdicts.font().alias("v")).select("l_orderkey", "l_linenumber", "v.branch_id", "v.editable")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN l_suppkey % 5 + 2 END AS shared, CASE l_partkey % 7 WHEN 0 THEN 'T3-a' ELSE 'T1-a' END AS branch, l_partkey % 5 <> 0 AS editable,
  l_partkey % 3 = 0 AS substitution, l_suppkey % 11 = 0 AS rtl, CASE WHEN l_suppkey % 4 = 0 THEN 'NOUNI' END AS bad FROM lineitem),
v AS (SELECT *, CASE WHEN shared IS NOT NULL THEN 'shared Form XObject, referenced by ' || shared || ' pages' WHEN branch = 'T3-a' THEN 'Type3' WHEN NOT editable THEN 'TrueType with no cmap table' WHEN rtl THEN 'right-to-left text' ELSE bad END AS reason FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN reason IS NOT NULL THEN 'not_editable' WHEN substitution THEN 'editable_substitution' ELSE 'editable_original' END AS state, reason FROM v""")
def run_verdict(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    v = verdicts.run(F.when(p % 13 == 0, s % 5 + 2), F.when(p % 7 == 0, "T3-a").otherwise("T1-a"), p % 5 != 0, F.lit("TrueType with no cmap table"), p % 3 == 0, s % 11 == 0,
        verdicts.glyph(F.lit(True), F.lit(None).cast("string"), F.when(s % 4 != 0, "x").otherwise("")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v.state", "v.reason")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS original, l_quantity + l_partkey % 40 - 10 AS shaped, 3.0 AS space, l_suppkey % 6 AS gaps FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN shaped - original <= 0 OR abs(shaped - original) <= space THEN 'trailing_kern' WHEN gaps > 0 AND abs(shaped - original) <= gaps * space * 0.5 THEN 'inter_word_kern'
  WHEN original * 100 >= shaped * 90 THEN 'tz' ELSE 'refused' END AS strategy FROM r""")
def fit_ladder(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", verdicts.fit(q, q + F.col("l_partkey") % 40 - 10, F.lit(3.0), F.col("l_suppkey") % 6).alias("strategy"))


AUDIT_SQL = "CASE WHEN o_orderkey % 19 = 0 THEN 'unreadable' WHEN o_custkey % 9 = 0 THEN 'no_text' WHEN o_custkey % 8 = 0 THEN 'no_candidates' WHEN o_orderstatus = 'F' THEN 'refused' WHEN o_orderkey % 7 = 0 THEN 'apply_failed' WHEN o_custkey % 6 = 0 THEN 'unverifiable' WHEN o_custkey % 5 = 0 THEN 'wrong_text' WHEN o_custkey % 4 = 0 THEN 'pixels_changed' ELSE 'ok' END"


@query(f"SELECT status, count(*) AS n FROM (SELECT {AUDIT_SQL} AS status FROM orders) GROUP BY status")
def audit_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey % 19 <> 0 AS opened", "o_custkey % 9 AS n_runs", "o_custkey % 8 AS n_candidates", "o_orderstatus <> 'F' AS planned_ok", "o_orderkey % 7 <> 0 AS applied", "if(o_custkey % 6 = 0, null, o_custkey % 5 <> 0) AS text_ok", "o_custkey % 4 <> 0 AS pixels_ok")
    return rows.groupBy(verdicts.audit_status().alias("status")).agg(F.count("*").alias("n"))


ESCAPED_SQL = r"regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|>~\-])', '\\\1', 'g')"


@query(f"""SELECT conv_id, string_agg('**' || coalesce(role, '') || ':** ' || {ESCAPED_SQL} || chr(10), chr(10) ORDER BY turn, role, text) AS body FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def export_transcript_md(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("**"), F.coalesce("role", F.lit("")), F.lit(":** "), layout.markdown_escape(F.col("text")), F.lit("\n"))
    return layout.joined(transcript(table(spark, d, "conversations")), ["conv_id"], ["turn", "role", "text"], part, "\n")


#: Turns as blocks of two spans, the first word and the rest; list items get a marker; some turns are tables of two rows of two cells.
TURNS_SQL = """SELECT conv_id, page, ord, kind, level, bold, italic, s1, substr(text, length(s1) + 1) AS s2, text,
  [[coalesce(w[1], ''), coalesce(w[2], '')], [coalesce(w[3], '') || chr(10) || coalesce(w[4], ''), array_to_string(w[5:], '|')]] AS grid
FROM (SELECT *, string_split(text, ' ') AS w, string_split(text, ' ')[1] AS s1 FROM (
  SELECT conv_id, CAST(turn // 3 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn, role, text) AS INTEGER) AS ord,
    CASE WHEN turn % 7 = 5 THEN 'table' WHEN turn % 4 = 0 THEN 'heading' WHEN role = 'user' THEN 'list' ELSE 'paragraph' END AS kind, CAST(turn % 8 AS INTEGER) AS level,
    turn % 2 = 1 AS bold, turn % 3 = 2 AS italic, CASE WHEN turn % 7 <> 5 AND turn % 4 <> 0 AND role = 'user' THEN '12.  ' ELSE '' END || text AS text FROM conversations WHERE text IS NOT NULL))"""


def _turn_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = transcript(table(spark, d, "conversations")).withColumn("page", F.floor(F.col("turn") / 3).cast("int"))
    kind = F.when(F.col("turn") % 7 == 5, "table").when(F.col("turn") % 4 == 0, "heading").when(F.col("role") == "user", "list").otherwise("paragraph")
    ord_ = F.row_number().over(W.partitionBy("conv_id", "page").orderBy("turn", "role", "text"))
    rows = rows.withColumn("kind", kind).withColumn("ord", ord_).withColumn("text", F.concat(F.when(F.col("kind") == "list", "12.  ").otherwise(""), "text")).withColumn("w", F.split("text", " ", -1))

    def span(text: F.Column, bold: F.Column | None = None, italic: F.Column | None = None) -> F.Column:
        no = F.lit(False)
        return F.struct(text.alias("text"), (no if bold is None else bold).alias("bold"), (no if italic is None else italic).alias("italic"))

    w = [F.coalesce(F.get("w", F.lit(i)), F.lit("")) for i in range(4)]
    cells = [[w[0], w[1]], [F.concat(w[2], F.lit("\n"), w[3]), F.array_join(F.slice("w", 5, F.size("w")), "|")]]
    grid = F.array(*[F.array(*[F.array(span(c)) for c in r]) for r in cells])
    first = F.get("w", F.lit(0))
    spans = F.array(span(first, bold=F.col("turn") % 2 == 1), span(F.col("text").substr(F.length(first) + 1, F.length("text")), italic=F.col("turn") % 3 == 2))
    return rows.select("conv_id", "page", "ord", "kind", (F.col("turn") % 8).cast("int").alias("level"), "text", spans.alias("spans"), F.when(F.col("kind") == "table", grid).alias("rows"))


def _md(x: str) -> str:
    return ESCAPED_SQL.replace("replace(text,", f"replace({x},")


_MD_CELLS = f"list_transform(grid, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace({_md('c')}, chr(10), '<br>')), ' | ') || ' |' || chr(10))"
_MD_SPANS = f"CASE WHEN kind = 'list' THEN '' WHEN bold THEN '**' || {_md('s1')} || '**' ELSE {_md('s1')} END || CASE WHEN italic THEN '*' || {_md('z')} || '*' ELSE {_md('z')} END"
_HTML = "replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>')"
_HTML_SPANS = f"CASE WHEN kind = 'list' THEN '' WHEN bold THEN '<strong>' || {_HTML.format('s1')} || '</strong>' ELSE {_HTML.format('s1')} END || CASE WHEN italic THEN '<em>' || {_HTML.format('z')} || '</em>' ELSE {_HTML.format('z')} END"
#: z: the second span, without what is left of a list marker.
_BODIES = f"b AS (SELECT *, CASE WHEN kind = 'list' THEN regexp_replace(s2, '^\\s+', '') ELSE s2 END AS z FROM ({TURNS_SQL}))"


@query(f"""WITH b AS ({TURNS_SQL}), t AS (SELECT conv_id, page, ord, CASE WHEN kind = 'table' THEN array_to_string(list_transform(grid, lambda r: array_to_string(r, chr(9)) || chr(10)), '') ELSE text || chr(10) END AS t FROM b),
p AS (SELECT conv_id, page, string_agg(t, '' ORDER BY ord) AS t FROM t GROUP BY ALL) SELECT conv_id, string_agg(t, chr(12) || chr(10) ORDER BY page) AS body FROM p GROUP BY conv_id""")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_document(_turn_blocks(spark, d), "conv_id")


@query(f"""WITH {_BODIES}, m AS (SELECT conv_id, page, ord, CASE kind WHEN 'table' THEN {_MD_CELLS}[1] || '| --- | --- |' || chr(10) || {_MD_CELLS}[2] || chr(10)
  ELSE CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' WHEN 'list' THEN '- ' ELSE '' END || {_MD_SPANS} || chr(10) || chr(10) END AS t FROM b),
p AS (SELECT conv_id, page, string_agg(t, '' ORDER BY ord) AS t FROM m GROUP BY ALL) SELECT conv_id, string_agg(t, chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS body FROM p GROUP BY conv_id""")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return layout.markdown_document(_turn_blocks(spark, d), "conv_id")


EXPORT_HTML_SQL = f"""WITH {_BODIES}, e AS (SELECT *, kind = 'list' AND coalesce(lag(kind) OVER w <> 'list', true) AS o, kind = 'list' AND coalesce(lead(kind) OVER w <> 'list', true) AS c,
  CASE kind WHEN 'heading' THEN 'h' || least(6, greatest(1, level)) WHEN 'list' THEN 'li' ELSE 'p' END AS tag FROM b WINDOW w AS (PARTITION BY conv_id, page ORDER BY ord)),
t AS (SELECT conv_id, page, ord, CASE WHEN kind = 'table' THEN '<table><tbody>' || chr(10) || array_to_string(list_transform(grid, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<td>' || {_HTML.format('c')} || '</td>'), '') || '</tr>' || chr(10)), '') || '</tbody></table>' || chr(10)
  ELSE CASE WHEN o THEN '<ul>' || chr(10) ELSE '' END || '<' || tag || '>' || {_HTML_SPANS} || '</' || tag || '>' || chr(10) || CASE WHEN c THEN '</ul>' || chr(10) ELSE '' END END AS t FROM e),
p AS (SELECT conv_id, page, '<section>' || chr(10) || string_agg(t, '' ORDER BY ord) || '</section>' || chr(10) AS t FROM t GROUP BY ALL)
SELECT conv_id, '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Document export</title></head><body>' || chr(10) || string_agg(t, '' ORDER BY page) || '</body></html>' || chr(10) AS body FROM p GROUP BY conv_id"""


@query(EXPORT_HTML_SQL)
def export_html(spark: SparkSession, d: str) -> DataFrame:
    return layout.html_document(_turn_blocks(spark, d), "conv_id")


@query(f"SELECT h.conv_id, h.body, coalesce(t.has_text, false) AS has_text FROM ({EXPORT_HTML_SQL}) h LEFT JOIN (SELECT conv_id, bool_or(trim(CASE WHEN kind = 'table' THEN array_to_string(flatten(grid), '') ELSE text END) <> '') AS has_text FROM ({TURNS_SQL}) GROUP BY 1) t USING (conv_id)")
def export_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return layout.export(_turn_blocks(spark, d), "conv_id", "html")


@query(r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, unnest(range(0, len(k))) AS ord, unnest(k) AS kind, unnest(t) AS text FROM (SELECT page_id, regexp_extract_all(h, '(?is)<(title|h[1-6]|li|p)\b[^>]*>([^<]*)', 1) AS k, regexp_extract_all(h, '(?is)<(title|h[1-6]|li|p)\b[^>]*>([^<]*)', 2) AS t FROM c))
SELECT page_id, CAST(ord AS INTEGER) AS ord, lower(kind) AS kind, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM b WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def html_block_scan(spark: SparkSession, d: str) -> DataFrame:
    return html_blocks(table(spark, d, "pages"))


@query("""WITH m AS (SELECT c_name AS filename, sha256(c_mktsegment) AS sha, c_custkey AS k FROM customer), f AS (SELECT filename, CASE WHEN k % 10 = 0 THEN sha256('other') ELSE sha END AS sha FROM m WHERE k % 7 <> 0)
SELECT m.filename, CASE WHEN f.sha IS NULL THEN 'missing' WHEN f.sha <> m.sha THEN 'sha_mismatch' ELSE 'ok' END AS status FROM m LEFT JOIN f USING (filename)""")
def manifest_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_name").alias("filename"), F.sha2(F.col("c_mktsegment").cast("binary"), 256).alias("sha"), F.col("c_custkey").alias("k"))
    files = rows.where("k % 7 <> 0").select("filename", F.expr("if(k % 10 = 0, sha2('other', 256), sha)").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha"), "sha_mismatch").otherwise("ok")
    return rows.join(files, "filename", "left").select("filename", status.alias("status"))


@query("""WITH a AS (SELECT c_nationkey AS n, list(DISTINCT c_mktsegment) AS declared FROM customer GROUP BY 1), b AS (SELECT c_nationkey AS n, list(DISTINCT c_mktsegment) AS detected FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT CAST(n AS INTEGER) AS nation, list_sort(list_filter(declared, lambda x: NOT list_contains(coalesce(detected, []), x))) AS undetected FROM a LEFT JOIN b USING (n)""")
def category_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("declared"), F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("detected"))
    return rows.select("nation", F.array_sort(F.array_except("declared", "detected")).alias("undetected"))


@query("""WITH f AS (SELECT event_type AS code, CAST(user_id % 40 AS BIGINT) AS page, CASE WHEN event_type = 'view' AND event_id % 100 = 0 THEN NULL ELSE event_id % 5 END AS n FROM events)
SELECT code, list_sort(list(DISTINCT page)) AS pages, CAST(CASE WHEN count(*) = count(n) THEN sum(n) END AS BIGINT) AS total FROM f GROUP BY code""")
def fact_merge(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").selectExpr("event_type AS code", "user_id % 40 AS page", "if(event_type = 'view' AND event_id % 100 = 0, null, event_id % 5) AS n")
    return measures.merge_facts(facts)


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY user_id""")
def page_summary(spark: SparkSession, d: str) -> DataFrame:
    def n(kind: str) -> F.Column:
        return F.count_if(F.col("event_type") == kind)

    return table(spark, d, "events").groupBy("user_id").agg(n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), F.count("*").alias("n"))


SPECS_SQL = "SELECT p_partkey AS id, p_partkey % 5 + 1 || '-' || (p_partkey % 5 + p_size % 4 + 1) || CASE WHEN p_partkey % 3 = 0 THEN ', ' || (p_size % 6 + 3) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '; ' || (p_size % 9 + 1) ELSE '' END AS spec FROM part"


@query(f"""WITH s AS ({SPECS_SQL}), g AS (SELECT id, unnest(range(0, len(string_split(spec, ';')))) AS grp, unnest(string_split(spec, ';')) AS part FROM s),
p AS (SELECT id, grp, unnest(range(0, len(string_split(part, ',')))) AS k, unnest(string_split(part, ',')) AS x FROM g),
e AS (SELECT id, grp, k, CAST(trim(string_split(trim(x), '-')[1]) AS INTEGER) AS a, CAST(trim(string_split(trim(x), '-')[-1]) AS INTEGER) AS b FROM p),
o AS (SELECT id, grp, row_number() OVER (PARTITION BY id, grp ORDER BY k, page) - 1 AS place, page FROM (SELECT id, grp, k, unnest(range(a - 1, b)) AS page FROM e)),
i AS (SELECT id, bool_and(coalesce(page > was, true)) AS increasing FROM (SELECT id, page, lag(page) OVER (PARTITION BY id ORDER BY grp, place) AS was FROM o) GROUP BY id)
SELECT id, CAST(grp AS INTEGER) AS grp, CAST(place AS INTEGER) AS place, CAST(page AS INTEGER) AS page, increasing FROM o JOIN i USING (id)""")
def page_split_groups(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "part").selectExpr("p_partkey AS id", SPECS_SQL.partition("AS id, ")[2].partition(" FROM")[0])
    rows = specs.withColumn("groups", pages.page_groups(F.col("spec"))).withColumn("increasing", pages.increasing(F.col("groups")))
    return rows.select("id", "increasing", F.posexplode("groups").alias("grp", "pages")).select("id", "grp", F.posexplode("pages").alias("place", "page"), "increasing")


PAGES_SQL = "SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page, o_orderkey FROM orders"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select(F.col("o_custkey").alias("doc"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("page"), "o_orderkey")


@query(f"""WITH p AS ({PAGES_SQL}), m AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, doc % 4 AS s, doc % 6 AS t FROM p),
k AS (SELECT *, CASE WHEN s < n AND t < n AND page = s THEN CASE WHEN t > s THEN t + 0.5 ELSE t - 0.5 END ELSE page END AS place FROM m)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY place, page) - 1 AS INTEGER) AS page, o_orderkey FROM k""")
def page_move(spark: SparkSession, d: str) -> DataFrame:
    return pages.move(_sequences(spark, d), ["doc"], F.col("doc") % 4, F.col("doc") % 6)


@query(f"""WITH p AS ({PAGES_SQL}), m AS (SELECT *, bool_and(o_orderkey % 3 = 0) OVER (PARTITION BY doc) AS all_gone FROM p)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS INTEGER) AS page, o_orderkey FROM m WHERE all_gone OR o_orderkey % 3 <> 0""")
def page_delete(spark: SparkSession, d: str) -> DataFrame:
    return pages.delete(_sequences(spark, d), ["doc"], F.col("o_orderkey") % 3 == 0)


@query(f"""WITH p AS ({PAGES_SQL}), u AS (SELECT doc, CAST(page AS DOUBLE) AS page, o_orderkey FROM p UNION ALL SELECT DISTINCT doc, 1.5, NULL FROM p)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS INTEGER) AS page, o_orderkey FROM u""")
def page_insert(spark: SparkSession, d: str) -> DataFrame:
    return pages.insert_blank(_sequences(spark, d), ["doc"], 2)


@query(f"""WITH p AS ({PAGES_SQL}) SELECT doc, page // 4 AS grp, page % 4 AS place, (page * 90 + 90 * (doc % 5 - 2)) % 360 + CASE WHEN (page * 90 + 90 * (doc % 5 - 2)) % 360 < 0 THEN 360 ELSE 0 END AS rotation FROM p""")
def page_chunks_rotated(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.every_n(_sequences(spark, d), 4)
    return rows.select("doc", "grp", "place", pages.rotate(F.col("page") * 90, F.col("doc") % 5 - 2).alias("rotation"))


@query("""WITH a AS (SELECT c_nationkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS page, c_name AS name FROM customer),
b AS (SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS page, s_name AS name FROM supplier)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY k, page) - 1 AS INTEGER) AS page, name FROM (SELECT doc, page, name, CASE WHEN page < 10 THEN 0 ELSE 2 END AS k FROM a UNION ALL SELECT doc, page, name, 1 FROM b)""")
def page_merge(spark: SparkSession, d: str) -> DataFrame:
    def sequence(name: str, p: str) -> DataFrame:
        page = F.row_number().over(W.partitionBy(f"{p}_nationkey").orderBy(f"{p}_{name[:4]}key")) - 1
        return table(spark, d, name).select(F.col(f"{p}_nationkey").alias("doc"), page.alias("page"), F.col(f"{p}_name").alias("name"))

    return pages.merge(sequence("customer", "c"), sequence("supplier", "s"), ["doc"], 10)


@query("SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def history_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    return pages.latest(rows, ["user_id"])


@query("""WITH h AS (SELECT user_id, event_id AS version, event_id % 50 + 1 AS bytes FROM events), r AS (SELECT *, row_number() OVER w AS k, sum(bytes) OVER w AS s FROM h WINDOW w AS (PARTITION BY user_id ORDER BY version DESC ROWS UNBOUNDED PRECEDING))
SELECT user_id, version, k = 1 OR (k <= 5 AND s <= 100) AS kept FROM r""")
def history_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), (F.col("event_id") % 50 + 1).alias("bytes"))
    return pages.admitted(rows, ["user_id"], 5, 100).select("user_id", "version", "kept")


@query("""WITH o AS (SELECT o_custkey AS source, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n, 'r' || o_orderkey AS run_id, o_orderkey % 3 AS part, o_orderstatus AS old, o_orderpriority AS new FROM orders),
a AS (SELECT source, n AS pos, run_id, old AS new_text FROM o WHERE part <> 2), b AS (SELECT source, n AS pos, run_id, new AS new_text FROM o WHERE part <> 0),
f AS (SELECT source, run_id, new_text, row_number() OVER (PARTITION BY source ORDER BY pos) + coalesce((SELECT max(pos) FROM a WHERE a.source = b.source), -1) AS pos FROM b WHERE (source, run_id) NOT IN (SELECT source, run_id FROM a))
SELECT source, pos, run_id, coalesce(b.new_text, a.new_text) AS new_text FROM a LEFT JOIN (SELECT source, run_id, new_text FROM b) b USING (source, run_id) UNION ALL SELECT source, CAST(pos AS INTEGER), run_id, new_text FROM f""")
def recipe_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), n.alias("pos"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("run_id"), (F.col("o_orderkey") % 3).alias("part"), "o_orderstatus", "o_orderpriority")
    old = rows.where("part <> 2").select("source", "pos", "run_id", F.col("o_orderstatus").alias("new_text"))
    return recipes.upsert(old, rows.where("part <> 0").select("source", "pos", "run_id", F.col("o_orderpriority").alias("new_text")))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS run_id, CASE WHEN p_partkey % 11 = 0 THEN -1 WHEN p_partkey > 8 THEN p_partkey // 2 END AS needs FROM part), gone(run_id) AS (
  SELECT run_id FROM c WHERE needs = -1 UNION SELECT c.run_id FROM c JOIN gone ON c.needs = gone.run_id) SELECT run_id FROM c WHERE run_id NOT IN (SELECT run_id FROM gone)""")
def preview_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS run_id", "CASE WHEN p_partkey % 11 = 0 THEN -1 WHEN p_partkey > 8 THEN p_partkey div 2 END AS needs")

    def resolve(left: DataFrame) -> DataFrame:
        known = left.select(F.col("run_id").alias("needs"), F.lit(True).alias("there"))
        return left.join(known, "needs", "left").select("run_id", (F.col("needs").isNull() | F.col("there").isNotNull()).alias("ok"))

    return recipes.preview(rows, resolve).select("run_id")


@query("""SELECT p_partkey, chr(65 + ('0x' || substr(md5(p_name), 1, 2))::INTEGER % 26) || chr(65 + ('0x' || substr(md5(p_name), 3, 2))::INTEGER % 26) || chr(65 + ('0x' || substr(md5(p_name), 5, 2))::INTEGER % 26)
  || chr(65 + ('0x' || substr(md5(p_name), 7, 2))::INTEGER % 26) || chr(65 + ('0x' || substr(md5(p_name), 9, 2))::INTEGER % 26) || chr(65 + ('0x' || substr(md5(p_name), 11, 2))::INTEGER % 26) AS tag FROM part""")
def subset_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", textual.subset_tag(F.col("p_name")).alias("tag"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/ABCDEF+' ELSE '/' END || p_brand AS f FROM part) SELECT p_partkey, regexp_replace(regexp_replace(f, '^/+', ''), '^[A-Z]{6}\\+(.)', '\\1') AS base FROM n""")
def base_font_name(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 0, "/ABCDEF+").otherwise("/"), "p_brand")
    return table(spark, d, "part").select("p_partkey", textual.base_font_name(raw).alias("base"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN event_id % 256 END AS num, CASE WHEN event_id % 7 <> 0 THEN event_type END AS name FROM events),
g AS (SELECT *, max(CASE WHEN num IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, since ORDER BY event_id) AS r FROM g)
SELECT user_id, event_id, name, CAST(CASE WHEN since IS NULL THEN r - 1 ELSE since % 256 + r - 2 END AS BIGINT) AS code FROM k WHERE name IS NOT NULL""")
def differences_counter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("user_id", "event_id", "if(event_id % 7 = 0, event_id % 256, null) AS num", "if(event_id % 7 <> 0, event_type, null) AS name")
    return textual.differences(rows, ["user_id"], "event_id").select("user_id", "event_id", "name", "code")


@query("""WITH i AS (SELECT DISTINCT user_id, event_id % 211 AS cid FROM events), g AS (SELECT user_id, cid, cid - row_number() OVER (PARTITION BY user_id ORDER BY cid) AS k FROM i)
SELECT user_id, min(cid) AS first, max(cid) AS last, count(*) AS n FROM g GROUP BY user_id, k""")
def width_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 211).alias("cid")).distinct()
    grouped = rows.withColumn("k", F.col("cid") - F.row_number().over(W.partitionBy("user_id").orderBy("cid")))
    return grouped.groupBy("user_id", "k").agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.count("*").alias("n")).drop("k")


@query("""SELECT event_type, CAST((r - 1) // 100 AS BIGINT) AS chunk, count(*) AS n, min(event_id) AS first FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY ALL""")
def bfchar_chunks(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    return table(spark, d, "events").select("event_type", "event_id", F.floor((rank - 1) / 100).alias("chunk")).groupBy("event_type", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT nation, first_segment, segments FROM (SELECT c_nationkey AS nation, arg_min(c_mktsegment, c_custkey) AS first_segment, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY 1)""")
def reverse_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min_by("c_mktsegment", "c_custkey").alias("first_segment"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.0 AS x, CAST(l_partkey % 700 AS DOUBLE) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x, 6) AS "left", round(800 - (y + 2.4), 6) AS bottom, round(x + 36, 6) AS "right", round(800 - (y - 9.6), 6) AS top FROM b""")
def run_box(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), (F.col("l_partkey") % 700).cast("double")
    ctm = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 800.0)])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pages.run_box(x, y, x + 36, F.lit(12.0), ctm).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"b.{c}", 6).alias(c) for c in ("left", "bottom", "right", "top")])


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 41 - 20 AS dx, l_suppkey % 31 - 15 AS dy FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE round_even(degrees(atan2(dy, dx)), 0) END AS INTEGER) AS angle FROM v""")
def angle_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clustering.angle_bucket(F.col("l_partkey") % 41 - 20, F.col("l_suppkey") % 31 - 15).alias("angle"))


@query("""WITH i AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 30 + 1 AS DOUBLE) AS h FROM part), s AS (SELECT *, least(200 / w, 100 / h) AS k FROM i)
SELECT p_partkey, round((200 - w * k) / 2, 6) + 0.0::DOUBLE AS x, round((100 - h * k) / 2, 6) + 0.0::DOUBLE AS y, round(w * k, 6) AS width, round(h * k, 6) AS height FROM s""")
def image_fit(spark: SparkSession, d: str) -> DataFrame:
    box = pages.fit_image(F.col("p_size").cast("double"), F.col("p_partkey") % 30 + F.lit(1.0), F.lit(200.0), F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", *[(F.round(f"b.{c}", 6) + F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")])


@query("""SELECT e.event_id, e.event_type, lead(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS witness FROM events e""")
def following_witness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("witness"))


@query("""WITH p AS (SELECT user_id, event_id, event_id % 90 + 11 AS n FROM events), o AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM p)
SELECT user_id, event_id, held > 300 AND held > n AS evicted FROM o""")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 90 + 11).alias("n"))
    held = F.sum("n").over(W.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("held", held).select("user_id", "event_id", ((F.col("held") > 300) & (F.col("held") > F.col("n"))).alias("evicted"))


@query("""WITH a AS (SELECT c_custkey AS row_id, c_nationkey AS k, c_acctbal AS x FROM customer), b AS (SELECT s_suppkey AS other_id, s_nationkey AS k, s_acctbal AS x FROM supplier),
m AS (SELECT a.row_id, count(other_id) AS n, min(other_id) AS o FROM a LEFT JOIN b ON a.k = b.k AND abs(a.x - b.x) < 300 GROUP BY a.row_id)
SELECT row_id, CASE WHEN n = 1 THEN o END AS other_id FROM m""")
def relocate_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    others = table(spark, d, "supplier").select(F.col("s_suppkey").alias("other_id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"))
    return joins.unique_match(rows, others, ["k"], "x", 300).select("row_id", "other_id")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS len FROM lineitem), o AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
SELECT l_orderkey, l_linenumber AS part, CAST(off AS BIGINT) AS part_start, CAST(off + len // 2 AS BIGINT) AS probe, CAST(len // 2 AS BIGINT) AS local FROM o""")
def part_locate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), (F.col("l_partkey") % 60).alias("len"))
    before = W.partitionBy("l_orderkey").orderBy("part", "len").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.withColumn("part_start", F.coalesce(F.sum(F.col("len") + 1).over(before), F.lit(0)))
    probes = parts.select("l_orderkey", (F.col("part_start") + F.floor(F.col("len") / 2)).alias("part_start"), "part")
    found = joins.as_of(probes, parts.select("l_orderkey", "part_start", F.struct("part", "part_start").alias("home")), ["l_orderkey"], "part_start", "home", "part")
    return found.select("l_orderkey", "as_of_home.part", "as_of_home.part_start", F.col("part_start").alias("probe"), (F.col("part_start") - F.col("as_of_home.part_start")).alias("local"))


@query(f"""WITH b AS ({TURNS_SQL}) SELECT conv_id, count(DISTINCT page) AS page_count, bool_or(trim(text) <> '') AS has_text, count(*) FILTER (kind = 'table') AS tables FROM b GROUP BY conv_id""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return docx.facts(_turn_blocks(spark, d), "conv_id")


@query()
def export_docx(spark: SparkSession, d: str) -> DataFrame:
    return docx.documents(_turn_blocks(spark, d), "conv_id").select("conv_id", F.length("content").alias("n_bytes"), "crc", "reason")
