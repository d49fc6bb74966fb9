"""Queries over addressed runs and what is known of fonts, pages and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.functions import run_ids, text as textual
from glyphmill.operators import clustering, evidence, layout, measures, recipes, search
from glyphmill.plans.registry import query
from glyphmill.sources import pdf
from glyphmill.sources.tables import runs, table

#: Order lines as located glyphs on pages of 40 orders: in four directions, some of no length, on close baselines.
_GLYPHS = {
    "source_hash": "sha256('doc')", "page": "CAST(l_orderkey // 40 AS BIGINT)", "part": "CAST(l_partkey % 2 AS BIGINT)", "ord": "((l_orderkey % 40) * 10 + l_linenumber) * 10000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)", "op_offset": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "ch": "chr(97 + CAST(l_partkey % 26 AS INTEGER))", "x": "CAST(l_suppkey % 40 AS DOUBLE) * 2.5", "y": "CAST(l_partkey % 7 AS DOUBLE) * 1.25", "dir_x": "CAST([1, 0, -1, 0][1 + l_linenumber % 4] AS DOUBLE)", "dir_y": "CAST([0, 2, 0, 0][1 + l_linenumber % 4] AS DOUBLE)",
    "em": "CASE WHEN l_quantity = 7 THEN 13.0::DOUBLE ELSE 12.0::DOUBLE END", "font_id": "CASE WHEN l_quantity % 11 = 0 THEN 'B' ELSE 'A' END", "visible": "l_quantity % 13 <> 0", "fill_color": "CASE WHEN l_quantity % 17 = 0 THEN '1' ELSE '0' END", "rise": "CASE WHEN l_quantity % 19 = 0 THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END", "editable": "l_quantity % 9 <> 0",
}
_CLUSTER_SQL = f"""WITH g AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _GLYPHS.items())} FROM lineitem),
v AS (SELECT *, sqrt(dir_x * dir_x + dir_y * dir_y) AS norm FROM g),
u AS (SELECT *, CASE WHEN norm = 0 THEN 1.0 ELSE dir_x / norm END AS ux, CASE WHEN norm = 0 THEN 0.0 ELSE dir_y / norm END AS uy, CASE WHEN norm = 0 THEN 0 ELSE round_even(degrees(atan2(dir_y, dir_x)), 0) END AS angle FROM v),
p AS (SELECT *, x * ux + y * uy AS along, y * ux - x * uy AS perp, 2.5 AS wide FROM u),
b1 AS (SELECT *, CASE WHEN coalesce(abs(perp - lag(perp) OVER w) >= 0.2::DOUBLE * em, true) THEN 1 ELSE 0 END AS nb FROM p WINDOW w AS (PARTITION BY page, part, angle ORDER BY perp, ord)),
b2 AS (SELECT *, sum(nb) OVER (PARTITION BY page, part, angle ORDER BY perp, ord) AS band FROM b1),
r1 AS (SELECT *, coalesce((along - (lag(along) OVER w + lag(wide) OVER w)) / em, 0) AS gap, lag(ord) OVER w IS NULL OR font_id <> lag(font_id) OVER w OR visible <> lag(visible) OVER w OR fill_color <> lag(fill_color) OVER w
  OR abs(em - lag(em) OVER w) > 0.01::DOUBLE * lag(em) OVER w OR abs(rise - lag(rise) OVER w) >= 0.5::DOUBLE * em OR (along - (lag(along) OVER w + lag(wide) OVER w)) / em > 0.33::DOUBLE OR (along - (lag(along) OVER w + lag(wide) OVER w)) / em < -0.2::DOUBLE AS brk
  FROM b2 WINDOW w AS (PARTITION BY page, part, angle, band ORDER BY along, perp, ord)),
r2 AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page, part, angle, band ORDER BY along, perp, ord) AS run FROM r1),
f1 AS (SELECT *, row_number() OVER w - 1 AS place, first_value(op_offset) OVER w AS anchor, NOT editable OR coalesce(NOT lag(editable) OVER w, true) AS opens FROM r2 WINDOW w AS (PARTITION BY page, part, angle, band, run ORDER BY along, perp, ord)),
f2 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page, part, angle, band, run ORDER BY along, perp, ord) AS frag FROM f1),
a AS (SELECT source_hash, page, part, angle, band, run, frag, min(anchor) AS anchor, min(place) AS g0, max(place) + 1 AS g1, bool_and(editable) AS editable, count(*) AS n_glyphs,
  string_agg(CASE WHEN NOT opens AND gap > 0.1::DOUBLE AND gap <= 0.33::DOUBLE THEN ' ' ELSE '' END || ch, '' ORDER BY place) AS text FROM f2 GROUP BY ALL),
m AS (SELECT *, max(frag) OVER (PARTITION BY page, part, angle, band, run) > 1 AS several FROM a)
SELECT page, source_hash || ':p' || page || ':c' || part || '/x5:o' || anchor || CASE WHEN several THEN ':g' || g0 || '-' || g1 ELSE '' END AS run_id, text, n_glyphs, editable FROM m"""


@query(_CLUSTER_SQL)
def cluster_page(spark: SparkSession, d: str) -> DataFrame:
    def spark_sql(e: str) -> str:
        e = e.replace("sha256('doc')", "sha2('doc', 256)").replace(" // ", " div ").replace("::DOUBLE", "D")
        return e.replace("[1, 0, -1, 0][1 + l_linenumber % 4]", "array(1, 0, -1, 0)[l_linenumber % 4]").replace("[0, 2, 0, 0][1 + l_linenumber % 4]", "array(0, 2, 0, 0)[l_linenumber % 4]")

    glyphs = table(spark, d, "lineitem").selectExpr(*[f"{spark_sql(e)} AS {n}" for n, e in _GLYPHS.items()])
    unit = F.sqrt(F.col("dir_x") * F.col("dir_x") + F.col("dir_y") * F.col("dir_y"))
    glyphs = glyphs.withColumns({"adv_x": F.when(unit == 0, 2.5).otherwise(F.col("dir_x") / unit * 2.5), "adv_y": F.when(unit == 0, 0.0).otherwise(F.col("dir_y") / unit * 2.5), "xobj_path": F.array(F.lit(5))})
    return clustering.cluster_page(glyphs).select("page", "run_id", "text", "n_glyphs", "editable")


#: Runs of parts: each part's stream shows its name; the offset is the operator's, one more, that of the text, a negative token or one behind the end.
_PART = "'q BT /F1 9 Tf (' || p_name || ') Tj T* ET Q'"
_KIND = "CAST(p_partkey % 6 AS INTEGER)"


@query(f"""WITH s AS (SELECT p_partkey, {_PART} AS body, {_KIND} AS kind FROM part),
o AS (SELECT p_partkey, kind, CASE kind WHEN 0 THEN strpos(body, ') Tj') + 1 WHEN 1 THEN strpos(body, ') Tj') + 2 WHEN 2 THEN 0 WHEN 3 THEN length(body) WHEN 4 THEN 2 ELSE strpos(body, '/F1') END AS at FROM s)
SELECT p_partkey, kind IN (0, 2, 4) AS resolves FROM o""")
def run_id_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_PART} AS body", f"{_KIND} AS kind")
    show = F.instr("body", ") Tj")
    at = F.get(F.array(show + 1, show + 2, F.lit(0), F.length("body"), F.lit(2), F.instr("body", "/F1")), F.col("kind"))
    ids = run_ids.encode(F.sha2(F.encode("body", "ISO-8859-1"), 256), F.lit(0), F.lit(3), at)
    return rows.select("p_partkey", run_ids.resolves(ids, F.create_map(F.lit(3), F.encode("body", "ISO-8859-1"))).alias("resolves"))


_PRODUCER = "[p_type || ' ' || p_brand || ' 4.0 for Windows', 'The ' || upper(p_brand) || ' Version ' || p_size || '.1 (' || p_type || ')', p_size || '.5', 'by the ver 2'][1 + p_partkey % 4]"


@query(f"""WITH r AS (SELECT p_partkey, {_PRODUCER} AS raw FROM part), w AS (SELECT p_partkey, list_filter(string_split(lower(trim(regexp_replace(raw, '[^a-zA-Z]+', ' ', 'g'))), ' '), lambda x: x <> '' AND NOT list_contains(['for', 'version', 'ver', 'by', 'the', 'on'], x)) AS w FROM r)
SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'unknown' ELSE substr(array_to_string(w, ' '), 1, 60) END AS producer FROM w""")
def producer_name(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_PRODUCER.replace("[p_type", "array(p_type").replace("'by the ver 2'][1 + p_partkey % 4]", "'by the ver 2')[p_partkey % 4]"))
    return table(spark, d, "part").select("p_partkey", textual.producer(raw).alias("producer"))


_FONT = {
    "name": "CASE p_partkey % 5 WHEN 0 THEN 'Times-BoldItalic' WHEN 1 THEN 'Helvetica-Oblique' WHEN 2 THEN 'Courier' ELSE 'Some-Bold' END", "flags": "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 68 WHEN 2 THEN 262144 ELSE 32 END",
    "weight": "CASE p_partkey % 7 WHEN 0 THEN 700 WHEN 1 THEN 400 END", "angle": "CASE p_partkey % 11 WHEN 0 THEN -12 WHEN 1 THEN 0 END", "selection": "CASE p_partkey % 13 WHEN 0 THEN 33 WHEN 1 THEN 64 END",
}


@query(f"""WITH f AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _FONT.items())} FROM part)
SELECT p_partkey, coalesce(flags & 4 <> 0, false) AS symbolic,
  CASE WHEN selection IS NOT NULL THEN selection & 32 <> 0 WHEN weight IS NOT NULL THEN weight >= 700 WHEN flags & 262144 <> 0 THEN true WHEN name <> 'Some-Bold' THEN name = 'Times-BoldItalic' END AS bold,
  CASE WHEN selection IS NOT NULL THEN selection & 1 <> 0 WHEN angle IS NOT NULL THEN angle <> 0 WHEN flags IS NOT NULL THEN flags & 64 <> 0 WHEN name <> 'Some-Bold' THEN name <> 'Courier' END AS italic FROM f""")
def font_style(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in _FONT.items()])
    style = evidence.font_style(*(F.col(c) for c in _FONT))
    return rows.select("p_partkey", evidence.symbolic(F.col("flags")).alias("symbolic"), style.alias("s")).select("p_partkey", "symbolic", "s.bold", "s.italic")


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS visible, count(*) FILTER (l_returnflag = 'R') AS invisible FROM lineitem
WHERE l_partkey % 600 BETWEEN 10 AND 590 AND l_partkey * 7 % 800 BETWEEN 12 AND 780 GROUP BY 1""")
def crop_counts(spark: SparkSession, d: str) -> DataFrame:
    crop = F.array(*map(F.lit, (10, 12, 590, 780)))
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 600).alias("x"), (F.col("l_partkey") * 7 % 800).alias("y"), (F.col("l_returnflag") != "R").alias("visible"), crop.alias("crop"))
    return evidence.page_counts(rows, ["l_orderkey"])


@query("""WITH g AS (SELECT p_partkey, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, 100.0 + p_size AS mw, 150.0::DOUBLE AS mh, CAST(p_partkey % 30 AS DOUBLE) AS cx, CAST(p_partkey % 20 AS DOUBLE) AS cy, CAST(p_partkey % 120 AS DOUBLE) AS cw, 90.0::DOUBLE AS ch, p_partkey % 4 * 90 AS rot, CASE WHEN p_partkey % 9 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM part),
s AS (SELECT *, greatest(mx, cx) AS sx, greatest(my, cy) AS sy, least(mw, cw) - greatest(mx, cx) AS sw, least(mh, ch) - greatest(my, cy) AS sh FROM g),
b AS (SELECT *, CASE WHEN sw > 0 AND sh > 0 THEN sx ELSE mx END AS x, CASE WHEN sw > 0 AND sh > 0 THEN sy ELSE my END AS y, CASE WHEN sw > 0 AND sh > 0 THEN sw ELSE mw END AS w, CASE WHEN sw > 0 AND sh > 0 THEN sh ELSE mh END AS h FROM s),
v AS (SELECT *, CASE WHEN rot % 180 = 90 THEN h ELSE w END * unit AS vw, CASE WHEN rot % 180 = 90 THEN w ELSE h END * unit AS vh FROM b),
f AS (SELECT *, least(300 / vw, 200 / vh) AS fit FROM v), k AS (SELECT *, fit * unit AS s, (300 - fit * vw) / 2 AS tx, (200 - fit * vh) / 2 AS ty FROM f)
SELECT p_partkey, list_transform(CASE rot WHEN 0 THEN [s, 0, 0, s, tx - x * s, ty - y * s] WHEN 90 THEN [0, -s, s, 0, tx - y * s, ty + (x + w) * s] WHEN 180 THEN [-s, 0, 0, -s, tx + (x + w) * s, ty + (y + h) * s] ELSE [0, s, -s, 0, tx + (y + h) * s, ty - x * s] END, lambda e: round(e, 6) + 0.0::DOUBLE) AS matrix FROM k""")
def fit_transform(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    media = F.array(F.lit(0.0), F.lit(0.0), (100.0 + F.col("p_size")).cast("double"), F.lit(150.0))
    crop = F.array((p % 30).cast("double"), (p % 20).cast("double"), (p % 120).cast("double"), F.lit(90.0))
    m = evidence.fit_transform(evidence.visible_box(media, crop), p % 4 * 90, F.when(p % 9 == 0, 2.0).otherwise(1.0), F.lit(300.0), F.lit(200.0))
    return table(spark, d, "part").select("p_partkey", F.transform(m, lambda e: F.round(e, 6) + F.lit(0.0)).alias("matrix"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 700 AS DOUBLE) AS y, l_quantity / 2.0 AS em, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS sign FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor((x - 3) * 2) AS INTEGER) AS "left", CAST(floor((y + least(-0.2 * em * sign, 0.8 * em * sign) - 3) * 2) AS INTEGER) AS top, CAST(ceil((x + 7 + 3) * 2) AS INTEGER) AS "right", CAST(ceil((y + greatest(-0.2 * em * sign, 0.8 * em * sign) + 3) * 2) AS INTEGER) AS bottom FROM g""")
def pixel_mask(spark: SparkSession, d: str) -> DataFrame:
    glyph = F.struct((F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 700).cast("double").alias("y"), F.lit(7.0).alias("adv_x"), F.lit(0.0).alias("adv_y"))
    mask = evidence.pixel_mask(F.array(glyph), (F.col("l_quantity") / 2.0).cast("double"), F.array(F.lit(2.0), F.lit(0.0)), F.col("l_linenumber") % 2 == 0, 2.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mask.alias("m")).select("l_orderkey", "l_linenumber", "m.left", "m.top", "m.right", "m.bottom")


#: A PDF for each part: its name in a composite font whose codes only the ToUnicode map tells, its brand in a simple font with
#: differences (B is shown as euro signs), then a stroked box, which a clip keeps from being a ruling in every third.
_OBJECTS = [
    "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 300 400] >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 8 0 R >> >> >>", None,
    "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", "<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [288 288 250] >>",
    "<< /Length 90 >>\nstream\n1 beginbfrange <0120> <017E> <0020> endbfrange                                            \nendstream", "<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [300] /Encoding << /Differences [66 /Euro] >> >>",
]


@query("""SELECT p_partkey, p_name AS text, replace(p_brand, 'B', '€') AS brand, 20.0::DOUBLE + 5.0 * (length(p_name) - 1) - 2.5 * (length(p_name[:-2]) - length(replace(p_name[:-2], ' ', '')))::DOUBLE AS last_x, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END AS rulings FROM part""")
def pdf_text(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array_join(F.transform(F.split("p_name", ""), lambda c: F.lpad(F.hex(F.ascii(c) + 256), 4, "0")), "")
    clip = F.when(F.col("p_partkey") % 3 == 0, "0 0 9 9 re W n ").otherwise("")
    body = F.concat(F.lit("BT /F1 10 Tf 20 300 Td <"), codes, F.lit("> Tj /F2 8 Tf 0 -20 Td ("), F.col("p_brand"), F.lit(") Tj ET "), clip, F.lit("5 5 40 30 re S"))
    stream = F.concat(F.lit("<< /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream"))
    parts = [F.concat(F.lit(f"{n} 0 obj\n"), F.lit(o) if o else stream, F.lit("\nendobj\n")) for n, o in enumerate(_OBJECTS, 1)]
    content = F.encode(F.concat(F.lit("%PDF-1.7\n"), *parts, F.lit("trailer << /Root 1 0 R >>\n%%EOF")), "ISO-8859-1")
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("").alias("source_hash"), content.alias("content"))
    glyph = F.col("kind") == "glyph"

    def shown(y: float) -> F.Column:
        said = F.array_sort(F.collect_list(F.when(glyph & (F.col("y") == y), F.struct("ord", "ch"))))
        return F.array_join(F.transform(said, lambda g: g["ch"]), "")

    last = F.max_by(F.when(F.col("y") == 300, F.col("x")), F.when(F.col("y") == 300, F.col("ord")))
    files = files.repartition(spark.sparkContext.defaultParallelism, "path")  # parsing is what costs, and the rows come from one file
    out = pdf.scan(files).groupBy("path").agg(shown(300.0).alias("text"), shown(280.0).alias("brand"), last.alias("last_x"), F.count_if(F.col("kind") == "ruling").alias("rulings"))
    return out.select(F.col("path").cast("long").alias("p_partkey"), "text", "brand", "last_x", "rulings")


@query("""WITH r AS (SELECT doc_id AS source, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS text FROM documents),
b AS (SELECT source, n, CASE WHEN n % 5 = 2 THEN 'in the end ' || text ELSE text END AS before FROM r), k AS (SELECT *, n % 7 = 3 AS stale, n % 4 <> 1 AS replaceable FROM b WHERE regexp_matches(before, '[tT][hH][eE]'))
SELECT source, 'r' || n AS run_id, before, CASE WHEN NOT stale THEN regexp_replace(before, '[tT][hH][eE]', 'A', 'g') END AS after, CAST((length(before) - length(regexp_replace(before, '[tT][hH][eE]', '', 'g'))) / 3 AS INTEGER) AS n, CASE WHEN stale THEN 'stale' END AS reason FROM k WHERE replaceable""")
def recipe_build(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents")).withColumnRenamed("doc_id", "source").withColumn("run_id", F.concat(F.lit("r"), F.col("run_order")))
    prior = rows.where("run_order % 5 = 2").select("source", "run_id", F.concat(F.lit("in the end "), "text").alias("new_text"))
    current = rows.withColumn("text", F.when(F.col("run_order") % 5 == 2, F.concat(F.lit("in the end "), "text")).otherwise(F.col("text")))
    found = search.find_matches(current, "the")
    matches = found.select("source", "run_id", "start", "end", F.when(F.col("run_order") % 7 == 3, "gone").otherwise(F.col("match")).alias("match"), (F.col("run_order") % 4 != 1).alias("replaceable"))
    return recipes.build(rows.select("source", "run_id", "text"), matches, prior, "A")


@query("""WITH g AS (SELECT o_custkey AS doc, CAST(l_quantity AS BIGINT) AS score, CASE WHEN l_quantity > 30 AND o_custkey % 4 <> 0 THEN 1 WHEN l_linenumber = 5 AND o_custkey % 4 <> 0 THEN 1 ELSE 0 END AS positive FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT doc, max(positive) AS has FROM g GROUP BY doc), t AS (SELECT g.* FROM g JOIN a USING (doc) WHERE has = 1), k AS (SELECT unnest(range(0, 50, 5)) AS threshold),
c AS (SELECT threshold, sum(CASE WHEN score > threshold THEN positive ELSE 0 END) AS tp, sum(CASE WHEN score > threshold THEN 1 - positive ELSE 0 END) AS fp, sum(positive) AS p FROM k, t GROUP BY threshold),
b AS (SELECT threshold, round(2 * tp / (2 * tp + fp + p - tp), 9) AS f1 FROM c ORDER BY 2 * tp / (2 * tp + fp + p - tp) DESC, threshold LIMIT 1),
n AS (SELECT quantile_disc(score, 0.99) AS negative_p99, quantile_disc(score, 0.999) AS negative_p999 FROM t WHERE positive = 0), q AS (SELECT quantile_disc(score, 0.1) AS positive_p10, quantile_disc(score, 0.5) AS positive_p50, quantile_disc(score, 0.9) AS positive_p90 FROM t WHERE positive = 1)
SELECT b.*, n.*, q.*, (SELECT count(*) FROM t WHERE positive = 1) AS n_positive, (SELECT count(*) FROM t WHERE positive = 0) AS n_negative, (SELECT count(*) FROM a) AS n_documents, (SELECT CAST(sum(has) AS BIGINT) FROM a) AS n_telling FROM b, n, q""")
def threshold_tuning(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("score"), "l_linenumber")
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc")), "o_orderkey")
    gaps = joined.select("doc", "score", F.when((F.col("doc") % 4 != 0) & ((F.col("score") > 30) | (F.col("l_linenumber") == 5)), 1).otherwise(0).alias("positive"))
    out = measures.tuning(gaps, spark.range(0, 50, 5).withColumnRenamed("id", "threshold"), ["doc"])
    return out.select("threshold", F.round("f1", 9).alias("f1"), *[F.col(c).cast("long").alias(c) for c in ("negative_p99", "negative_p999", "positive_p10", "positive_p50", "positive_p90")], "n_positive", "n_negative", "n_documents", "n_telling")


@query("""SELECT CASE event_type WHEN 'view' THEN 'COLUMN_LAYOUT' WHEN 'click' THEN 'UNSUPPORTED_DIRECTION' WHEN 'purchase' THEN 'AMBIGUOUS_TABLE' END AS code, count(*) AS n FROM events GROUP BY 1""")
def layout_warnings(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "view", "columns-inferred-unruled-tables-unsupported").when(F.col("event_type") == "click", "unsupported-text-direction").when(F.col("event_type") == "purchase", "ambiguous-table-grid").otherwise("other")
    return table(spark, d, "events").groupBy(measures.warning_fact(said).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS em, CAST(l_suppkey * 3 AS DOUBLE) AS y, CAST(l_partkey AS DOUBLE) AS x, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS ord FROM lineitem),
s AS (SELECT *, CASE WHEN coalesce(abs(y - lag(y) OVER w) * 100 >= 20 * em, true) THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, x, ord))
SELECT l_orderkey, l_linenumber, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY y, x, ord) AS BIGINT) AS band FROM s""")
def baseline_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS em", "CAST(l_suppkey * 3 AS DOUBLE) AS y", "CAST(l_partkey AS DOUBLE) AS x", "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS ord")
    return clustering.bands(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "band")


@query("""WITH s AS (SELECT l_orderkey, CAST(l_partkey % 80 AS DOUBLE) AS a, CAST(l_partkey % 80 + l_quantity AS DOUBLE) AS b FROM lineitem),
e AS (SELECT *, greatest(10, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10)) AS reached FROM s),
h AS (SELECT l_orderkey, greatest(max(least(a, 60) - reached), 60 - greatest(10, max(b)), 0) AS hole FROM e GROUP BY 1)
SELECT l_orderkey, hole <= 5 AS covered FROM h""")
def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("l_partkey") % 80).cast("double")
    pieces = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(at.alias("a"), (at + F.col("l_quantity")).cast("double").alias("b")))).alias("p"))
    return pieces.select("l_orderkey", (layout.uncovered(F.col("p"), F.lit(10.0), F.lit(60.0)) <= 5).alias("covered"))


@query("""SELECT p_brand AS face, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY 1""")
def face_glyph_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("face")).agg(F.array_sort(F.collect_set("p_type")).alias("names"))


@query("""SELECT count(*) AS n, count(*) >= 100 AS enough FROM (SELECT sha256(text) FROM documents GROUP BY 1)""")
def corpus_floor(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).distinct()
    return files.agg(F.count("*").alias("n")).select("n", (F.col("n") >= 100).alias("enough"))


PAGES_SQL = "SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page, o_orderkey FROM orders"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), "o_orderkey")


@query(f"SELECT doc, page, o_orderkey FROM ({PAGES_SQL}) WHERE page < 5")
def page_sample(spark: SparkSession, d: str) -> DataFrame:
    return evidence.sampled(_pages(spark, d), 5)


@query(f"""WITH p AS ({PAGES_SQL}), g AS (SELECT DISTINCT doc, grp, place, CAST(CASE WHEN doc % 7 = 0 AND grp = 1 THEN 0 ELSE grp * 2 + place * (1 + doc % 2) END AS INTEGER) AS page FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(grp, place)),
k AS (SELECT g.*, p.o_orderkey, g.page > lag(g.page) OVER (PARTITION BY g.doc ORDER BY grp, place) AS rises FROM g LEFT JOIN p ON p.doc = g.doc AND p.page = g.page),
ok AS (SELECT doc FROM k GROUP BY doc HAVING bool_and(o_orderkey IS NOT NULL AND coalesce(rises, true)))
SELECT doc, CAST(grp AS INTEGER) AS grp, CAST(place AS INTEGER) AS page, o_orderkey FROM k WHERE doc IN (SELECT doc FROM ok)""")
def page_subset(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    places = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(p).alias("place")) for g in (0, 1) for p in (0, 1)])
    page = F.expr("CAST(IF(doc % 7 = 0 AND grp = 1, 0, grp * 2 + place * (1 + doc % 2)) AS INT)")
    groups = pages.select("doc").distinct().select("doc", F.explode(places).alias("g")).select("doc", "g.*").withColumn("page", page)
    return evidence.subset(pages, groups, ["doc"]).select("doc", "grp", "page", "o_orderkey")
