"""Queries over documents: runs, search, recipes, glyphs, layout, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import run_ids, unicode
from glyphmill.operators import clustering, joins, layout, measures, recipes, search
from glyphmill.plans.registry import query, values
from glyphmill.sources.tables import glyphs, hashes, parse_recipes, runs, table, verdict_state

RUNS_SQL = "SELECT doc_id, lang, unnest(range(0, len(string_split(text, chr(10))))) AS run_order, unnest(string_split(text, chr(10))) AS text FROM documents"
IDS_SQL = f"""WITH h AS (SELECT doc_id, sha256(text) AS source_hash FROM documents), r AS ({RUNS_SQL}),
ids AS (SELECT r.*, source_hash, source_hash || ':p' || (run_order % 3) || ':c0:o' || (run_order * 10) AS run_id,
  CASE lang WHEN 'en' THEN 'editable_original' WHEN 'de' THEN 'editable_substitution' ELSE 'not_editable' END AS state FROM r JOIN h USING (doc_id))"""


def addressed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with run_id, source (the document) and a state by language."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"), F.posexplode(F.split("text", "\n", -1)).alias("run_order", "text"))
    run_id = run_ids.encode(F.col("source_hash"), F.col("run_order") % 3, F.lit(0), F.col("run_order") * 10)
    return rows.withColumn("run_id", run_id).withColumn("state", verdict_state())


@query(f"SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, text FROM ({RUNS_SQL})")
def runs_scan(spark: SparkSession, d: str) -> DataFrame:
    return runs(table(spark, d, "documents"))


@query("SELECT doc_id, sha256(text) AS source_hash FROM documents")
def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return hashes(table(spark, d, "documents"))


MATCHES_SQL = f"""
WITH r AS ({RUNS_SQL}),
c AS (SELECT doc_id, run_order, text, unnest(range(0, length(text))) AS start, unnest(string_split(text, '')) AS c FROM r WHERE text <> ''),
w AS (SELECT doc_id, run_order, text, start, c || coalesce(lead(c, 1) OVER l, '') || coalesce(lead(c, 2) OVER l, '') AS here FROM c WINDOW l AS (PARTITION BY doc_id, run_order ORDER BY start)),
s AS (SELECT doc_id, run_order, text, CAST(start AS INTEGER) AS start FROM w WHERE lower(here) = 'the')
"""


@query(MATCHES_SQL + """
SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, start, start + 3 AS "end", substr(text, start + 1, 3) AS match,
  CASE WHEN start > 48 THEN '…' ELSE '' END || substr(text, greatest(start - 48, 0) + 1, least(start, 48)) AS before,
  substr(text, start + 4, 48) || CASE WHEN start + 51 < length(text) THEN '…' ELSE '' END AS after
FROM s""")
def find_matches(spark: SparkSession, d: str) -> DataFrame:
    found = search.find_matches(runs(table(spark, d, "documents")), "the")
    return found.select("doc_id", "run_order", "start", "end", "match", "before", "after")


@query(MATCHES_SQL + "SELECT doc_id, count(*) AS n_matches, CAST(sum(start) AS BIGINT) AS start_sum FROM s GROUP BY doc_id")
def match_counts_by_doc(spark: SparkSession, d: str) -> DataFrame:
    found = runs(table(spark, d, "documents")).select("doc_id", F.explode(search.offsets(F.col("text"), "the")).alias("start"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.sum("start").alias("start_sum"))


@query(IDS_SQL + """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN run_order % 7 = 0 THEN 'normalization_boundary_unreplaceable' WHEN state = 'not_editable' THEN CASE WHEN run_order % 2 = 0 THEN 'Type3' ELSE 'uneditable' END
    WHEN count(*) OVER (PARTITION BY run_id) > 1 THEN 'operator_shared_by_multiple_runs' END AS reason FROM ids) GROUP BY reason""")
def match_refusals(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_sharers(addressed_runs(spark, d))
    reason = search.refusal(F.col("state"), F.when(F.col("run_order") % 2 == 0, "Type3").otherwise(""), F.col("run_order") % 7 != 0, F.col("sharers"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(IDS_SQL + "SELECT run_id, count(*) AS sharers FROM ids GROUP BY run_id HAVING count(*) > 1")
def address_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return addressed_runs(spark, d).groupBy("run_id").agg(F.count("*").alias("sharers")).where("sharers > 1")


@query(IDS_SQL + """
SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, run_id, true AS valid, source_hash AS hash, CAST(run_order % 3 AS BIGINT) AS page, CAST(run_order * 10 AS BIGINT) AS byte_offset FROM ids""")
def run_id_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = addressed_runs(spark, d).withColumn("p", run_ids.decode(F.col("run_id")))
    return rows.select("doc_id", "run_order", "run_id", run_ids.is_valid(F.col("run_id")).alias("valid"), F.col("p.source_hash").alias("hash"), "p.page", "p.byte_offset")


#: Pieces of run ids and whether each is in the grammar: an id is, if all of its pieces are.
_HASH = "0123456789abcdef" * 4
ID_PIECES = [
    (0, _HASH, True), (0, _HASH[1:], False), (0, _HASH.upper(), False), (0, "x" + _HASH, False), (0, "", False),
    (1, ":p0", True), (1, ":p31", True), (1, ":p-1", False), (1, ":p", False),
    (2, ":c0", True), (2, ":c1/x7/x12", True), (2, ":c", False), (2, ":c0/t1/x2", False),
    (3, "", True), (3, "/a2:On.1", True), (3, "/a1", False),
    (4, "", True), (4, "/t4", True), (4, "/t", False),
    (5, "", True), (5, "/yA_b", True), (5, "/y-+", True), (5, "/y*", False),
    (6, ":o99", True), (6, ":o", False),
    (7, "", True), (7, ":g2-5", True), (7, ":g1", False), (7, " ", False),
]
_N_PIECES = [sum(p[0] == k for p in ID_PIECES) for k in range(8)]
#: Which piece each event's id has at each place; the first, a good one, in most.
_PIECE_OF = "CASE WHEN (event_id * (2 * k + 3) + event_id // 7) % 3 < 2 THEN 0 ELSE (event_id * (k + 2) + event_id // 11) % n END"


@query(f"""WITH p AS (SELECT k, piece, ok, row_number() OVER (PARTITION BY k ORDER BY nth) - 1 AS i FROM (VALUES {values([(nth, *p) for nth, p in enumerate(ID_PIECES)])}) t(nth, k, piece, ok)), n AS (SELECT k, count(*) AS n FROM p GROUP BY k),
e AS (SELECT event_id, k, {_PIECE_OF} AS i FROM events, n)
SELECT event_id, string_agg(piece, '' ORDER BY k) AS run_id, bool_and(ok) AS valid FROM e JOIN p USING (k, i) GROUP BY event_id""")
def run_id_grammar(spark: SparkSession, d: str) -> DataFrame:
    def piece(k: int) -> F.Column:
        at = F.expr(_PIECE_OF.replace("//", "div").replace("k", str(k)).replace(" n ", f" {_N_PIECES[k]} "))
        return F.get(F.array(*[F.lit(p) for place, p, _ in ID_PIECES if place == k]), at.cast("int"))

    rows = table(spark, d, "events").select("event_id", F.concat(*[piece(k) for k in range(8)]).alias("run_id"))
    return rows.select("event_id", "run_id", run_ids.is_valid(F.col("run_id")).alias("valid"))


#: Operations derived from runs: some ids are spoilt, some are another document's, some are of no run.
_OPS = """CASE WHEN run_order % 11 = 3 THEN 'x' || run_id WHEN run_order % 11 = 5 THEN repeat('0', 64) || substr(run_id, 65)
  WHEN run_order % 11 = 7 THEN run_id || ':g0-1' ELSE run_id END"""
PLAN_SQL = IDS_SQL + f""",
ops AS (SELECT doc_id AS source, CAST(run_order AS INTEGER) AS op, {_OPS} AS run_id, upper(text) AS new_text FROM ids
  UNION ALL SELECT doc_id, 9999, run_id, '' FROM ids WHERE doc_id % 17 = 0 AND run_order = 0),
most AS (SELECT source, max(n) AS most FROM (SELECT source, run_id, count(*) AS n FROM ops GROUP BY ALL) GROUP BY source),
plan AS (SELECT o.source, o.op, o.run_id, CASE WHEN most > 1 THEN 'duplicate_run_id_in_recipe'
    WHEN NOT regexp_full_match(o.run_id, '[0-9a-f]{{64}}:p[0-9]+:c[0-9]+:o[0-9]+(:g[0-9]+-[0-9]+)?') THEN 'malformed_run_id'
    WHEN substr(o.run_id, 1, 64) <> sha256(d.text) THEN 'source_hash_mismatch' WHEN i.state IS NULL THEN 'run_id_not_found'
    WHEN i.state = 'not_editable' THEN 'Type3' END AS reason, o.new_text
  FROM ops o JOIN most USING (source) JOIN documents d ON d.doc_id = o.source LEFT JOIN (SELECT run_id, min(state) AS state FROM ids GROUP BY run_id) i ON i.run_id = o.run_id)
"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    ids = addressed_runs(spark, d)
    ops = ids.select(F.col("doc_id").alias("source"), F.col("run_order").alias("op"), F.expr(_OPS).alias("run_id"), F.upper("text").alias("new_text"))
    again = ids.where("doc_id % 17 = 0 AND run_order = 0").select("doc_id", F.lit(9999), "run_id", F.lit(""))
    known = ids.groupBy("run_id").agg(F.min("state").alias("state"), F.lit("Type3").alias("verdict_reason"))
    return recipes.plan(ops.union(again), known, hashes(table(spark, d, "documents")).withColumnRenamed("doc_id", "source"))


@query(PLAN_SQL + "SELECT source, op, run_id, reason, reason IS NULL AS ok FROM plan")
def recipe_plan(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).select("source", "op", "run_id", "reason", "ok")


@query(PLAN_SQL + "SELECT source, bool_and(reason IS NULL) AS ok, count(*) AS n_ops, count(reason) AS n_refused FROM plan GROUP BY source")
def recipe_report(spark: SparkSession, d: str) -> DataFrame:
    return recipes.report(_planned(spark, d))


@query(PLAN_SQL + "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM plan GROUP BY ALL")
def refusal_census(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(IDS_SQL + """, wanted AS (SELECT doc_id AS source, run_id, run_order, text, replace(text, 'e', 'E') AS new_text, state <> 'not_editable' AND (doc_id + run_order) % 9 <> 0 AS ok FROM ids),
good AS (SELECT source FROM wanted GROUP BY source HAVING bool_and(ok))
SELECT w.source, CAST(w.run_order AS INTEGER) AS run_order, CASE WHEN g.source IS NULL THEN text ELSE new_text END AS text FROM wanted w LEFT JOIN good g USING (source)""")
def recipe_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = addressed_runs(spark, d).withColumnRenamed("doc_id", "source")  # copies of a document share run ids
    plan = rows.select("source", "run_id", F.replace("text", F.lit("e"), F.lit("E")).alias("new_text"), F.expr("state <> 'not_editable' AND (source + run_order) % 9 <> 0").alias("ok"))
    return recipes.apply(rows.select("source", "run_id", "run_order", "text"), plan).select("source", "run_order", "text")


@query(f"SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, regexp_replace(text, '[tT][hH][eE]', 'THE', 'g') AS text FROM ({RUNS_SQL})")
def replace_all_text(spark: SparkSession, d: str) -> DataFrame:
    return runs(table(spark, d, "documents")).select("doc_id", "run_order", search.replace_all(F.col("text"), "the", "THE").alias("text"))


@query("""WITH c AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN regexp_replace(text, 'the', 'XX') WHEN 1 THEN replace(text, 'the', 'XX') WHEN 2 THEN text ELSE 'XX' || text END AS after, string_split(text, 'the') AS p FROM documents),
k AS (SELECT doc_id, after, p, unnest(range(1, len(p))) AS k FROM c),
g AS (SELECT DISTINCT doc_id FROM k WHERE array_to_string(list_slice(p, 1, k), 'the') || 'XX' || array_to_string(list_slice(p, k + 1, len(p)), 'the') = after)
SELECT doc_id, CASE WHEN len(p) = 1 THEN 'unverifiable' WHEN g.doc_id IS NULL THEN 'wrong' ELSE 'replaced' END AS verdict FROM c LEFT JOIN g USING (doc_id)""")
def edit_text_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("before"))
    once = F.expr("if(instr(before, 'the') > 0, concat(left(before, instr(before, 'the') - 1), 'XX', substring(before, instr(before, 'the') + 3)), before)")
    after = F.when(F.col("doc_id") % 4 == 0, once).when(F.col("doc_id") % 4 == 1, F.replace("before", F.lit("the"), F.lit("XX"))).when(F.col("doc_id") % 4 == 2, F.col("before")).otherwise(F.concat(F.lit("XX"), "before"))
    return rows.withColumn("after", after).select("doc_id", search.text_verdict(F.col("before"), F.col("after"), "the", F.lit("XX")).alias("verdict"))


GLYPHS_SQL = f"""WITH r AS ({RUNS_SQL}), c AS (SELECT doc_id, run_order, unnest(range(0, length(text))) AS ord, unnest(string_split(text, '')) AS ch FROM r WHERE text <> ''),
w AS (SELECT *, CASE WHEN ch <> ' ' THEN 100 WHEN lag(ch) OVER l = '.' THEN 48 ELSE 24 END AS wide FROM c WINDOW l AS (PARTITION BY doc_id, run_order ORDER BY ord)),
g AS (SELECT *, sum(wide) OVER (PARTITION BY doc_id, run_order ORDER BY ord) - wide AS x FROM w),
v AS (SELECT * FROM g WHERE ch <> ' '),
i AS (SELECT *, x - lag(x) OVER l - 100 AS gap FROM v WINDOW l AS (PARTITION BY doc_id, run_order ORDER BY x, ord)),
n AS (SELECT *, CASE WHEN gap IS NULL OR gap * 100 > 33 * 120 OR gap * 100 < -20 * 120 THEN 1 ELSE 0 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, run_order ORDER BY x, ord) AS island, new = 0 AND gap * 100 > 10 * 120 AS spaced FROM n)
"""


@query(GLYPHS_SQL + """SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, CAST(island AS BIGINT) AS island,
  string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || ch, '' ORDER BY x, ord) AS text, CAST(min(x) AS BIGINT) AS x0, CAST(max(x) + 100 AS BIGINT) AS x1, count(*) AS n_glyphs FROM k GROUP BY doc_id, run_order, island""")
def glyph_cluster(spark: SparkSession, d: str) -> DataFrame:
    keys = ["doc_id", "run_order"]
    return clustering.display(clustering.islands(glyphs(table(spark, d, "documents")), keys), [*keys, "island"])


@query(GLYPHS_SQL + """, b AS (SELECT *, ch IN ('q', 'z', '|') AS bad FROM k),
f AS (SELECT *, CASE WHEN bad OR coalesce(lag(bad) OVER l, true) THEN 1 ELSE 0 END AS nf FROM b WINDOW l AS (PARTITION BY doc_id, run_order, island ORDER BY x, ord)),
o AS (SELECT *, sum(nf) OVER (PARTITION BY doc_id, run_order, island ORDER BY x, ord) AS fragment FROM f)
SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, CAST(island AS BIGINT) AS island, CAST(fragment AS BIGINT) AS fragment, bool_and(bad) AS bad, count(*) AS n_glyphs FROM o GROUP BY ALL""")
def editability_fragments(spark: SparkSession, d: str) -> DataFrame:
    keys = ["doc_id", "run_order"]
    rows = clustering.fragments(clustering.islands(glyphs(table(spark, d, "documents")), keys), keys, F.col("ch").isin("q", "z", "|"))
    return rows.groupBy(*keys, "island", "fragment").agg(F.bool_and("bad").alias("bad"), F.count("*").alias("n_glyphs"))


@query("""WITH s AS (SELECT n_chars AS score, quality AS positive FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(50, 5001, 50)) AS threshold),
c AS (SELECT threshold, sum(CASE WHEN score > threshold THEN positive ELSE 0 END) AS tp, sum(CASE WHEN score > threshold THEN 1 - positive ELSE 0 END) AS fp, sum(positive) AS p, sum(1 - positive) AS n FROM t, s GROUP BY threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(p, 0), 0), 9) AS recall,
  round(coalesce(fp / nullif(n, 0), 0), 9) AS fpr, round(coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0), 9) AS f1 FROM c""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = measures.threshold_sweep(_scored(spark, d), spark.range(50, 5001, 50).withColumnRenamed("id", "threshold"))
    return out.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f1")])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("positive"))
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")).join(labels, "doc_id")


@query("""WITH s AS (SELECT n_chars AS score, quality AS positive FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(50, 5001, 50)) AS threshold),
c AS (SELECT threshold, sum(CASE WHEN score > threshold THEN positive ELSE 0 END) AS tp, sum(CASE WHEN score > threshold THEN 1 - positive ELSE 0 END) AS fp, sum(positive) AS p FROM t, s GROUP BY threshold)
SELECT threshold, round(2 * tp / (2 * tp + fp + p - tp), 9) AS f1 FROM c ORDER BY 2 * tp / (2 * tp + fp + p - tp) DESC, threshold LIMIT 1""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    sweep = measures.threshold_sweep(_scored(spark, d), spark.range(50, 5001, 50).withColumnRenamed("id", "threshold"))
    return measures.best_threshold(sweep).select("threshold", F.round("f1", 9).alias("f1"))


@query("SELECT lang, quantile_disc(n_chars, 0.1) AS p10, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY lang")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return measures.nearest_rank(table(spark, d, "documents"), ["lang"], "n_chars", [0.1, 0.5, 0.9, 0.99]).select("lang", *[F.col(c).cast("long").alias(c) for c in ("p10", "p50", "p90", "p99")])


@query(f"""WITH r AS ({RUNS_SQL}), s AS (SELECT doc_id, round_even((length(text) % 37) / 8.0 * 2, 0) / 2 AS size, greatest(1, length(text)) AS w FROM r),
g AS (SELECT doc_id, size, sum(w) AS w FROM s GROUP BY ALL)
SELECT doc_id, CAST(arg_max(size, {{'a': w, 'b': -size}}) AS DOUBLE) AS body FROM g GROUP BY doc_id""")
def weighted_mode_size(spark: SparkSession, d: str) -> DataFrame:
    size = ((F.length("text") % 37) / F.lit(8)).cast("double")
    return measures.weighted_mode(runs(table(spark, d, "documents")), ["doc_id"], size, F.length("text")).withColumn("body", F.col("body").cast("double"))


@query("""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
m AS (SELECT t.w, k.w IS NOT NULL AS known FROM t LEFT JOIN k USING (w))
SELECT count(*) FILTER (length(w) >= 2 AND known) AS hits, count(*) FILTER (length(w) >= 2) AS long_tokens, count(*) FILTER (length(w) = 1) AS singletons, count(*) AS n_tokens,
  round(count(*) FILTER (length(w) >= 2 AND known) / count(*) FILTER (length(w) >= 2), 9) AS hit_rate, round(count(*) FILTER (length(w) = 1) / count(*), 9) AS singleton_rate FROM m""")
def lexicon_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    def words(name: str, column: str) -> DataFrame:
        return table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias(column))

    return measures.lexicon(words("documents", "token"), words("benchmark", "word"))


@query("""SELECT doc_id, item, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT doc_id, unnest(string_split(text, '')) AS item, 1 AS n FROM documents WHERE text <> '' UNION ALL
  SELECT doc_id, unnest(string_split(replace(text, 'the', 'XY'), '')), -1 FROM documents WHERE text <> '' UNION ALL
  SELECT doc_id, unnest(['+', 'e']), 1 FROM documents) GROUP BY ALL HAVING sum(n) <> 0""")
def char_multiset_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")

    def chars(text: F.Column) -> DataFrame:
        return docs.select("doc_id", F.explode(F.split(text, "")).alias("item")).where("item <> ''")

    added = docs.select("doc_id", F.explode(F.array(F.lit("+"), F.lit("e"))).alias("item"))
    return measures.multiset_delta(chars(F.col("text")), chars(F.replace("text", F.lit("the"), F.lit("XY"))), added, ["doc_id"])


@query(f"""WITH r AS ({RUNS_SQL}), o AS (SELECT doc_id, run_order, length(text) AS v FROM r), n AS (SELECT doc_id, run_order, length(replace(text, 'q', '')) AS v FROM r WHERE NOT (doc_id % 10 = 0 AND run_order = 2))
SELECT doc_id, count(*) FILTER (o.v IS DISTINCT FROM n.v) AS n_changed, count(o.v) <> count(n.v) AS length_changed FROM o FULL JOIN n USING (doc_id, run_order) GROUP BY doc_id""")
def positional_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents"))
    new = rows.where("NOT (doc_id % 10 = 0 AND run_order = 2)").withColumn("v", F.length(F.replace("text", F.lit("q"), F.lit(""))))
    return joins.positional_diff(rows.withColumn("v", F.length("text")), new, ["doc_id"], "run_order", "v")


@query("""WITH m AS (SELECT greatest(2, floor(count(*) * 0.04)) AS most FROM documents), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY regexp_replace(source, '[0-9]$', '') ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source FROM r, m WHERE k <= most""")
def producer_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("n"))
    return measures.capped(docs, F.regexp_replace("source", "[0-9]$", ""), 0.04, ["n", "doc_id"]).select("doc_id", "source")


@query(f"""WITH r AS ({RUNS_SQL}), b AS (SELECT doc_id, run_order, length(text) AS w FROM r)
SELECT doc_id, CAST(run_order AS INTEGER) AS run_order, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY run_order) AS BIGINT) AS running, sum(w) OVER (PARTITION BY doc_id ORDER BY run_order) <= 2000 AS within, sum(w) OVER (PARTITION BY doc_id) > 2000 AS refused FROM b""")
def work_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents")).select("doc_id", "run_order", F.length("text").alias("w"))
    return measures.budgeted(rows, ["doc_id"], ["run_order"], "w", 2000).drop("w")


LINES_SQL = f"""WITH r AS ({RUNS_SQL}), l AS (SELECT doc_id, run_order AS line_id, text, CAST(run_order * 14 + CASE WHEN length(text) % 5 = 0 THEN 12 ELSE 0 END AS INTEGER) AS y, CAST((length(text) % 3) * 3 + CASE WHEN length(text) % 7 = 0 THEN 300 ELSE 0 END AS INTEGER) AS x, length(text) AS n FROM r)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents")).withColumnRenamed("run_order", "line_id").withColumn("n", F.length("text"))
    return rows.withColumns({"y": F.expr("line_id * 14 + if(n % 5 = 0, 12, 0)"), "x": F.expr("(n % 3) * 3 + if(n % 7 = 0, 300, 0)")})


@query(LINES_SQL + """, c AS (SELECT doc_id, line_id, x AS x0, x + n % 90 AS x1 FROM l), m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
k AS (SELECT *, CASE WHEN r IS NULL OR x0 > r + 20 THEN 1 ELSE 0 END AS new FROM m)
SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY x0, x1, line_id) AS BIGINT) AS col FROM k""")
def layout_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("doc_id", "line_id", F.col("x").alias("x0"), (F.col("x") + F.col("n") % 90).alias("x1"))
    return layout.columns(lines, ["doc_id"], 20).select("doc_id", "line_id", "col")


@query(LINES_SQL + """, k AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'heading' WHEN n % 13 = 0 THEN 'list' ELSE 'paragraph' END AS kind FROM l),
p AS (SELECT *, y - lag(y) OVER w AS dy, abs(x - lag(x) OVER w) AS dx, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY y, x, line_id)),
q AS (SELECT *, CASE WHEN kind = 'paragraph' AND before = 'paragraph' AND dy > 0 AND dy <= 16.5 AND dx < 7.5 THEN 0 ELSE 1 END AS new FROM p)
SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, kind, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY y, x, line_id) AS BIGINT) AS block FROM q""")
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n") % 11 == 0, "heading").when(F.col("n") % 13 == 0, "list").otherwise("paragraph")
    return layout.paragraphs(_lines(spark, d).withColumn("kind", kind), ["doc_id"], 10.0).select("doc_id", "line_id", "kind", "block")


@query(LINES_SQL + """, c AS (SELECT doc_id, line_id AS run_id, x * 2 + line_id * 7 AS x0, x * 2 + line_id * 7 + n % 40 AS x1 FROM l), g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0, run_id) > 24 AS far FROM c)
SELECT doc_id, CAST(run_id AS INTEGER) AS run_id, CAST(sum(CASE WHEN coalesce(far, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0, run_id) AS BIGINT) AS grp FROM g""")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("x") * 2 + F.col("line_id") * 7
    rows = _lines(spark, d).select("doc_id", F.col("line_id").alias("run_id"), at.alias("x0"), (at + F.col("n") % 40).alias("x1"))
    return layout.line_groups(rows, ["doc_id"], F.lit(24)).select("doc_id", "run_id", "grp")


@query(LINES_SQL + """, v AS (SELECT doc_id, list_sort(list(DISTINCT CAST((y + n % 9) AS DOUBLE))) AS v FROM l GROUP BY doc_id)
SELECT doc_id, list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 15 THEN list_concat(a, b) ELSE a END) AS axes FROM v""")
def axis_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return layout.axes(_lines(spark, d).withColumn("v", F.col("y") + F.col("n") % 9), ["doc_id"], "v", 15.0)


@query("""SELECT doc_id, text, kind FROM (SELECT doc_id, text, CASE WHEN length(text) % 31 = 0 THEN 'heading' WHEN regexp_matches(text, '^([-*•]|[0-9]+[.)])\\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))""")
def block_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(table(spark, d, "documents"))
    return rows.select("doc_id", "text", layout.kind(F.when(F.length("text") % 31 == 0, 20.0).otherwise(10.0), F.lit(10.0), F.col("text")).alias("kind"))


@query()
def unicode_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", unicode.project_udf("text").alias("p"))
    return rows.select("doc_id", F.col("p.text").alias("text"), F.size("p.spans").alias("n_units"))


@query()
def whole_word_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(unicode.find_udf("the", whole_words=True)("text")).alias("m"))
    return rows.select("doc_id", "m.start", "m.end", "m.text", "m.safe")


@query()
def right_to_left(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", unicode.is_rtl("text").alias("rtl"))


#: Pieces of a recipe's operation in JSON: its id, its text, what follows them; and the reason against each, in the order of precedence.
RECIPE_PIECES = [
    ("id", 0, '"run_id":"a"', None), ("id", 1, '"run_id":1', "wrong_type"), ("id", 2, "", "missing_key"),
    ("text", 0, ',"new_text":"b"', None), ("text", 1, ',"new_text":null', "wrong_type"), ("text", 2, ',"new_text":true', "wrong_type"),
    ("more", 0, "", None), ("more", 1, ',"x":1', "unknown_key"), ("more", 2, ',"style":{"color":[0,2,0]}', "style_out_of_range"),
    ("more", 3, ',"style":{"font_family":"Sans","color":[0,0.5,1],"bold":true,"font_size":9.5}', None), ("more", 4, ',"style":{"weight":1}', "unknown_key"), ("more", 5, ',"style":{"font_size":0}', "style_out_of_range"),
]
_KINDS = {"id": "p_partkey % 7 % 4 % 3", "text": "p_partkey % 11 % 5 % 3", "more": "p_size % 6"}


def _recipes_sql() -> str:
    """Each part's recipe with the first of the reasons against its pieces."""
    joins = " ".join(f"JOIN (SELECT i, piece, reason FROM x WHERE kind = '{k}') {k}_ ON {k}_.i = {at}" for k, at in _KINDS.items())
    said = " ".join(f"WHEN '{r}' IN (coalesce(id_.reason, ''), coalesce(text_.reason, ''), coalesce(more_.reason, '')) THEN '{r}'" for r in ("wrong_type", "unknown_key", "missing_key", "style_out_of_range"))
    return f"""WITH x AS (SELECT * FROM (VALUES {values(RECIPE_PIECES)}) t(kind, i, piece, reason))
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'not_a_json_array' WHEN p_partkey % 13 = 1 THEN NULL {said} END AS reason FROM part {joins}"""


@query(_recipes_sql())
def recipe_json(spark: SparkSession, d: str) -> DataFrame:
    def piece(kind: str) -> F.Column:
        return F.get(F.array(*[F.lit(p) for k, _, p, _ in RECIPE_PIECES if k == kind]), F.expr(_KINDS[kind]).cast("int"))

    body = F.concat(*map(piece, _KINDS))
    op = F.concat(F.lit("{"), F.regexp_replace(body, "^,", ""), F.lit("}"))
    none = F.get(F.array(F.lit("no json"), F.lit('{"run_id":"a"}'), F.lit(None)), (F.col("p_partkey") % 3).cast("int"))
    recipe = F.when(F.col("p_partkey") % 13 == 0, none).when(F.col("p_partkey") % 13 == 1, "[]").otherwise(F.concat(F.lit("["), op, F.lit("]")))
    return parse_recipes(table(spark, d, "part").select("p_partkey", recipe.alias("recipe"))).select("p_partkey", "reason")
