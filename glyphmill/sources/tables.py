"""Tables of the document model, read or derived without Python: documents, runs, glyphs, blocks, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, source_hash, content, is_pdf) of the files under path; content is only read where it is used."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("source_hash"), "content", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, source_hash): the identity of a document is the SHA-256 of its bytes."""
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run_order, text): one run for each line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("run_order", "text"))


def verdict_state() -> F.Column:
    """A fixed editing state for the runs of a document, by its language; drives verdict precedence in queries."""
    return F.expr("CASE lang WHEN 'en' THEN 'editable_original' WHEN 'de' THEN 'editable_substitution' ELSE 'not_editable' END")


def glyphs(docs: DataFrame) -> DataFrame:
    """(doc_id, run_order, ord, ch, x, y, em, advance): whole-number layout, a row for each character but spaces.

    Characters are 100 wide; a space is 24 wide, or 48 after a full stop, and has no row of its own.
    """
    chars = runs(docs).select("doc_id", "run_order", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    line = W.partitionBy("doc_id", "run_order").orderBy("pos")
    wide = F.when(F.col("ch") != " ", 100).when(F.lag("ch").over(line) == ".", 48).otherwise(24)
    placed = chars.where("ch <> ''").withColumn("wide", wide).withColumn("x", F.sum("wide").over(line) - F.col("wide"))
    return placed.where("ch <> ' '").select("doc_id", "run_order", F.col("pos").alias("ord"), "ch", "x", (F.col("run_order") * 200).alias("y"), F.lit(120).alias("em"), F.lit(100).alias("advance"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, text): titles, headings, list items and paragraphs of raw HTML, scripts and styles cut out first."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", "")
    pattern = r"(?is)<(title|h[1-6]|li|p)\b[^>]*>([^<]*)"
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), 1).alias("tag"), F.regexp_extract_all(clean, F.lit(pattern), 2).alias("body"))).alias("ord", "b"))
    return found.select("page_id", "ord", F.lower("b.tag").alias("kind"), F.trim(F.regexp_replace("b.body", r"\s+", " ")).alias("text")).where("text <> ''")


def transcript(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without empty turns."""
    return conversations.where("text IS NOT NULL").select("conv_id", "turn", "role", "text")


#: A recipe's operations, by their permitted keys; anything else is refused.
RECIPE_SCHEMA = "array<struct<run_id: string, new_text: string, style: struct<font_family: string, color: array<double>, bold: boolean, italic: boolean, font_size: double>>>"
MAX_OPS, MAX_CHARS = 50_000, 10_000
FAMILIES = ("Sans", "Serif", "Mono")


def parse_recipes(rows: DataFrame, column: str = "recipe") -> DataFrame:
    """rows with ops (null if refused) and reason: recipes in JSON, strictly checked.

    Types must be right in the JSON itself (a number is no string), keys known, ids and texts present, the
    style's values in range, and the whole within its limits.
    """
    v = F.try_parse_json(F.col(column))
    shape = F.schema_of_variant(v)
    ops = F.from_json(F.col(column), RECIPE_SCHEMA)
    raw = F.from_json(F.col(column), "array<map<string, string>>")
    styles = F.transform(raw, lambda m: F.from_json(m["style"], "map<string, string>"))
    known = F.forall(raw, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, ("run_id", "new_text", "style"))))) == 0)
    known_style = F.forall(styles, lambda m: m.isNull() | (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, ("font_family", "color", "bold", "italic", "font_size"))))) == 0))
    # text fields must be JSON strings: their raw form in a map keeps no quotes, so the variant tells
    strings = ~shape.rlike(r"(run_id|new_text): (?!STRING)")
    present = F.forall(ops, lambda o: o["run_id"].isNotNull() & o["new_text"].isNotNull())
    ranges = F.forall(ops, lambda o: o["style"].isNull() | (
        F.coalesce(o["style"]["font_family"].isin(*FAMILIES), F.lit(True))
        & F.coalesce((F.size(o["style"]["color"]) == 3) & F.forall(o["style"]["color"], lambda c: c.between(0, 1)), F.lit(True))
        & F.coalesce(o["style"]["font_size"] > 0, F.lit(True))))
    reason = (
        F.when(v.isNull() | ~shape.startswith("ARRAY"), "not_a_json_array")
        .when(F.size(ops) == 0, F.lit(None))
        .when(ops.isNull() | raw.isNull() | ~F.coalesce(strings, F.lit(False)), "wrong_type")
        .when(~F.coalesce(known & known_style, F.lit(False)), "unknown_key")
        .when(~F.coalesce(present, F.lit(False)), "missing_key")
        .when(~F.coalesce(ranges, F.lit(False)), "style_out_of_range")
        .when((F.size(ops) > MAX_OPS) | F.exists(ops, lambda o: F.length(o["new_text"]) > MAX_CHARS), "recipe_too_large")
    )
    return rows.withColumn("reason", reason).withColumn("ops", F.when(F.col("reason").isNull(), ops))
