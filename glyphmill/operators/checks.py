"""Lookups, reconciliations and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def coverage_refusal(texts: DataFrame, key: str, names: DataFrame, present: DataFrame) -> DataFrame:
    """(key, reason): the first character of text that has no name, or whose name has no glyph, decides.

    names: ch, name; present: name. Both are dimensions; distinct characters are looked up once, not texts.
    """
    chars = texts.select(key, F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    known = chars.select("ch").distinct().join(names, "ch", "left").join(present.select("name", F.lit(True).alias("there")), "name", "left")
    said = known.select("ch", F.when(F.col("name").isNull(), F.concat(F.lit("no name: "), "ch")).when(F.col("there").isNull(), F.concat(F.lit("character_has_no_glyph_in_bundled_font: "), "ch")).alias("said"))
    bad = chars.join(said.where("said IS NOT NULL"), "ch").groupBy(key).agg(F.min_by("said", "pos").alias("reason"))
    return texts.select(key).join(bad, key, "left")


def family(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """rows (base_font) with family, variant and reason: an exact lookup that names what it misses."""
    return rows.join(dim, "base_font", "left").withColumn("reason", F.when(F.col("family").isNull(), F.concat(F.lit("no mapping table entry for BaseFont "), "base_font")))


def snapshot_changes(before: DataFrame, after: DataFrame, keys: list[str], state: str) -> DataFrame:
    """(keys, change): kept, changed, gone or new, for tokens by key."""
    both = before.select(*keys, F.struct(state).alias("_b")).join(after.select(*keys, F.struct(state).alias("_a")), keys, "full")
    change = F.when(F.col("_a").isNull(), "gone").when(F.col("_b").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "kept").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def verified(ops: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, ok): each operation must have exactly one result, and that one ok."""
    n = results.groupBy(key).agg(F.count("*").alias("_n"), F.bool_and("ok").alias("_ok"))
    return ops.select(key).distinct().join(n, key, "left").select(key, F.coalesce((F.col("_n") == 1) & F.col("_ok"), F.lit(False)).alias("ok"))


def same_sets(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, same): whether both sides have the same items for each key."""
    a = left.select(*keys, item).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys, item).distinct().withColumn("_r", F.lit(1))
    return a.join(b, [*keys, item], "full").groupBy(*keys).agg(F.bool_and(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("same"))


def collisions(own: DataFrame, imported: DataFrame, name: str) -> DataFrame:
    """imported with clashes: whether a name is taken."""
    return imported.join(own.select(name).distinct().withColumn("_t", F.lit(True)), name, "left").withColumn("clashes", F.coalesce("_t", F.lit(False))).drop("_t")


def interleaved(blocks: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, n, place): blocks and images of a page by y, blocks first where equal."""
    both = blocks.select(*keys, "y", "n", F.lit("block").alias("kind")).union(images.select(*keys, "y", "n", F.lit("image").alias("kind")))
    return both.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("y", "kind", "n")) - 1).drop("y")


def insert_position(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position): where a table (y) goes: before the first block (n, y) with a greater y, else at the end."""
    met = tables.select(*keys, F.col("y").alias("_ty")).join(blocks, keys, "left")
    return met.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("y") > F.col("_ty"), F.col("n"))), F.count("n")).alias("position"))


def spaced(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs (x0, x1, size, text) with space: whether a space goes before a run on its line.

    It does where the gap is over .15 of the smaller size and neither side brings a space.
    """
    w = W.partitionBy(*keys).orderBy("x0", "run_id")
    gap = F.col("x0") - F.lag("x1").over(w)
    wide = gap > F.least("size", F.lag("size").over(w)) * 0.15
    bare = ~F.lag("text").over(w).rlike("[ \n]$") & ~F.col("text").rlike("^[ \n]")
    return runs.withColumn("space", F.coalesce(wide & bare, F.lit(False)))


def page_geometry(box: Column, rotation: Column, unit: Column) -> Column:
    """(width, height, rotation): null unless the box is finite, rotation a multiple of 90 and the unit above 0."""
    w, h = box[2] - box[0], box[3] - box[1]
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    turned = F.pmod(rotation, F.lit(180)) == 90
    ok = finite & (F.pmod(rotation, F.lit(90)) == 0) & (unit > 0) & (w > 0) & (h > 0)
    return F.when(ok, F.struct((F.when(turned, h).otherwise(w) * unit).alias("width"), (F.when(turned, w).otherwise(h) * unit).alias("height"), F.pmod(rotation, F.lit(360)).alias("rotation")))


def transaction_gate(c=F.col) -> Column:
    """Why a page operation may not be applied, or null: columns expected, version, signed, confirmed, bytes, free."""
    return F.when(c("expected") != c("version"), "stale").when(c("signed") & ~c("confirmed"), "signature_would_break").when(c("bytes") > c("free"), "history_full")


def reconciled(report: DataFrame, results: DataFrame) -> DataFrame:
    """(name, claimed, counted, agrees): a report's counters against its results (name)."""
    counted = results.groupBy("name").agg(F.count("*").alias("counted"))
    both = report.join(counted, "name", "full").select("name", F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.withColumn("agrees", F.col("claimed") == F.col("counted"))
