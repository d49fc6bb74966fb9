"""From glyphs to runs: islands of glyphs on a line, their texts and their editable fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from glyphmill.functions import run_ids

# Fixed values, in hundredths of an em: a gap above BREAK or below OVERLAP ends a run, one above SPACE reads as a space.
SPACE, BREAK, OVERLAP = 10, 33, -20
# In hundredths of an em: a new baseline; a rise that splits. In per cent: a change of size that splits.
BAND, RISE, SIZE = 20, 50, 1


def angle_bucket(dx: Column, dy: Column) -> Column:
    """Direction in whole degrees, halves to even; 0 without a direction."""
    return F.when((dx == 0) & (dy == 0), 0).otherwise(F.bround(F.degrees(F.atan2(dy, dx))).cast("int"))


def bands(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs with band: along y, a new one where the step to the glyph before reaches BAND of the em."""
    order = W.partitionBy(*keys).orderBy("y", "x", "ord")
    step = F.abs(F.col("y") - F.lag("y").over(order)) * 100 >= F.lit(BAND) * F.col("em")
    return glyphs.withColumn("_new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("band", F.sum("_new").over(order)).drop("_new")


def islands(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs with gap (to the end of the one before), spaced and island, within keys, in the order of x.

    Breaks look at the glyph before: another font, size, rise, visibility or colour where such columns exist,
    or a gap out of bounds. One window sort serves all of them.
    """
    order = W.partitionBy(*keys).orderBy("x", "ord")

    def was(name: str) -> Column:
        return F.lag(name).over(order)

    gap = F.col("x") - was("x") - was("advance")
    breaks = (gap * 100 > F.lit(BREAK) * F.col("em")) | (gap * 100 < F.lit(OVERLAP) * F.col("em"))
    for name in ("font_id", "visible", "fill_color"):
        if name in glyphs.columns:
            breaks = breaks | ~F.col(name).eqNullSafe(was(name))
    if "rise" in glyphs.columns:
        breaks = breaks | (F.abs(F.col("rise") - was("rise")) * 100 >= F.lit(RISE) * F.col("em"))
    breaks = breaks | (F.abs(F.col("em") - was("em")) * 100 > F.lit(SIZE) * was("em"))
    marked = glyphs.withColumn("gap", gap).withColumn("_new", F.coalesce(breaks, F.lit(True)).cast("int"))
    spaced = (F.col("_new") == 0) & (F.col("gap") * 100 > F.lit(SPACE) * F.col("em"))
    return marked.withColumn("spaced", spaced).withColumn("island", F.sum("_new").over(order)).drop("_new")


def display(islands: DataFrame, keys: list[str]) -> DataFrame:
    """keys with text, x0, x1 and n_glyphs of each group of glyphs: characters in order, with the spaces that gaps stand for."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("x", "ord")) == 1
    rows = islands.withColumn("_c", F.concat(F.when(F.col("spaced") & ~first, " ").otherwise(""), F.coalesce("ch", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("x", "ord", "_c")))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["_c"]), "").alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("advance")).alias("x1"), F.count("*").alias("n_glyphs")
    )


def fragments(islands: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """islands with bad and fragment: each bad glyph is alone, good stretches are as long as can be."""
    order = W.partitionBy(*keys, "island").orderBy("x", "ord")
    rows = islands.withColumn("bad", bad)
    new = F.coalesce(F.col("bad") | F.lag("bad").over(order), F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("fragment", F.sum("_new").over(order)).drop("_new")


def cluster_page(glyphs: DataFrame) -> DataFrame:
    """Addressed runs of located glyphs: (source_hash, page, xobj_path, part, run_id, g_start, g_end, text, n_glyphs, editable, em).

    glyphs: source_hash, page, part, xobj_path, ord, op_offset, ch, x, y, dir_x, dir_y, adv_x, adv_y, em, font_id,
    visible, fill_color, rise, editable. Per page, path, part and angle, glyphs are banded by their place across the
    reading direction, ordered along it, split into runs where font, size, rise, visibility, colour or the gap
    breaks, and each run into fragments: bad glyphs alone, good stretches as long as can be. All fragments of a run
    have the address of its first glyph; g_start and g_end tell them apart, and are null where there is but one.
    All windows refine one partitioning, so rows move once.
    """
    keys = ["source_hash", "page", "xobj_path", "part"]
    norm = F.sqrt(F.col("dir_x") * F.col("dir_x") + F.col("dir_y") * F.col("dir_y"))
    rows = glyphs.withColumns({"_ux": F.when(norm == 0, 1.0).otherwise(F.col("dir_x") / norm), "_uy": F.when(norm == 0, 0.0).otherwise(F.col("dir_y") / norm), "_angle": angle_bucket(F.col("dir_x"), F.col("dir_y"))})
    rows = rows.withColumns({"_along": F.col("x") * F.col("_ux") + F.col("y") * F.col("_uy"), "_perp": F.col("y") * F.col("_ux") - F.col("x") * F.col("_uy"), "_end": F.col("adv_x") * F.col("_ux") + F.col("adv_y") * F.col("_uy")})
    keys = [*keys, "_angle"]
    across = W.partitionBy(*keys).orderBy("_perp", "ord")
    far = F.abs(F.col("_perp") - F.lag("_perp").over(across)) >= F.lit(BAND / 100) * F.col("em")
    rows = rows.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("_band", F.sum("_new").over(across))
    keys = [*keys, "_band"]
    along = W.partitionBy(*keys).orderBy("_along", "_perp", "ord")

    def was(name: str) -> Column:
        return F.lag(name).over(along)

    rows = rows.withColumn("_gap", F.when(F.col("em") != 0, (F.col("_along") - (was("_along") + was("_end"))) / F.col("em")).otherwise(0.0))
    risen = (F.col("em") > 0) & (F.col("rise") != was("rise")) & (F.abs(F.col("rise") - was("rise")) >= F.lit(RISE / 100) * F.col("em"))
    breaks = risen | (F.abs(F.col("em") - was("em")) > F.lit(SIZE / 100) * was("em")) | (F.col("_gap") > BREAK / 100) | (F.col("_gap") < OVERLAP / 100)
    for name in ("font_id", "visible", "fill_color"):
        breaks = breaks | ~F.col(name).eqNullSafe(was(name))
    rows = rows.withColumn("_new", F.coalesce(was("ord").isNull() | breaks, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(along))
    keys = [*keys, "_run"]
    order = W.partitionBy(*keys).orderBy("_along", "_perp", "ord")
    cut = ~F.col("editable") | F.coalesce(~F.lag("editable").over(order), F.lit(True))
    rows = rows.withColumn("_place", F.row_number().over(order) - 1).withColumn("_new", cut.cast("int")).withColumn("_fragment", F.sum("_new").over(order)).withColumn("_anchor", F.first("op_offset").over(order))
    opens = F.col("_new") == 1
    part = F.concat(F.when(~opens & (F.col("_gap") > SPACE / 100) & (F.col("_gap") <= BREAK / 100), " ").otherwise(""), F.coalesce("ch", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("_place", part.alias("_c"))))
    found = rows.groupBy(*keys, "_fragment").agg(
        F.min("_place").alias("_start"), (F.max("_place") + 1).alias("_stop"), F.first("_anchor").alias("_anchor"), F.bool_and("editable").alias("editable"), F.first("em").alias("em"),
        F.array_join(F.transform(parts, lambda p: p["_c"]), "").alias("text"), F.count("*").alias("n_glyphs"))
    several = F.max("_fragment").over(W.partitionBy(*keys)) > 1
    found = found.withColumn("g_start", F.when(several, F.col("_start"))).withColumn("g_end", F.when(several, F.col("_stop")))
    run_id = run_ids.encode(F.col("source_hash"), F.col("page"), F.col("part"), F.col("_anchor"), xobj_path=F.col("xobj_path"), g_start=F.col("g_start"), g_end=F.col("g_end"))
    return found.select("source_hash", "page", "xobj_path", "part", run_id.alias("run_id"), "g_start", "g_end", "text", "n_glyphs", "editable", "em")


def gap_islands(rows: DataFrame, keys: list[str], order: list[str], at: Column, most: int) -> DataFrame:
    """rows with island: a new one where `at` is more than `most` after the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = rows.withColumn("_at", at)
    step = step.withColumn("_new", F.coalesce(F.col("_at") - F.lag("_at").over(w) > most, F.lit(True)).cast("int"))
    return step.withColumn("island", F.sum("_new").over(w)).drop("_at", "_new")
