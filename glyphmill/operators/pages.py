"""Page sequences, histories and geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from glyphmill.functions.arrays import let


def increasing(groups: Column) -> Column:
    """Whether every group holds a page and pages strictly increase, from one group to the next too; a split needs that."""
    rising = let(F.flatten(groups), lambda p: F.forall(F.transform(p, lambda v, i: (i == 0) | (v > F.get(p, i - 1))), lambda ok: ok))
    return (F.size(groups) > 0) & F.forall(groups, lambda g: F.size(g) > 0) & rising


def page_groups(spec: Column) -> Column:
    """`1-3;5` as [[0, 1, 2], [4]]: groups of pages from 0, in the order given."""

    def pages(part: Column) -> Column:
        ends = F.transform(F.split(F.trim(part), "-"), lambda x: F.trim(x).cast("int"))
        return F.sequence(ends[0] - 1, F.element_at(ends, -1) - 1)

    return F.transform(F.split(spec, ";"), lambda g: F.flatten(F.transform(F.split(g, ","), pages)))


def every_n(rows: DataFrame, n: int) -> DataFrame:
    """rows (page, from 0) with grp and place: chunks of n pages."""
    return rows.withColumn("grp", F.floor(F.col("page") / n).cast("int")).withColumn("place", F.pmod("page", F.lit(n)).cast("int"))


def _renumbered(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    return rows.withColumn("page", (F.row_number().over(W.partitionBy(*keys).orderBy(place, "page")) - 1).cast("int"))


def move(rows: DataFrame, keys: list[str], source: Column, target: Column) -> DataFrame:
    """rows with the page `source` moved so that it becomes page `target`; an index outside the document changes nothing."""
    n = F.count("*").over(W.partitionBy(*keys))
    rows = rows.withColumns({"_s": source, "_t": target, "_n": n})
    ok = F.col("_s").between(0, F.col("_n") - 1) & F.col("_t").between(0, F.col("_n") - 1)
    behind = F.when(F.col("_t") > F.col("_s"), F.col("_t") + 0.5).otherwise(F.col("_t") - 0.5)
    place = F.when(ok & (F.col("page") == F.col("_s")), behind).otherwise(F.col("page").cast("double"))
    return _renumbered(rows.withColumn("_p", place), keys, F.col("_p")).drop("_s", "_t", "_n", "_p")


def delete(rows: DataFrame, keys: list[str], gone: Column) -> DataFrame:
    """rows without the pages where `gone` holds, numbered anew; a document never loses its last page."""
    last = F.min(gone.cast("int")).over(W.partitionBy(*keys)) == 1
    return _renumbered(rows.withColumn("_keep", ~gone | last).where("_keep").drop("_keep"), keys, F.col("page"))


def insert_blank(rows: DataFrame, keys: list[str], at: int) -> DataFrame:
    """rows with one more page (its other columns null) before page `at` of each document."""
    blank = rows.select(*keys).distinct()
    filled = blank.select(*[F.col(c) if c in keys else F.lit(at - 0.5).alias(c) if c == "page" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    both = rows.withColumn("page", F.col("page").cast("double")).unionByName(filled)
    return _renumbered(both, keys, F.col("page"))


def rotate(rotation: Column, quarters: Column) -> Column:
    return F.pmod(rotation + 90 * quarters, F.lit(360))


def merge(first: DataFrame, second: DataFrame, keys: list[str], at: int) -> DataFrame:
    """The pages (keys, page, ...) of second put before page `at` of the first's document with equal keys."""
    place = F.when(F.col("_side") == 0, F.when(F.col("page") < at, 0).otherwise(2)).otherwise(1)
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(place, "page")
    return both.withColumn("page", (F.row_number().over(order) - 1).cast("int")).drop("_side")


def latest(history: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The last version of each key."""
    return history.groupBy(*keys).agg(F.max_by(F.struct(*history.columns), version).alias("_h")).select("_h.*")


def admitted(history: DataFrame, keys: list[str], entries: int, size: int) -> DataFrame:
    """history (version, bytes) with kept: the newest versions, at most `entries` of them and `size` bytes in all, one at least."""
    w = W.partitionBy(*keys).orderBy(F.desc("version"))
    rows = history.withColumn("_rank", F.row_number().over(w)).withColumn("_sum", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("kept", (F.col("_rank") == 1) | ((F.col("_rank") <= entries) & (F.col("_sum") <= size))).drop("_rank", "_sum")


def run_box(x0: Column, y: Column, x1: Column, em: Column, ctm: Column) -> Column:
    """(left, bottom, right, top) in user space of a run in device space; null where the matrix can't be inverted.

    Its box reaches .8 em over and .2 em under the baseline and is .01 wide and high at least.
    """
    a, b, c, d, e, f = (ctm[i] for i in range(6))
    det = a * d - b * c

    def user(x: Column, yy: Column) -> Column:
        return F.struct((((x - e) * d - (yy - f) * c) / det).alias("x"), (((yy - f) * a - (x - e) * b) / det).alias("y"))

    corners = F.array(*[user(x, yy) for x in (x0, x1) for yy in (y - em * 0.8, y + em * 0.2)])
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    left, bottom = F.array_min(xs), F.array_min(ys)
    box = F.struct(left.alias("left"), bottom.alias("bottom"), F.greatest(F.array_max(xs), left + 0.01).alias("right"), F.greatest(F.array_max(ys), bottom + 0.01).alias("top"))
    return F.when(F.abs(det) > 1e-12, box)


def fit_image(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """(x, y, width, height): the image as large as fits the box, centred."""
    scale = F.least(box_width / width, box_height / height)
    w, h = width * scale, height * scale
    return F.struct(((box_width - w) / 2).alias("x"), ((box_height - h) / 2).alias("y"), w.alias("width"), h.alias("height"))


def rotation_matrix(quarters: int) -> tuple[float, float, float, float]:
    """The turn of a page by quarters, exact."""
    a = math.pi / 2 * (quarters % 4)
    return (round(math.cos(a)), round(math.sin(a)), -round(math.sin(a)), round(math.cos(a)))
