"""Joins that the document model needs beyond equality: as-of, ranges, containment, positions."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """left with the value of the last row of right at or before `at`, within keys; null if that value is null.

    Both sides go through one window sort: no pair of rows is ever built. The value travels in a struct, so a
    null in the latest row hides older ones. tie: a column of left that makes its order complete.
    """
    every = left.select(*keys, at, F.col(tie).alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(value)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    every = every.unionByName(right.select(*keys, at, F.lit(None).cast(every.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(every.schema["_l"].dataType).alias("_l"), F.struct(value).alias("_r"), F.lit(0).alias("_side")))
    w = W.partitionBy(*keys).orderBy(at, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    return every.withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", F.col(f"_found.{value}").alias(f"as_of_{value}"))


def range_lookup(rows: DataFrame, ranges: DataFrame, keys: list[str], key: Column, default: int) -> DataFrame:
    """rows with width: of the first of ranges (keys, ord, first, last, width) that holds the key, else the default.

    The ranges, the width table of each font, are first laid out into pieces that don't overlap, those that no
    range holds without a width; then the piece of a key is the last that starts at it or before.
    """
    keyed = rows.withColumn("_at", key)
    starts = ranges.select(*keys, F.col("first").cast("long").alias("_at")).union(ranges.select(*keys, F.col("last").cast("long") + 1)).distinct()
    holds = F.col("_at").between(F.col("first"), F.col("last"))
    owner = F.min(F.when(holds, F.struct("ord", "width")))
    pieces = starts.join(ranges.select(*keys, "ord", "first", "last", "width"), keys).groupBy(*keys, "_at").agg(owner["width"].alias("width"))
    known = keyed.select(*keys, F.col("_at").cast("long").alias("_at")).distinct().withColumn("_one", F.lit(0))
    found = as_of(known, pieces, keys, "_at", "width", "_one").select(*keys, "_at", "as_of_width")
    return keyed.join(found, [*keys, "_at"], "left").drop("_at").withColumn("as_of_width", F.coalesce("as_of_width", F.lit(default))).withColumnRenamed("as_of_width", "width")


def containment(boxes: DataFrame, cells: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """(keys, box_id, row, col): for boxes (x0, y0, x1, y1) the one cell of the page's grid that holds it strictly inside, else null.

    A page's grid has few cells (layout.MOST_AXES bounds it), so it travels as one array.
    """
    grids = cells.groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "cx0", "cy0", "cx1", "cy1")).alias("_cells"))
    held = F.filter("_cells", lambda c: (F.col("x0") > c["cx0"] + margin) & (F.col("x1") < c["cx1"] - margin) & (F.col("y0") > c["cy0"] + margin) & (F.col("y1") < c["cy1"] - margin))
    met = boxes.join(grids, keys, "left").select(*keys, "box_id", held.alias("_held"))
    one = F.when(F.size("_held") == 1, F.col("_held")[0])
    return met.select(*keys, "box_id", one["row"].alias("row"), one["col"].alias("col"))


def positional_diff(old: DataFrame, new: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """(keys, n_changed, length_changed): rows compared place by place."""
    both = old.select(*keys, pos, F.struct(value).alias("_o")).join(new.select(*keys, pos, F.struct(value).alias("_n")), [*keys, pos], "full_outer")
    changed = F.count_if(~F.col("_o").eqNullSafe(F.col("_n")))
    return both.groupBy(*keys).agg(changed.alias("n_changed"), (F.count("_o") != F.count("_n")).alias("length_changed"))


def unique_match(rows: DataFrame, others: DataFrame, keys: list[str], x: str, epsilon: float) -> DataFrame:
    """rows with other_id: that of the one row of others with equal keys and x within epsilon; null for none or several."""
    near = rows.join(others.select(*keys, F.col(x).alias("_x"), "other_id"), keys, "left").where(F.col("_x").isNull() | (F.abs(F.col(x) - F.col("_x")) < epsilon))
    one = near.groupBy("row_id").agg(F.count("other_id").alias("_n"), F.min("other_id").alias("other_id"))
    return rows.join(one, "row_id", "left").withColumn("other_id", F.when(F.col("_n") == 1, F.col("other_id"))).drop("_n")


@contextlib.contextmanager
def _plain_plans(spark: SparkSession) -> Iterator[None]:
    """Without what Spark infers from rows' expressions: a checkpoint keeps it, so it would grow from round to round."""
    key = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def reach(starts: DataFrame, links: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, round): all that is reached from starts (keys, at) over links (at, _to), and in how many steps.

    Breadth first: each round joins the frontier with the links and drops what has been reached, until a round adds
    nothing. Checkpoints keep each round's plan short.
    """
    with _plain_plans(starts.sparkSession):
        links = links.checkpoint()
        seen = starts.distinct().withColumn("round", F.lit(0)).checkpoint()
        for i in count(1):
            step = seen.where(F.col("round") == i - 1).join(links, at).select(*keys, F.col("_to").alias(at), F.lit(i).alias("round"))
            grown = seen.union(step).groupBy(*keys, at).agg(F.min("round").alias("round")).checkpoint()
            if grown.where(F.col("round") == i).isEmpty():
                return seen
            seen = grown


def shared_objects(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(object, n_pages) of the objects that more than one page reaches; edges (parent, child), roots (page, object).

    A cycle ends, and shared parts are walked once a page.
    """
    links = edges.select(F.col("parent").alias("object"), F.col("child").alias("_to"))
    seen = reach(roots.select("page", "object"), links, ["page"], "object")
    return seen.groupBy("object").agg(F.countDistinct("page").alias("n_pages")).where("n_pages > 1")
