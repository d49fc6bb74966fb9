"""Editing of instruction lists, page graphs and text state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from glyphmill.operators.joins import reach


def splice(instructions: Column, touched: Column, replacement: Column) -> Column:
    """An array of instructions with replacement in the place of the first touched ordinal (from 0) and the other touched ones gone."""
    kept = F.filter(F.transform(instructions, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: ~F.array_contains(touched, p["i"]))
    first = F.array_min(touched)

    def values(part: Column) -> Column:
        return F.transform(part, lambda p: p["v"])

    done = F.concat(values(F.filter(kept, lambda p: p["i"] < first)), replacement, values(F.filter(kept, lambda p: p["i"] > first)))
    return F.when(F.coalesce(F.size(touched), F.lit(0)) == 0, instructions).otherwise(done)


def redirect(pages: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """links (target) with redirected: the target, or if that page goes, the next page that stays, else the one before.

    pages: keys, page, gone.
    """
    order = W.partitionBy(*keys).orderBy("page")
    stays = F.when(~F.col("gone"), F.col("page"))
    after = F.first(stays, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    before = F.last(stays, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    homes = pages.select(*keys, F.col("page").alias("target"), F.coalesce(after, before).alias("redirected"))
    return links.join(homes, [*keys, "target"], "left")


def positions_match(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    """Both unknown, or both known and within epsilon."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= epsilon)


def geometry_refusal(old_x: Column, new_x: Column, old_extent: Column, new_extent: Column, epsilon: float = 1e-6) -> Column:
    """Why a replacement's geometry is refused, or null: its anchor must stay, its extent must not grow."""
    return F.when(~positions_match(old_x, new_x, epsilon), "replacement_anchor_shifted").when(new_extent > old_extent + epsilon, "replacement_exceeds_visible_extent")


def advance_with_kerns(shaped: Column, kerns: Column, size: Column) -> Column:
    """The advance of a text with kerns in thousandths of its size, summed in their order."""
    return F.aggregate(kerns.cast("array<double>"), shaped.cast("double"), lambda total, k: total + (-k / 1000) * size)


def first_shared(path: Column, shared: Column) -> Column:
    """(object, n_pages) of the first object on the path that the map `shared` knows, else null."""
    found = F.filter(path, lambda x: F.map_contains_key(shared, x))
    return F.when(F.size(found) > 0, F.struct(found[0].alias("object"), shared[found[0]].alias("n_pages")))


def gap_labels(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs (ch, x, advance) with gap and label: boundary for a gap that a space stands in, intra between two letters."""
    order = W.partitionBy(*keys).orderBy("ord")
    here, ahead = F.col("ch"), F.lead("ch").over(order)
    beyond = F.lead("ch", 2).over(order)
    end = F.col("x") + F.col("advance")
    to = F.when(ahead == " ", F.lead("x", 2).over(order)).otherwise(F.lead("x").over(order))
    label = F.when(here == " ", None).when((ahead == " ") & (beyond != " "), "boundary").when(ahead != " ", "intra")
    return glyphs.withColumn("gap", to - end).withColumn("label", label).where("label IS NOT NULL")


STATE = "doc long, page long, ord long, op string, char_space double, word_space double, scale double, depth int"


def replay_text_state(ops: DataFrame) -> DataFrame:
    """(doc, page, ord, op, char_space, word_space, scale, depth): the text state at each operator, q and Q nesting it.

    ops: doc, page, ord, op, operand. A stack is no window, so the rows go page by page through one pass over
    partitions sorted by document and page; a page is held by no more than its state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, state, stack = None, (0.0, 0.0, 100.0), []
        for b in batches:
            out = []
            for d, p, o, op, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (d, p) != page:
                    page, state, stack = (d, p), (0.0, 0.0, 100.0), []
                if op == "q":
                    stack.append(state)
                elif op == "Q":
                    state = stack.pop() if stack else state
                elif op in ("Tc", "Tw", "Tz"):
                    state = tuple(value if n == op else s for n, s in zip(("Tc", "Tw", "Tz"), state, strict=True))
                out.append((d, p, o, op, *state, len(stack)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                names = [c.split()[0] for c in STATE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = ops.select(F.col("doc").cast("long"), F.col("page").cast("long"), F.col("ord").cast("long"), "op", F.col("operand").cast("double"))
    return rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "ord").mapInArrow(run, STATE)


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(root, n): nodes (id, parent; null parent for roots) below each root, itself included; cycles count once."""
    links = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("_to"))
    reached = reach(nodes.where("parent IS NULL").select(F.col("id").alias("root"), "id"), links, ["root"], "id")
    return reached.groupBy("root").agg(F.count("*").alias("n"))
