"""What fonts, pages and placements are: style, symbol fonts, visible boxes, masks, transforms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags of a font's descriptor and of its program's style selection, the weight that is bold, and the
# fonts whose names alone tell their style.
SYMBOLIC, ITALIC, FORCE_BOLD, OS2_BOLD, OS2_ITALIC, BOLD = 4, 64, 262144, 32, 1, 700
BASE_14 = "Helvetica Helvetica-Bold Helvetica-Oblique Helvetica-BoldOblique Times-Roman Times-Bold Times-Italic Times-BoldItalic Courier Courier-Bold Courier-Oblique Courier-BoldOblique Symbol ZapfDingbats".split()
# In points: a mask's ink beyond its glyphs. In times of the em: what glyphs reach over and under the baseline. An unknown size.
INK, ASCENT, DESCENT, UNKNOWN_SIZE = 3, 0.8, 0.2, 12.0


def _has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def symbolic(flags: Column) -> Column:
    """Whether a descriptor's flags call the font symbolic; no flags, no."""
    return F.coalesce(_has(flags, SYMBOLIC), F.lit(False))


def font_style(name: Column, flags: Column, weight: Column, angle: Column, selection: Column) -> Column:
    """(name, bold, italic) of a font: its program's word counts most, then its descriptor's, and names only of BASE_14. Unknown is null.

    name: without subset tag and slash; weight and angle: the descriptor's; selection: fsSelection of a TrueType program.
    """
    forced = F.when(_has(flags, FORCE_BOLD), True)
    bold = F.coalesce(_has(selection, OS2_BOLD), weight >= BOLD, forced, F.when(name.isin(*BASE_14), name.contains("Bold")))
    italic = F.coalesce(_has(selection, OS2_ITALIC), angle != 0, _has(flags, ITALIC), F.when(name.isin(*BASE_14), name.contains("Italic") | name.contains("Oblique")))
    return F.struct(name.alias("name"), bold.alias("bold"), italic.alias("italic"))


def size(em: Column) -> Column:
    """em, if it is a positive number, else UNKNOWN_SIZE."""
    return F.when((em > 0) & (em < float("inf")), em).otherwise(UNKNOWN_SIZE)


def in_crop(x: Column, y: Column, crop: Column) -> Column:
    """Whether a point lies in the box (x0, y0, x1, y1), its edges included."""
    return x.between(crop[0], crop[2]) & y.between(crop[1], crop[3])


def page_counts(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, visible, invisible): glyphs (x, y, visible, crop) inside the crop box."""
    inside = glyphs.where(in_crop(F.col("x"), F.col("y"), F.col("crop")))
    return inside.groupBy(*keys).agg(F.count_if("visible").alias("visible"), F.count_if(~F.col("visible")).alias("invisible"))


def visible_box(media: Column, crop: Column) -> Column:
    """(x, y, width, height): what both boxes (x0, y0, x1, y1) share, or the media box if nothing."""
    x, y = F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1])
    w, h = F.least(media[2], crop[2]) - x, F.least(media[3], crop[3]) - y

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))

    return F.when((w > 0) & (h > 0), box(x, y, w, h)).otherwise(box(media[0], media[1], media[2] - media[0], media[3] - media[1]))


def fit_transform(box: Column, rotation: Column, unit: Column, width: Column, height: Column) -> Column:
    """The matrix (array of six) that turns a page upright and centres it, as large as fits, on a page of width and height; null if it can't.

    box: visible_box(). The page's size as seen is its box's, turned by rotation, times its user unit.
    """
    turned = F.pmod(rotation, F.lit(180)) == 90
    seen_w, seen_h = (F.when(turned, a).otherwise(b) * unit for a, b in ((box["height"], box["width"]), (box["width"], box["height"])))
    fit = F.least(width / seen_w, height / seen_h)
    s, tx, ty = fit * unit, (width - fit * seen_w) / 2, (height - fit * seen_h) / 2
    left, low, right, high = box["x"] * s, box["y"] * s, (box["x"] + box["width"]) * s, (box["y"] + box["height"]) * s
    none = s * 0
    turns = {0: (s, none, none, s, tx - left, ty - low), 90: (none, -s, s, none, tx - low, ty + right), 180: (-s, none, none, -s, tx + right, ty + high), 270: (none, s, -s, none, tx + high, ty - left)}
    matrix = F.when(F.lit(False), F.array(*turns[0]))
    for angle, m in turns.items():
        matrix = matrix.when(F.pmod(rotation, F.lit(360)) == angle, F.array(*m))
    ok = (width > 0) & (height > 0) & (seen_w > 0) & (seen_h > 0) & (fit < float("inf"))
    return F.when(ok, matrix)


def pixel_mask(glyphs: Column, em: Column, direction: Column, upright: Column, scale: float) -> Column:
    """(left, top, right, bottom) in pixels that a run's glyphs may touch, rounded outward.

    glyphs: array of structs (x, y, adv_x, adv_y); direction: array of two numbers; upright: whether the page's
    matrix keeps the turn's sense.
    """
    length = F.sqrt(direction[0] * direction[0] + direction[1] * direction[1])
    ux, uy = F.when(length > 0, direction[0] / length).otherwise(1.0), F.when(length > 0, direction[1] / length).otherwise(0.0)
    sign = F.when(upright, 1.0).otherwise(-1.0)

    def reach(axis: str, normal: Column) -> Column:
        pads = F.array(normal * em * -DESCENT, normal * em * ASCENT)
        ends = F.flatten(F.transform(glyphs, lambda g: F.array(g[axis], g[axis] + g[f"adv_{axis}"])))
        return F.flatten(F.transform(ends, lambda v: F.transform(pads, lambda p: v + p)))

    xs, ys = reach("x", -uy * sign), reach("y", ux * sign)

    def edge(v: Column, out: int) -> Column:
        return (F.floor if out < 0 else F.ceil)((v + out * INK) * scale).cast("int")

    return F.struct(edge(F.array_min(xs), -1).alias("left"), edge(F.array_min(ys), -1).alias("top"), edge(F.array_max(xs), 1).alias("right"), edge(F.array_max(ys), 1).alias("bottom"))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """rows (page, from 0) of the first `most` pages of each document."""
    return rows.where(F.col("page") < most)


def subset(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, page, ...): rows of the pages (page) of each group (keys, grp, page), numbered anew inside it.

    A document's groups must hold some page each, and pages must strictly rise from one to the next, over groups
    too, and exist; else none of its groups comes out.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy("grp", "place")
    here = rows.select(*keys, "page").distinct().withColumn("_there", F.lit(True))
    checked = groups.join(here, [*keys, "page"], "left").withColumn("_rises", F.coalesce(F.col("page") > F.lag("page").over(order), F.lit(True)))
    checked = checked.withColumn("_ok", F.min((F.col("_rises") & F.col("_there").isNotNull()).cast("int")).over(W.partitionBy(*keys)))
    picked = checked.where("_ok = 1").select(*keys, "page", "grp", "place")
    return rows.join(picked, [*keys, "page"]).withColumn("page", F.col("place")).drop("place")
