"""Line dedup by a segment-partition edit join. DataFrame functions only.

Two lines are linked if their edit distance is at most THRESHOLD (t) and a fifth of the longer one's characters
(LIKENESS). A line is cut into t + 1 even segments; t edits leave one of them whole, so a line within t of it
holds that segment as a substring, near the same place. Every line is therefore entered under its segments, with
its length, and every line probes the lengths from its own down to t less, at the few starts where a segment can
lie given how many edits may fall before and behind it. A pair that meets is verified by banded bit-parallel edit
distance.

Equal lines are one before the join, and the pairs of a key's group are never all made. The lines entered under a
key are dealt by hash into blocks, each eight times as large as the one before, and a round compares one block with
the lines that probe the key and are not yet in its class, merges what is linked, and drops the keys whose lines
are all in one class.
So each pair is compared or known to be of one class, and a group of variants collapses in the first rounds.
Under ten characters only one edit is allowed; such lines are linked by keys that leave one character out, whose
groups are linked as a whole and need no verifying.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import components, drop_scratch, materialize, sieved, table

#: Edits allowed, and the share of the longer line's characters that must be left by them.
THRESHOLD, LIKENESS = 2, 0.8
#: Characters for each edit, and the length of the longer line from which more than one is allowed.
PER_EDIT = round(1 / (1 - LIKENESS))
LONG = 2 * PER_EDIT
#: Characters that are counted in lines that meet another one, for two numbers, and the bits of each count (modulo).
COUNTED, COUNT_BITS = ["eanitrsohdlucmf", "pgwybvk01234567"], 4
#: Halving steps to what two lines have in common: lines of 2^20 characters and less.
HALVINGS = 20
#: The logarithm of how many times as large as the one before a block of entered lines is.
GROWTH = 3
#: Rows of a key that are joined in one task; the entered lines are sent to each such part.
PART_ROWS = 20_000


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line): the lines that hold a word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of t + 1: the last ones are longer by one."""
    k = t + 1
    short, extra = F.floor(length / k).cast("int"), length % k
    start = 1 + i * short + F.greatest(F.lit(0), i - (k - extra))
    return start.cast("int"), (short + (F.lit(i) >= k - extra).cast("int")).cast("int")


def probes(t: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift): where a line looks for the segments of lines shorter by 0 to t.

    Segment i has i edits before it at most, or else an earlier one would match too, and t - i behind it. The
    entries with no length less and no shift are a line's own segments.
    """
    out = []
    for less in range(t + 1):
        for i in range(t + 1):
            low, high = max(-i, less - (t - i)), min(i, less + (t - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _key(line: Column, length: Column, probe: tuple[int, int, int], t: int) -> Column:
    less, i, shift = probe
    start, n = _segment(length - less, i, t)
    at = start + shift
    inside = (at >= 1) & (at + n - 1 <= length) & (length - less >= LONG - t)
    # a line that is too short to probe is entered all the same, for the longer ones
    long = F.lit(not less and not shift) | (length >= LONG)
    return F.when(inside & long, F.xxhash64(line.substr(at, n), length - less, F.lit(i)))


def _counts(line: Column) -> list[Column]:
    """How often each of COUNTED is in the line, packed into numbers."""
    size, mask = F.octet_length(line), F.lit((1 << COUNT_BITS) - 1)

    def one(c: str, k: int) -> Column:
        return F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(mask).cast("long"), COUNT_BITS * k)

    return [reduce(lambda a, b: a.bitwiseOR(b), [one(c, k) for k, c in enumerate(group)]).alias(f"c{i}") for i, group in enumerate(COUNTED)]


def _may_match(x: str, y: str, t: int) -> Column:
    """Whether the counts of columns with prefixes x and y allow t edits: each edit moves two counts by one at most."""
    mask = (1 << COUNT_BITS) - 1

    def apart(i: int, k: int) -> Column:
        a, b = (F.shiftrightunsigned(F.col(f"{p}c{i}"), COUNT_BITS * k).bitwiseAND(F.lit(mask)) for p in (x, y))
        return F.least(F.abs(a - b), mask + 1 - F.abs(a - b))

    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a + b, [apart(i, k) for k in range(len(group))]) <= 2 * t for i, group in enumerate(COUNTED)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: lambdas share no subexpressions."""
    return F.transform(F.array(value), body)[0]


def edits(a: str, b: str, t: int) -> Column:
    """The edit distance of string columns a and b if it is at most t, else a greater number.

    What both have in common at the start and the end is cut off by halving steps. The rest goes column by
    column through a band around the diagonal, the band's differences held as bits of two numbers: first along
    the band's upper edge, then along the last row.
    """
    w = 2 * t + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    zero = F.lit(0).cast("long")
    halves = F.array(*[F.lit(1 << k) for k in range(HALVINGS, -1, -1)])

    def common(x: Column, y: Column, head: bool) -> Column:
        def same(n: Column) -> Column:
            return (F.left(x, n) == F.left(y, n)) if head else (F.right(x, n) == F.right(y, n))

        return F.aggregate(halves, F.lit(0), lambda got, step: F.when((step <= F.length(y) - got) & same(got + step), got + step).otherwise(got))

    def cut(p: Column, head: bool) -> Column:
        """p without the common start (or end) of its x and y."""

        def rest(v: Column, n: Column) -> Column:
            return v.substr(n + 1, F.length(v)) if head else F.left(v, F.length(v) - n)

        return _let(common(p["x"], p["y"], head), lambda n: F.struct(rest(p["x"], n).alias("x"), rest(p["y"], n).alias("y")))

    def distance(p: Column) -> Column:
        nx, ny = F.length(p["x"]), F.length(p["y"])
        pad = F.array_repeat(F.lit(""), w)

        def scan(q: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                # bit k stands for the character of x at i + t + 1 - w + k
                bits = F.aggregate(F.slice(q["xs"], i + (t + 2), w), F.struct(zero.alias("m"), F.lit(1).cast("long").alias("bit")), lambda m, v: F.struct(F.when(v == q["ys"][i], m["m"] + m["bit"]).otherwise(m["m"]).alias("m"), (m["bit"] * 2).alias("bit")), lambda m: m["m"])
                vp, vn = acc["vp"], acc["vn"]

                def rows(d0: Column) -> Column:
                    return _let(F.struct(d0.alias("d0"), vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")), down)

                def down(h: Column) -> Column:
                    d0, hp, hn = h["d0"], h["hp"], h["hn"]
                    below = F.shiftrightunsigned(d0, 1)
                    # along the last row the bit that counts moves down by one a column
                    last = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(w - 2, -1, -1)]), F.greatest(i - q["edge"], F.lit(0)) + 1)
                    along = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
                    across = F.when(hp.bitwiseAND(last) != 0, 1).when(hn.bitwiseAND(last) != 0, -1).otherwise(0)
                    return F.struct(hn.bitwiseOR(F.lit(full).bitwiseXOR(below.bitwiseOR(hp))).alias("vp"), below.bitwiseAND(hp).alias("vn"), (acc["dist"] + F.when(i < q["edge"], along).otherwise(across)).alias("dist"))

                moved = _let(bits, lambda x: _let((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full)), rows))
                return F.when(acc["dist"] > 2 * t, acc).otherwise(moved)  # the last row has t steps down at most

            start = F.struct(F.lit(full - ((1 << (w - t - 1)) - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(t).alias("dist"))
            return F.aggregate(F.sequence(F.lit(0), F.size(q["ys"]) - 1), start, step, lambda acc: acc["dist"])

        # the band needs more than t characters: short rests get an equal start, which costs no edit
        more = F.when(nx <= t, F.lit("_" * (t + 1))).otherwise("")
        xs, ys = (F.split(F.concat(more, p[c]), "") for c in ("x", "y"))
        chars = F.struct(F.concat(pad, xs, pad).alias("xs"), ys.alias("ys"), (F.length(more) + nx - t).alias("edge"))
        return F.when(nx - ny > t, F.lit(t + 1)).when(ny == 0, nx).otherwise(_let(chars, scan))

    longer = F.length(a) >= F.length(b)
    pair = F.struct(F.when(longer, F.col(a)).otherwise(F.col(b)).alias("x"), F.when(longer, F.col(b)).otherwise(F.col(a)).alias("y"))
    return _let(_let(_let(pair, lambda p: cut(p, True)), lambda p: cut(p, False)), distance)


def linked(a: str, b: str, t: int) -> Column:
    """Whether string columns a and b, one of LONG characters at least, are within t edits and alike enough."""
    return edits(a, b, t) <= F.least(F.lit(t), F.floor(F.greatest(F.length(a), F.length(b)) / PER_EDIT))


def distinct_lines(docs: DataFrame, t: int, id_col: str, text_col: str) -> DataFrame:
    """(h, k0, k1, ...): one row for each different line, with its probes' keys."""
    lines = lines_of(docs, id_col, text_col).withColumn("n_chars", F.length("line"))
    line, n = F.col("line"), F.col("n_chars")
    keyed = lines.select(F.xxhash64("line").alias("h"), *[_key(line, n, p, t).alias(f"k{i}") for i, p in enumerate(probes(t))])
    # all rows of a line agree, so a minimum is its value; numbers keep the grouping in a hash table
    return keyed.groupBy("h").agg(*[F.min(c).alias(c) for c in keyed.columns[1:]])


def first_places(occurrences: DataFrame) -> DataFrame:
    """(h, first_doc, first_line): where each line is first, null ids last. Grouped by document first, as one row of two numbers can't be compared in a hash table."""
    by_doc = occurrences.groupBy("h", "doc_id").agg(F.min("line_no").alias("line_no"))
    lone = F.min("line_no")
    return by_doc.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.coalesce(F.min_by("line_no", "doc_id"), lone).alias("first_line"))


def short_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between lines of which the longer has PER_EDIT to LONG - 1 characters: one edit.

    Lines that are equal but for the character at one place are all linked with each other, so a link of each with
    the smallest says the same; a line with one character left out may itself be a line.
    """
    line, n = F.col("line"), F.length("line")
    lines = lines_of(docs, id_col, text_col).where(n.between(PER_EDIT - 1, LONG - 1)).select("line").distinct()
    places = F.sequence(F.lit(1), n)
    less = lines.select(F.xxhash64("line").alias("h"), n.alias("n"), F.posexplode(F.transform(places, lambda k: F.concat(F.left(line, k - 1), line.substr(k + 1, n)))).alias("at", "rest"))
    less = less.where(F.col("n") >= PER_EDIT).select("h", "at", F.xxhash64("rest").alias("rest"))
    alike = less.groupBy("rest", "at").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a < z")
    changed = less.join(alike, ["rest", "at"]).where("h <> a").select("a", F.col("h").alias("b"))
    whole = lines.select(F.xxhash64("line").alias("rest"))
    return changed.union(less.join(whole, "rest").select(F.col("rest").alias("a"), F.col("h").alias("b"))).distinct()


def met_entries(distinct: DataFrame, t: int) -> DataFrame:
    """(key, h, own, block, only): what probes a key under which another line is entered.

    own: the line is entered under the key itself. block: the line's round among those entered. only: the entered
    line, where it is one.
    """
    spots = probes(t)
    own = [i for i, (less, _, shift) in enumerate(spots) if not less and not shift]
    keys = [F.struct(F.col(f"k{i}").alias("key"), F.lit(i in own).alias("own")) for i in range(len(spots))]
    entries = distinct.select("h", F.explode(F.array(*keys)).alias("e")).select("e.key", "h", "e.own").where("key IS NOT NULL")
    entered = distinct.select("h", F.explode(F.array(*[f"k{i}" for i in own])).alias("key")).where("key IS NOT NULL")
    groups = entered.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n"))
    met = entries.join(groups, "key").where("low < high OR low <> h")
    u = F.shiftrightunsigned(F.xxhash64("h", F.lit("block")), 11) / float(1 << 53) * F.col("n")
    block = F.when(u < 1, 0).otherwise(F.floor(F.log2(u) / GROWTH) + 1).cast("int")
    return met.select("key", "h", "own", F.when(F.col("own"), block).alias("block"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))


def with_text(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, line) of the wanted lines (h); a sieve keeps most others out of the shuffle that finds them."""
    lines = lines_of(docs, id_col, text_col).select(F.xxhash64("line").alias("h"), "line")
    passed = sieved(lines, F.col("h"), wanted, "h").where("_hit").select("h", "line")
    # wanted hashes are distinct; a semi join would be pushed before the sieve
    return passed.join(wanted, "h").groupBy("h").agg(F.first("line").alias("line"))


def _as(texts: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return texts.select(F.col("h").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _single_links(met: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """(a, b): links of lines with the only one that is entered under a key of theirs."""
    pairs = met.where("only IS NOT NULL").select(F.least("h", "only").alias("a"), F.greatest("h", "only").alias("b")).distinct()
    for name in ("a", "b"):
        pairs = pairs.join(_as(texts, name, ["c0", "c1"]), name)
    pairs = materialize(pairs.where(_may_match("a_", "b_", t)).select("a", "b"), "pairs")
    for name in ("a", "b"):
        pairs = pairs.join(_as(texts, name, ["line"]), name)
    return pairs.where(linked("a_line", "b_line", t)).select("a", "b")


def _block_links(rows: DataFrame, block: int, t: int) -> DataFrame:
    """(a, b): links between classes (root) that lines of a block make with those that probe their keys.

    rows: key, h, own, block, line, c0, c1, root, size (of the key's group). The rows of a large group are dealt
    into parts, and the block's lines go to each part. Only what is verified leaves the join.
    """
    parts = F.floor(F.col("size") / PART_ROWS).cast("int")
    columns = ["root", "c0", "c1", "line"]
    part = F.pmod(F.xxhash64("h"), parts + 1).cast("int")
    probing = rows.select("key", part.alias("part"), *[F.col(c).alias(f"b_{c}") for c in columns])
    entered = rows.where(F.col("own") & (F.col("block") == block)).select("key", F.explode(F.sequence(F.lit(0), parts)).alias("part"), *[F.col(c).alias(f"a_{c}") for c in columns])
    met = probing.join(entered, ["key", "part"]).where((F.col("a_root") != F.col("b_root")) & _may_match("a_", "b_", t) & linked("a_line", "b_line", t))
    return met.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()


def classes(docs: DataFrame, distinct: DataFrame, t: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root): the class of each line that is linked to another one; its hash and that of the class's first node."""
    met = materialize(met_entries(distinct, t), "met")
    wanted = materialize(met.select("h").union(met.where("only IS NOT NULL").select("only")).distinct(), "wanted")
    texts = with_text(docs, wanted, id_col, text_col)
    texts = materialize(texts.select("h", "line", *_counts(F.col("line"))), "lines")
    roots = materialize(components(_single_links(met, texts, t).union(short_links(docs, id_col, text_col))), "roots")
    left, block = met.where("only IS NULL").select("key", "h", "own", "block").join(texts, "h"), 0
    held = None
    while True:
        now = left.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        now = now if block else materialize(now, "rooted")
        groups = now.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("block").alias("last"))
        live = groups.where((F.col("low") < F.col("high")) & (F.col("last") >= block)).select("key", "size")
        rows = materialize(now.join(live, "key"), "live")
        if rows.isEmpty():
            return roots
        found = materialize(_block_links(rows, block, t), "links")
        if not found.isEmpty():
            merged = materialize(components(found), "merged")
            kept = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
            roots = materialize(kept.union(merged.join(roots, "node", "left_anti")), "roots")
        drop_scratch(held or now)
        held, left, block = rows, rows.drop("root", "size"), block + 1


def dedup_lines(docs: DataFrame, t: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, class_size, kept), one row for each line that holds a word.

    A class is what links join, directly or through others, so no link leads out of it; it is named by its first
    line in the order of id (null ids last) and line number, and that line is kept. class_size counts its different
    lines. Lines are parted by line feeds, numbered from 0, and compared as they are; blank lines are in no class
    and not returned. Lines of fewer than five characters are linked only to equal ones or, if of four, to longer
    ones by one edit: the rule of LIKENESS allows no more. Null and empty texts have no lines. The rows of a
    repeated document id are told apart by nothing else, so both keep a line that is first. An empty table gives
    an empty frame. Other columns are ignored, whatever their names.
    """
    if not 1 <= t <= 4:
        raise ValueError("t must be 1 to 4: the lines under ten characters that longer ones probe have no more segments")
    distinct = materialize(distinct_lines(docs, t, id_col, text_col), "distinct")
    found = classes(docs, distinct, t, id_col, text_col)
    drop_scratch(distinct)
    occurrences = materialize(lines_of(docs, id_col, text_col).select("doc_id", "line_no", F.xxhash64("line").alias("h")), "occurrences")
    places = first_places(occurrences)
    of_class = materialize(found.withColumnRenamed("node", "h").join(places, "h"), "linked")
    by_place = F.struct(F.col("first_doc").isNull().alias("n"), "first_doc", "first_line")
    names = of_class.groupBy("root").agg(F.min_by(F.struct("first_doc", "first_line"), by_place).alias("name"), F.count("*").alias("class_size"))
    known = of_class.join(names, "root").select("h", "class_size", "name")
    name = F.coalesce("name", F.struct("first_doc", "first_line"))
    # one row a line, written before the last join: Spark can then split the rows of a very common line over tasks
    info = materialize(places.join(known, "h", "left").select("h", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), name.alias("name")), "info")
    rows = occurrences.join(info, "h")
    kept = F.col("name.first_doc").eqNullSafe(F.col("doc_id")) & (F.col("name.first_line") == F.col("line_no"))
    return rows.select("doc_id", "line_no", F.col("name.first_doc").alias("class_doc_id"), F.col("name.first_line").alias("class_line_no"), "class_size", kept.alias("kept"))


def drop_lines(docs: DataFrame, t: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, their texts without the lines that dedup_lines() doesn't keep. Ids must be distinct and not null."""
    gone = dedup_lines(docs, t, id_col, text_col).where("NOT kept").groupBy("doc_id").agg(F.collect_list("line_no").alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    whole = docs.select(F.struct("*").alias("_d")).join(gone, F.col("_d")[id_col] == F.col("_gone_id"), "left")
    left = F.array_join(F.filter(F.split(F.col("_d")[text_col], "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_d")[text_col]).otherwise(left)
    return whole.select(*[text.alias(c) if c == text_col else F.col("_d")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
