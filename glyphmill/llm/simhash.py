"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a binary trie.

Each distinct fingerprint enters four tries, one per 16-bit block rotated to the top. Two fingerprints
within three bits agree on one whole block, so each trie is entered with no error allowed in its top 16
levels: the subtrees below those levels are the units of distribution. Inside a task all its subtrees are
walked together, pairs of nodes at a time: a pair goes to its children's pairs, a differing bit adds to the
pair's count, and pairs over the budget are dropped. Matches are merged into classes as they appear, and a
pair of nodes already of one class is dropped too, so a dense group costs links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from glyphmill.llm.common import components, materialize, partitions, sieved, table, utf8

BITS, BLOCK = 64, 16
#: A subtree with more fingerprints than this is dealt again by the blocks below its root.
SUBTREE = 500_000
#: Node pairs that are walked at once.
CHUNK = 1 << 18
#: Fingerprints that a task holds before it walks the subtrees that they make up.
HELD = 1 << 20


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    """Signed 64-bit form of fingerprint()."""
    return pa.array(np.array([fingerprint(t) for t in utf8(text)], dtype=np.uint64).view(np.int64))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Give the classes of a[i] and b[i] one label, the smallest; whether anything changed."""
    changed = False
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return changed
        changed = True
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_classes(keys: np.ndarray, budget: int, top: int) -> np.ndarray:
    """For sorted distinct uint64 keys: for each, the index of the first key of its class.

    Links are pairs that agree in their first `top` bits and differ in `budget` bits at most.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] >> np.uint64(BITS - top)) != (keys[:-1] >> np.uint64(BITS - top))))) if top else np.array([0])
    last = np.append(first[1:], n)
    wide = last - first > 1
    # a frontier: node [lo, hi) against node [lo2, hi2) at a depth, with the bits that differ above it
    stack = [(top, first[wide], last[wide], first[wide], last[wide], np.zeros(wide.sum(), np.int8))]
    steps, prune = None, True
    while stack:
        depth, lo, hi, lo2, hi2, err = stack.pop()
        if len(lo) > CHUNK:
            half = len(lo) // 2
            stack += [(depth, lo[:half], hi[:half], lo2[:half], hi2[:half], err[:half]), (depth, lo[half:], hi[half:], lo2[half:], hi2[half:], err[half:])]
            continue
        if prune or steps is None:
            steps, prune = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))), False
        one = (label[lo] == label[lo2]) & (steps[lo] == steps[hi - 1]) & (steps[lo2] == steps[hi2 - 1])
        area = (hi - lo) * (hi2 - lo2)
        if depth == BITS:
            go, leaf = np.zeros(len(lo), bool), ~one
        else:
            leaf = ~one & (area <= 64)
            go = ~one & ~leaf
        if leaf.any():
            idx = np.flatnonzero(leaf)
            for part in np.array_split(idx, max(1, int(area[idx].sum()) // (4 * CHUNK))):
                k = area[part]
                at = np.repeat(part, k)
                off = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                w = (hi2 - lo2)[at]
                i, j = lo[at] + off // w, lo2[at] + off % w
                ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                prune |= _merge(label, i[ok], j[ok])
        if not go.any():
            continue
        lo, hi, lo2, hi2, err = (x[go] for x in (lo, hi, lo2, hi2, err))
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        high = ~(bit | (bit - np.uint64(1)))

        def middle(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(keys, (keys[start] & high) | bit), start, end)

        m, m2, same = middle(lo, hi), middle(lo2, hi2), lo == lo2
        kids = [
            (lo, m, lo2, m2, err, None),
            (m, hi, m2, hi2, err, None),
            (lo, m, m2, hi2, err + 1, None),
            (m, hi, lo2, m2, err + 1, ~same),
        ]
        parts = []
        for a, b, c, d, e, only in kids:
            keep = (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a == 1))
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (a, b, c, d, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return label


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    by %= BITS
    return (x << np.uint64(by)) | (x >> np.uint64(BITS - by)) if by else x


def _join_subtrees(budget: int):
    """mapInArrow function: rows (rot int, sub int, block int, below int, fp long) of whole subtrees, in this order -> (a, b) links to class firsts."""

    def walk(rot: int, sub: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        turn = _second_level(12 * sub) if sub >= 0 else (lambda k: k)
        back = _second_level(48 - 12 * sub) if sub >= 0 else (lambda k: k)
        keys = np.unique(turn(_rotate(fp, BLOCK * rot)))
        label = trie_classes(keys, budget, BLOCK + 12 * (sub >= 0))
        hit = np.flatnonzero(label != np.arange(len(keys)))
        if len(hit):
            ends = [pa.array(_rotate(back(k), BITS - BLOCK * rot).view(np.int64)) for k in (keys[hit], keys[label[hit]])]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def walk_all(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both = rows[0].astype(np.int64) * 64 + rows[1] + 1
        for k in np.unique(both):
            yield from walk(int(k) // 64, int(k) % 64 - 1, np.ascontiguousarray(rows[4][both == k]).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            if sum(len(h[0]) for h in held) >= HELD:  # all but the last subtree, which may go on
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from walk_all([c[:cut] for c in rows])
                held = [[c[cut:] for c in rows]]
        if held:
            yield from walk_all([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _second_level(by: int):
    """A function that rotates the 48 bits below the root block left by `by`, in place."""
    by %= 48
    body = np.uint64((1 << (BITS - BLOCK)) - 1)

    def turn(x: np.ndarray) -> np.ndarray:
        low = x & body
        return (x & ~body) | (((low << np.uint64(by)) | (low >> np.uint64(48 - by))) & body) if by else x

    return turn


def links(fingerprints: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b: long) that join the distinct fingerprints (column fp: long) into their classes.

    Any pair within `budget` bits (at most 3) is connected by the links; there are fewer links than four per
    fingerprint. A subtree of more than `subtree` fingerprints is entered again through each of four 12-bit
    blocks of its other 48 bits, one of which two fingerprints within three bits share.
    """
    if not 0 <= budget <= 3:
        raise ValueError("budget must be 0 to 3: four blocks guarantee one equal block for 3 differing bits")
    spark = fingerprints.sparkSession
    rows = fingerprints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(BITS // BLOCK)])).alias("rot"))
    rows = rows.withColumn("block", F.expr(f"cast(shiftrightunsigned(shiftleft(fp, rot * {BLOCK}), {BITS - BLOCK}) as int)"))
    crowded = rows.groupBy("rot", "block").count().where(F.col("count") > subtree).select("rot", "block", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["rot", "block"], "left")
    # the 48 bits below the root; for rot = 0 the JVM takes a shift by 64 as one by 0
    rest = f"shiftleft(shiftleft(fp, rot * {BLOCK}) | shiftrightunsigned(fp, 64 - rot * {BLOCK}), {BLOCK})"
    rows = rows.withColumn("sub", F.explode(F.expr("if(crowded, array(0, 1, 2, 3), array(-1))")))
    rows = rows.withColumn("below", F.expr(f"if(sub < 0, -1, cast(shiftrightunsigned(shiftleft({rest}, 12 * sub), 52) as int))"))
    keys = ["rot", "sub", "block", "below"]
    rows = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).select("rot", "sub", F.col("block").cast("int").alias("block"), "below", "fp")
    return rows.mapInArrow(_join_subtrees(budget), "a long, b long")


def classes(docs: DataFrame, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", subtree: int = SUBTREE) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows has id, fp and row_hash (of the text) of every document; roots (fp, root, component_id).

    Every row has a fingerprint: null, empty and wordless texts have 0 and link like any other. Repeated rows
    keep their own row. component_id is the smallest id of the class, null only if the class has no id. An empty
    table gives empty frames. Other columns of docs are ignored, whatever their names.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp"), F.xxhash64(F.col(text_col)).alias("row_hash")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    distinct = materialize(distinct, "distinct")
    comp = components(links(distinct.select("fp"), budget, subtree))
    roots = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows, roots.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id), one row per document."""
    rows, roots = classes(docs, budget, id_col, text_col)
    return rows.join(roots, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id (null ids last, then by text hash).

    All columns stay. Of rows that repeat id and text, the one stays whose other columns have the smallest hash.
    Null, empty and wordless texts are one class, as their fingerprint is zero. An empty table stays empty.
    """
    rows, roots = classes(docs, budget, id_col, text_col)
    here = F.xxhash64("id", "row_hash")
    key = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), "row_hash")
    per_row = rows.groupBy("fp", "id", "row_hash").agg(F.count("*").alias("n_rows"))
    best = per_row.join(roots, "fp").groupBy("root").agg(F.min_by(F.struct("id", "row_hash", "n_rows"), key).alias("k")).select("k.*")
    best = materialize(best.select(F.col("id").alias("_id"), F.col("row_hash").alias("_hash"), F.col("n_rows").alias("_rows")), "best")
    # most rows are the only one of their class: a row that is neither dropped nor repeated stays without a join
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
    unsure = per_row.join(best.where("_rows = 1"), same, "left_anti").select(here.alias("h"))
    whole = docs.select(F.struct("*").alias("d"))
    met = sieved(whole, F.xxhash64(F.col("d")[id_col], F.xxhash64(F.col("d")[text_col])), materialize(unsure, "unsure"), "h")
    sure = met.where("NOT _hit").select("d.*")
    kept = met.where("_hit").join(best, F.col("d")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("d")[text_col]) == F.col("_hash")))
    several = kept.where("_rows > 1").groupBy("_id", "_hash").agg(F.min_by("d", F.xxhash64(F.to_json("d"))).alias("d"))
    return sure.union(kept.where("_rows = 1").select("d.*")).union(several.select("d.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
