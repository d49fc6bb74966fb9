"""Sharding by minimax contiguous partition.

Documents with equal texts are one group, never split. Groups stand in the order of their text's hash, and the
shards are contiguous runs of them such that the largest shard is as small as any such cut can make it. That
capacity is found by binary search; a check walks the group sizes greedily, filling each shard while it holds.

The walk needs only the groups near the cuts. The driver keeps cells, ranges of hashes with their bytes: 4096
at first. Bounds on the capacity bound each cut, and the few cells that a cut may lie in are divided by 4096
again until they are single groups. So the driver holds some ten thousand cells, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, table

SHARDS, STEP = 8, 12
#: Rows are numbered within cells of a shard: so many ranges of hashes times so many salts of the id.
RANGES, SALTS = 1024, 64


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts (indices after each shard's last group) that hold capacity, or None. ends: running sums of sizes."""
    cuts, at, n = [], 0, len(ends)
    for _ in range(shards):
        at = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + capacity, "right"))
        cuts.append(at)
    return cuts if at == n else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Of all cuts of sizes into contiguous shards, the least size of the largest shard."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, shards) else (mid + 1, high)
    return low


def _bucket(down: int) -> Column:
    """The upper bits of the hash, which stands for an unsigned number."""
    return F.shiftrightunsigned("h", down)


def cut_points(groups: DataFrame, shards: int, largest: int) -> list[int]:
    """The first hash (as an unsigned number) of shards 1 to shards - 1. groups: (h: long, bytes) by text hash."""
    cells: dict[tuple[int, int], int] = {}  # (first hash, bits that are fixed): bytes
    sums = groups.groupBy(_bucket(64 - STEP).alias("b")).agg(F.sum("bytes").alias("n"), F.count("*").alias("k")).collect()
    single: set[int] = set()

    def put(rows: list, bits: int) -> None:
        for r in rows:
            start = (int(r.b) << (64 - bits)) % (1 << 64)
            cells[start, bits] = r.n
            if r.k == 1 or bits >= 64:
                single.add(start)

    put(sums, STEP)
    while True:
        order = sorted(cells)
        sizes = np.array([cells[c] for c in order], dtype=np.int64)
        if not len(sizes):
            return []
        ends = np.cumsum(sizes)
        high = smallest_capacity(sizes, shards)  # whole cells can hold it, so groups can
        low = max(largest, -(-int(ends[-1]) // shards))
        # where each shard can end: with the least capacity and all cells divided, and with the most
        least, most, wide = 0, 0, set()
        for _ in range(shards):
            lo_cell = int(np.searchsorted(ends, least + low, "right"))
            hi_cell = int(np.searchsorted(ends, most + high, "right"))
            wide |= set(range(lo_cell, min(hi_cell + 1, len(order))))
            least = int(ends[lo_cell - 1]) if lo_cell else 0
            most = min(most + high, int(ends[-1]))
        split = [order[i] for i in sorted(wide) if order[i][0] not in single]
        if not split:
            break
        for bits in sorted({b for _, b in split}):
            own = [s >> (64 - bits) for s, b in split if b == bits]
            rows = groups.where(_bucket(64 - bits).isin([x - (1 << bits) if bits == 64 and x >= 1 << 63 else x for x in own]))
            found = rows.groupBy(_bucket(max(0, 64 - bits - STEP)).alias("b")).agg(F.sum("bytes").alias("n"), F.count("*").alias("k")).collect()
            for x in own:
                del cells[x << (64 - bits), bits]
            put(found, min(64, bits + STEP))
    cuts = greedy(ends, high, shards)
    return [order[c][0] if c < len(order) else 1 << 64 for c in cuts[:-1]]


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def _cuts(sized: DataFrame, shards: int) -> list[int]:
    groups = materialize(sized.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    return cut_points(groups, shards, largest)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, h, shard, slot) for every row: size is the text's UTF-8 bytes plus 1.

    Null texts count as empty ones. Rows with equal texts, repeated rows too, are in one shard; slots number
    each shard's rows from 0 without gaps. Shards behind the last group stay empty. An empty table gives an
    empty frame. Other columns are ignored, whatever their names.
    """
    sized = materialize(_keyed(docs, id_col, text_col), "sizes")
    placed = _placed(sized, _cuts(sized, shards))
    return _slots(placed, placed)


def _placed(rows: DataFrame, firsts: list[int]) -> DataFrame:
    """rows with their shard: the number of cuts at or below their hash."""
    place = F.lit(0)
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # compares as the unsigned hash does
    for first in firsts:
        if first < 1 << 64:
            place = place + (unsigned >= F.lit(first - (1 << 63))).cast("int")
    return rows.withColumn("shard", place.cast("int"))


def _slots(placed: DataFrame, counted: DataFrame) -> DataFrame:
    """Number the rows of each shard: within cells of it, on top of the counts of the cells before.

    A cell takes a range of hashes and a salt of the id, so the rows of one large group are dealt out too. The
    counts, over `counted`, the same rows without their texts, are at most RANGES * SALTS plus the cuts.
    """
    cell = (F.shiftrightunsigned("h", 64 - 10) * SALTS + F.pmod(F.xxhash64("id"), F.lit(SALTS))).cast("int")
    counts = counted.groupBy("shard", cell.alias("cell")).count()
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy("h", "id", "size")) - 1
    return placed.withColumn("cell", cell).withColumn("n", number).join(offsets, ["shard", "cell"]).withColumn("slot", F.col("offset") + F.col("n")).drop("n", "offset", "cell")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with size, text_crc32, shard and slot.

    A column of docs with such a name keeps its place; the new one then has trailing underscores, as many as
    make its name a new one. Null texts count as empty ones, rows with equal texts go together, an empty table
    stays empty.
    """
    sized = materialize(_keyed(docs, id_col, text_col), "sizes")
    cuts = _cuts(sized, shards)
    whole = _keyed(docs, id_col, text_col, F.struct("*").alias("d"))
    rows = _slots(_placed(whole, cuts), _placed(sized, cuts))  # the texts move once
    extra = ("size", "text_crc32", "shard", "slot")
    names, taken = [], set(docs.columns)
    for name in extra:
        while name in taken:
            name += "_"
        names.append(name)
        taken.add(name)
    return rows.select("d.*", *[F.col(c).alias(n) for c, n in zip(extra, names, strict=True)])
