"""Benchmark decontamination by winnowing.

A fingerprint is the smallest k-gram hash in a sliding window of hashes (each of equal smallest ones). With
k = 5 and windows of 9 hashes, any 13 words that a document shares with a benchmark item hold a k-gram that
both sides selected, so joining the two sets of fingerprints misses no shared span of 13 words. Each joined
fingerprint is extended word by word on both sides, and a span that reaches 13 words is a hit. Items of
fewer than 13 words have no full window; they are looked up whole, by the hash of all their words.

A benchmark of at most BLOCK_WORDS words is one block of arrays that goes to all tasks, and the documents meet its
fingerprints where they lie. For a larger one both sides' fingerprints are joined by a shuffle: the fingerprints
that match tell which windows of a text to look up among the benchmark's, and only windows that occur remain. Its
items of fewer than 13 words still go over in blocks. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F, types as T

from glyphmill.llm.common import dealt_table, materialize, table, utf8

WINDOW, K = 13, 5
BLOCK_WORDS = 2_000_000
#: Words of documents that are matched at once.
SLICE_WORDS = 1 << 20
#: Fingerprint hits that are extended at once.
HITS = 1 << 19

#: A-Z to a-z; digits, a-z and everything beyond ASCII stay; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
END = 0xFFFFFFFF  # stands between items; no word has it
TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads word numbers over 64 bits."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed, out = _mix(ids.astype(np.uint64)), np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + mixed[i : i + n]
    return _mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of hashes that are the smallest of some window of `window` hashes, ties included."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = hashes[:n].copy()
    for i in range(1, window):
        np.minimum(low, hashes[i : i + n], out=low)
    # a hash is selected if the largest of the minima of the windows over it is the hash itself
    best = np.zeros(len(hashes), np.uint64)
    for i in range(window):
        np.maximum(best[i : i + n], low, out=best[i : i + n])
    return np.flatnonzero(best == hashes)


class Block:
    """Fingerprints of some benchmark items: what a task needs to match documents with them."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names, self.sizes = [name for name, _ in items], [len(w) for _, w in items]
        self.vocabulary: dict[bytes, int] = {}
        seq, owner, prints = [np.array([END], np.int64)], [np.array([-1])], []
        at, short = 1, {}
        for i, (_, w) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
            if len(ids) >= WINDOW:
                prints.append(winnow(gram_hashes(ids, K), WINDOW - K + 1) + at)
            else:
                short.setdefault(len(ids), []).append(at)
            seq += [ids, np.array([END], np.int64)]
            owner.append(np.full(len(ids) + 1, i))
            at += len(ids) + 1
        pad = np.full(WINDOW, END, np.int64)  # so that an extension never leaves the array
        self.seq = np.concatenate([*seq, pad])
        self.owner = np.concatenate(owner)
        self.long = self._table(np.concatenate(prints) if prints else np.empty(0, np.int64), K)
        self.short = {n: self._table(np.array(starts), n) for n, starts in short.items()}

    def _table(self, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-grams at starts, sorted, and the starts in that order."""
        mixed, h = _mix(self.seq.astype(np.uint64)), np.zeros(len(starts), np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + mixed[starts + i]
        h = _mix(h)
        order = np.argsort(h, kind="stable")
        return h[order], starts[order]

    def match(self, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Raise marks (a difference array) over the hit words; give (document word, item) pairs of hits.

        ids: word numbers of documents, END between and around them, WINDOW of it at the end at least.
        """
        for k, (hashes, starts) in [(K, self.long), *self.short.items()]:
            if not len(starts):
                continue
            grams = gram_hashes(ids, k)
            known = np.cumsum(np.concatenate(([0], (ids == 0) | (ids == END))))
            at = winnow(grams, WINDOW - K + 1) if k == K and starts is self.long[1] else np.arange(len(grams))
            at = at[known[at + k] == known[at]]
            lo, hi = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            whole = starts is not self.long[1]
            total = np.cumsum(hi - lo)
            cut = 0
            while cut < len(at):
                to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + HITS, "right")))
                n = (hi - lo)[cut:to]
                p = np.repeat(at[cut:to], n)
                q = starts[np.repeat(lo[cut:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                cut = to
                ok = np.ones(len(p), bool)
                for i in range(k):
                    ok &= ids[p + i] == self.seq[q + i]
                p, q = p[ok], q[ok]
                left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                if not whole:
                    going = np.ones(len(p), bool)
                    for i in range(1, WINDOW - K + 1):
                        going &= (p >= i) & (q >= i)
                        going &= (ids[np.maximum(p - i, 0)] == self.seq[np.maximum(q - i, 0)]) & (ids[np.maximum(p - i, 0)] != END)
                        left += going
                    going = np.ones(len(p), bool)
                    for i in range(WINDOW - K):
                        going &= (ids[p + k + i] == self.seq[q + k + i]) & (ids[p + k + i] != END)
                        right += going
                    full = left + right >= WINDOW - K
                    p, q, left, right = p[full], q[full], left[full], right[full]
                np.add.at(marks, p - left, 1)
                np.add.at(marks, p + k + right, -1)
                pairs = np.unique(np.stack([p, self.owner[q]]), axis=1)
                yield pairs[0], pairs[1]


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of at most block_words words (or of one item).

    Rows without words are left out; an item id of null counts as the empty string. Rows that repeat an id
    are one item.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")).where("text IS NOT NULL")
    items, n = [], 0
    for r in rows.toLocalIterator():
        if w := words(r.text.encode("utf-8", "surrogatepass")):
            if items and n + len(w) > block_words:
                yield Block(items)
                items, n = [], 0
            items.append((r.item, w))
            n += len(w)
    if items:
        yield Block(items)


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    out, n = [], 0
    for t in texts:
        out.append(words(t))
        n += len(out[-1])
        if n >= SLICE_WORDS:
            yield out
            out, n = [], 0
    if out:
        yield out


def _scan(docs: list[list[bytes]], blocks: list) -> list[tuple[int, int, list[str]]]:
    sizes = np.array([len(w) for w in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # an END before each document
    length = int(sizes.sum()) + len(docs) + WINDOW + 1
    marks = np.zeros(length + 1, np.int32)
    found: dict[int, set[str]] = {}
    for b in blocks:
        block = b.value
        ids, get = np.full(length, END, np.int64), block.vocabulary.get
        for s, w in zip(starts.tolist(), docs, strict=True):
            ids[s : s + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        for at, item in block.match(ids, marks):
            pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, item]), axis=1)
            for d, i in pairs.T.tolist():
                found.setdefault(d, set()).add(block.names[i])
        if len(blocks) > 1:  # one block at a time is held
            b.__dict__.pop("_value", None)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(marks) > 0)))
    hit = covered[starts + sizes] - covered[starts]
    return [(int(n), int(h), sorted(found.get(i, ()))) for i, (n, h) in enumerate(zip(sizes, hit, strict=True))]


def overlap_udf(spark: SparkSession, benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Column function text -> struct(n_words, n_hit, items): items in string order."""
    blocks = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, block_words)]

    @F.arrow_udf(TYPE)
    def overlap(text: pa.Array) -> pa.Array:
        rows = [r for s in _slices(utf8(text)) for r in _scan(s, blocks)]
        n, h, items = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["n_words", "n_hit", "items"])

    return overlap


CONTAMINATED = "o.n_hit > 0 AND 20 * o.n_hit >= o.n_words"


@F.arrow_udf(T.LongType())
def n_words_udf(text: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for t in utf8(text)], pa.int64())


def is_small(benchmark: DataFrame, block_words: int) -> bool:
    return (benchmark.agg(F.sum(n_words_udf("text"))).first()[0] or 0) <= block_words


def _hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    found = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def _prints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's fingerprints."""
    grams = gram_hashes(ids, K)
    at = winnow(grams, WINDOW - K + 1)
    return grams[at].view(np.int64), at


def _doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (text, _text) -> (text, print), each once."""
    for b in batches:
        found = [np.unique(_prints(_hashes(t))[0]) for t in utf8(b.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(f) for f in found])), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["text", "print"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (item, text) -> (window, print, item) of items with full windows: each window, with a fingerprint inside it."""
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            ids = _hashes(text)
            if len(ids) < WINDOW:
                continue
            grams, whole = gram_hashes(ids, K), gram_hashes(ids, WINDOW).view(np.int64)
            low = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - K + 1).min(1).view(np.int64)
            rows = np.unique(np.stack([whole, low], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array([item] * len(rows))], ["window", "print", "item"])


def _near_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (text, _text, prints) -> (text, pos, window): the windows over places of these prints."""
    for b in batches:
        for name, text, known in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            ids = _hashes(text)
            prints, at = _prints(ids)
            at = at[np.isin(prints, np.array(known, np.int64))]
            n = len(ids) - WINDOW + 1
            pos = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).ravel())
            pos = pos[(pos >= 0) & (pos < n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), name)), pa.array(pos), pa.array(gram_hashes(ids, WINDOW)[pos].view(np.int64))], ["text", "pos", "window"])


def _short_hits(blocks: list):
    """mapInArrow function: (text, _text) -> (text, pos, stop, item) of the places of the blocks' items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                w = words(text)
                for held in blocks:
                    block = held.value
                    ids = np.full(len(w) + WINDOW + 2, END, np.int64)
                    ids[1 : len(w) + 1] = np.fromiter((block.vocabulary.get(x, 0) for x in w), np.int64, len(w))
                    marks = np.zeros(len(ids) + 1, np.int32)
                    for at, item in block.match(ids, marks):
                        rows += [(name, p - 1, p - 1 + block.sizes[i], block.names[i]) for p, i in zip(at.tolist(), item.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, [pa.int64()] * 3 + [pa.string()], strict=True)], ["text", "pos", "stop", "item"])

    return run


def joined_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(text: xxhash64 of the text, n_hit, items) of the texts that hold windows of the benchmark, by a join of fingerprints."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text"), F.col(text_col).alias("_text"))
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = materialize(items.mapInArrow(_item_windows, "window long, print long, item string"), "windows")
    short = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark.where(n_words_udf("text") < WINDOW), block_words)]
    with dealt_table(rows.dropDuplicates(["text"]), "text") as texts:
        met = texts.mapInArrow(_doc_prints, "text long, print long").join(windows.select("print").distinct(), "print", "left_semi")
        near = texts.join(met.groupBy("text").agg(F.collect_list("print").alias("prints")), "text").select("text", "_text", "prints")
        near = near.mapInArrow(_near_windows, "text long, pos long, window long")
        found = materialize(near.join(windows.select("window").distinct(), "window", "left_semi"), "found")
        few = materialize(texts.mapInArrow(_short_hits(short), "text long, pos long, stop long, item string"), "short") if short else None
    places = found.select("text", "pos", (F.col("pos") + WINDOW).alias("stop"))
    named = found.select("text", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("text", "item")
    if few is not None:
        places, named = places.union(few.select("text", "pos", "stop")), named.union(few.select("text", "item"))
    before = F.max("stop").over(W.partitionBy("text").orderBy("pos", "stop").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("pos"), F.coalesce(before, F.lit(0))))
    hit = places.distinct().withColumn("new", new).groupBy("text").agg(F.sum("new").alias("n_hit"))
    return hit.join(named.distinct().groupBy("text").agg(F.array_sort(F.collect_list("item")).alias("items")), "text")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) for every document, repeated rows included.

    Null, empty and wordless texts have no words and are clean. An empty benchmark hits nothing. Other columns
    of docs are ignored, whatever their names.
    """
    if not is_small(benchmark, block_words):
        per_text = joined_overlaps(docs, benchmark, text_col, block_words).withColumnRenamed("text", "_t")
        rows = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("_t"), n_words_udf(text_col).alias("n_words")).join(per_text, "_t", "left")
        n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
        rows = rows.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
        return rows.withColumn("contaminated", F.expr(CONTAMINATED.replace("o.", "")))
    udf = overlap_udf(docs.sparkSession, benchmark, block_words)
    out = docs.select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("o"))
    return out.select(F.col("id").alias(id_col), "o.n_words", "o.n_hit", F.size("o.items").cast("long").alias("n_items"), "o.items", F.expr(CONTAMINATED).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the contaminated documents.

    Null, empty and wordless texts are clean; repeated rows stay or go together; an empty table stays empty, and an
    empty benchmark takes nothing. Other columns go along, whatever their names.
    """
    if not is_small(benchmark, BLOCK_WORDS):
        dirty = overlaps(docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("x")), benchmark, "t", "x").where("contaminated").select(F.col("t").alias("_t")).distinct()
        return docs.select(F.struct("*").alias("d")).join(dirty, F.xxhash64(F.col("d")[text_col]) == F.col("_t"), "left_anti").select("d.*")
    udf = overlap_udf(docs.sparkSession, benchmark)
    whole = docs.select(F.struct("*").alias("d")).withColumn("o", udf(F.col("d")[text_col]))
    return whole.where(f"NOT ({CONTAMINATED})").select("d.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, p, n, item FROM places JOIN windows USING (n, gram)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
