"""Token ids on disk: blocks of concatenated ids with Elias-Fano encoded document boundaries.

A store is a folder of Parquet files of blocks, in ascending document order by (part, seq). A block holds up to
about BLOCK_TOKENS ids, its ids as little-endian 16- or 32-bit numbers and the n + 1 boundaries of its n
documents as an Elias-Fano sequence: the low bits of each boundary packed, the high bits in unary, 2 + log2(ids
per document) bits a document in all, and a directory of every 256th, from which select() reads values without
decoding those before. The documents' own ids, ascending too, are a second such sequence, less the first of them;
null ids come first and are only counted. Offsets in the whole store are a block's own plus the ids of the blocks
before it, and those come from a manifest of one small row per block.

Blocks are written by Spark's writers, so a task that is lost leaves nothing behind and is run again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import scratch_path, table

BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 1 << 16
END_ID = 2
#: Words whose ids a worker keeps; beyond that it starts afresh.
CACHED_WORDS = 1_200_000
#: Signs that may follow a plain word, none of which the tokenizer's pattern treats by itself.
POINTS = ".,;:!?*#$%&|"
BEYOND_LATIN, SEPARATORS = re.compile("[\u0250-\U0010ffff]"), re.compile("[\x1c-\x1f]")
NOT_SPACE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class EliasFano:
    """A non-decreasing sequence of numbers below 2^64 in near-minimal space, with random access.

    The directory holds, for every SAMPLED-th value, the byte of the high bits that its one is in and the ones
    before that byte, as 32-bit numbers.
    """

    SAMPLED = 256

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        raw = np.packbits(high, bitorder="little")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)))
        byte = ones[:: cls.SAMPLED] // 8
        directory = np.stack([byte, before[byte]], 1).astype("<u4")
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), raw.tobytes(), directory.tobytes())

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        at = first * self.low_bits
        raw = np.frombuffer(self.low, np.uint8)[at // 8 : (at + count * self.low_bits + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[at % 8 :][: count * self.low_bits].reshape(count, self.low_bits)
        out = np.zeros(count, np.uint64)
        for k in range(self.low_bits):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Values first to first + count - 1, read from the directory's last entry before them on; nothing else is decoded."""
        if not 0 <= first <= first + count <= self.n:
            raise IndexError(first)
        if not count:
            return np.empty(0, np.uint64)
        marks = np.frombuffer(self.directory, "<u4").reshape(-1, 2)
        byte, ones = (int(x) for x in marks[first // self.SAMPLED])
        end = (first + count - 1) // self.SAMPLED + 1
        stop = int(marks[end][0]) + 1 if end < len(marks) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[byte:stop], bitorder="little")
        at = np.flatnonzero(bits)[first - ones :][:count] + 8 * byte
        return ((at - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(first, count)


#: An Elias-Fano sequence's columns in a block, by a prefix.
def _fields(prefix: str) -> str:
    return f"{prefix}_bits int, {prefix}_low binary, {prefix}_high binary, {prefix}_directory binary"


def _put(prefix: str, ef: EliasFano) -> dict:
    return {f"{prefix}_bits": ef.low_bits, f"{prefix}_low": ef.low, f"{prefix}_high": ef.high, f"{prefix}_directory": ef.directory}


def _get(row: dict, prefix: str, n: int) -> EliasFano:
    return EliasFano(n, *(row[f"{prefix}_{c}"] for c in ("bits", "low", "high", "directory")))


BLOCK_SCHEMA = f"part int, seq int, n_docs int, n_tokens long, width int, n_null int, first_id long, {_fields('doc')}, {_fields('bound')}, ids binary"


class Encoder:
    """Ids of texts. White space separates the tokenizer's words, so ids are looked up by word.

    A new word goes to the tokenizer once. Plain words (letters of the Latin blocks only) are sent many in one
    string and told apart by the vocabulary's word ends; the POINTS after a plain word are a word of their own to
    the tokenizer. All others are sent one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.points: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Of plain words: one string, parted behind each id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._alone(words)
        raw, at = ids.tobytes(), [0, *(ends * self.width).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def learn(self, words: set[str]) -> None:
        """Put words (lower-cased where that is safe) into the cache."""
        plain, odd, pointed = set(), [], []
        for w in words:
            core = w.rstrip(POINTS)
            if core.isalpha() and (core.isascii() or not BEYOND_LATIN.search(core)):
                if len(core) < len(w):
                    pointed.append((w, core))
                if core not in self.cache:
                    plain.add(core)
            else:
                odd.append(w)
        plain = list(plain)
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            self.cache.update(zip(part, self._together(part), strict=True))
        tails = {w[len(core) :] for w, core in pointed}.difference(self.points)
        for known, new in ((self.cache, odd), (self.points, list(tails))):
            known.update(zip(new, self._alone(new), strict=True) if new else ())
        for w, core in pointed:
            self.cache[w] = self.cache[core] + self.points[w[len(core) :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers."""
        split = [self._words(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = set(chain.from_iterable(split))
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in split]

    @staticmethod
    def _words(text: str) -> list[str]:
        """What white space parts, lower-cased where that maps letter by letter as in the tokenizer: below U+0250."""
        if text.isascii() or not BEYOND_LATIN.search(text):
            text = text.lower()
        # split() parts at U+001C to U+001F too, which the tokenizer keeps
        return NOT_SPACE.findall(text) if SEPARATORS.search(text) else text.split()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(path: str, end_id: int, block_tokens: int):
    """mapInArrow function: (id, text) in order -> blocks. path: the tokenizer among the files that Spark has sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(SparkFiles.get(path))
        part, end = TaskContext.get().partitionId(), np.array([end_id], enc.dtype).tobytes()
        seq, ids, held, n = 0, [], [], 0

        def block() -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(x) // enc.width for x in held])))
            known = np.array([i for i in ids if i is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            row = {
                "part": part, "seq": seq, "n_docs": len(held), "n_tokens": int(bounds[-1]), "width": enc.width, "n_null": len(ids) - len(known), "first_id": first,
                **_put("doc", EliasFano.encode(known.view(np.uint64) - np.uint64(first % (1 << 64)))), **_put("bound", EliasFano.encode(bounds)), "ids": b"".join(held),
            }
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, kinds[k]) for n, k in map(str.split, BLOCK_SCHEMA.split(", "))]))

        for b in batches:
            for i in range(0, len(b), 500):
                own, texts = (c.to_pylist() for c in b.slice(i, 500).columns)
                for d, raw in zip(own, enc.encode(texts), strict=True):
                    ids.append(d)
                    held.append(raw + end)
                    n += len(held[-1]) // enc.width
                    if n >= block_tokens or len(held) >= BLOCK_DOCS:
                        yield block()
                        seq, ids, held, n = seq + 1, [], [], 0
        if held:
            yield block()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode docs with the tokenizer file and write the store. path: a folder that all executors share.

    Documents come in ascending order of id, null ids first; repeated ids in the order of their text's hash.
    Null and empty texts are the end id alone. Ids may be any long, or text of one. The tokenizer's file is sent to
    the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(_blocks(os.path.basename(tokenizer), end_id, block_tokens), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, pa.Array, np.ndarray]]:
    """(row, boundaries, document ids, ids) of each block, all read through select()."""
    for b in batches:
        for r in range(len(b)):
            row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
            row |= {n: v.as_py() for n, v in row.items() if n != "ids"}
            n, nulls = row["n_docs"], row["n_null"]
            bounds = _get(row, "bound", n + 1).select(0, n + 1).astype(np.int64)
            own = (_get(row, "doc", n - nulls).select(0, n - nulls) + np.uint64(row["first_id"] % (1 << 64))).view(np.int64)
            names = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(own)])
            yield row, bounds, names, np.frombuffer(row["ids"].as_buffer(), f"<u{row['width']}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, bounds, names, ids in _rows(batches):
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
        part, seq = (pa.array(np.full(len(crc), row[c], np.int32)) for c in ("part", "seq"))
        yield pa.RecordBatch.from_arrays([part, seq, names, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, from its files."""
    store = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sums = store.select("part", "seq", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    manifest = store.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    docs = store.mapInArrow(_read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(manifest, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids: array<long>) of every document of a store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bounds, names, ids in _rows(batches):
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_index(spark, path)
