"""Quality rules as a short-circuit cascade.

A document is kept if every rule passes. Rules differ in cost and in how much they reject, so a sample is put
through all of them, timed, and the cascade runs them in the order of rejections per second: what is likely
to fail fails early, and the dear rules see the survivors only. The order moves the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from glyphmill.llm.common import table, utf8

SYMBOLS = b"#*$%&|<>"
SPAN = 8
#: Documents that the order of the rules is estimated on.
SAMPLE = 2000
#: Words whose spans are looked up together.
SLICE_WORDS = 1 << 19
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
PLAIN = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))
TYPE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("kept", T.BooleanType())])


class Doc:
    """A text's bytes and words, and its base statistics but the repeated words."""

    __slots__ = ("data", "lines", "n_dup_lines", "n_repeat_words", "n_symbols", "n_words", "word_chars", "words")

    def __init__(self, data: bytes | None):
        self.data = data = data or b""
        self.words = data.split()
        self.n_words = len(self.words)
        chars = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
        self.word_chars = chars - (len(data) - sum(map(len, self.words)))
        self.n_symbols = len(data) - len(data.translate(None, SYMBOLS))
        self.lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = 0

    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def _shouting(d: Doc) -> bool:
    up = _without(d.data, UPPER)
    return 10 * up > 6 * (up + _without(d.data, LOWER))


#: Each rule: whether it rejects a document that has words.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "word_length": lambda d: 2 * d.word_chars < 5 * d.n_words or d.word_chars > 12 * d.n_words,
    "repeated_lines": lambda d: 10 * d.n_dup_lines > 4 * len(d.lines),
    "exclamation": lambda d: 2 * d.data.count(b"!") > d.n_words,
    "shouting": _shouting,
    "few_words_with_letters": lambda d: 10 * sum(1 for w in d.words if w.translate(None, PLAIN)) < 6 * d.n_words,
    "small_vocabulary": lambda d: len(set(d.words)) ** 2 < 4 * d.n_words,
    "trailing_off": lambda d: 10 * sum(1 for x in d.lines if x.rstrip().endswith((b"...", "…".encode()))) > 3 * len(d.lines),
}


def count_repeats(docs: list[Doc]) -> None:
    """Set n_repeat_words: the words of each document inside SPAN-word windows that it holds twice or more.

    Windows are compared by a 64-bit hash over the hashes of their words.
    """
    sizes = np.array([d.n_words for d in docs], np.int64)
    if not sizes.sum():
        return
    h = np.fromiter((x for d in docs for x in map(hash, d.words)), np.int64, int(sizes.sum())).view(np.uint64)
    n = len(h) - SPAN + 1
    if n <= 0:
        return
    w = np.zeros(n, np.uint64)
    for i in range(SPAN):
        w = w * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)
    inside = doc[:n] == doc[SPAN - 1 :]  # windows that cross into the next document don't count
    w ^= (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(inside)
    s = np.sort(w[at])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return
    pos = np.minimum(np.searchsorted(twice, w[at]), len(twice) - 1)
    hit = at[twice[pos] == w[at]]
    marks = np.zeros(len(h) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + SPAN, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(marks[:-1]) > 0)))
    for d, e, k in zip(docs, ends.tolist(), sizes.tolist(), strict=True):
        d.n_repeat_words = int(covered[e] - covered[e - k])


def _docs(texts: list[bytes | None]) -> Iterator[list[Doc]]:
    out, n = [], 0
    for t in texts:
        out.append(Doc(t))
        n += out[-1].n_words
        if n >= SLICE_WORDS:
            count_repeats(out)
            yield out
            out, n = [], 0
    if out:
        count_repeats(out)
        yield out


def measure(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict[str, tuple[int, int, float]]:
    """For each rule: documents of the sample that have words, how many it rejects, and its seconds.

    About `sample` documents, chosen at random over the whole table.
    """
    total = docs.count()
    drawn = docs.select(F.col(text_col).alias("text"))
    if total > sample:
        drawn = drawn.sample(sample / total, seed=3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {name: [0, 0, 0] for name in RULES}
        for b in batches:
            for part in _docs(utf8(b.column(0))):
                part = [d for d in part if not d.base_failed()]
                for name, rule in RULES.items():
                    t = time.perf_counter_ns()
                    rejected = sum(map(rule, part))
                    seen[name] = [x + y for x, y in zip(seen[name], (len(part), rejected, time.perf_counter_ns() - t), strict=True)]
        yield pa.RecordBatch.from_pylist([{"rule": k, "seen": v[0], "rejected": v[1], "ns": v[2]} for k, v in seen.items()])

    rows = drawn.mapInArrow(run, "rule string, seen long, rejected long, ns long").groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("ns").alias("ns"))
    return {r.rule: (r.seen, r.rejected, r.ns / 1e9) for r in rows.collect()}


def order_rules(measured: dict[str, tuple[int, int, float]]) -> list[str]:
    """Names by rejections per second, the most first; a rule that rejected nothing counts as half a rejection."""
    return sorted(RULES, key=lambda r: -max(measured.get(r, (0, 0, 0))[1], 0.5) / max(measured.get(r, (0, 0, 0))[2], 1e-9))


def cascade_udf(order: list[str]):
    """Column function text -> TYPE: base statistics, and whether all rules pass."""

    @F.arrow_udf(TYPE)
    def cascade(text: pa.Array) -> pa.Array:
        rules, rows = [RULES[r] for r in order], []
        for part in _docs(utf8(text)):
            for d in part:
                kept = not d.base_failed() and not any(rule(d) for rule in rules)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, kept))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(TYPE)
        return pa.StructArray.from_arrays([pa.array(c, pa.bool_() if f.name == "kept" else pa.int64()) for c, f in zip(columns, TYPE, strict=True)], TYPE.names)

    return cascade


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null texts have no words and fail the base rule, as do empty and blank ones. Repeated rows are judged alike.
    An empty table gives an empty frame. Other columns are ignored, whatever their names.
    """
    cascade = cascade_udf(order_rules(measure(docs, text_col)))
    out = docs.select(F.col(id_col).alias("id"), cascade(F.col(text_col)).alias("q"))
    failed = F.expr("q.n_words < 20 OR 100 * q.n_repeat_words > 30 * q.n_words")
    return out.select(F.col("id").alias(id_col), *[f"q.{n}" for n in TYPE.names[:5]], failed.alias("base_failed"), "q.kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT r, p, array_to_string(list_slice(w, p, p + 7), ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, p FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
stats AS (
  SELECT doc_id, text, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[a-z]')) AS low
  FROM d LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
         OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 4 * len(lines)
         OR 2 * len(regexp_extract_all(text, '!')) > n_words OR 10 * up > 6 * (up + low)
         OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 6 * n_words
         OR len(list_distinct(w)) * len(list_distinct(w)) < 4 * n_words
         OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)) AS kept
FROM stats
"""
