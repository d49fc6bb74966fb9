"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are binned once; every level of a tree is grown from histograms of gradients, one bincount each. The
trees are complete, so a model is three arrays (feature, threshold, leaf value), and scoring walks all trees
for all rows at once with numpy, a level a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from glyphmill.llm.common import table, utf8

#: At most so many labelled rows are fitted on, chosen by the hash of their id.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 5

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789", "stops": b".", "commas": b",",
    "exclamations": b"!?", "bars": b"|", "marks": b"#*$%&<>=_~^@", "brackets": b"()[]{}", "quotes": b"\"'`", "dashes": b"-/\\+:;",
}
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES.values(), 1):
    _KIND[list(_chars)] = _i
_KIND[128:192], _KIND[192:] = len(_CLASSES) + 1, len(_CLASSES) + 2  # continuation and leading bytes
NAMES = ["log_words", "word_length", "long_words", "vocabulary", "commonest_word", "capital_words", "letter_words", "lines", "repeated_lines", "line_length", "beyond_ascii", *_CLASSES]


def features(text: bytes | None) -> list[float]:
    """Statistics of a text, by NAMES; all zero without words."""
    data = text or b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 3)
    chars = len(data) - int(kinds[len(_CLASSES) + 1])
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    letters = sum(k for w, k in counts.items() if w[:1].isalpha() or w[0] >= 128)
    capitals = sum(k for w, k in counts.items() if w[:1].isupper())
    distinct = len(counts)
    return [
        np.log1p(n), lengths.sum() / n, np.count_nonzero(lengths > 12) / n, np.log1p(distinct) / np.log1p(n), max(counts.values()) / n, capitals / n, letters / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(chars / len(lines)), kinds[len(_CLASSES) + 2] / chars, *(kinds[1 : len(_CLASSES) + 1] / chars),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float32).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """Complete trees in heap order: node i has the children 2i + 1 (feature <= threshold) and 2i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        out = np.full(len(x), self.base)
        trees, inner = np.arange(len(self.leaf)), self.feature.shape[1] if len(self.leaf) else 0
        if len(trees):
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int32)
                for _ in range(DEPTH):
                    node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
                out[i : i + 4096] += self.leaf[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost logistic loss. Without both classes the model is the constant share of class 1 (0.5 without rows)."""
    inner = 2**DEPTH - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    none = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64)
    flat = binned + np.arange(m) * BINS
    raw, out = np.full(n, none.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            at = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, m) if v is not None else None, width * m * BINS).reshape(width, m, BINS) for v in (g, h, None)]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            total = [s[:, :1, :].sum(2, keepdims=True) for s in sums]
            right = [t - a for t, a in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS - 1)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = np.zeros(inner + 1)
        sg, sh = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf = -RATE * sg / (sh + RIDGE)
        raw += leaf[node - inner]
        out.append((feature, threshold, leaf))
    return Trees(none.base, *(np.stack(v) for v in zip(*out, strict=True)))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def features_udf(text: pa.Array) -> pa.Array:
    x = matrix(utf8(text))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))


def sample_of(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(id, y) of at most `most` rows of labels with label 0 or 1, by the hash of the id."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(label).alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id", "y").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Trees:
    """Fit on the documents of at most `most` label rows. Several label rows of one id all count."""
    picked = F.broadcast(sample_of(labels, label, most))  # at most `most` rows of two numbers
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    rows = known.select("y", features_udf("text").alias("x"), F.xxhash64("id", "text").alias("h"), "id").orderBy("h", "id", "y").limit(most).select("y", "x").toPandas()
    x = np.array(rows.x.tolist(), dtype=np.float32).reshape(-1, len(NAMES))
    return fit(x, rows.y.to_numpy(dtype=np.float64))


def score_udf(model: Trees):
    """Column function text -> probability of class 1."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(utf8(text))))

    return score


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def score_documents(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row.

    Null, empty and blank texts have features of zero and are scored like any text. Repeated rows score alike;
    an empty table gives an empty frame. Other columns are ignored, whatever their names.
    """
    out = docs.select(F.col(id_col).alias(id_col), score_udf(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """docs, all columns, without those that score below 0.5.

    Null, empty and very long texts are scored like any; repeated rows stay or go together; an empty table stays
    empty. Other columns go along, whatever their names.
    """
    whole = docs.select(F.struct("*").alias("d"))
    return whole.where(score_udf(model)(F.col("d")[text_col]) >= 0.5).select("d.*")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
