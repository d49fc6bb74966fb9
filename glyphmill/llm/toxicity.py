"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are used as examples; everything else is unlabelled text that holds toxic texts
too, at a known rate, the class prior. The risk of a classifier is
    prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)]),
the second term standing for the negatives that nobody labelled. Where it falls below zero, which only
overfitting can do, the step goes the other way. The classifier is linear over the rates of words and word
beginnings (which inflected words share) that the positives hold, or hold often, far more than the unlabelled
text does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from glyphmill.llm.common import materialize, table, utf8
from glyphmill.llm.decontamination import words
from glyphmill.llm.quality_model import remainder, sample_of

#: Bounds of the sample: positives and unlabelled documents; features looked at and features kept.
POSITIVES, UNLABELLED = 10_000, 20_000
CANDIDATES, VOCABULARY = 50_000, 512
#: A feature must be in so many positives, and so large a share of them; ridge penalty over the positives.
LEAST, LEAST_SHARE, RIDGE = 3, 0.01, 0.03
#: The prior where no labels tell it.
PRIOR = 0.1


#: A rate counts per hundred words, a text being this much longer; DENSE is a high one, MOST where it is cut off.
LONGER, DENSE, MOST = 60, 0.6, 3.0


def counts(found: list[bytes]) -> dict[bytes, int]:
    """How often each word, and each of the words' beginnings of 4 to 8 bytes, stands in a text."""
    out: dict[bytes, int] = {}
    for w in found:
        for t in {w + b"=", w[:4], w[:5], w[:6], w[:7], w[:8]} if len(w) > 3 else (w + b"=",):
            out[t] = out.get(t, 0) + 1
    return out


def rate(n: int, n_words: int) -> float:
    return min(100 * n / (n_words + LONGER), MOST)


def marks(found: list[bytes]) -> list[bytes]:
    """What a text is searched for tell-tale features by: each is there (1), or there often (2)."""
    out = []
    for t, n in counts(found).items():
        out.append(t + b"1")
        if rate(n, len(found)) >= DENSE:
            out.append(t + b"2")
    return out


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def score(self, text: bytes | None) -> float:
        """Only words that begin like some feature are looked at."""
        if not hasattr(self, "starts"):
            self.starts = {f.removesuffix(b"=")[:4] for f in self.weights}
        starts, found = self.starts, words(text)
        seen = counts([w for w in found if w[:4] in starts])
        raw = self.bias + sum(self.weights[f] * rate(seen[f], len(found)) for f in self.weights.keys() & seen.keys())
        return float(1 / (1 + np.exp(-raw)))


def risk(theta: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk of the positives, risk of the negatives, their gradients) of weights and, last, bias, with logistic loss.

    l(+) = log(1 + e^-z), l(-) = log(1 + e^z). The second risk is E_unl[l(-)] - prior * E_pos[l(-)] and may be negative.
    """
    m = pos.shape[1]
    zp, zu = pos @ theta[:m] + theta[m], unl @ theta[:m] + theta[m]

    def sigma(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def pull(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Gradient of a mean over rows whose derivative by the score is d."""
        return np.append(x.T @ d.astype(x.dtype), d.sum()) / len(d)

    positives = prior * np.logaddexp(0, -zp).mean()
    negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positives, negatives, prior * pull(pos, sigma(zp) - 1), pull(unl, sigma(zu)) - prior * pull(pos, sigma(zp))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam on all rows): where the negatives' risk is below zero, a step raises it."""
    m, ridge = pos.shape[1], ridge / len(pos)
    theta, first, second = np.zeros(m + 1, np.float32), np.zeros(m + 1), np.zeros(m + 1)
    theta[m] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, negatives, grad_pos, grad_neg = risk(theta, pos, unl, prior)
        grad = grad_pos + grad_neg if negatives >= 0 else -grad_neg
        grad[:m] += ridge * theta[:m]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - (rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return theta[:m], float(theta[m])


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def marks_udf(text: pa.Array) -> pa.Array:
    return pa.array([marks(words(t)) for t in utf8(text)], pa.list_(pa.binary()))


def _places(names: list[bytes]):
    """Column function text -> positions in `names` of the marks that it has."""
    index = {f: i for i, f in enumerate(names)}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(text: pa.Array) -> pa.Array:
        return pa.array([[index[f] for f in marks(words(t)) if f in index] for t in utf8(text)], pa.list_(pa.int32()))

    return places


def _rates(features: list[bytes]):
    """Column function text -> rates of `features`, position and rate in turn, those that are there."""
    index = {f: i for i, f in enumerate(features)}

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def rates(text: pa.Array) -> pa.Array:
        rows = []
        for t in utf8(text):
            found = words(t)
            seen = counts(found)
            rows.append([v for f in sorted(index.keys() & seen.keys()) for v in (index[f], rate(seen[f], len(found)))])
        return pa.array(rows, pa.list_(pa.float32()))

    return rates


def _matrix(rows: list[list[float]], m: int) -> np.ndarray:
    out = np.zeros((len(rows), m), np.float32)
    for i, r in enumerate(rows):
        out[i, np.array(r[::2], np.int64)] = r[1::2]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> Model:
    """Fit on at most POSITIVES labelled toxic documents and about UNLABELLED others, drawn by hash over all.

    The prior is the share of toxic rows among the labels where none is given. Both samples are found in one pass
    over the documents and written; of rows that repeat a text one counts as a positive. Without positives or words that tell them apart, the
    score of every text is the prior.
    """
    share = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label).alias("p")).first().p
    prior = min(max(prior if prior is not None else PRIOR if share is None else float(share), 1e-3), 0.999)
    nothing = Model(float(np.log(prior / (1 - prior))), {})
    ids = F.broadcast(sample_of(labels.where(F.col(label) == 1), label, POSITIVES).select("id").distinct())  # at most POSITIVES ids
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = docs.count()
    chosen = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(min(1.0, UNLABELLED / max(total, 1)) * (1 << 20))
    picked = own.join(ids.withColumn("toxic", F.lit(True)), "id", "left").select("text", F.coalesce("toxic", F.lit(False)).alias("toxic"), chosen.alias("drawn"))
    picked = materialize(picked.where("toxic OR drawn"), "sample")
    pos, drawn = picked.where("toxic").dropDuplicates(["text"]), picked.where("drawn")
    n = pos.count()
    seen = pos.select(F.explode(marks_udf("text")).alias("w")).groupBy("w").count().where(F.col("count") >= max(LEAST, LEAST_SHARE * n))
    candidates = {bytes(r.w): r["count"] for r in seen.orderBy(F.desc("count"), "w").limit(CANDIDATES).collect()}
    if not candidates or not total:
        return nothing
    names = list(candidates)
    counted = drawn.select(F.explode(F.concat(F.array(F.lit(-1)), _places(names)("text"))).alias("at")).groupBy("at").count().collect()
    common = {r["at"]: r["count"] for r in counted}  # -1: all rows
    n_unl = common.get(-1, 0)
    p = np.array([candidates[f] for f in names]) / n
    u = (np.array([common.get(i, 0) for i in range(len(names))]) + 0.5) / (n_unl + 1)
    z = (p - u) / np.sqrt(u * (1 - np.minimum(u, 0.999)) / n)
    # features that make a text more likely toxic than not
    good = np.flatnonzero((prior * p / u >= 0.5) & (z > 3))
    features = list(dict.fromkeys(names[i][:-1] for i in good[np.argsort(-z[good], kind="stable")]))[:VOCABULARY]
    if not features or not n_unl:
        return nothing
    rates = _rates(features)
    x = [_matrix(sorted(r["x"] for r in df.select(rates("text").alias("x")).collect()), len(features)) for df in (pos, drawn)]
    weights, bias = fit(x[0], x[1], prior)
    return Model(bias, {f: float(w) for f, w in zip(features, weights, strict=True)})


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row.

    Null, empty and blank texts hold no word and score the bias. Repeated rows score alike; an empty table gives
    an empty frame. Other columns are ignored, whatever their names.
    """

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in utf8(text)], pa.float64())

    out = docs.select(F.col(id_col).alias(id_col), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder("doc_id", 5) != 0))
    return score_documents(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
