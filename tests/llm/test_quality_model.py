import zlib

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import quality_model as qm


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(qm.NAMES))).astype(np.float32)
    y = (x[:, 0] + x[:, 3] * x[:, 4] > 0).astype(float)
    model = qm.fit(x, y, trees=20)
    got = model.score(x)
    for i in range(0, 600, 37):
        raw = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            raw += leaf[node - len(f)]
        assert np.isclose(got[i], 1 / (1 + np.exp(-raw)))
    assert ((got >= 0.5) == (y == 1)).mean() > 0.9


def slow_fit(x, y, trees):
    """The same boosting with plain loops: every feature, every edge, every row."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = np.log(share / (1 - share))
    edges = [sorted({np.float32(v) for v in np.quantile(x[:, j], np.linspace(0, 1, qm.BINS + 1)[1:-1])}) for j in range(m)]
    raw = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = [list(range(n))]
        for _ in range(qm.DEPTH):
            below = []
            for rows in nodes:
                best, where = 1e-6, None
                total = (g[rows].sum(), h[rows].sum())
                for j in range(m):
                    for e in edges[j]:
                        left = [i for i in rows if x[i, j] <= e]
                        if len(left) < qm.LEAST or len(rows) - len(left) < qm.LEAST:
                            continue
                        a, b = g[left].sum(), h[left].sum()
                        gain = a**2 / (b + qm.RIDGE) + (total[0] - a) ** 2 / (total[1] - b + qm.RIDGE) - total[0] ** 2 / (total[1] + qm.RIDGE)
                        if gain > best + 1e-9:
                            best, where = gain, (j, e)
                below += [[i for i in rows if not where or x[i, where[0]] <= where[1]], [i for i in rows if where and x[i, where[0]] > where[1]]]
            nodes = below
        for rows in nodes:
            if rows:
                raw[rows] -= qm.RATE * g[rows].sum() / (h[rows].sum() + qm.RIDGE)
    return 1 / (1 + np.exp(-raw))


def test_training_equals_plain_loops():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, len(qm.NAMES))).astype(np.float32)
    x[:, 3:] = 0  # three features carry all; the others tell nothing
    x[:, 2] = np.round(x[:, 2])  # with ties
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    assert np.allclose(qm.fit(x, y, trees=4).score(x), slow_fit(x, y, 4), atol=1e-6)


def test_the_sample_is_settled_by_hash(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} " * (i % 5 + 1)) for i in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one, two = (qm.train(docs.repartition(n), labels.repartition(n), most=30) for n in (1, 6))
    assert (one.leaf == two.leaf).all() and (one.threshold == two.threshold).all()


def test_one_class_or_no_rows():
    x = np.zeros((3, len(qm.NAMES)), np.float32)
    assert qm.fit(x[:0], np.zeros(0)).score(x)[0] == 0.5
    assert qm.fit(x, np.ones(3)).score(x)[0] > 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = qm.op2_quality_model(spark, d)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95, auc
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "word " * 60_000, 0.3), (2, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = qm.train(docs, labels)
    out = qm.score_documents(docs, model)
    assert out.count() == 4 and out.where("score BETWEEN 0 AND 1").count() == 4
    assert qm.keep_good(docs, model).columns == docs.columns
    none = docs.where("false")
    assert qm.score_documents(none, qm.train(none, labels.where("false"))).count() == 0
    assert docs.select(qm.remainder("doc_id", 3)).where(F.col("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3)").isNull()).count() == 1
