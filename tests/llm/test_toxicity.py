import zlib

import numpy as np

from glyphmill.llm import toxicity as tx


def test_risk_estimator_finds_the_separating_word():
    rng = np.random.default_rng(0)
    pos = np.stack([np.ones(300), rng.random(300) < 0.5], 1).astype(np.float32)
    toxic = rng.random(4000) < 0.1
    unl = np.stack([toxic, rng.random(4000) < 0.5], 1).astype(np.float32)
    w, b = tx.fit(pos, unl, 0.1)
    assert b < -1 and b + w[1] < -1 and w[0] + b > 1 and w[0] + w[1] + b > 1


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    pos, unl = rng.random((7, 4)), rng.random((11, 4))
    for prior in (0.1, 0.6):
        theta = rng.normal(size=5)
        values = tx.risk(theta, pos, unl, prior)
        for k in range(5):
            step = np.eye(5)[k] * 1e-6
            up, down = tx.risk(theta + step, pos, unl, prior), tx.risk(theta - step, pos, unl, prior)
            for i in (0, 1):
                assert abs((up[i] - down[i]) / 2e-6 - values[2 + i][k]) < 1e-6


def test_a_negative_risk_turns_the_step():
    pos, unl = np.ones((4, 1)), np.zeros((4, 1))
    theta = np.array([9.0, -9.0])  # the unlabelled text is taken for clean, and much of it should be toxic
    assert tx.risk(theta, pos, unl, 0.5)[1] < 0
    w, b = tx.fit(pos.astype(np.float32), unl.astype(np.float32), 0.5)
    assert tx.risk(np.append(w, b), pos, unl, 0.5)[1] > -0.2


def test_scores_against_plain_counting(spark):
    """Each feature's rate counted by itself, for every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = tx.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tx.score_documents(docs, model).collect():
        found = tx.words((texts[r.doc_id] or "").encode())
        raw = model.bias
        for f, weight in model.weights.items():
            n = found.count(f[:-1]) if f.endswith(b"=") else sum(len(w) > 3 and w[: len(f)] == f and (len(f) >= 4) for w in found)
            raw += weight * min(100 * n / (len(found) + tx.LONGER), tx.MOST)
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_ties_and_repeats_in_the_sample(spark):
    rows = [(i, f"scum and filth {i} " * 5) for i in range(30)] + [(i, f"nice day number {i}") for i in range(30, 90)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] * 2, "doc_id long, toxic int")
    models = [tx.train(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert models[0].weights.keys() == models[1].weights.keys()
    scores = [{r.doc_id: round(r.score, 4) for r in tx.score_documents(docs, m).collect()} for m in models]
    assert scores[0] == scores[1] and scores[0][0] > 0.5 > scores[0][40]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = tx.op8_toxicity(spark, d)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    known = [(rows[r.doc_id].predicted, r.toxic, rows[r.doc_id].held_out) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(p, t) for p, t, h in known if h]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert np.mean([p for p, t in held if t]) > 0.7


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you are scum here " * (i % 2) + f"fine text {i}", "s") for i in range(60)] + [(None, None, "s"), (61, "", "s"), (62, "w " * 90_000, "s"), (0, "again", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = tx.train(docs, labels)
    out = tx.score_documents(docs, model)
    assert out.count() == 64 and out.where("score BETWEEN 0 AND 1").count() == 64
    none = labels.where("false")
    assert {round(r.score, 6) for r in tx.score_documents(docs, tx.train(docs, none)).collect()} == {0.1}
    assert tx.score_documents(docs.where("false"), tx.train(docs.where("false"), labels)).count() == 0
