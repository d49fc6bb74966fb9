import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import mixing


def goals(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Plain water-filling: deal the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, budget, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if budget * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: budget * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
        budget = share * sum(sizes.values()) - sum(out.values())
    return out


def test_targets_and_taken(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        s = rng.choice(["hot"] * 8 + ["b", "Z", "é", "", None, "tiny"]) if i > 5 else "one"
        rows.append((i if i % 97 else None, rng.choice([None, "", " \t", "w " * rng.randint(1, 200)]), s, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, src string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = goals(sizes)
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns
    took = {r.source: r.n for r in kept.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n")).collect()}
    by_size = defaultdict(lambda: [0, 0.0])
    for r in out:
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0
        by_size[r.source_size][0] += r.taken
        by_size[r.source_size][1] = r.target
    for s, n in sizes.items():
        taken, target = by_size[n]
        assert target == pytest.approx(want[s])
        assert abs(taken - target) <= 100 + 97 * (s is None) * 100
        assert taken == (took.get(s) or 0)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(docs).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixing.apply_mix(docs).count() == 0
    one = spark.createDataFrame([(1, "a b", "s")] * 3, "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(one).collect()} <= {(2, 9.0), (4, 9.0)}


def test_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, mixing.op4_mixing(spark, d).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.sql(mixing.OP4_SQL).fetchall())
