import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from glyphmill.llm import sharding


def slow_minimax(sizes, shards):
    best = {(0, 0): 0}
    for k in range(1, shards + 1):
        for n in range(len(sizes) + 1):
            best[k, n] = min((max(best[k - 1, m], sum(sizes[m:n])) for m in range(n + 1) if (k - 1, m) in best), default=10**18)
    return best[shards, len(sizes)]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_minimal(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50]) for _ in range(rng.randint(0, 24))]
    assert sharding.smallest_capacity(np.array(sizes, dtype=np.int64), 4) == slow_minimax(sizes, 4)


def unsigned(h):
    return h % 2**64


def verify(spark, docs, shards=8):
    rows = docs.collect()
    out = sharding.shard(docs, shards).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) and sorted(zlib.crc32((r.text or "").encode()) for r in rows) == sorted(r.text_crc32 for r in out)
    assert sum(r.size for r in out) == sum(len((r.text or "").encode()) + 1 for r in rows)
    for s in range(shards):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    out.sort(key=lambda r: unsigned(r.h))
    groups = [(h, list(g)) for h, g in groupby(out, key=lambda r: unsigned(r.h))]
    assert all(len({r["shard"] for r in g}) == 1 for _, g in groups)
    order = [g[0]["shard"] for _, g in groups]
    assert order == sorted(order)
    sizes = [sum(r.size for r in g) for _, g in groups]
    loads = [sum(n for n, s in zip(sizes, order) if s == k) for k in range(shards)]
    assert max(loads) == sharding.smallest_capacity(np.array(sizes, dtype=np.int64), shards)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice([None, "", "same text", "é" * rng.randint(1, 400), str(i) * rng.randint(1, 99)]), "x") for i in range(3000)]
    rows += [(7, "z" * 100_000, "y"), (7, "z" * 100_000, "y")]
    verify(spark, spark.createDataFrame(rows, "doc_id long, text string, shard string"))
    verify(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_few_groups_and_empty(spark):
    verify(spark, spark.createDataFrame([(i, "all the same") for i in range(100)], "doc_id long, text string"))
    verify(spark, spark.createDataFrame([(i, str(i % 3)) for i in range(10)], "doc_id long, text string"))
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", "s0"), (1, "a", "s0"), (2, None, "s1"), (None, "b", "s2")], "doc_id long, text string, shard string")
    out = sharding.shard_documents(docs, 2)
    assert out.columns == ["doc_id", "text", "shard", "size", "text_crc32", "shard_", "slot"]
    assert sorted((r.text or "", r["shard"]) for r in out.collect()) == [("", "s1"), ("a", "s0"), ("a", "s0"), ("b", "s2")]
