import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame(
        [(900, None, "a"), (901, "", "a"), (902, " \n ", "b"), (903, "One two", "b"), (904, "one TWO", "c"), (905, "x " * 30000, "c"), (905, "x " * 30000, "c")],
        "doc_id long, text string, fp string",
    )
    docs = docs.select("doc_id", "text", F.lit("clash").alias("fp")).unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(fps).values()))


def test_hash_is_spark_xxhash64(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("é a b"))).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest("é a b".encode(), 42)


@pytest.mark.parametrize("subtree", [1, 10**6])
def test_links_join_what_brute_force_joins(spark, subtree):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    keys = set(base)
    for x in base:
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            keys.add(y)
    keys = sorted(keys)
    want = slow_components({k: k for k in keys})
    df = spark.createDataFrame([(k - 2**64 if k >= 2**63 else k,) for k in keys], "fp long")
    root = {k: k for k in keys}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.links(df, subtree=subtree).collect():
        a, b = find(r.a % 2**64), find(r.b % 2**64)
        root[max(a, b)] = min(a, b)
    assert {k: find(k) for k in keys} == want


def test_dense_group_costs_links_not_pairs():
    rng = np.random.default_rng(1)
    x = np.uint64(0xABCDEF0123456789)
    keys = np.unique([x ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in rng.integers(0, 48, (3000, 2))])
    label = simhash.trie_classes(keys, 3, 16)
    assert (label == 0).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_null_id_is_kept(spark):
    docs = spark.createDataFrame([(None, "alone here in the text"), (3, None), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, None), (3, 3), (None, 3)}
    assert simhash.keep_one(docs).count() == 2
