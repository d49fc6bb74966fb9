import hashlib
import random
import re

from pyspark.sql import functions as F

from glyphmill.llm import decontamination as dec


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items):
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        v = split(t)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in dec.overlaps(d, b, **kw).collect()}
    for i, t in enumerate(docs):
        n, h, f = slow(t, items)
        assert got[i] == (n, h, f, h > 0 and 20 * h >= n), (i, t)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Été", "x1", "ß"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 7, 12, 13, 14, 25, 60])))) for i in range(2, 30)]
    items += [(50, None), (51, ""), (52, " .- "), (53, "the " * 40), (2, "a b a b a b a b a b a b a b a b")]
    docs = [None, "", "...", "the " * 100, "the " * 12, "Z"]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            _, t = rng.choice(items)
            v = split(t)
            a = rng.randint(0, max(0, len(v) - 1)) if v else 0
            parts += v[a : a + rng.randint(1, 40)] + [rng.choice(["q", "rr", "a", "b"]) for _ in range(rng.randint(0, 5))]
        docs.append(rng.choice([" ", "-", "\n"]).join(parts))
    check(spark, docs, items)
    check(spark, docs, items, block_words=50)  # by a join of fingerprints


def test_a_large_benchmark_in_the_pipeline(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_t", F.lit("own"))
    base = base.unionByName(base.limit(3)).unionByName(base.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in base.dtypes]))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    small = sorted(map(str, dec.drop_contaminated(base, bench).collect()))
    monkeypatch.setattr(dec, "BLOCK_WORDS", 10)
    assert sorted(map(str, dec.drop_contaminated(base, bench).collect())) == small and len(small) < base.count()


def test_long_document_and_fixture(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = [r.text for r in base.collect()] + ["word " * 200_000 + items[0][1]]
    check(spark, docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = dec.overlaps(d, none).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (3, 0, 0, False)
    assert dec.overlaps(d.where("false"), none).count() == 0
    assert dec.drop_contaminated(d, none).count() == 1


def test_digest(spark, tmp_path):
    d = spark.createDataFrame([(1, "p q r"), (2, "zzz")], "doc_id long, text string")
    b = spark.createDataFrame([(10, "q"), (9, "r"), (8, "none")], "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.items_sha256 for r in dec.op9_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"10,9").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = dec.op9_decontamination(spark, d)
    want = con.sql(dec.OP9_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
