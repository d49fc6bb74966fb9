import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import quality_model
from glyphmill.llm.sharding import smallest_capacity
from tests.llm.test_decontamination import slow
from tests.llm.test_mixing import goals
from tests.llm.test_sharding import unsigned
from tests.llm.test_simhash import slow_components, slow_fingerprint

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    rows, kept = {}, [r for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        out = stage(spark, docs, D)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = docs.collect()
        rows[name] = kept
        if k < 4:
            assert docs.columns == columns
        ids = Counter(r.doc_id for r in kept)
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
            held = [(i in ids) == bool(q) for i, q in labels.items()]
            assert sum(held) > 0.9 * len(held) and all(n == 1 for n in ids.values())
        elif k == 1:
            assert ids == Counter(set(slow_components({r.doc_id: slow_fingerprint(r.text) for r in before}).values()))
        elif k == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            clean = [r.doc_id for r in before for n, h, _ in [slow(r.text, items)] if not (h and 20 * h >= n)]
            assert ids == Counter(clean)
        elif k == 3:
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(r.text.split())
            for r in kept:
                taken[r.source] += len(r.text.split())
            longest = max(len(r.text.split()) for r in before)
            assert max(ids.values()) <= 2
            assert all(abs(taken[s] - t) <= longest for s, t in goals(sizes).items())
        else:
            assert ids == Counter(r.doc_id for r in before)
            place = {}
            for r in kept:
                assert place.setdefault(r.text, r["shard"]) == r["shard"]
            for s in range(8):
                assert sorted(r.slot for r in kept if r["shard"] == s) == list(range(sum(r["shard"] == s for r in kept)))
            assert unsigned(-1) == 2**64 - 1


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_mix(rows):
    """How often each row is taken: by source, whole copies, then rows by hash until the budget's nearer end."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    times = [0] * len(rows)
    for source, target in goals(sizes).items():
        copies = min(int(target // sizes[source]), 2) if sizes[source] else 0
        budget = target - copies * sizes[source] if copies < 2 else 0
        own = defaultdict(list)
        for i, r in enumerate(rows):
            if r.source == source:
                times[i] = copies
                name = str(r.doc_id) if r.doc_id is not None else "null" + md5((r.text or "").encode()).hexdigest()
                own[int(md5(name.encode()).hexdigest()[:15], 16)].append(i)
        before = 0
        for h in sorted(own) if budget > 0 else ():
            n = sum(len(words(rows[i].text)) for i in own[h])
            if before + n >= budget:
                for i in own[h] if 2 * before + n <= 2 * budget else ():
                    times[i] += 1
                break
            for i in own[h]:
                times[i] += 1
            before += n
    return times


def test_run_against_brute_force(spark, tmp_path):
    """run() over rows with nulls, repeats, ties, empty and very long texts and clashing columns, held against each stage done plainly."""
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("size", F.lit("own")).withColumn("shard", F.lit(7))
    good = docs.orderBy(F.desc("n_chars")).first().text
    odd = [(None, None), (901, None), (902, ""), (903, " \n "), (None, good + " one"), (905, good + " two"), (905, good + " two"), (906, "alpha beta " * 40_000)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", s, len(t or ""), "own", 7) for (i, t), s in zip(odd, ["a", None, "a", "b", None, "b", "b", "a"])], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "size_", "text_crc32", "shard_", "slot"]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = quality_model.train(docs, labels.where(quality_model.remainder("doc_id", 3) != 1))
    rows = [r for r in docs.collect() if model.score(quality_model.matrix([None if r.text is None else r.text.encode()]))[0] >= 0.5]
    part = slow_components({i: slow_fingerprint(r.text) for i, r in enumerate(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, str(r))))})
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, str(r)))
    rows = [order[i] for i in sorted(set(part.values()))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = [r for r in rows for n, h, _ in [slow(r.text, items)] if not (h and 20 * h >= n)]
    want = Counter()
    for r, n in zip(rows, plain_mix(rows), strict=True):
        want[r.doc_id, r.text] += n
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == +want
    by_shard = defaultdict(list)
    for r in got:
        assert r.size_ == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by_shard[r["shard_"]].append(r)
    groups = Counter()
    for r in got:
        groups[xxhash.xxh64_intdigest((r.text or "").encode(), 42)] += r.size_
    sizes = np.array([groups[h] for h in sorted(groups)], np.int64)
    assert max(sum(r.size_ for r in g) for g in by_shard.values()) == smallest_capacity(sizes, 8)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by_shard.values())


def test_stages_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
