import random
import re
from collections import Counter

import duckdb

from glyphmill.llm import quality_rules as qr


def slow_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    rep = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "\n\n\n", "x " * 50_000, "a b   c\x85d", "é|<ß>\nline\nline\n \nline", "l\r\nl\r\nl"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "word. ", "a b c d e f g h "]) for _ in range(rng.randint(0, 120))))
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in qr.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], slow_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_moves_cost_not_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = docs.select("doc_id", qr.cascade_udf(list(qr.RULES))("text").alias("q")).collect()
    b = docs.select("doc_id", qr.cascade_udf(list(qr.RULES)[::-1])("text").alias("q")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    measured = {r: (100, 0, 1.0) for r in qr.RULES} | {"shouting": (100, 50, 1.0), "symbols": (100, 50, 0.1)}
    assert qr.order_rules(measured)[:2] == ["symbols", "shouting"]


def test_empty_table(spark):
    assert qr.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oracle_and_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, qr.op3_quality_rules(spark, d).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.sql(qr.OP3_SQL).fetchall())
    kept = {r[0] for r in got if r[-1]}
    failed = {r[0] for r in got if r[-2]}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality == 1 and r.doc_id not in failed]
    assert all(i in kept for i in clean)
    assert sum(r.doc_id not in kept for r in labels if r.quality == 0) > 0.8 * sum(r.quality == 0 for r in labels)
