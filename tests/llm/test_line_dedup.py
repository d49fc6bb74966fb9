import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import line_dedup as ld


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, p = rng.randint(0, 2), rng.randint(0, len(s))
        if k == 0:
            s.insert(p, rng.choice("abé 𝄞"))
        elif s and k == 1:
            del s[min(p, len(s) - 1)]
        elif s:
            s[min(p, len(s) - 1)] = rng.choice("abé 𝄞")
    return "".join(s)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance(spark, t):
    rng = random.Random(t)
    pairs = [("", ""), ("", "ab"), ("a", "bcd"), ("abc", "abc"), ("ab" * 300, "ba" * 300), ("a+b", "a+c"), ("x" * 40, "x" * 38)]
    for _ in range(500):
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 30)))
        pairs.append((a, mutate(rng, a, rng.randint(0, t + 2))))
    long = "".join(rng.choice("abé ") for _ in range(40000))  # its length wraps in the packed column
    pairs += [(long, long[:17] + long[18:]), (long, long[:39990] + "xyz" + long[39990:]), (long, "x" + long[1:])]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ld.edits("a", "b", t).alias("n")).collect():
        true = {39999: 1, 40003: 3, 40000: 1}[len(r.b)] if len(r.a) == 40000 else edit(r.a, r.b)
        assert min(r.n, t + 1) == min(true, t + 1), (r.a, r.b)


def slow(docs, t):
    """Classes by comparing all pairs of different lines."""
    first, lines = {}, []
    for d, text in docs:
        for i, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                lines.append((d, i, x))
                first[x] = min(first.get(x, (d, i)), (d, i))
    texts = sorted(first)
    root, sizes = {x: x for x in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            allowed = min(t, max(len(a), len(b)) // 5)
            if abs(len(a) - len(b)) <= allowed and edit(a, b) <= allowed:
                x, y = sorted((find(a), find(b)), key=lambda v: first[v])
                root[y] = x
    sizes.update(find(x) for x in texts)
    return {(d, i): (*first[find(x)], sizes[find(x)], first[find(x)] == (d, i)) for d, i, x in lines}


def compare(spark, docs, t=ld.THRESHOLD):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, line int")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.class_size, r.kept) for r in ld.dedup_lines(df, t).collect()}
    assert got == slow(docs, t)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_against_all_pairs(spark, t):
    rng = random.Random(7 * t)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([4, 5, 8, 9, 10, 11, 13, 19, 21, 24, 40, 90]))) for _ in range(12)]
    docs = []
    for d in range(60):
        lines = [mutate(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
        docs.append((d, "\n".join([*lines, rng.choice(["", "  ", "same line for everyone here\r"])])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "long " * 400), (104, "long " * 400 + "x")]
    compare(spark, docs, t)


def test_real_lines(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()
    compare(spark, [(r.doc_id, r.text) for r in rows])


def test_cleaned_texts_and_empty_table(spark):
    a = "the quick brown fox jumps over"
    df = spark.createDataFrame([(1, f"{a}\n\nTi.", "k"), (2, f"new line\n{a}s\nTi.", "k"), (3, None, "k")], "doc_id long, text string, n string")
    out = ld.drop_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{a}\n\nTi.", 2: "new line", 3: None}
    none = df.where("false")
    assert ld.dedup_lines(none).count() == 0 and ld.drop_lines(none).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one line of some length here"), (2, "one line of some length here"), (2, "one line of some length here")], "doc_id long, text string")
    assert [(r.class_doc_id, r.kept) for r in ld.dedup_lines(df).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [(2, False), (2, True), (2, True)]


def test_short_lines(spark):
    rng = random.Random(3)
    lines = {mutate(rng, rng.choice(["abcd", "abcde", "ab cd ef", "éabababab", "color: red", "a line of 19 chars."]), rng.randint(0, 3)) for _ in range(400)}
    compare(spark, list(enumerate([*sorted(lines), "colour: red", "a line of 19 chars!", "a", "b"])))


def test_variants_in_digits_make_rows_in_proportion(spark):
    docs = [(i, f"visitor number {7919 * i % 2000:04d} has come to this page") for i in range(2000)]
    docs += [(2000 + i, f"{i:03d} of the pages say it {i:03d} times over and then again {i:03d}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ld.dedup_lines(df).collect()
    assert {(r.class_doc_id, r.class_size) for r in rows if r.doc_id < 2000} == {(0, 2000)}
    assert all(r.class_size == 1 for r in rows if r.doc_id >= 2000)


def test_large_groups_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(ld, "PART_ROWS", 5)
    rng = random.Random(9)
    compare(spark, [(i, mutate(rng, f"item {rng.randint(0, 99):02d} of the list of all things", rng.randint(0, 2))) for i in range(150)])


def test_a_very_long_line(spark):
    a = "word " * 30000
    rows = ld.dedup_lines(spark.createDataFrame([(1, a + "x"), (2, a + "y"), (3, a)], "doc_id long, text string")).collect()
    assert {(r.class_doc_id, r.class_size) for r in rows} == {(1, 3)}
