import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano_round_trip(seed):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.choice([0, 1, 3, 50, 100_000], size=rng.integers(1, 3000), p=[0.3, 0.3, 0.2, 0.15, 0.05]))
    ef = ts.EliasFano.encode(v)
    assert (ef.select(0, len(v)) == v).all()
    for i in [0, len(v) - 1, *rng.integers(0, len(v), 60).tolist()]:
        assert ef.select(i)[0] == v[i]
        n = int(rng.integers(0, len(v) - i + 1))
        assert (ef.select(i, n) == v[i : i + n]).all()
    with pytest.raises(IndexError):
        ef.select(len(v))
    assert len(ef.directory) <= 8 * (len(v) // ef.SAMPLED + 1)
    assert 8 * (len(ef.low) + len(ef.high)) <= len(v) * (3 + max(0, int(v[-1] // len(v)).bit_length())) + 16


def test_elias_fano_of_wide_and_no_numbers():
    v = np.array([0, 0, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (ts.EliasFano.encode(v).select(0, 5) == v).all()
    assert len(ts.EliasFano.encode(np.empty(0, np.uint64)).select(0, 0)) == 0


def test_encoder_equals_the_tokenizer():
    rng = random.Random(9)
    odd = ["", " ", "A\tB", "don't stop", "I'LL we've", "x\x1cy z", "a b", "ﬁne Ǆ", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é café.", "<|endoftext|> a", "a<|startoftext|>b.", "1234 v2.0,", "ÀÉ ß, ŉ.", "…", "日本語 テスト", " line", "🙂👍🏽 ok", "word.,", "idiot$$$", "x!?*#", "é%.", "$$", "a.b.", "ªº ª.", "a\x85b", "ﬀ K Å", "'s 'S", "q\x00r", "ͅx ẞ"]
    pool = [*odd, "The", "thing,", "ouen.", "von", "HELLO!!", "x|y", "é", "ǰ"]
    texts = odd + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(1, 0xD7FF), 32])) for _ in range(40)) for _ in range(300)]
    t = Tokenizer.from_file(PATH)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = ts.Encoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        for a, b, text in zip(got, want, texts):
            assert a == b, repr(text)


def slow(rows):
    t = Tokenizer.from_file(PATH)
    at, out = 0, {}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    return out


def test_store(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-(2**63), None), (-4, ""), (2**63 - 1, "x"), (10**12, "long text, " * 40_000)], docs.schema))
    want = slow(sorted((r.doc_id, r.text) for r in docs.collect()))
    for tokens in (300, ts.BLOCK_TOKENS):
        path = f"{tmp_path}/store{tokens}"
        ts.write_store(docs.repartition(5), path, PATH, block_tokens=tokens)
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.read_index(spark, path).collect()}
        assert got == {d: v[:3] for d, v in want.items()}
    assert {r.doc_id: r.ids for r in ts.token_ids(spark, path).collect()} == {d: v[3] for d, v in want.items()}


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    rows = [(None, "a b"), (3, "c"), (3, "c"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    ts.write_store(docs, f"{tmp_path}/a", PATH)
    got = sorted(ts.read_index(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    ts.write_store(docs.where("false"), f"{tmp_path}/b", PATH)
    assert ts.read_index(spark, f"{tmp_path}/b").count() == 0
