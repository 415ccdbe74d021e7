import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from rosterlane.llm.common import scratch
from rosterlane.llm.token_files import WaveletMatrix, count_token, encode_rows, find_token, op7_token_files, read_tokens, write_tokens
from rosterlane.llm.tokens import tokenizer_file
from tests.llm import cases
from tests.llm.test_tokens import SHORT_TWINS, texts, twins
from tokenizers import Tokenizer

FILE = tokenizer_file("byte_bpe_50k.json")


def expected(docs):
    t, at, out = Tokenizer.from_file(FILE), 0, []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(2)
    for n in (1, 7, 511, 512, 513, 5000):
        ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
        built = WaveletMatrix.build(ids)
        w = WaveletMatrix(n, built.zeros, [p.tobytes() for p in built.planes], [r.tobytes() for r in built.ranks])
        assert (w.decode() == ids).all()
        for i in rng.integers(0, n, 50).tolist():
            assert w.access(i) == ids[i]
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert w.count(int(ids[i]), a, b) == int((ids[a:b] == ids[i]).sum())
            where = np.flatnonzero(ids == ids[i])
            assert [w.select(int(ids[i]), k) for k in range(min(5, len(where)))] == where[:5].tolist()
        assert w.select(50256, n) == -1 and w.count(70000, 0, n) == 0


def test_encoding_equals_the_library_on_odd_texts():
    t, odd = Tokenizer.from_file(FILE), texts()
    ids, lengths = encode_rows(open(FILE).read(), odd, 0)
    at = np.concatenate(([0], np.cumsum(lengths)))
    odd = [*odd, *twins(), *SHORT_TWINS[0], *SHORT_TWINS[1]]
    ids, lengths = encode_rows(open(FILE).read(), odd, 0)
    at = np.concatenate(([0], np.cumsum(lengths)))
    for k, x in enumerate(odd):
        assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_query_against_the_library(spark, sf_dir):
    assert sorted(map(tuple, op7_token_files(spark, sf_dir).collect())) == expected(sorted(cases.corpus(spark, sf_dir)))


def test_order_lookup_and_awkward_rows(spark):
    path = scratch(spark)
    docs = cases.frame(spark, ["shard", "__k0"])
    write_tokens(docs, path, FILE, [F.col("doc_id")], shard_tokens=500)
    rows = sorted(((r[0], r[1]) for r in cases.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    t = Tokenizer.from_file(FILE)
    fox = t.encode(" fox", add_special_tokens=False).ids[0]
    places = [(i, k) for i, text in rows for k, x in enumerate(t.encode(text or "", add_special_tokens=False).ids) if x == fox]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, find_token(spark, path, fox).collect()), key=key) == sorted(places, key=key)
    assert count_token(spark, path, fox).agg(F.sum("count")).first()[0] == len(places)
    path = scratch(spark)
    write_tokens(cases.empty(spark), path, FILE, [F.col("doc_id")])
    assert read_tokens(spark, path).count() == 0


def test_ids_beyond_sixteen_bits(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 200_000, 3000).astype(np.uint32)
    w = WaveletMatrix.build(ids, 18)
    assert (w.decode() == ids).all() and w.access(7) == ids[7] and w.count(int(ids[7]), 0, 3000) == int((ids == ids[7]).sum())
    path = scratch(spark)
    write_tokens(cases.frame(spark), path, FILE, [F.col("doc_id")], end_id=100_000)
    assert count_token(spark, path, 100_000).agg(F.sum("count")).first()[0] == len(cases.rows())
    assert read_tokens(spark, path).count() == len(cases.rows())
