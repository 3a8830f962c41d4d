from __future__ import annotations

import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merge_by_rank(v, data):
    """Every merge in order of rank, leftmost first."""
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((v.ids[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in v.ids), default=None)
        if best is None:
            return [v.ids[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def texts(n=1500):
    rnd = random.Random(2)
    kinds = ["ab", "aA ", "  \n\t\r", "é漢字🙂ß​", "aaaa", "<|endoftext|>", "0123", "'s've", "\x00\x1b", "the quick hash ", "ﬁǅ", "́"]
    return ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_equals_the_public_encoder(known):
    v = bpe.load()
    for t in [*texts(), " " * 500, "a" * 3000, "abcdefgh" * 900, "<|endoftext|>" * 20, "�" * 30]:
        assert v.encode(t) == known.encode_ordinary(t), repr(t)[:80]


def test_equals_merging_by_rank():
    v = bpe.load()
    rnd = random.Random(4)
    for _ in range(400):
        data = bytes(rnd.choice(b"etaoin shr\xc3\xa9lu") for _ in range(rnd.randint(1, 40)))
        assert v.encode_bytes(data) == merge_by_rank(v, data)


def test_a_small_vocabulary_with_backtracking():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"aa", b"aaa"]
    v = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    rnd = random.Random(1)
    for _ in range(500):
        data = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 14)))
        assert v.encode_bytes(data) == merge_by_rank(v, data), data


def test_time_is_linear_in_a_single_long_piece():
    import time

    v = bpe.load()
    rnd = random.Random(0)
    took = []
    for n in (20_000, 160_000):
        data = bytes(rnd.choice(b"abcdefgh") for _ in range(n))
        t = time.perf_counter()
        v.encode_bytes(data)
        took.append(time.perf_counter() - t)
    assert took[1] < 30 * took[0] + 0.5


def test_vocabulary_is_checked():
    with pytest.raises(ValueError):
        bpe.Vocabulary(base64.b64encode(b"a") + b" 1")
    with pytest.raises(ValueError):
        bpe.Vocabulary(base64.b64encode(b"a") + b" 0")


def test_decoding_by_offsets(known):
    v = bpe.load()
    rows = [known.encode_ordinary(t) for t in texts(200)]
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    data, ends = v.decode_rows(flat, np.cumsum([len(r) for r in rows]))
    begins = [0, *ends[:-1]]
    assert [data[a:b].tobytes().decode() for a, b in zip(begins, ends)] == texts(200)


def test_columns_round_trip_null_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "café <|endoftext|>"), (5, "x" * 50_000), (5, "x" * 50_000), (None, "\U0001f642")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra.col", F.lit(1))
    out = bpe.encode_corpus(df, "text")
    ids = [r["ids"] for r in out.orderBy("doc_id").collect()]
    assert ids[1] == ids[2] == []
    back = out.select("text", bpe.decoder(spark)("ids").alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decoder(spark)("ids").alias("t")).first()["t"] is None
    assert bpe.encode_corpus(out.withColumn("ids", F.lit("old")), "text").columns == out.columns
    assert bpe.encode_corpus(df, "text", "text").orderBy("doc_id").collect()[1]["text"] == []


def test_empty_table(spark):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "text").count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).select(F.expr("cast(unhex('61ff62') as string)").alias("text"))
    assert bpe.encode_corpus(df, "text").first()["ids"] == bpe.load().encode("a�b")


def test_sizes_split_at_the_first_line(spark):
    df = spark.createDataFrame([("do this\nanswer words",), ("one line",), ("",), (None,), ("\nx",)], "text string")
    v = bpe.load()
    got = [tuple(r["s"]) for r in df.select(bpe.sizes(spark)("text").alias("s")).collect()]
    assert got[0] == (len(v.encode("do this\nanswer words")), len(v.encode("do this\n")))
    assert got[1] == (2, 0) and got[2] == got[3] == (0, 0) and got[4][1] == 1


def test_other_vocabulary_by_parameter(spark):
    path = os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([("naïve 漢字",)], "text string")
    assert df.select(bpe.decoder(spark, path)(bpe.encoder(spark, path)("text")).alias("t")).first()["t"] == "naïve 漢字"
