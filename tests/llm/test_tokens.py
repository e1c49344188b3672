import random

import pytest
import regex
from pyspark.sql import functions as F

from auditlake.llm import queries, tokens
from oracle import compare

ALPHABET = ["a", "B", "é", "日本", "ß", "1", "23", " ", "  ", "\n", "\t", "　", "​", ".", "'", "'s", "'re", "'ll", "’", "!?", "<|endoftext|>", "😀", "👩‍🚀", "é", "_", "\x00", "﻿"]


def sample(r, n):
    return "".join(r.choice(ALPHABET) if r.random() < 0.7 else r.choice(ALPHABET) * r.randrange(1, 20) for _ in range(n))


def test_pattern_is_the_vocabulary_s():
    public = pytest.importorskip("public_tokenizers")
    assert tokens.PATTERN == public.PATTERN


def test_boundaries_hold_for_every_scan():
    r = random.Random(1)
    for _ in range(300):
        text = sample(r, 60)
        true = {m.end() for m in regex.finditer(tokens.PATTERN, text)}
        for _ in range(5):
            start = r.randrange(len(text))
            assert {start + b for b in tokens.safe_boundaries(text[start:], 1, len(text))} <= true


def encoded(spark, rows, **more):
    df = spark.createDataFrame(rows, "id long, text string, ids string, row string")
    return [(r["row"], r["ids"]) for r in tokens.token_ids(df, F.col("id"), F.col("text"), **more).collect()]


def test_chunks_equal_the_whole(spark):
    enc, r = tokens.encoder(), random.Random(2)
    texts = [sample(r, r.choice([3, 30, 300, 1500])) for _ in range(80)] + ["a" * 5000, " " * 3000, "'s" * 2000, "ab " * 2000, "あ" * 4000 + "。" + "い" * 900, "x" * 99 + " " + "y" * 3000, "1" * 700 + "a" * 700]
    for chunk, overlap in ((100, 20), (257, 8)):
        got = dict(encoded(spark, [(i, t, None, "x") for i, t in enumerate(texts)], chunk=chunk, overlap=overlap))
        assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_nulls_empty_repeats_and_very_long(spark):
    enc = tokens.encoder()
    long = "The price rose to 5.50 for one lantern. " * 30_000
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, " ", None, None), (4, long, "", ""), (4, long, "", ""), (None, "x", "", ""), (5, "x", "", ""), (5, "y", "", "")]
    got = encoded(spark, rows)
    want = [(1, []), (2, []), (3, enc.encode_ordinary(" ")), (4, enc.encode_ordinary(long)), (4, enc.encode_ordinary(long)), (None, enc.encode_ordinary("x")), (5, enc.encode_ordinary("x")), (5, enc.encode_ordinary("y"))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(encoded(spark, rows, lengths_only=True), key=repr) == sorted([(a, len(b)) for a, b in want], key=repr)
    assert encoded(spark, []) == []


def test_against_the_other_library(spark, folder):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, folder).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


def test_round_trip(spark, folder):
    compare(spark, folder, queries.QUERIES["p6_roundtrip"], queries.SQL["p6_roundtrip"])


def test_decode_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert [(r["row"], r["text"]) for r in tokens.decode(df, F.col("id"), F.col("ids")).collect()] == [(1, None), (2, "")]
