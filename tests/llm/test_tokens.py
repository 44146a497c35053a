"""Corpus encoding against the tokenizer library itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from brindle.llm import tokens

DOC = "doc_id bigint, text string, ids string"
TEXTS = [
    None, "", " ", "  \n\t ", "Hello  world's 'tis I'll", "naïve café ſ ﬁ ß", "<|endoftext|> <|endoftext|>", "a b c\u0085d e", "😀😀 👍🏽 ​", "x" * 3000, " " * 500 + "y", "١٢٣ 一二三 Ⅷ ½", "don't'nt 'S 'LL", "a\x00b\x1fc\r\n\r\n d", "Wörter-\ntrennung 12,345.67 €", "same", "same", "\n\n\nx",
]


@pytest.fixture(scope="module")
def truth():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


@pytest.mark.parametrize("budget", [0, 60, 1 << 20])
def test_ids_equal_the_library_whatever_the_dictionary(spark, truth, budget):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], DOC)
    got = {r.doc_id: r.ids for r in tokens.encode(df, dictionary_bytes=budget).collect()}
    assert got == {i: truth(t) for i, t in enumerate(TEXTS)}


def test_random_texts(spark, truth):
    rng = random.Random(5)
    alpha = "ab AB12 .,'\n\t é字😀-—́"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {i: truth(t) for i, t in enumerate(texts)}


def test_round_trip_and_counts(spark, truth):
    df = spark.createDataFrame([(i % 7, t, None) for i, t in enumerate(TEXTS)], DOC)  # ids repeat
    back = tokens.decode(tokens.encode(df))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in TEXTS)
    counts = tokens.encode(df, count_only=True, keep=["text"])
    assert sorted((r.text or "", r.n_tokens) for r in counts.collect()) == sorted((t or "", len(truth(t))) for t in TEXTS)


def test_words_concatenate_to_the_text(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], DOC)
    rows = df.select("text", F.array_join(tokens.split_words(F.col("text")), "").alias("joined")).collect()
    assert all(r.joined == (r.text or "") for r in rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert tokens.encode(empty).count() == 0
    odd = spark.createDataFrame([(1, []), (2, None), (3, [10**6, 64, -1, None]), (4, [160]), (5, [64, 65])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(odd).collect()} == {1: "", 2: "", 3: "a", 4: "\ufffd", 5: "ab"}
