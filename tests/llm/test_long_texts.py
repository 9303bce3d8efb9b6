"""Texts of megabytes, one of them a single word, through the operators that take whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tilewright.llm import bpe, common, near_duplicates, run_index

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(260_000))
    words = long.split(" ")
    words[1000] = "changed"
    return [long, "ab" * 1_000_000, " ".join(words)]


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    common.prepare(spark)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe(long_docs, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(long_docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    assert got[0]["ids"] == library.encode_ordinary(texts[0])
    for d, text in enumerate(texts):
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_near_duplicates(long_docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(long_docs).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 1)}


def test_run_index(long_docs, texts):
    got = {r["doc_id"]: r for r in run_index.repeated_spans(long_docs).collect()}
    assert got[0]["edges"] == [] and got[0]["kept_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()
    assert got[1]["edges"] == []
    assert got[2]["n_bytes"] == len(texts[2]) and len(got[2]["edges"]) == 4  # all but the changed word
    (a, b), (c, d) = zip(got[2]["edges"][::2], got[2]["edges"][1::2], strict=True)
    at = texts[2].index("changed")
    assert a == 0 and d == len(texts[2]) and at - 2 <= b <= c <= at + 9
