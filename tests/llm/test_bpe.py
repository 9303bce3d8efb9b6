import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import bpe, registry

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, PATTERN)


def check(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]]
        assert own.tolist() == LIBRARY.encode_ordinary(text), text
        assert ENCODER.decode(own) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cn"], max_codepoint=0x1F6FF)), max_size=4))
def test_any_text_as_the_library(texts):
    check(texts)


def test_white_space_and_specials():
    check(["", " ", "a  b", " \n a", "a \n\n b  ", "it's we'll 'tis", "<|endoftext|> x", "　a  b", "x" * 3000, "ab" * 200 + " " + "ab" * 200, "😀" * 100])


def test_long_words_merge_as_short_ones():
    fold = bpe.RankFold(RANKS)
    for word in (b"internationalisation" * 9, bytes(range(256)), b"aaaa" * 60):
        assert fold._long(word) == fold._short(word)


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    check(["some words here"])
    check(["other words there", "some words here"])


def test_documents(spark, odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, PATH, PATTERN, keep_ids=True, keep_decoded=True).collect()
    assert len(got) == odd_docs.count()
    wanted = sorted((str(r["doc_id"]), r["text"] or "") for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in got) == wanted
    for r in got:
        assert r["ids"] == LIBRARY.encode_ordinary(bytes(r["decoded"]).decode()) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()
    assert bpe.encode_documents(no_docs, PATH, PATTERN).count() == 0
    back = bpe.decode_documents(spark.createDataFrame([(1, LIBRARY.encode_ordinary("it's so")), (2, None)], "doc_id long, ids array<int>"), PATH, PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {1: b"it's so", 2: b""}


def test_native_fold_gives_the_same_ids(spark):
    words = ["", "a", " the", "internationalisation", "don", "é中", "xqzjk"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_native(F.encode("w", "UTF-8"), RANKS).alias("ids"))
    assert {r["w"]: r["ids"] for r in df.collect()} == {w: LIBRARY.encode_ordinary(w) for w in words}


def test_query(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    for doc_id, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(data).hexdigest() and got[doc_id]["n_tokens"] == len(ids)
    assert len(got) == len(rows)


@pytest.mark.parametrize("bad", ["\x1c a", "a\x85 b", "​ x"])
def test_rare_white_space(bad):
    check([bad])
