import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilewright.llm import range_coder as R
from tilewright.llm import registry

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = R.TextEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=700), st.sampled_from([300, 49408]))
def test_any_ids_come_back(ids, vocabulary):
    block = R.encode_block(np.array(ids, np.int64), vocabulary)
    assert R.decode_block(block).tolist() == ids


@pytest.mark.parametrize("kind", ["one", "all", "two", "ends"])
def test_extreme_ids_come_back(kind):
    rng = np.random.default_rng(0)
    ids = {"one": np.full(20000, 7), "all": rng.integers(0, 49408, 20000), "two": np.arange(20000) % 2 * 49407, "ends": np.concatenate([np.zeros(9000, int), np.full(9000, 49407)])}[kind]
    block = R.encode_block(ids, 49408)
    assert (R.decode_block(block) == ids).all()
    assert len(block) < 2.4 * len(ids) + 4096 and (kind != "one" or len(block) < len(ids))


def test_mixing_beats_plain_ids():
    ids = np.concatenate([np.tile(np.random.default_rng(1).integers(0, 49408, 300), 60), np.random.default_rng(2).zipf(1.3, 20000) % 49408])
    assert len(R.encode_block(ids, 49408)) < 0.75 * 2 * len(ids)


def test_damage_is_seen():
    block = bytearray(R.encode_block(np.arange(1000), 49408))
    block[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        R.decode_block(bytes(block))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cn"], max_codepoint=0x1F6FF)), min_size=1, max_size=4))
def test_any_text_as_the_library(texts):
    ids, sizes = ENCODER.encode(pa.array(texts), 1)
    want = [x.ids + [1] for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def assert_as_library(texts):
    ids, sizes = ENCODER.encode(pa.array(texts), 1)
    want = [x.ids + [1] for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(sizes)
    for text, own, end, size in zip(texts, want, ends, sizes, strict=True):
        assert ids[end - size : end].tolist() == own, text


@pytest.mark.parametrize("form", ["a {}. b", "x{}!? {}{}", "{}x, {}"])
def test_every_letter_with_marks_as_the_library(form):
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() or unicodedata.combining(c)]
    assert_as_library([form.format(*[c] * form.count("{}")) for c in letters])


def test_special_and_dotted_strings_as_the_library():
    assert_as_library(["<|endoftext|>", "a<|endoftext|>b <|startoftext|>.", "<|ENDOFTEXT|>", "İSTANBUL BELEDİYESİ. Son", "a İ.", "İ!", "\u0958. x\u0958!", "it's I'LL 'S.", "ﬁ. ＡＢ! ẞ?", "Σ. ΑΣ, ς!"])


def test_many_odd_strings_as_the_library():
    rng = np.random.default_rng(8)
    pool = list("abZÉñİıßǅσΣ中のק٣9 \n\t.,!?'-\u0307\u0301\u0958\u00a0\u3000<|>_") + ["'s", "'ll", "<|endoftext|>", " İ.", "Ⅷ", "½", "👍🏽"]
    assert_as_library(["".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 24))) for _ in range(30_000)])


def test_one_word_and_one_line_of_megabytes():
    assert_as_library(["ab" * 1_000_000, "é" * 300_000 + ".", "word " * 400_000])


def check(rows, got):
    order = sorted((d is not None, d, t or "") for d, t in rows) if all(d is not None for d, _ in rows) else sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for row in order:
        doc_id, text = row[-2], row[-1] or ""
        ids = np.array(LIBRARY.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((str(doc_id), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_odd_rows(odd_docs, no_docs, block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_IDS", block)
    files = R.write_ids(odd_docs, PATH)
    got = R.read_ids(files).collect()
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()], got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert R.read_ids(R.write_ids(no_docs, PATH)).count() == 0


def test_query(spark, sf_dir, rows):
    check(rows, registry.QUERIES["op9_token_id_output"](spark, sf_dir).collect())
