import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tilewright.llm import alignment as A
from tilewright.llm import registry

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZEROS = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def plain():
    """All texts by the libraries alone and byte offsets."""
    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters, names = A.byte_letters(), {v: k for k, v in a_side.get_vocab().items()}

    def one(text):
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return None
        a_end, b_end = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            first = i, j
            while i < len(a) and a_end[i] <= cut:
                i += 1
            while j < len(b) and b_end[j] <= cut:
                j += 1
            groups.append((a[first[0] : i], b[first[1] : j]))
            links += [(a[x], b[y]) for x in range(first[0], i) for y in range(first[1], j) if max(a_end[x] - len(a_bytes[x]), b_end[y] - len(b_bytes[y])) < min(a_end[x], b_end[y])]
        return len(a), len(b), groups, links

    def run(texts):
        docs = [one(t or "") for t in texts]
        count = Counter(p for d in docs if d for p in set(d[3]))
        best = {}
        for (x, _), c in count.items():
            best[x] = max(best.get(x, 0), c)
        out = []
        for d in docs:
            if d is None:
                out.append(ZEROS)
                continue
            named = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in d[2])
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(named.encode()).hexdigest()))
        return out

    return run


def same(got, ids, want):
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))


def test_query_equals_the_libraries(spark, sf_dir, rows, plain):
    same(registry.op12_token_alignment(spark, sf_dir), [d for d, _ in rows], plain([t for _, t in rows]))


def test_odd_texts(spark, plain):
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "é", "中", "😀", "▁", "the", "<s>", "<|endoftext|>", " ", "́", "\x1c", "\x85", "'s", "12", "\t", "　", "﻿", " fo", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", " ", "x" * 3000, "▁", "a▁ b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same(A.align_documents(docs, *PATHS), range(len(texts)), plain(texts))


def test_odd_rows_and_groups(spark, odd_docs, no_docs, plain):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = A.align_documents(odd_docs, *PATHS, keep_groups=True)
    same(got.drop("groups"), [d for d, _ in rows], plain([t for _, t in rows]))
    for r in got.filter("n_a > 0").collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]
        assert len(r["groups"].split(";")) == r["n_groups"]
    assert A.align_documents(no_docs, *PATHS).count() == 0


def test_counts_span_blocks(spark, plain):
    texts = ["one two three", "two three four", None, "▁", "three four five", "one two three"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    same(A.align_documents(docs, *PATHS), range(len(texts)), plain(texts))


def test_texts_of_megabytes(spark, plain):
    texts = ["ab" * 250_000, "word " * 200_000]
    same(A.align_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *PATHS), range(2), plain(texts))


def test_transducer_forms_agree():
    """One by one and many at once; sides whose bytes differ are told."""
    t = A.Transducer([b"a", b"ab", b"b", b"abc"], [b"a", b"b", b"bc", b"ca"])
    assert t.align([3], [0, 2]) == ([0], [0, 0], [3 << A.SHIFT | 0, 3 << A.SHIFT | 2])
    assert t.align([0, 2], [0, 1]) == ([0, 1], [0, 1], [0, 2 << A.SHIFT | 1])
    assert t.align([3], [0, 1]) is None and t.align([1], [2]) is None and t.align([0], []) is None and t.align([], [0]) is None
    import numpy as np

    a, b = np.array([3, 0, 2, 3, 1]), np.array([0, 2, 0, 1, 0, 1, 2])
    own_a, own_b, owner, links, wrong = t.align_many(a, np.array([0, 1, 3, 4, 5]), b, np.array([0, 2, 4, 6, 7]))
    assert wrong.tolist() == [False, False, True, True]
    assert own_a[:3].tolist() == [0, 0, 1] and own_b[:4].tolist() == [0, 0, 0, 1]
    assert links[owner < 2].tolist() == t.align([3], [0, 2])[2] + t.align([0, 2], [0, 1])[2]
