import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import fingerprint as P
from tilewright.llm import registry

TEXT = st.text(st.sampled_from("abé中😀 \n"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = P.PrefixHashes(a), P.PrefixHashes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert x.extension(i, y, j) == common
    end = data.draw(st.integers(i, len(a)))
    assert x.equal(i, end, y, j) == (b[j : j + end - i] == a[i:end])


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_equal_texts_alone_have_equal_fingerprints(a, b):
    x, y = P.fingerprint(a)[1], P.fingerprint(b)[1]
    assert (x == y) == (a == b)
    assert P.likeness(x, x) == 1 and 0 <= P.likeness(x, y) <= 1 and P.likeness(x, y) == P.likeness(y, x)


def test_likeness_follows_jaccard():
    import random

    rng = random.Random(3)
    words = [f"{rng.randrange(10**6)}x" for _ in range(600)]
    for keep in (600, 500, 300, 0):
        other = words[:keep] + [f"{rng.randrange(10**6)}y" for _ in range(600 - keep)]
        a, b = " ".join(words), " ".join(other)
        grams = [{t[i : i + P.SPAN] for i in range(len(t) - P.SPAN + 1)} for t in (a, b)]
        exact = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        assert P.likeness(P.fingerprint(a)[1], P.fingerprint(b)[1]) == pytest.approx(exact, abs=0.2)


def plain(text):
    """The fingerprint by its definition, in whole numbers: hashes of the text and of each span, one by one."""
    points = [ord(c) + 1 for c in text]

    def hashed(part):
        return [sum(x * pow(b, i, p) for i, x in enumerate(part)) % p for p, b in zip(P.MODULI, P.BASES, strict=True)]

    size, bins = min(P.SPAN, len(points)), [2**32 - 1] * P.BINS
    for i in range(len(points) - size + 1 if size else 0):
        one, other = hashed(points[i : i + size])
        x = (one << 31 | other) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 % 2**64 >> 32
        bins[x >> 26] = min(bins[x >> 26], x)
    short = ["ffff" if x == 2**32 - 1 else f"{min(x >> 10 & 0xFFFF, 0xFFFE):04x}" for x in bins]
    return f"{len(points):x}:" + "".join(f"{x:08x}" for x in hashed(points)) + ":" + "".join(short)


def plain_likeness(a, b):
    x, y = ([f.split(":")[2][i : i + 4] for i in range(0, 4 * P.BINS, 4)] for f in (a, b))
    either = [(v, w) for v, w in zip(x, y, strict=True) if (v, w) != ("ffff", "ffff")]
    return 1.0 if a == b else sum(v == w for v, w in either) / max(1, len(either))


@settings(max_examples=60, deadline=None)
@given(TEXT, TEXT)
def test_fingerprints_and_likeness_by_definition(a, b):
    x, y = P.fingerprint(a)[1], P.fingerprint(b)[1]
    assert (x, y) == (plain(a), plain(b)) and P.likeness(x, y) == plain_likeness(x, y)


def test_a_text_of_millions(spark):
    docs = spark.createDataFrame([(1, "ab" * 1_000_000), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in P.fingerprint_documents(docs, 2).collect()}
    assert got[1] == (2_000_000, hashlib.sha256(("ab" * 500_000 + "x").encode()).hexdigest())


def check(rows, got):
    order = sorted(((-(2**63) if d is None else d), t or "", d) for d, t in rows)
    order.sort(key=lambda x: -x[0])  # stable: equal ids by text
    want = []
    for (_, a, d), (_, b, _) in zip(order, [*order[1:], *order[:1]], strict=True):
        k = len(a) // 2
        edited = a[: len(a) - k] + b[:k]
        want.append((str(d), len(a), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(a)[1], P.fingerprint(edited)[1], P.likeness(P.fingerprint(a)[1], P.fingerprint(b)[1])))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got) == sorted(want)


@pytest.mark.parametrize("buckets", [1, 3, 20])
def test_odd_rows(odd_docs, no_docs, buckets):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(rows, P.fingerprint_documents(odd_docs, buckets).collect())
    assert P.fingerprint_documents(no_docs, buckets).count() == 0


def test_one_document_follows_itself(spark):
    (r,) = P.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string"), 4).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1


def test_query(spark, sf_dir, rows):
    got = registry.QUERIES["op8_document_fingerprints"](spark, sf_dir).collect()
    check(rows, got)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)
