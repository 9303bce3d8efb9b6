import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import periodic_runs as P
from tilewright.llm import registry

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def collapsed(w):
    gone = {i for s, n, q in P.brute_force(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def edited(doc_id, text):
    """The contract's edit, word by word."""
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def runs(row):
    return [(r["start"], r["length"], r["period"]) for r in row["runs"]]


def test_runs_equal_the_definition(spark):
    rng = random.Random(7)
    texts = []
    for k in range(300):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(4))] + unit * rng.randrange(1, 12) + [rng.choice("abc") for _ in range(6)] + unit * rng.randrange(1, 6)
        # a copy of a whole run inside a later block, and a run that ends a text
        texts.append(rng.choice([" ", "\n", " \t "]).join(text * rng.randrange(1, 4)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.find_runs(df).collect()}
    for d, text in enumerate(texts):
        assert runs(got[d]) == P.brute_force(words(text)) and got[d]["collapsed"] == collapsed(words(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_runs_of_many_texts_together(texts):
    import numpy as np

    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = P.runs_of(np.array([w for t in texts for w in t], np.int32), bounds).tolist()
    assert got == [[s + int(b), n, q] for t, b in zip(texts, bounds, strict=False) for s, n, q in P.brute_force(t)]


def test_query_equals_the_definition(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in registry.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        w = edited(d, text)
        found, r = P.brute_force(w), got[d]
        best = min(((-n, s, q) for s, n, q in found), default=None)
        want = (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda x: (x[0], x[2])))
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > len(rows) // 20


def test_odd_rows(spark, odd_docs, no_docs):
    got = P.report(P.find_runs(odd_docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.count() == odd_docs.count() and P.report(P.find_runs(no_docs)).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    empty = got.filter("doc_id in (1, 2, 3)").collect()
    assert len(empty) == 3 and all((r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) == (0, None, none, none) for r in empty)
    long = P.find_runs(odd_docs).filter("doc_id = 9").first()  # 30000 words of period 977
    assert runs(long) == [(0, 30000, 977)] and len(long["collapsed"].split()) == 977


def test_texts_of_megabytes(spark):
    rng = random.Random(1)
    texts = ["x" * 2_000_000, "a " * 400_000, " ".join(f"w{rng.randrange(50000)}" for _ in range(300_000))]
    got = {r["doc_id"]: r for r in P.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert runs(got[0]) == [] and got[0]["collapsed"] == texts[0]
    assert runs(got[1]) == [(0, 400_000, 1)] and got[1]["collapsed"] == "a"
    assert runs(got[2]) == [] and got[2]["collapsed"] == texts[2]
