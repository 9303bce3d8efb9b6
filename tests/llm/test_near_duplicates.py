import numpy as np
import pytest
from pyspark.sql import functions as F
from same import assert_same

from tilewright.llm import near_duplicates as N
from tilewright.llm import registry


def sets(rows):
    shingle = N.Shingler()
    return [set(shingle(t or "").tolist()) for _, t in rows]


def brute(rows, threshold=N.THRESHOLD):
    s = sets(rows)
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            both = len(s[i] & s[j])
            links[i, j] = links[j, i] = s[i] == s[j] or both >= threshold * (len(s[i]) + len(s[j]) - both) - 1e-9 and bool(s[i]) and bool(s[j])
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i], *(label[j] for j in np.flatnonzero(links[i]))])
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[i]] = min(ids.get(label[i], d), d)
    return sorted((str(rows[i][0]), str(ids.get(label[i])), int(links[i].sum()), sum(s[i] == s[j] for j in range(n)) - 1) for i in range(n))


def got(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in df.collect())


def test_odd_rows_equal_all_pairs(odd_docs):
    assert got(N.near_duplicates(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_empty_table(no_docs):
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one(no_docs).count() == 0


def variants(seed, n, words=400, edits=4):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, edits):
            copy[at] = f"e{rng.integers(10**9)}"
        out.append(" ".join(copy))
    return out


def test_large_group_in_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = list(enumerate([*variants(1, 70), *variants(2, 5), "alone in the world with no copy at all"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(df)) == brute(rows)
    kept = [r["doc_id"] for r in N.keep_one(df).collect()]
    assert sorted(kept) == sorted({int(c) for _, c, _, _ in brute(rows)})


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_a_chain_is_compared_bucket_by_bucket(spark, monkeypatch, dense):
    """Neighbours share half of their shingles or more, so candidates chain; a dense group hangs at its end."""
    rng = np.random.default_rng(6)
    words = [f"c{x}" for x in rng.integers(0, 10**6, 40 * 400 + 400)]
    chain = [" ".join(words[i * 40 : i * 40 + 240]) for i in range(300)]
    rows = list(enumerate([*chain, *variants(7, 30), chain[5] + " one more"]))
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "DENSE", dense)
    dealt = []
    units = N._units

    def seen(buckets):
        dealt.append(units(buckets))
        return dealt[0]

    monkeypatch.setattr(N, "_units", seen)
    compared = []
    monkeypatch.setattr(N.common, "discard", lambda *t: compared.extend(x for x in t if dealt and x is dealt[0]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(df)) == brute(rows)
    pairs = sum(n * n for n in (r["count"] for r in compared[0].groupBy("unit", "tree").count().collect()))
    assert pairs < 300 * 300 / 4
    assert compared[0].filter("tree >= 0").count() > 0


def test_prefixes_shorten_to_what_is_found(spark):
    """Signatures of near copies at 0.97 or more leave the prefixes long; a pair near the threshold shortens them."""
    close = [(i, t) for i, t in enumerate(t for s in range(8) for t in variants(20 + s, 2, 400, 1))]
    far = [(100 + i, t) for i, t in enumerate(variants(40, 6, 400, 8))]
    for rows, depth in ((close, N.DEPTH), (close + far, N.prefix_depth())):
        sets_ = N._sets(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc_id").alias("id"), "minima")
        members = N._members(sets_, N.prefix_depth())
        assert N.prefix_depth(N.least_likeness(members, sets_, N.THRESHOLD)) == depth


def test_members_are_those_of_shared_prefixes(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sets_ = N._sets(docs.select("doc_id", N.common.text_of())).filter("n_shingles > 0").select(F.col("doc_id").alias("id"), "minima")
        rows = sets_.collect()
        got = {(r["tree"], bytes(r["key"]), r["id"]): r["near"] for r in N._members(sets_, 4).collect()}
    finally:
        N.common.prepare(spark)
    keys = sorted((t, bytes(r["minima"])[24 * t : 24 * t + 24], r["id"]) for r in rows for t in range(N.TREES))
    want = {}
    for i, (t, k, d) in enumerate(keys):
        same = lambda j, t=t, k=k: 0 <= j < len(keys) and keys[j][0] == t and keys[j][1][:16] == k[:16]
        if same(i - 1) or same(i + 1):
            want[t, k, d] = keys[i - 1][2] if same(i - 1) else None
    assert got == want


def test_keep_one_keeps_columns_of_inner_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9), (2, "a b c", 7, 8, 9)], "doc_id long, text string, __key long, __id long, __other long")
    assert [tuple(r) for r in N.keep_one(docs).collect()] == [(1, "a b c", 7, 8, 9)]


def test_null_ids_are_linked_too(spark):
    rows = [(None, t) for t in variants(4, 4)] + [(3, variants(4, 5)[4]), (None, "on its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(df)) == brute(rows)


def test_keep_one_keeps_columns_and_drops_repeated_rows(odd_docs):
    kept = N.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 0 and ids.count(1) == 1 and ids.count(2) == 0 and 9 in ids and 14 in ids


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    both = N.intersections(own)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert both[i, j] == len(set(own[i].tolist()) & set(own[j].tolist()))


def test_depth_meets_the_recall():
    assert N.prefix_depth() == 4
    assert 1 - (1 - 0.8 ** N.prefix_depth()) ** N.TREES >= N.RECALL
    assert N.prefix_depth(0.99, recall=0.5) == N.DEPTH


def test_query_equals_sql(spark, sf_dir, duck):
    assert_same(registry.QUERIES["op2_ngram_jaccard_join"](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES["op2_ngram_jaccard_join"]).df())


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 5), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, edges):
    from tilewright.llm import common

    df = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in common.components(df, "test").collect()} == label


@pytest.mark.parametrize("ids", ["null", "equal", "repeated"])
def test_rows_to_verification_grow_with_the_rows(spark, monkeypatch, ids):
    """Many rows of null or of one id, or many equal rows, among near copies."""
    words = [f"w{i}" for i in range(200)]
    counts = []
    plain = N._texts
    monkeypatch.setattr(N, "_texts", lambda *args: counts.append(plain(*args).count()) or plain(*args))
    for n in (100, 200):
        texts = [" ".join(words[:50] + [f"x{i // 2}"] + words[60:100] + [f"y{i}"] * (i % 2) + [f"z{i // 2}_{k}" for k in range(60)]) for i in range(n)]
        rows = [(None if ids == "null" else 7, t) for t in texts]
        if ids == "repeated":
            rows = [(7, texts[0])] * n + [(8, texts[1])] * n + [(9, "other words of another text altogether")]
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        if ids == "repeated":
            assert sorted(r["n_links"] for r in got) == [0] + [2 * n - 1] * (2 * n)
        else:
            assert all(r["n_links"] >= 1 for r in got)
    assert counts[1] <= 2 * counts[0] and counts[1] <= 400
