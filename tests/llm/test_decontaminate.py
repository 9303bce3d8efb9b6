import hashlib

import pytest
from same import assert_same

from tilewright.llm import decontaminate as D
from tilewright.llm import registry


def as_rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.report(df).collect())


def wanted(docs, items):
    out = []
    for doc_id, text in docs:
        n, hit, found = D.brute_force([(doc_id, text)], items)[doc_id]
        out.append((str(doc_id), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    return sorted(out)


ITEMS = [(1, "The quick brown FOX jumps over the lazy dog near the old river"), (2, "one"), (10, None), (11, ""), (12, "!!"), (20, "two words"), (21, "a b c d e f g h i j"), (22, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (23, "a b c d e f g h i j"), (24, "É中文 x")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_odd_rows_and_blocks_equal_brute_force(spark, odd_docs, block_bytes):
    extra = spark.createDataFrame([(30, "a-b c.d e f g h i j then a b c d e f g h i j k"), (31, "over the lazy dog near the old river bank"), (32, "a b c d e f g h i a b c d e f g h i j")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as n_words")
    got = D.find_contamination(docs, items, block_bytes)
    assert as_rows(got) == wanted(rows, [(str(i), t) for i, t in ITEMS])


def test_columns_kept_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.find_contamination(odd_docs, items, keep=tuple(odd_docs.columns))
    assert kept.count() == odd_docs.count() and {"text", "text_key", "block", "n_words"} <= set(kept.columns)
    assert D.find_contamination(no_docs, items).count() == 0
    assert {r["contaminated"] for r in D.report(D.find_contamination(odd_docs, items.limit(0))).collect()} == {False}


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_kept_columns_of_inner_names(spark, block_bytes):
    docs = spark.createDataFrame([(1, "two words", 5, "b", 7), (1, "two words", 5, "b", 7), (2, None, None, None, None)], "doc_id long, text string, row long, __body string, key long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, D.find_contamination(docs, items, block_bytes, keep=("row", "text", "__body", "key")).collect()))
    assert got == [(1, 2, [0, 2], ["20"], 5, "two words", "b", 7)] * 2 + [(2, 0, [], [], None, None, None, None)]


def test_a_word_and_a_text_of_megabytes(spark):
    docs = spark.createDataFrame([(1, "x" * 2_000_000), (2, "y " * 300_000 + "two words")], "doc_id long, text string")
    got = D.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["hit_edges"], r["items"]) for r in got] == [(1, [], []), (300_002, [300_000, 300_002], ["20"])]


def test_query_equals_brute_force(spark, sf_dir, rows):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = registry.QUERIES["op7_benchmark_decontamination"](spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == wanted(rows, items)
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_query_equals_sql(spark, sf_dir, duck):
    assert_same(registry.QUERIES["op7_benchmark_decontamination"](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES["op7_benchmark_decontamination"]).df())
