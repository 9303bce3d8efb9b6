import os

import pytest

from tilewright.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, white, short, long, repeated and equal texts, and extra columns that carry inner names."""
    line = "the quick brown fox jumps over the lazy dog near the old river bank every single morning"
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, "   \n \t"), (4, "one"), (5, "Two  words\n\nmore"), (6, line), (6, line), (7, line), (8, line + "\n" + line), (9, long), (10, "É中文 😀 it's 123　x"),
        (None, line), (12, None), (13, "a\nb\nc\n" + line), (14, "x\na\nb\nc\n"), (14, "another text of the same id with a few more words in it"),
    ]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA)
    return docs.selectExpr("*", "1 as block", "'k' as text_key", "2 as rank", "'n' as node", "3 as bucket", "4 as pos", "0.5 as score", "7 as n_words")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
