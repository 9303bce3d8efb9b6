"""A training-data pipeline over ``documents``: five stages, each one operator at its usual parameters.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return
the columns of documents. A stage sees all rows that its predecessor kept. For every stage
an empty table gives no rows, other columns than those of documents are left out, texts
are taken whole at any length, and a null text is the empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, common, decontaminate, line_dedup, near_duplicates, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, learned from the labelled ones among these, rejects.

    Without labels all stay. Equal texts, null and empty ones too, are kept or dropped alike; repeated rows are rows of their own.
    """
    common.prepare(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    if model is None:
        return docs.select(*COLUMNS)
    return quality.score_documents(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs and of long single lines; a document of which nothing is left goes.

    Earlier means a smaller id, null first, then the text's hash, then the line. A null text turns into the
    empty text, whose one empty line is no copy. Repeated rows of equal id and text are cut alike.
    """
    common.prepare(spark)
    return line_dedup.dedup_lines(docs).filter("n_removed < n_lines").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id (null first, then the text's hash).

    Texts without words, null ones too, are one class; of repeated rows one stays.
    """
    common.prepare(spark)
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark window occurs. Null and empty texts hold none; repeated rows stay or go together."""
    common.prepare(spark)
    hits = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return hits.filter(F.size("hit_edges") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of the decoded bytes, a row for each row."""
    common.prepare(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: A fitted classifier and BPE are beyond SQL; tests/llm holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
