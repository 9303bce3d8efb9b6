"""Queries of the text operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import alignment, bpe, chat, common, decontaminate, fingerprint, hidden_markov, licenses, line_dedup, near_duplicates, periodic_runs, quality, range_coder, run_index


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return near_duplicates.near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return line_dedup.report(line_dedup.dedup_lines(common.table(spark, sf_dir, "documents")))


def op4_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return hidden_markov.score_documents(common.table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return licenses.report(licenses.scan_documents(common.table(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return decontaminate.report(decontaminate.find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return fingerprint.fingerprint_documents(common.table(spark, sf_dir, "documents"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    files = range_coder.write_ids(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return range_coder.read_ids(files, keep_ids=False)


def op10_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return run_index.report(run_index.repeated_spans(common.table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", periodic_runs.with_repeats().alias("text"))
    return periodic_runs.report(periodic_runs.find_runs(docs))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return alignment.align_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.report(chat.render(chat.reconstruct(chat.log_of(rows.unionByName(marks)))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_ngram_jaccard_join, op3_line_dedup, op4_hidden_markov_scores, op5_quality_classifier, op6_license_scan, op7_benchmark_decontamination, op8_document_fingerprints, op9_token_id_output, op10_run_length_dedup, op11_periodic_runs, op12_token_alignment, op13_chat_format)}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": near_duplicates.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op10_run_length_dedup": run_index.ORACLE,
    "op13_chat_format": chat.ORACLE,
}
