import hashlib

import corpus_pipeline as C
import public_tokenizers
import tiktoken
from test_decontaminate import D
from test_line_dedup import brute as line_brute
from test_near_duplicates import brute as near_brute

from tilewright.llm import bpe, quality


def plain(spark, sf_dir):
    """All stages over Python lists, with the fitted classifier's scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.score(*quality.passages([t.encode()]))[0] >= quality.THRESHOLD]
    cut = line_brute(rows)
    rows = [(d, cut[d, t][0]) for d, t in rows if cut[d, t][1] < len(t.split("\n"))]
    kept = {c for _, c, _, _ in near_brute(rows)}
    rows = [(d, t) for d, t in rows if str(d) in kept]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = D.brute_force(rows, items)
    return {d: t for d, t in rows if not hit[d][1]}


def test_run_equals_the_plain_version(spark, sf_dir):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = plain(spark, sf_dir)
    got = {r["doc_id"]: r for r in C.run(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for d, text in want.items():
        assert got[d]["ids"] == library.encode_ordinary(text) and got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir, odd_docs, no_docs):
    assert len(C.STAGES) == 5
    for _, stage in C.STAGES[:-1]:
        assert tuple(stage(spark, odd_docs, sf_dir).columns) == C.COLUMNS
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert C.STAGES[-1][1](spark, odd_docs, sf_dir).count() == odd_docs.count()
