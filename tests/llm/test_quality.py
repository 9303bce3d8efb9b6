import zlib

import numpy as np
import pytest

from tilewright.llm import quality as Q
from tilewright.llm import registry


def test_passages_cover_whole_texts():
    texts = [b"", b"a", b"word " * 400, bytes(range(256)) * 5]
    x, offsets = Q.passages(texts)
    assert np.diff(offsets).tolist() == [1, 1, -(-2000 // Q.PASSAGE), -(-1280 // Q.PASSAGE)]
    assert np.isfinite(x).all() and not x[0].any()
    one, _ = Q.passages([texts[2]])
    assert np.allclose(one, x[offsets[2] : offsets[3]], atol=1e-6)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, offsets, y = rng.normal(size=(9, Q.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = Q.Model.fresh(x, 1)

    def loss():
        p = model.score(x, offsets)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, grad in model.gradients(x, offsets, y, np.ones(3)).items():
        at = tuple(rng.integers(0, s) for s in grad.shape)
        keep, step = model.weights[k][at], 1e-6
        model.weights[k][at] = keep + step
        high = loss()
        model.weights[k][at] = keep - step
        low = loss()
        model.weights[k][at] = keep
        assert grad[at] == pytest.approx((high - low) / (2 * step), rel=1e-3, abs=1e-7), k


def test_scores_by_plain_arithmetic():
    """Encoder, gates, attention and output, number by number."""
    from math import exp, tanh

    rng = np.random.default_rng(2)
    x, offsets = rng.normal(size=(7, Q.N_FEATURES)), np.array([0, 1, 3, 7])
    model = Q.Model.fresh(x, 4)
    w, got = model.weights, model.score(x, offsets)
    dot = lambda a, b: sum(float(p) * float(q) for p, q in zip(a, b, strict=True))
    for bag in range(3):
        encoded, weights = [], []
        for row in x[offsets[bag] : offsets[bag + 1]]:
            scaled = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [tanh(dot(scaled, w["W"][:, k]) + w["b"][k]) for k in range(Q.HIDDEN)]
            gated = [tanh(dot(h, w["V"][:, k])) / (1 + exp(-dot(h, w["U"][:, k]))) for k in range(Q.GATE)]
            encoded.append(h)
            weights.append(exp(dot(gated, w["w"])))
        pooled = [sum(a * h[k] for a, h in zip(weights, encoded, strict=True)) / sum(weights) for k in range(Q.HIDDEN)]
        assert got[bag] == pytest.approx(1 / (1 + exp(-dot(pooled, w["c"]) - w["d"][0])))


def test_what_fits_the_classifier_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "FIT_PASSAGES", 5)
    docs = spark.createDataFrame([(1, "word " * 4000)] * 50 + [(1, "short")] * 20 + [(2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    x, offsets, marks = Q.training_rows(docs, labels, held_out=10**9)
    assert len(marks) == 3 and np.diff(offsets).max() <= 5 and len(x) == offsets[-1]


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(400)).encode() for _ in range(80)]
    bad = [g[:1500] + b"!!!! " * 120 + g[1500:] for g in good]
    x, offsets = Q.passages([*good[:60], *bad[:60]])
    model = Q.fit(x, offsets, np.repeat([1.0, 0.0], 60))
    scores = model.score(*Q.passages([*good[60:], *bad[60:]]))
    assert (scores[:20] > 0.5).all() and (scores[20:] < 0.5).all()


def test_odd_rows_labels_and_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (9, 1, 0), (9, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(odd_docs, labels)
    got = Q.score_documents(odd_docs, model, keep=tuple(odd_docs.columns)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert Q.train(odd_docs, labels.limit(0)) is None
    assert {r["score"] for r in Q.score_documents(odd_docs, None).collect()} == {0.5}
    one = Q.train(odd_docs, labels.filter("quality = 1"))
    assert all(r["predicted"] == 1 for r in Q.score_documents(odd_docs, one).collect())
    assert Q.score_documents(no_docs, model).count() == 0


def test_query_is_right_on_the_held_out_fold(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = registry.QUERIES["op5_quality_classifier"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert held and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9
