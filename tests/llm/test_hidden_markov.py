import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import hidden_markov as H
from tilewright.llm import registry


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]


def base(rows, modulus=7, remainder=2):
    held = [zlib.crc32(str("" if d is None else d).encode()) % modulus == remainder for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(str(d), h, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for (d, t), h in zip(rows, held, strict=True)]


def test_base_scores_are_exact(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in H.score_documents(odd_docs, rounds=2).collect()))
    for g, w in zip(got, sorted(base(rows)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and np.isfinite(g[6]) and g[6] < 0
    assert H.score_documents(no_docs).count() == 0


def test_without_training_rows_the_score_is_the_base(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = H.score_documents(spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in got)


def test_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = H.Model(norm(rng.random(3)), norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6)]
    got = H.log_likelihood(model, np.concatenate(seqs).astype(np.uint16), np.array([1, 4, 6]))
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.step[a, b] * model.emit[x, b]
            total += p
        assert g == pytest.approx(log10(total))


def test_counts_are_posteriors():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = H.Model(norm(rng.random(2)), norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))).T)
    s = rng.integers(0, 4, 5)
    counts = H.Counts.zero(model)
    counts.add(model, s.astype(np.uint16), np.array([5]))
    start, step, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in np.ndindex(*[2] * 5):
        p = model.start[path[0]] * model.emit[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:], strict=False):
            p *= model.step[a, b] * model.emit[x, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            step[a, b] += p
        for x, a in zip(s, path, strict=True):
            emit[x, a] += p
    assert np.allclose(counts.start, start / total, atol=1e-5) and np.allclose(counts.step, step / total, atol=1e-4) and np.allclose(counts.emit, emit / total, atol=1e-5)
    assert counts.log == pytest.approx(log10(total), abs=1e-5)


def test_training_does_not_lose_likelihood():
    rng = np.random.default_rng(2)
    lexicon = H.Lexicon(5000, 8, {bytes([i]): i for i in range(6)}, np.full(6, 800), np.array([100, 100]))
    symbols = np.where(np.arange(5000) // 50 % 2, rng.integers(0, 3, 5000), rng.integers(3, 6, 5000)).astype(np.uint16)
    model, logs = H.Model.fresh(lexicon, 2), []
    for _ in range(12):
        counts = H.Counts.zero(model)
        counts.add(model, symbols, np.full(10, 500))
        logs.append(counts.log)
        model = counts.model(lexicon, smooth=1e-6)
    assert logs[-1] > logs[1] and all(b > a - 12 for a, b in zip(logs[1:], logs[2:], strict=False))
    assert logs[-1] > 5000 * log10(1 / 4)


def test_scores_do_not_depend_on_the_number_of_buckets(spark, docs, rows, monkeypatch):
    width, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens(t))
    want = [(b"" if w is None else w.encode(), c) for w, c in counts.items()]
    want = sorted(want, key=lambda x: (-x[1], x[0]))[:300]
    try:
        for n in (4, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            blocks = H.token_blocks(docs, 7, 2, n)
            assert H.frequent_words(blocks, H.word_totals(blocks, 300, 64, n), 300) == want
            made.append({r["doc_id"]: r["score"] for r in H.score_documents(docs, rounds=1, most=300, groups=64).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    for other in made[1:]:
        assert other == pytest.approx(made[0], abs=1e-6)


def test_counts_in_a_tree_are_the_counts(spark, docs, monkeypatch):
    one = H.score_documents(docs.repartition(9), rounds=1, most=300, groups=64, block_bytes=10_000)
    want = {r["doc_id"]: r["score"] for r in one.collect()}
    monkeypatch.setattr(H, "TREE", 2)
    got = {r["doc_id"]: r["score"] for r in H.score_documents(docs.repartition(9), rounds=1, most=300, groups=64, block_bytes=10_000).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_query_score_is_the_recursion_over_words(spark, docs, rows):
    """The model's own numbers, applied to plain words one by one."""
    blocks = H.token_blocks(docs, 7, 2, 4)
    totals = H.word_totals(blocks, 300, 64, 4)
    lexicon = H.Lexicon.of(blocks, totals, 300, 64)
    symbols = H.symbol_blocks(blocks, totals, lexicon)
    model = H.train(symbols, lexicon, rounds=1)
    got = {r["doc_id"]: r["score"] for r in H.score(symbols, lexicon, model).collect()}
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens(t))
    names = {(b"" if w is None else w.encode()): c for w, c in counts.items()}
    frequent = sorted(names, key=lambda w: (-names[w], w))[:300]
    place, group = {w: i for i, w in enumerate(frequent)}, Counter()
    for w, c in names.items():
        if w not in place:
            group[zlib.crc32(w[-3:]) % 64] += c
    for d, t in rows[:40]:
        state, total = model.start, 0.0
        for i, w in enumerate(b"" if w is None else w.encode() for w in tokens(t)):
            if w in place:
                emit = model.emit[place[w]]
            elif w in names:
                g = zlib.crc32(w[-3:]) % 64
                emit = model.emit[300 + g] * names[w] / group[g]
            else:
                emit = model.emit[-1] / (len(names) + 1)
            state = (state if i == 0 else state @ model.step) * emit
            total += log10(state.sum())
            state = state / state.sum()
        assert got[d] == pytest.approx(total, abs=1e-6)


def test_query_beats_the_base_on_held_out_texts(spark, sf_dir, rows):
    got = registry.QUERIES["op4_hidden_markov_scores"](spark, sf_dir).collect()
    want = {int(w[0]): w for w in base(rows)}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5] and r["base_score"] == pytest.approx(w[5])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_buckets_grow_in_number_and_not_in_size(spark, docs, rows, monkeypatch):
    want = {r["doc_id"]: r["score"] for r in H.score_documents(docs, rounds=1, most=300, groups=64).collect()}
    made, token_blocks = [], H.token_blocks
    monkeypatch.setattr(H, "BUCKET_BYTES", sum(len((t or "").encode()) for _, t in rows) // 40)
    monkeypatch.setattr(H, "token_blocks", lambda docs, modulus, remainder, buckets, size: made.append(buckets) or token_blocks(docs, modulus, remainder, buckets, size))
    got = {r["doc_id"]: r["score"] for r in H.score_documents(docs, rounds=1, most=300, groups=64, block_bytes=50_000).collect()}
    assert made[0] >= 40 > int(spark.conf.get("spark.sql.shuffle.partitions")) and got == pytest.approx(want, abs=1e-4)


def test_groups_of_words_are_those_of_each():
    words = pa.array([b"", b"a", b"ab", b"abc", b"abcd", b"\xff\x00z", b""])
    assert H.groups_of(words, 2048).tolist() == [H.group_of(w, 2048) for w in words.to_pylist()]
    assert H.groups_of(words[3:], 7).tolist() == [H.group_of(w, 7) for w in words[3:].to_pylist()]
    assert H.groups_of(words[:1], 7).tolist() == [0]
