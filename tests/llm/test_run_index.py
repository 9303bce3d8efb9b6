import numpy as np
import pyarrow as pa
import pytest
from same import assert_same

from tilewright.llm import registry
from tilewright.llm import run_index as R


def check(rows, got):
    want = sorted((str(d), len((t or "").encode()), *b) for (d, t), b in zip(rows, R.brute_force(rows), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def passages(seed, n=60):
    """Documents that share passages at all offsets, with edits, runs of one byte, and windows' length on the dot."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcde "), rng.integers(45, 200))) for _ in range(8)] + ["x" * 130, "ab" * 80, "é" * 40, "y" * 50, "z" * 49]
    out = []
    for _ in range(n):
        text = "".join("".join(rng.choice(list("fghij"), rng.integers(0, 30))) + pool[rng.integers(len(pool))] for _ in range(rng.integers(1, 6)))
        if rng.random() < 0.5:
            at = rng.integers(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        out.append(text)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("how", [{}, {"heavy": 0}, {"heavy": 2, "block_bytes": 1000}])
def test_shared_passages_equal_brute_force(spark, seed, how):
    rows = [(int(d), t) for d, t in zip(np.random.default_rng(seed).permutation(60), passages(seed), strict=True)]
    check(rows, R.report(R.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), **how)).collect())


def test_hashes_that_collide_remove_nothing(spark, monkeypatch):
    """Two strings of equal keys, and of equal keys and names, as heavy windows and as segments."""
    rows = [(1, "a" * 50), (2, "b" * 50), (3, "c" * 20 + "a" * 50 + "d" * 20), (4, "b" * 50)]
    resolve, hashes = R._resolve, R._window_hashes
    sent = []

    def collide(names):
        def f(data, at, base):
            real = hashes(data, at, base)
            return np.full(len(at), 7 << 20, np.uint64) if base == R._M[0] or names else real

        return f

    for names in (False, True):
        monkeypatch.setattr(R, "_window_hashes", collide(names))
        table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "block": [0] * 4})
        anchors = R._name_anchors(1)(table)
        statuses = R._find_repeated(0)(anchors)
        contents = R._send_contents(1)(table, statuses)
        least = resolve(contents)
        answers = pa.concat_tables([statuses, least], promote_options="default")
        out = R._mark(1)(table, answers).to_pylist()
        sent.append([(r["doc_id"], sum(r["edges"][1::2]) - sum(r["edges"][::2])) for r in sorted(out, key=lambda r: r["doc_id"])])
    assert sent == [[(1, 0), (2, 0), (3, 50), (4, 50)]] * 2


def test_long_texts_are_worked_through_in_pieces(spark, monkeypatch):
    text = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 20000))
    data, sizes = np.frombuffer(text.encode(), np.uint8), np.array([20000])
    whole = R.segments(data, sizes)
    monkeypatch.setattr(R, "PIECE", 700)
    parts = R.segments(data, sizes)
    assert whole.windows.sum() == parts.windows.sum() == 20000 - R.WINDOW + 1
    anchors = [np.repeat(s.anchor, s.windows)[np.argsort(np.concatenate([np.arange(a, a + n) for a, n in zip(s.start, s.windows, strict=True)]))] for s in (whole, parts)]
    assert (anchors[0] == anchors[1]).all()


def test_index_samples_are_first_documents():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"ab"), rng.integers(50, 90))) for _ in range(40)] + [b"a" * 80, b"a" * 60]
    docs = np.sort(rng.integers(0, 30, len(texts)))
    windows = np.array([len(t) - R.WINDOW + 1 for t in texts])
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    index = R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), starts, windows, docs)
    first = {}
    for t, d in zip(texts, docs, strict=True):
        for i in range(len(t) - R.WINDOW + 1):
            first[t[i : i + R.WINDOW]] = min(first.get(t[i : i + R.WINDOW], 99), d)
    want = [first[t[i : i + R.WINDOW]] for t in texts for i in range(len(t) - R.WINDOW + 1)]
    assert index.first_documents().tolist() == want
    assert index.n_runs <= windows.sum() + len(texts)


def test_odd_rows(odd_docs, no_docs):
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()], R.report(R.repeated_spans(odd_docs)).collect())
    assert R.repeated_spans(no_docs).count() == 0


def test_query(spark, sf_dir, rows):
    check(rows, registry.QUERIES["op10_run_length_dedup"](spark, sf_dir).collect())


def test_query_equals_sql(spark, sf_dir, duck):
    assert_same(registry.QUERIES["op10_run_length_dedup"](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES["op10_run_length_dedup"]).df())


def test_keys_and_texts_come_back_squeezed():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 100_000, dtype=np.uint64))
    keys = keys[keys % np.uint64(7) == 3]
    for own in (keys, rng.permutation(keys), keys[:1]):
        packed = R._pack_keys(own, 7)
        assert (R._unpack_keys(packed) * np.uint64(7) + np.uint64(3) == own).all()
    assert len(R._pack_keys(keys, 7)) < 5 * len(keys) < 6 * len(keys)
    rows = [(1, "é" * 30, 2), (None, "", 0), (3, "lorem ipsum " * 40, 2), (4, "x", 0), (5, "lorem ipsum " * 40, 1)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t, "block": b} for d, t, b in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())]))
    made = pa.Table.from_batches(list(R._gather(iter([batch.slice(1, 1), batch.slice(0, 1), batch.slice(2)]))))
    assert made.column("block").to_pylist() == [0, 1, 2]
    assert sorted((None if null else d, t.decode()) for d, null, t in R._unpacked(made) if not null) == sorted((d, t) for d, t, _ in rows if d)
    assert [t for _, null, t in R._unpacked(made) if null] == [b""] and sum(len(x) for x in made.column("text").to_pylist()) < 200


def test_names_tell_contents_apart():
    text = b"".join(bytes([97 + i % 5]) * 60 + b"-" * 40 for i in range(10))
    windows = np.array([51, 1] * 7)[:13]
    size = windows + R.WINDOW - 1
    parts = [text[i * 37 : i * 37 + n] for i, n in enumerate(size.tolist())] * 2
    data, start = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.tile(size, 2)) - np.tile(size, 2)
    names = R._names(data, start, np.tile(windows, 2), many=3)
    assert (names[:13] == names[13:]).all() and len(set(names.tolist())) == len(set(parts))


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_anchors_are_dealt_by_windows(spark, seed):
    """An anchor of many windows is as heavy as one in many blocks; all blocks' windows count."""
    rows = [(int(d), t) for d, t in zip(np.random.default_rng(seed).permutation(60), passages(seed), strict=True)]
    check(rows, R.report(R.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000, heavy_windows=100)).collect())
    ends = ["".join(np.random.default_rng(i).choice(list("klmnopq"), 60)) for i in range(600)]
    texts = [e[:30] + "a passage of just less than a window's fifty byte" + e[30:] for e in ends]
    tables = [pa.table({"doc_id": range(b, 600, 3), "text": texts[b::3], "block": [b] * 200}) for b in range(3)]
    anchors = pa.concat_tables([R._name_anchors(1)(t) for t in tables])
    limits = [3 * 10**4, 1000, 0]
    heavy = [sum(np.unpackbits(np.frombuffer(s[len(s) // 2 :], np.uint8)).sum() for s in R._find_repeated(1024, n)(anchors).column("status").to_pylist()) for n in limits]
    assert heavy[0] == 0 and heavy[2] > 0 and heavy[1] > 0


def test_buckets_grow_with_the_corpus_not_only_with_partitions(spark, monkeypatch):
    seen, real = [], R._name_anchors
    monkeypatch.setattr(R, "_name_anchors", lambda buckets: seen.append(buckets) or real(buckets))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = [(i, t) for i, t in enumerate(passages(6, 40))]
        check(rows, R.report(R.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1000)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] >= sum(len(t.encode()) for _, t in rows) / 1000 > 4


def test_a_bucket_is_indexed_and_marked_by_slices(monkeypatch):
    """No index and no marking grows with a bucket's or a block's repeated contents, and the rows stay the same."""
    texts = passages(7, 80)
    rows = list(enumerate(texts))
    halves = [pa.table({"doc_id": range(b, 80, 2), "text": texts[b::2], "block": [b] * 40}) for b in range(2)]

    def spans():
        anchors = [R._name_anchors(3)(t) for t in halves]
        by = lambda tables, c, v: (x := pa.concat_tables(tables)).filter(pa.array(x.column(c).to_numpy() == v))
        statuses = [R._find_repeated(1024)(by(anchors, "bucket", b)) for b in range(3)]
        contents = [R._send_contents(3)(t, by(statuses, "block", i)) for i, t in enumerate(halves)]
        least = [R._resolve(by(contents, "bucket", b)) for b in range(3)]
        answers = pa.concat_tables([*statuses, *least], promote_options="default")
        marked = pa.concat_tables([R._mark(3)(t, by([answers], "block", i)) for i, t in enumerate(halves)]).to_pylist()
        return [r | {"n_removed": sum(r["edges"][1::2]) - sum(r["edges"][::2]), "n_spans": len(r["edges"]) // 2} for r in marked]

    sizes, made = [], R.RunIndex.__init__
    monkeypatch.setattr(R.RunIndex, "__init__", lambda self, data, start, windows, docs: sizes.append(int(windows.sum())) or made(self, data, start, windows, docs))
    check(rows, whole := spans())
    largest, several = max(sizes), len(sizes)
    sizes.clear()
    monkeypatch.setattr(R, "SLICE_WINDOWS", 50)
    monkeypatch.setattr(R, "SLICE_RUNS", 7)
    assert spans() == whole
    assert max(sizes) < largest and len(sizes) > several


def test_windows_of_two_bytes_that_change_places_are_told_apart():
    """All pairs of bytes in one block, where contents are told apart by hash alone."""
    text = np.random.default_rng(8).permutation(np.arange(65, 115)).astype(np.uint8)
    swapped = [text.copy() for _ in range(R.WINDOW * (R.WINDOW - 1) // 2)]
    for own, (i, j) in zip(swapped, ((i, j) for i in range(R.WINDOW) for j in range(i)), strict=True):
        own[[i, j]] = own[[j, i]]
    assert len({int(R._piece(x)[1][0]) for x in [text, *swapped]}) == len(swapped) + 1
    texts = ["".join(map(chr, text)), *("".join(map(chr, x)) for x in swapped)]
    table = pa.table({"doc_id": range(len(texts)), "text": texts, "block": [0] * len(texts)})
    anchors = R._name_anchors(1)(table)
    statuses = R._find_repeated(1024)(anchors)
    answers = pa.concat_tables([statuses, R._resolve(R._send_contents(1)(table, statuses))], promote_options="default")
    assert all(not r["edges"] for r in R._mark(1)(table, answers).to_pylist())
