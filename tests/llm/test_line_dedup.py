import hashlib

import numpy as np
import pytest
from same import assert_same

from tilewright.llm import line_dedup as L
from tilewright.llm import registry


def brute(rows, min_lines=L.MIN_LINES, long_words=L.LONG_WORDS):
    """Distinct (id, text) rows in the order of ids: (text left, lines removed, maximal runs, longest run), by all pairs of places."""
    places = [(key, i) for key in sorted(set(rows)) for i in range(len(key[1].split("\n")))]
    lines = {key: key[1].split("\n") for key in set(rows)}
    by_line = {}
    for place in places:
        by_line.setdefault(lines[place[0]][place[1]], []).append(place)
    out, most = {}, {}
    for key, i in places:
        best, own = 0, lines[key]
        for other, j in by_line[own[i]]:
            if (other, j) >= (key, i):
                break
            n = 1
            while i + n < len(own) and j + n < len(lines[other]) and own[i + n] == lines[other][j + n]:
                n += 1
            best = max(best, n)
        if best >= min_lines or best and long_words is not None and len(own[i].encode().split()) >= long_words:
            most[key, i] = best
    for key, own in lines.items():
        runs = {i: most[key, i] for i in range(len(own)) if (key, i) in most}
        gone = {i + k for i, n in runs.items() for k in range(n)}
        maximal = [n for i, n in runs.items() if n > runs.get(i - 1, 1) - 1]
        out[key] = "\n".join(x for i, x in enumerate(own) if i not in gone), len(gone), len(maximal), max(maximal, default=0)
    return out


def results(row):
    return row["text"], row["n_removed"], row["n_runs"], row["longest_run"]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 5])
def test_every_run_length_equals_all_pairs(spark, min_lines):
    texts = ["a\nb\nc\nd\ne\nf", "x\na\nb\nc\nd\ny", "b\nc\nd\ne\nf", "a\na\na\na\na\na", "", "c\nd", "a\nb\nc\nd\ne\nf", "q", "\n\n\n", "a\nb\nc\nd\nc\nd\ne"]
    rows = list(enumerate(texts))
    want = brute(rows, min_lines)
    for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines).collect():
        assert results(r) == want[r["doc_id"], texts[r["doc_id"]]], r


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_runs_equal_all_pairs(spark, seed):
    """Short and long runs that overlap, nest and follow one another, of a few lines."""
    rng = np.random.default_rng(seed)
    pool = [[f"l{x}" for x in rng.integers(0, 6, n)] for n in (2, 3, 5, 9, 17, 40)]
    texts = ["\n".join(x for _ in range(rng.integers(1, 6)) for x in pool[rng.integers(len(pool))][rng.integers(0, 3) :]) for _ in range(30)]
    want = brute(list(enumerate(texts)))
    for r in L.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert results(r) == want[r["doc_id"], texts[r["doc_id"]]], r


def test_without_repeated_lines_nothing_goes(spark):
    rows = [(1, "a\nb"), (2, "c"), (3, "d\ne")]
    assert {(r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(t, 0) for _, t in rows}


def test_a_text_and_a_line_of_megabytes(spark):
    line, many = "x" * 2_000_000, "\n".join(map(str, range(10_000)))
    rows = [(1, line), (2, f"{line}\nz"), (3, many), (4, f"a\n{many}")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["longest_run"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 0, 0), 3: (10_000, 0, 0), 4: (10_001, 10_000, 10_000)}


def test_odd_rows_keep_their_columns(odd_docs, no_docs):
    got = L.dedup_lines(odd_docs)
    assert got.count() == odd_docs.count()
    assert set(odd_docs.columns) <= set(got.columns)
    assert {r["text_key"] for r in got.collect()} == {"k"}
    by_id = {r["doc_id"]: r for r in got.filter("doc_id in (8, 13, 14)").collect() if r["doc_id"] != 14 or r["n_lines"] > 1}
    assert by_id[8]["n_removed"] == 0 and by_id[13]["n_removed"] == 0
    assert by_id[14]["text"] == "x\n" and by_id[14]["n_runs"] == 1 and by_id[14]["longest_run"] == 3 and by_id[14]["n_chars"] == 2
    assert L.dedup_lines(no_docs).count() == 0


def test_query_equals_sql(spark, sf_dir, duck):
    got = registry.QUERIES["op3_line_dedup"](spark, sf_dir).toPandas()
    assert_same(got, duck.sql(registry.ORACLES["op3_line_dedup"]).df())


def test_kept_texts(docs, rows):
    want = brute([(d, t or "") for d, t in rows])
    assert want != brute([(d, t or "") for d, t in rows], long_words=None)
    for r in L.report(L.dedup_lines(docs)).collect():
        text, *rest = want[r["doc_id"], dict(rows)[r["doc_id"]] or ""]
        assert [r["kept_sha256"], r["n_removed"], r["n_runs"], r["longest_run"]] == [hashlib.sha256(text.encode()).hexdigest(), *rest]


def test_a_long_line_between_other_neighbours_goes(spark):
    long, short = " ".join(f"w{i}" for i in range(L.LONG_WORDS)), " ".join(f"w{i}" for i in range(L.LONG_WORDS - 1))
    texts = [long, f"a\n{long}\nb", f"c\n{long}\n{short}", f"{short}\nd\n{long}\nd\n{long}", f"c\n{long}"]
    got = L.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == {0: (long, 0), 1: ("a\nb", 1), 2: (f"c\n{short}", 1), 3: (f"{short}\nd", 3), 4: ("", 2)}


def test_two_lines_rule_alone(docs, rows):
    want = brute([(d, t or "") for d, t in rows], long_words=None)
    for r in L.dedup_lines(docs, long_words=None).collect():
        assert results(r) == want[r["doc_id"], dict(rows)[r["doc_id"]] or ""]
