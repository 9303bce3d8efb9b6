import numpy as np
import pytest

from tilewright.llm import licenses as L
from tilewright.llm import registry


def brute(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    """Templates of which some window at the operator's size and stride holds the share."""
    index, words, found = L.Index.of(templates, threshold), L.words_of(text or ""), set()
    for c in index.classes:
        last = max(0, len(words) - c.window)
        for start in {*range(0, last + 1, c.stride), last}:
            own = words[start : start + c.window]
            grams = {tuple(own[i : i + c.size]) for i in range(len(own) - c.size + 1)}
            found |= {name for name, t in c.members if len(t & grams) / len(t) >= threshold}
    return sorted(found)


def test_any_place_of_a_template_is_found():
    index = L.Index.of(L.TEMPLATES)
    for at in range(0, 45, 4):
        for name, text in L.TEMPLATES:
            words = [f"w{i}".encode() for i in range(at)] + L.words_of(text) + [f"v{i}".encode() for i in range(50 - at)]
            assert name in {m[0] for m in L.scan_words(words, index)}, (name, at)


def test_changed_templates_as_containment_says():
    rng = np.random.default_rng(1)
    text = dict(L.TEMPLATES)["gpl-3.0-notice"].split()
    for _ in range(40):
        copy = list(text)
        for at in rng.integers(0, len(copy), rng.integers(0, 4)):
            copy[at] = "changed"
        document = "before " * int(rng.integers(0, 9)) + " ".join(copy) + " after" * 5
        assert sorted({m[0] for m in L.scan_words(L.words_of(document), L.Index.of(L.TEMPLATES))}) == brute(document)


def test_inserted_words_at_any_place():
    index, rng = L.Index.of(L.TEMPLATES), np.random.default_rng(2)
    for name, inserted in (("apache-2.0-notice", 8), ("mit-notice", 10), ("gpl-3.0-notice", 12)):
        template = L.words_of(dict(L.TEMPLATES)[name])
        cut = int(rng.integers(9, len(template) - 9))
        copy = [*template[:cut], *[f"x{i}".encode() for i in range(inserted)], *template[cut:]]
        for at in range(60):
            words = [f"w{i}".encode() for i in range(at)] + copy + [f"v{i}".encode() for i in range(70)]
            found = [m for m in L.scan_words(words, index) if m[0] == name]
            assert [m[1:3] for m in found] == [(at, at + len(copy))], (name, at, found)


def test_scan_is_every_window():
    rng = np.random.default_rng(4)
    texts = [L.words_of(t) for _, t in L.TEMPLATES]
    index = L.Index.of(L.TEMPLATES)
    for _ in range(150):
        words = [b"w"] * int(rng.integers(0, 70))
        for _ in range(int(rng.integers(1, 4))):
            for w in texts[rng.integers(len(texts))]:
                words += [b"x"] * int(rng.random() < 0.04) + [w] * int(rng.random() > 0.02)
            words += [b"v"] * int(rng.integers(0, 30))
        want = set()
        for c in index.classes:
            for start in range(max(0, len(words) - c.window) + 1):
                own = words[start : start + c.window]
                grams = {tuple(own[i : i + c.size]) for i in range(len(own) - c.size + 1)}
                want |= {name for name, t in c.members if len(t & grams) / len(t) >= L.THRESHOLD}
        assert {m[0] for m in L.scan_words(words, index)} == want


def test_bands_guarantee_the_recall():
    for c in L.Index.of(L.TEMPLATES).classes:
        shortest = min(len(t) for _, t in c.members)
        need = int(np.ceil(L.THRESHOLD * shortest - 1e-9))
        likeness = need / (c.window - c.size + 1 + shortest - need)
        assert likeness == 1 or 1 - (1 - likeness) ** c.bands >= L.RECALL


def test_odd_rows(odd_docs, no_docs):
    got = L.report(L.scan_documents(odd_docs)).collect()
    assert len(got) == odd_docs.count() and {r["n_matches"] for r in got} == {0}
    assert L.scan_documents(no_docs).count() == 0
    assert L.scan_documents(odd_docs, [("none", ""), ("null", None)]).filter("size(matches) > 0").count() == 0
    with pytest.raises(ValueError, match="TEMPLATE_CHARS"):
        L.Index.of([("big", "x " * L.TEMPLATE_CHARS)])


def test_templates_of_megabytes_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "TEMPLATE_CHARS", 900)
    assert len(L.parts_of(L.TEMPLATES)) > 5 and sum(L.parts_of(L.TEMPLATES), []) == L.TEMPLATES
    docs = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(L.TEMPLATES)] + [(999, "nothing of the kind")], "doc_id long, text string")
    parted = {r["doc_id"]: sorted(map(tuple, r["matches"])) for r in L.scan_documents(docs).collect()}
    monkeypatch.undo()
    assert parted == {r["doc_id"]: sorted(map(tuple, r["matches"])) for r in L.scan_documents(docs).collect()}
    assert all(name in {m[0] for m in parted[i]} for i, (name, _) in enumerate(L.TEMPLATES)) and parted[999] == []


def test_a_long_text_without_white_space_and_one_of_many_words(spark):
    docs = spark.createDataFrame([(1, "x" * 2_000_000), (2, "word " * 200_000 + dict(L.TEMPLATES)["isc"])], "doc_id long, text string")
    assert [(r["n_words"], [m["template"] for m in r["matches"]]) for r in L.scan_documents(docs).orderBy("doc_id").collect()] == [(1, []), (200_000 + len(L.words_of(dict(L.TEMPLATES)["isc"])), ["isc"])]


def test_query_equals_brute_force(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_license_scan"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id]["templates"] == ",".join(brute(text)), doc_id
