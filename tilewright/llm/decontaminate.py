"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one
window). Each window is a set of shingles, ordered by how rare they are in the
documents. Containment must be full, so a window's necessary prefix is its single
rarest shingle: documents are probed for those alone. Each hit fixes where the
window would have to start; it must fit within the document, and then all words
are compared. The benchmark is taken in blocks of a fixed size, each sent to all
tasks, and each adding its hits to the rows as they pass, so that it may grow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

WINDOW = 10
SHINGLE = 5
#: Text of one benchmark block, which is all that is ever broadcast at once.
BLOCK_BYTES = 2 << 20

#: Bytes of words (digits, letters, all of a non-ASCII character), lower-cased; others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_R = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _R[0]
    return x ^ (x >> np.uint64(29))


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit mix of each run of ``size`` word numbers."""
    n = len(ids) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        total += _mixed((ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _R[k])
    return _mixed(total)


@dataclass
class Windows:
    """Windows of a benchmark block: numbered words, and by length the word rows with their items."""

    vocabulary: dict[bytes, int]
    rows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]

    @classmethod
    def of(cls, block: list[tuple[str, str]]) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in block:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            size = min(WINDOW, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        rows, items = {}, {}
        for size in sorted({len(w) for w in found}):
            own = sorted(w for w in found if len(w) == size)
            rows[size] = np.array(own, np.int64)
            items[size] = [sorted(found[w]) for w in own]
        return cls(vocabulary, rows, items)

    def shingle_sizes(self) -> dict[int, int]:
        return {size: min(SHINGLE, size) for size in self.rows}


def _numbered(text: str, get) -> np.ndarray:
    """Numbers of a text's words, 0 for words that no item has."""
    words = words_of(text)
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def _known_runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` words that items have."""
    sums = np.concatenate([[0], np.cumsum(ids > 0)])
    return np.flatnonzero(sums[size:] - sums[:-size] == size) if len(ids) >= size else np.zeros(0, np.int64)


def _tables(windows: Windows) -> dict[int, np.ndarray]:
    """Sorted distinct shingles of the windows, by shingle size."""
    out: dict[int, list[np.ndarray]] = {}
    for size, s in windows.shingle_sizes().items():
        out.setdefault(s, []).extend(_shingles(row, s) for row in windows.rows[size])
    return {s: np.unique(np.concatenate(x)) for s, x in out.items()}


def _matches(ids: np.ndarray, s: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose shingle is in the sorted table, and its place there."""
    starts = _known_runs(ids, s)
    if not len(starts) or not len(table):
        return starts[:0], starts[:0]
    total = np.zeros(len(starts), np.uint64)
    for k in range(s):
        total += _mixed((ids[starts + k].astype(np.uint64) + np.uint64(1)) * _R[k])
    hashed = _mixed(total)
    at = np.searchsorted(table, hashed).clip(max=len(table) - 1)
    good = table[at] == hashed
    return starts[good], at[good]


def _counts(docs: DataFrame, shared) -> dict[tuple[int, int], int]:
    """How often the block's shingles occur in all documents, as (size, place in its table)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        tables, get = _tables(windows), windows.vocabulary.get
        sums = {s: np.zeros(len(t), np.int64) for s, t in tables.items()}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = _numbered(text, get)
                for s, t in tables.items():
                    sums[s] += np.bincount(_matches(ids, s, t)[1], minlength=len(t))
        for s, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(x[at])], names=["size", "at", "n"])

    # at most a row per shingle of the block, which is bounded
    found = docs.select(common.text_of()).mapInArrow(count, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], r["at"]): r["n"] for r in found}


@dataclass
class Index:
    """For each window length, its prefix: window numbers by their rarest shingle, with its offset."""

    tables: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, windows: Windows, counts: dict[tuple[int, int], int]) -> Index:
        tables = _tables(windows)
        made: list[dict[int, np.ndarray]] = [{}, {}, {}]
        for size, s in windows.shingle_sizes().items():
            prefix = []
            for number, row in enumerate(windows.rows[size]):
                at = np.searchsorted(tables[s], _shingles(row, s))
                # the necessary prefix for full containment: 1 shingle, the rarest (ties: the least hash, then the first)
                best = min(range(len(at)), key=lambda k, at=at: (counts.get((s, int(at[k])), 0), int(at[k]), k))
                prefix.append((int(at[best]), number, best))
            prefix.sort()
            places = np.array([p[0] for p in prefix], np.int64)
            made[0][size] = np.searchsorted(places, np.arange(len(tables[s]) + 1))
            made[1][size] = np.array([p[1] for p in prefix], np.int64)
            made[2][size] = np.array([p[2] for p in prefix], np.int64)
        return cls(tables, *made)


def _verified(ids: np.ndarray, windows: Windows, index: Index, matched) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: starts of occurrences and their window numbers."""
    for size, s in windows.shingle_sizes().items():
        if len(ids) < size:  # length bound
            continue
        at, places = matched[s]
        first = index.first[size]
        many = first[places + 1] - first[places]
        if not many.sum():
            continue
        rows = np.repeat(first[places], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(at, many) - index.offset[size][rows]
        fits = (starts >= 0) & (starts + size <= len(ids))  # positional bound
        starts, numbers = starts[fits], index.window[size][rows[fits]]
        for low in range(0, len(starts), 1 << 16):
            st, nu = starts[low : low + (1 << 16)], numbers[low : low + (1 << 16)]
            same = (ids[st[:, None] + np.arange(size)] == windows.rows[size][nu]).all(axis=1)
            yield size, st[same], nu[same]


def _edges(n: int, runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Starts and ends, in turn, of the maximal runs that (starts, ends) cover among ``n`` words."""
    cover = np.zeros(n + 1, np.int64)
    for starts, ends in runs:
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
    return np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])))


def _scan(shared, keep: list[str], body: str, more: bool) -> object:
    """Adds one block's hits to the rows' own; the text stays if there are ``more`` blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, index = shared.value
        get = windows.vocabulary.get
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, edges, names in zip(*(batch.column(c).to_pylist() for c in (body, "hit_edges", "items")), strict=True):
                ids = _numbered(text, get)
                matched = {s: _matches(ids, s, t) for s, t in index.tables.items()}
                runs, items = [(np.array(edges[::2], np.int64), np.array(edges[1::2], np.int64))] if edges else [], set(names)
                for size, starts, numbers in _verified(ids, windows, index, matched):
                    runs.append((starts, starts + size))
                    for number in np.unique(numbers):
                        items.update(windows.items[size][number])
                out[0].append(len(ids))
                out[1].append(_edges(len(ids), runs).tolist() if runs else [])
                out[2].append(sorted(items))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            kept = [*keep, *[body] * more]
            columns = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)], *[batch.column(c) for c in kept]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hit_edges", "items", *kept])

    return scan


_HITS = "doc_id long, n_words long, hit_edges array<long>, items array<string>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of bounded text, streamed to the driver one at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null and item is not null").toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:  # a longer item makes a block of its own
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, hit_edges, items) and ``keep``: the documents' words inside occurrences of benchmark windows.

    hit_edges has the starts and ends of maximal hit runs, in words. A null or
    empty text has no words, hence no hits; texts are scanned whole at any length; null item
    ids and texts are no items; repeated rows of either table count as rows; kept columns
    stay whatever their names, but for the four of results; other columns are
    ignored. With no item at all every document is clean; an empty table gives no rows.
    The benchmark is taken block by block, each a pass over the rows that adds its hits.
    """
    context = docs.sparkSession.sparkContext
    names = [c for c in keep if c not in ("doc_id", "n_words", "hit_edges", "items")]
    (body,) = common.unused([*docs.columns, *names], "body")
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    none = F.array().cast("array<long>").alias("hit_edges"), F.array().cast("array<string>").alias("items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *none, *names, common.text_of().alias(body))
    blocks = _blocks(benchmark, block_bytes)
    block: list[tuple[str, str]] | None = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        windows = Windows.of(block)
        counts = _counts(docs, context.broadcast(windows)) if block else {}
        shared = context.broadcast((windows, Index.of(windows, counts)))
        more = following is not None
        rows = rows.mapInArrow(_scan(shared, names, body, more), _HITS + fields + f", `{body}` string" * more)
        block = following
    return rows.select("doc_id", "n_words", "hit_edges", "items", *names)


def report(hits: DataFrame) -> DataFrame:
    """The contract's columns from find_contamination's rows."""
    runs = F.transform(F.sequence(F.lit(0), F.size("hit_edges") - 1, F.lit(1)), lambda i: F.when(i % 2 == 1, F.element_at("hit_edges", i + 1)).otherwise(-F.element_at("hit_edges", i + 1)))
    n_hit = F.when(F.size("hit_edges") == 0, F.lit(0)).otherwise(F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x))
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_edges") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    """Reference for tests: every window against every position."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for item, text in items:
        w = split(text)
        size = min(WINDOW, len(w))
        windows += [(item, w[i : i + size]) for i in range(len(w) - size + 1 if size else 0)]
    out = {}
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


#: The query's rows in DuckDB.
ORACLE = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
    FROM items, LATERAL unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0
),
grams AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS s
    FROM docs, (SELECT DISTINCT size FROM windows), LATERAL unnest(range(1, len(w) - size + 2)) u(i) WHERE len(w) >= size
),
hits AS (SELECT g.doc_id, g.i, g.size, v.item FROM grams g JOIN windows v ON g.size = v.size AND g.s = v.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(range(i, i + size)) u(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
