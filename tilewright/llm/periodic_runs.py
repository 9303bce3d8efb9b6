"""Runs of words: maximal stretches that repeat with a period, in each text.

A batch of texts is one sequence of word numbers. Prefix doubling names all blocks of 1, 2, 4, ... words,
which gives the suffix array, common extensions in either direction and the LCP array. The nearest suffixes
that start earlier give each position's longest previous factor (LPF), and jumping by it parts a text into
LZ blocks. A run that touches a block's border is found there, by extending both ways at each period that
the two blocks beside it allow (Main's bound); a run strictly inside a block is a copy of one in the
block's earlier occurrence, fetched from buckets of runs by start.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

#: A run has at least so many words, and at least so many periods.
LEAST, POWER = 6, 4
#: Bytes of text that are worked on together; a longer text is alone.
TOGETHER = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of a binary array without nulls, and each text's first word's number, with an end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = inside[begin]  # a text's first word is not the end of the text before
    starts = np.flatnonzero(first)
    kept = np.append(np.flatnonzero(inside).searchsorted(starts), int(inside.sum())).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(kept), pa.py_buffer(data[inside])])
    return words, starts.searchsorted(offsets)


class Names:
    """Names of all blocks of 1, 2, 4, ... words, alike where the blocks are; those of different texts always differ."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n = self.n = len(words)
        sizes = np.diff(bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        last = np.repeat(bounds[1:], sizes)
        key = text * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        active, step = np.arange(n), 1
        self.levels: list[np.ndarray] = []
        name, sort_key = np.full(n + 1, -1, np.int32), key[order]
        where = order
        while True:
            fresh = np.ones(len(active), bool)
            fresh[1:] = sort_key[1:] != sort_key[:-1]
            # a block's name is the place of its group in the order of suffixes
            name = name.copy()
            name[where] = np.maximum.accumulate(np.where(fresh, active, 0))
            self.levels.append(name)
            several = ~(fresh & np.append(fresh[1:], True))
            active = active[several]
            if not len(active):
                break
            where = order[active]
            after = where + step
            key = name[where].astype(np.int64) * (n + 2) + np.where(after < last[where], name[np.minimum(after, n)], -1) + 1
            by = np.argsort(key, kind="stable")
            where, sort_key = where[by], key[by]
            order[active] = where
            step *= 2
        self.suffixes = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i < j on are alike."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            got += (self.levels[k][i + got] == self.levels[k][j + got]).astype(np.int64) << k
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i < j are alike."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - got - (1 << k), j - got - (1 << k)
            got += ((self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)]) & (a >= 0)).astype(np.int64) << k
        return got


def _nearest_earlier(position: np.ndarray, common_words: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the nearest one before it in that order that starts earlier, and the words they share.

    ``common_words`` is what each shares with its neighbour before it. All walk at once, each over what the suffix
    it stands at has walked; few are left after some rounds, which take turns.
    """
    n = len(position)
    near, least = np.arange(-1, n - 1), common_words.copy()
    least[:1] = 0
    active = np.flatnonzero(least > 0)
    active = active[position[near[active]] > position[active]]
    for _ in range(rounds):
        if not len(active):
            return near, least
        at = near[active]
        low, then = np.minimum(least[active], least[at]), near[at]
        near[active], least[active] = then, low
        go = (low > 0) & (then >= 0)
        go[go] = position[then[go]] > position[active[go]]
        active = active[go]
    for r in active.tolist():
        p, low = int(near[r]), int(least[r])
        while low > 0 and p >= 0 and position[p] > position[r]:
            low, p = min(low, int(least[p])), int(near[p])
        near[r], least[r] = p, low
    return near, least


def previous_factors(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """LPF: the longest factor from each position on that also starts earlier in its text, and where."""
    sa, n = names.suffixes, names.n
    shared = np.zeros(n, np.int64)
    near = np.flatnonzero(names.levels[0][sa[1:]] == names.levels[0][sa[:-1]]) + 1
    low, high = np.minimum(sa[near - 1], sa[near]), np.maximum(sa[near - 1], sa[near])
    shared[near] = names.ahead(low, high)
    before, left = _nearest_earlier(sa, shared)
    # the same from the other end of the order
    after, right = _nearest_earlier(sa[::-1], np.append(0, shared[:0:-1]))
    after, right = n - 1 - after[::-1], right[::-1]
    take = right > left
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[sa] = np.where(take, right, left)
    source[sa] = sa[np.where(take, np.minimum(after, n - 1), np.maximum(before, 0))]
    return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Starts of all LZ blocks: each is the longest previous factor, or a new word. A factor ends with its text, so that texts are parted too."""
    then = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    out, at, n = [], 0, len(length)
    while at < n:
        out.append(at)
        at = then[at]
    return np.array(out, np.int64)


def _at_borders(names: Names, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period) that touch a border of blocks."""
    sizes = np.diff(np.append(starts, names.n))
    opens = np.isin(starts, bounds)  # blocks that begin a text
    ends = np.append(opens[1:], True)
    border = np.concatenate([starts[~opens], (starts + sizes)[ends]])
    room = np.concatenate([(sizes[:-1] + sizes[1:])[~opens[1:]], sizes[ends]])
    # what reaches POWER periods has (POWER - 1) periods less than the two blocks' words
    many = np.maximum((room - 1) // (POWER - 1), 0)
    b = np.repeat(border, many)
    p = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + 1
    text = np.searchsorted(bounds, b, side="left")  # the bound at or after each border
    c, p = np.concatenate([b, b - p]), np.concatenate([p, p])
    low, high = (np.concatenate([bounds[t], bounds[t]]) for t in (text - 1, text))
    one = names.levels[0]
    ok = (c >= low) & (c + p <= high)
    c, p, low = c[ok], p[ok], low[ok]
    ok = (one[c] == one[c + p]) | ((c > low) & (one[np.maximum(c - 1, 0)] == one[np.maximum(c - 1, 0) + p]))
    c, p = c[ok], p[ok]
    back = names.behind(c, c + p)
    length = p + back + names.ahead(c, c + p)
    ok = length >= np.maximum(LEAST, POWER * p)
    return (c - back)[ok], length[ok], p[ok]


def _copied(runs: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``runs`` and their copies strictly inside later blocks (start, size, source)."""
    buckets: dict[int, dict[int, int]] = {}
    for start, length, period in runs:
        own = buckets.setdefault(start, {})
        own[length] = min(period, own.get(length, period))
    starts = sorted(buckets)
    for start, size, source in blocks:
        i = bisect_right(starts, source)
        while i < len(starts) and starts[i] < source + size:
            at = starts[i]
            for length, period in list(buckets[at].items()):
                if at + length < source + size:
                    to = at - source + start
                    if to not in buckets:
                        buckets[to] = {}
                        insort(starts, to)
                    buckets[to].setdefault(length, period)
            i += 1
    return sorted((s, n, p) for s, own in buckets.items() for n, p in own.items())


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of all texts as rows (start, length, smallest period) in order of start, by number of word in the whole batch.

    ``words`` are numbers, equal for equal words; ``bounds`` holds each text's first place, and the end.
    """
    if not len(words):
        return np.zeros((0, 3), np.int64)
    names = Names(words, bounds)
    length, source = previous_factors(names)
    starts = blocks_of(length)
    start, many, period = _at_borders(names, starts, np.unique(bounds))
    if not len(start):
        return np.zeros((0, 3), np.int64)
    found: dict[int, list] = {}
    for row in zip(start.tolist(), many.tolist(), period.tolist(), strict=True):
        found.setdefault(int(np.searchsorted(bounds, row[0], side="right")) - 1, []).append(row)
    out = []
    for text in sorted(found):
        own = starts[np.searchsorted(starts, bounds[text]) : np.searchsorted(starts, bounds[text + 1])]
        own = own[length[own] >= LEAST + 2]  # a copy has a word on either side
        out += _copied(found[text], list(zip(own.tolist(), length[own].tolist(), source[own].tolist(), strict=True)))
    return np.array(out, np.int64).reshape(-1, 3)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _slices(texts: pa.Array) -> Iterator[slice]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
        yield slice(start, stop)
        start = stop


def _found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column("text").cast(pa.binary())
    for part in _slices(texts):
        words, bounds = words_of(texts[part])
        runs = runs_of(words.dictionary_encode().indices.to_numpy(), bounds)
        text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(cover[:-1]) == 0
        left = words.filter(pa.array(kept))
        inner = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(inner), left), b" ")
        fields = [pa.array(runs[:, 0] - bounds[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(bounds))).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], lists.cast(_RUNS), collapsed.cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) of each text's words.

    Words lie between ASCII white space and count from 0. A run is a stretch of at least LEAST words and POWER
    periods whose words one smallest period apart are alike and that no neighbour extends; runs are in order of start,
    then period. ``collapsed`` is the text without the words that a run holds after its first period, joined by one space.
    A null or empty text, or one of white space, has no runs and collapses to the empty text; repeated rows and ids stay
    as they are; an empty table gives no rows; a text of any length is searched whole and takes some 4 bytes
    a word for each doubling of its longest repeat; other columns are ignored. No row leaves its task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _found(batch)

    return docs.select(F.col("doc_id").cast("long"), common.text_of()).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns: the longest run (ties: least start, then period) and digests of all."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.n")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.expr("(-best.n) * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_repeats(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A text whose last part repeats, for every tenth id by CRC-32: words from a on become word a + (i - a) % p; else the text."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 0)
    return F.when(h % 10 == 0, edited).otherwise(F.col(text))


def brute_force(words: list[str]) -> list[tuple[int, int, int]]:
    """Reference for tests: all runs by their definition, period by period."""
    n, found = len(words), {}
    for q in range(1, n // POWER + 1):
        x = 0
        while x + q < n:
            s = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x > s and x - s + q >= max(LEAST, POWER * q):
                found.setdefault((s, x - s + q), q)
            x += 1
    return sorted((s, n, q) for (s, n), q in found.items())
