"""Repeated byte strings across documents, by run-length indexes.

Every window of WINDOW bytes belongs to the anchor that is least among its
GRAM-byte strings, so equal windows meet at equal anchors. Blocks of documents name
their anchors; those that occur in more than one document are kept, and their
segments (runs of windows of one anchor, with distinct contents once a block) meet in
buckets of anchors. A bucket builds a run-compressed Burrows-Wheeler transform of the
contents that compete at an anchor: rows are ordered by WINDOW - 1 bytes of context,
so a run is a byte before a context, and each run has as its sample the first document
that holds it. The segments' matching statistics are then streamed through the index
from right to left: each step goes from a context and the byte before it to the
window that they make, whose sample is the least document with that window. Windows
with a smaller document than the one at hand are long matches, and their bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

WINDOW, GRAM = 50, 16
#: Text of one block and for each bucket, in bytes, whatever the corpus and the number of partitions, as a task holds
#: one of them; a longer text makes a larger block. Blocks are worked through in PIECEs.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
#: Text that a task gathers before it squeezes each block's share of it into one row.
GATHER_BYTES = 32 << 20
#: An anchor in more blocks than the first, or with more windows than the second, is dealt by single windows, so that
#: no bucket grows with its copies or its contents. A block tells windows in WINDOWS_STEPs.
HEAVY, HEAVY_WINDOWS = 1024, 1 << 20
WINDOWS_STEP = 64
#: Windows whose index is made at once, but for the anchor that goes beyond them; runs that are marked at once.
SLICE_WINDOWS, SLICE_RUNS = 1 << 19, 1 << 19
#: Windows of one segment at most: first and last window then cover a segment's bytes.
_RUN = WINDOW
_LAST_DOC = 2**63 - 1

_BYTES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_48 = np.uint64(16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Segments:
    """Runs of windows of one anchor: where they start in the block's bytes, how many windows, whose."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    owner: np.ndarray


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``data``: its anchor and its own hash."""
    hashed = {1: _BYTES[data]}
    for j, m in enumerate((1, 2, 4, 8, 16)):
        x = hashed[m]
        hashed[2 * m] = x[:-m] * _M[j] + x[m:]
    n = len(data) - WINDOW + 1
    # no two bytes of a window have one weight, else windows in which they change places would have one hash
    own = hashed[32][:n] * _M[5] + hashed[16][32 : 32 + n] * _M[0] + hashed[2][48 : 48 + n] * _M[4]
    least, span, reach = _mix(hashed[GRAM]), 1, WINDOW - GRAM + 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[reach - span : reach - span + n]), own


def segments(data: np.ndarray, sizes: np.ndarray) -> Segments:
    """Segments of texts that lie one after the other in ``data``."""
    ends = np.cumsum(sizes)
    found: list[list[np.ndarray]] = [[], [], [], []]
    low = 0
    while low < len(data):
        piece = data[low : low + PIECE + WINDOW - 1]
        n = len(piece) - WINDOW + 1
        if n <= 0:
            break
        anchor, own = _piece(piece)
        inside = np.ones(n, bool)
        near = ends[np.searchsorted(ends, low + 1) : np.searchsorted(ends, low + n + WINDOW)]
        for end in near.tolist():  # windows may not cross a text's end
            if end < low + len(piece):
                inside[max(0, end - WINDOW + 1 - low) : max(0, end - low)] = False
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n))
        at, length = at[inside[at]], length[inside[at]]
        if len(length) and length.max() > _RUN:
            parts = -(-length // _RUN)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(_RUN, np.repeat(length, parts) - step * _RUN)
            at = np.repeat(at, parts) + step * _RUN
        found[0].append(at + low)
        found[1].append(length)
        found[2].append(anchor[at] >> _48)
        found[3].append(_mix(_mix(own[at]) * _M[1] + _mix(own[at + length - 1]) * _M[2] + length.astype(np.uint64)))
        low += PIECE
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    start, windows, anchor, content = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds, strict=True))
    return Segments(start, windows, anchor, content, np.searchsorted(ends, start, side="right"))


@dataclass
class Block:
    """A block's texts with their distinct segments (records), in the order of anchor and content."""

    ids: list
    data: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray
    found: Segments
    record: np.ndarray
    first: np.ndarray
    least: np.ndarray
    anchors: np.ndarray
    anchor_of: np.ndarray
    several: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        # every pass must see the block alike, in whatever order its rows arrive
        rows = sorted(_unpacked(table))
        ids, texts = [None if none else d for d, none, _ in rows], [t for _, _, t in rows]
        docs = np.array([d for d, _, _ in rows], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = segments(data, sizes)
        order = np.lexsort((found.content, found.anchor))
        a, c = found.anchor[order], found.content[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        new = new_a.copy()
        new[1:] |= c[1:] != c[:-1]
        record = np.empty(len(order), np.int64)
        record[order] = np.cumsum(new) - 1
        heads, doc = np.flatnonzero(new), docs[found.owner[order]]
        tops = np.flatnonzero(new_a)
        if not len(order):
            none = np.zeros(0, np.int64)
            return cls(ids, data, sizes, docs, found, record, none, none, np.zeros(0, np.uint64), none, np.zeros(0, bool))
        several = np.minimum.reduceat(doc, tops) != np.maximum.reduceat(doc, tops)
        return cls(ids, data, sizes, docs, found, record, order[heads], np.minimum.reduceat(doc, heads), a[tops], (np.cumsum(new_a) - 1)[heads], several)

    def chosen(self, status: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records of repeated anchors, by bucket: (record, place of the one window or -1, key)."""
        own = status[self.anchor_of]
        plain = np.flatnonzero(own == 1)
        heavy = np.flatnonzero(own == 2)
        windows = self.found.windows[self.first[heavy]]
        place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        record = np.repeat(heavy, windows)
        key = np.concatenate([self.anchors[self.anchor_of[plain]], _window_hashes(self.data, self.found.start[self.first[record]] + place, _M[0]) >> _48])
        record, place = np.concatenate([plain, record]), np.concatenate([np.full(len(plain), -1), place])
        order = np.lexsort((place, record, key % np.uint64(buckets)))
        return record[order], place[order], key[order]


def _window_hashes(data: np.ndarray, at: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of single windows; the upper 48 bits by one base are a window's key, those by another its content's name."""
    total = np.full(len(at), WINDOW, np.uint64)
    for k in range(WINDOW):
        total = total * base + _BYTES[data[at + k]]
    return _mix(total)


def _squeeze(data: bytes) -> bytes:
    """Smaller than the shuffle's own compression makes it."""
    return pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _pack_keys(keys: np.ndarray, buckets: int) -> bytes:
    """Keys of 48 bits that lie in one bucket, by their quotients' differences (few bits where they rise), byte by byte."""
    steps = np.diff(keys // np.uint64(buckets), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return len(keys).to_bytes(4, "little") + _squeeze(np.ascontiguousarray(steps.T).tobytes())


def _unpack_keys(x: bytes) -> np.ndarray:
    """The quotients, which tell a bucket's keys apart as the keys do."""
    n = int.from_bytes(x[:4], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = np.frombuffer(_unsqueeze(x[4:], 6 * n), np.uint8).reshape(6, n).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64) & np.uint64((1 << 48) - 1)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of several ranges, one after the other."""
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


_TEXTS = "block int, ids binary, nulls binary, sizes binary, text binary"
_ANCHORS = "bucket int, block int, anchors binary, several binary, many binary"
_STATUS = "block int, bucket int, status binary"
_CONTENTS = "bucket int, block int, keys binary, docs binary, windows binary, bytes binary"
_LEAST = "block int, bucket int, runs binary, lengths binary, docs binary"
_RESULT = "doc_id long, n_bytes long, edges array<long>, kept_sha256 string"


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (doc_id, text, block) as one row for each block, its text squeezed."""
    table = pa.Table.from_batches(batches)
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    texts = table.column("text").cast(pa.large_binary()).take(pa.array(order)).combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    doc = table.column("doc_id").take(pa.array(order))
    nulls, ids = doc.is_null().to_numpy(), doc.fill_null(_LAST_DOC).to_numpy()
    own, edges = np.unique(block[order], return_index=True)
    rows = []
    for b, low, high in zip(own.tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        rows.append((b, ids[low:high].tobytes(), np.packbits(nulls[low:high]).tobytes(), np.diff(offsets[low : high + 1]).tobytes(), _squeeze(data[offsets[low] : offsets[high]].tobytes())))
    return _table(_TEXTS, rows).combine_chunks().to_batches()[0]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield _packed(held)
            held, size = [], 0
    if size:
        yield _packed(held)


def _unpacked(table: pa.Table) -> Iterator[tuple[int, bool, bytes]]:
    """(doc_id, whether it is null, text) of packed rows or of plain ones."""
    if "ids" not in table.column_names:
        for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
            yield _LAST_DOC if d is None else d, d is None, (t or "").encode()
        return
    for row in table.to_pylist():
        ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(ids)).astype(bool)
        ends = np.cumsum(sizes)
        text = _unsqueeze(row["text"], int(ends[-1]))
        for d, null, low, high in zip(ids.tolist(), nulls.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            yield d, null, text[low:high]


def _name_anchors(buckets: int):
    def f(rows: pa.Table) -> pa.Table:
        block, key = Block.of(rows), rows.column("block")[0].as_py()
        bucket = block.anchors % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        windows = np.bincount(block.anchor_of, block.found.windows[block.first], len(block.anchors))
        many = np.minimum(windows // WINDOWS_STEP, 2**16 - 1).astype("<u2")
        out = []
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                out.append((b, key, _pack_keys(block.anchors[at], buckets), np.packbits(block.several[at]).tobytes(), _squeeze(many[at].tobytes())))
        return _table(_ANCHORS, out)

    return f


def _find_repeated(heavy: int, heavy_windows: int = HEAVY_WINDOWS):
    def f(rows: pa.Table) -> pa.Table:
        anchors = [_unpack_keys(x) for x in rows.column("anchors").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for x, a in zip(rows.column("several").to_pylist(), anchors, strict=True)])
        order = np.argsort(flat := np.concatenate(anchors), kind="stable")
        new = np.concatenate([[True], np.diff(flat[order]) != 0])
        group = np.cumsum(new) - 1
        many = np.bincount(group)
        windows = np.concatenate([np.frombuffer(_unsqueeze(x, 2 * len(a)), "<u2") for x, a in zip(rows.column("many").to_pylist(), anchors, strict=True)])
        crowded = np.bincount(group, windows[order]) * WINDOWS_STEP > heavy_windows
        repeated = (many > 1) | (np.bincount(group, several[order]) > 0)
        kind = np.where(repeated, np.where((many > heavy) | crowded, 2, 1), 0).astype(np.uint8)
        status = np.empty(len(flat), np.uint8)
        status[order] = kind[group]
        parts = np.split(status, np.cumsum([len(a) for a in anchors])[:-1])
        pack = lambda s: np.packbits(s & 1).tobytes() + np.packbits(s >> 1).tobytes()
        return _table(_STATUS, [(block, bucket, pack(s)) for block, bucket, s in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), parts, strict=True)])

    return f


def _statuses(block: Block, parts: dict[int, bytes], buckets: int) -> np.ndarray:
    """Status of each of the block's anchors: 0 in one document only, 1 repeated, 2 repeated in very many blocks."""
    bucket = block.anchors % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    status = np.zeros(len(order), np.uint8)
    for b, packed in parts.items():
        at = order[edges[b] : edges[b + 1]]
        bits = np.frombuffer(packed, np.uint8)
        half = len(bits) // 2
        status[at] = np.unpackbits(bits[:half], count=len(at)) | np.unpackbits(bits[half:], count=len(at)) << 1
    return status


def _send_contents(buckets: int):
    def f(docs: pa.Table, statuses: pa.Table) -> pa.Table:
        if not docs.num_rows or not statuses.num_rows:
            return _table(_CONTENTS, [])
        block, key = Block.of(docs), docs.column("block")[0].as_py()
        status = _statuses(block, dict(zip(statuses.column("bucket").to_pylist(), statuses.column("status").to_pylist(), strict=True)), buckets)
        record, place, keys = block.chosen(status, buckets)
        first = block.first[record]
        start = block.found.start[first] + np.maximum(place, 0)
        windows = np.where(place < 0, block.found.windows[first], 1)
        bucket = keys % np.uint64(buckets)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        out = []
        for b in range(buckets):
            at = slice(edges[b], edges[b + 1])
            if edges[b] < edges[b + 1]:
                out.append((b, key, _pack_keys(keys[at], buckets), _squeeze(block.least[record[at]].tobytes()), windows[at].astype(np.uint8).tobytes(), _squeeze(_gathered(block.data, start[at], windows[at] + WINDOW - 1).tobytes())))
        return _table(_CONTENTS, out)

    return f


class RunIndex:
    """Run-compressed transform of segments' contents, in the order of their documents.

    A segment of n windows has n + 1 rows: before its bytes at 0 to n, with the
    WINDOW - 1 bytes after each as context. Rows go by context, then by the byte
    before, then by the documents' order; so the rows of one context and byte are one
    run, and the run's sample is its first row's document. A backward step (from a
    context by the byte before it) is one lookup: every run points to the context that
    its window begins with, as in a move structure.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, windows: np.ndarray, docs: np.ndarray):
        self.data, self.start, self.windows = data, start, windows
        rows = windows + 1
        ends = np.cumsum(rows)
        segment = np.repeat(np.arange(len(rows)), rows)
        offset = np.arange(int(ends[-1])) - np.repeat(ends - rows, rows)
        at = start[segment] + offset
        before = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256)
        rank = self._contexts(at)
        # one sort settles contexts, bytes before and, by the row's number, documents
        bits = int(len(rank)).bit_length()
        key = rank * 257 + before
        if bits + int(key.max()).bit_length() < 63:
            order = np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = order[heads]
        self.byte, context = before[first].astype(np.int32), rank[first]
        self.sample = docs[segment[first]]
        self.runs_of = np.searchsorted(context, np.arange(int(rank.max()) + 2))  # where each context's runs begin
        self.left = np.where(self.byte < 256, rank[np.maximum(first - 1, 0)], -1)
        self.last = rank[ends - 1]

    @property
    def n_runs(self) -> int:
        return len(self.byte)

    def _contexts(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the WINDOW - 1 bytes at each place, in byte order."""
        # the eight bytes at each place as a number whose order is theirs
        n = -(-(len(self.data) + 8) // 8)
        padded = np.concatenate([self.data, np.zeros(8 * n + 16 - len(self.data), np.uint8)])
        words = np.empty(8 * n, np.uint64)
        for k in range(8):
            words[k::8] = padded[k : k + 8 * n].view(">u8")
        rest = (WINDOW - 1) % 8
        keys = [words[at + 8 * k] for k in range((WINDOW - 1) // 8)]
        if rest:
            keys.append(words[at + 8 * len(keys)] >> np.uint64(8 * (8 - rest)))
        # equal contexts are found by hash and confirmed by their words, so that only distinct ones are put in order
        hashed = np.zeros(len(at), np.uint64)
        for key in keys:
            hashed = _mix(hashed + key)
        order = np.argsort(hashed)
        new = np.concatenate([[True], np.diff(hashed[order]) != 0])
        same = np.flatnonzero(~new)
        if any((key[order[same]] != key[order[same - 1]]).any() for key in keys):  # a collision: by words alone
            order = np.lexsort(keys[::-1])
            new = np.concatenate([[True], np.any([np.diff(key[order]) != 0 for key in keys], axis=0)])
        heads = order[new]
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        first = keys[0][heads]
        by_first = np.argsort(first, kind="stable")
        tie = np.diff(first[by_first]) == 0
        tied = np.flatnonzero(np.concatenate([tie, [False]]) | np.concatenate([[False], tie]))
        rows = heads[by_first[tied]]
        by_first[tied] = by_first[tied][np.lexsort([key[rows] for key in keys[::-1]])]
        rank = np.empty(len(heads), np.int64)
        rank[by_first] = np.arange(len(heads))
        return rank[group]

    def first_documents(self) -> np.ndarray:
        """The sample of each window of all segments, by streaming them through the index from right to left."""
        ends = np.cumsum(self.windows)
        out = np.empty(int(ends[-1]), np.int64)
        order = np.argsort(-self.windows, kind="stable")
        context, longest = self.last[order], int(self.windows.max())
        size, start, base = self.windows[order], self.start[order], (ends - self.windows)[order]
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        for step in range(longest):
            n = active[step]
            place = size[:n] - 1 - step
            byte = self.data[start[:n] + place]
            run = self.runs_of[context[:n]]
            # few bytes stand before a context, and the one at hand is among them
            while (other := np.flatnonzero(self.byte[run] != byte)).size:
                run[other] += 1
            out[base[:n] + place] = self.sample[run]
            context = self.left[run]
        return out


def _grouped(doc: np.ndarray, content: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, content and document, and where in it keys and contents begin."""
    order = np.lexsort((doc, content, key))
    k, c = key[order], content[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    return order, new_key, new


def _unlike(data: np.ndarray, start: np.ndarray, windows: np.ndarray, order: np.ndarray, new: np.ndarray, many: int = 1 << 14) -> np.ndarray:
    """Contents whose bytes are not those of the one before them that has the same key and name."""
    same = np.flatnonzero(~new)
    one, other = order[same], order[same - 1]
    out = [one[windows[one] != windows[other]]]
    for low in range(0, len(one), many):
        a, b = one[low : low + many], other[low : low + many]
        size = np.minimum(windows[a], windows[b]) + WINDOW - 1
        differ = _gathered(data, start[a], size) != _gathered(data, start[b], size)
        if differ.any():
            out.append(a[np.unique(np.repeat(np.arange(len(a)), size)[differ])])
    return np.concatenate(out)


def _names(data: np.ndarray, start: np.ndarray, windows: np.ndarray, many: int = 1 << 12) -> np.ndarray:
    """64 bits by which contents are told apart; the contents lie one after the other in ``data``."""
    out = np.empty(len(start), np.uint64)
    base = int(_M[0])
    reach = min(many, len(start)) * (int(windows.max(initial=1)) + WINDOW - 1)
    power, inverse = (np.multiply.accumulate(np.full(reach + 1, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    for low in range(0, len(start), many):
        own = slice(low, low + many)
        begin = start[own] - start[low]
        end = begin + windows[own] + WINDOW - 1
        part = _BYTES[data[start[low] : start[low] + end[-1]]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)])
        out[own] = _mix((sums[end] - sums[begin]) * inverse[begin] + windows[own].astype(np.uint64))
    single = np.flatnonzero(windows == 1)
    for low in range(0, len(single), 16 * many):
        own = single[low : low + 16 * many]
        out[own] = _window_hashes(data, start[own], _M[4])
    return out


def _firsts(key: np.ndarray, doc: np.ndarray, data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's content, and of each content the number of its runs, their windows and the least document of each."""
    content = _names(data, start, windows)
    order, new_key, new = _grouped(doc, content, key)
    other = _unlike(data, start, windows, order, new)
    if len(other):  # a name that two contents share: by their bytes
        alike = np.isin(key, key[other])
        names: dict[bytes, int] = {}
        content = content.copy()
        content[alike] = [names.setdefault(data[a : a + n].tobytes(), len(names)) for a, n in zip(start[alike].tolist(), (windows[alike] + WINDOW - 1).tolist(), strict=True)]
        order, new_key, new = _grouped(doc, content, key)
    group = np.cumsum(new) - 1
    heads = order[np.flatnonzero(new)]
    least = doc[heads]
    rivals = np.bincount((np.cumsum(new_key) - 1)[np.flatnonzero(new)])[(np.cumsum(new_key) - 1)[np.flatnonzero(new)]]
    # a content without rivals at its anchor holds its windows alone
    runs = np.ones(len(heads), np.int64)
    lengths, docs = [windows[heads]], [least]
    owner = [np.arange(len(heads))]
    several = np.flatnonzero(rivals > 1)
    if len(several):
        several = several[np.argsort(least[several], kind="stable")]
        at = heads[several]
        first = RunIndex(data, start[at], windows[at], least[several]).first_documents()
        segment = np.repeat(np.arange(len(at)), windows[at])
        cut = np.concatenate([[True], (first[1:] != first[:-1]) | (segment[1:] != segment[:-1])])
        places = np.flatnonzero(cut)
        runs[several] = np.bincount(segment[places], minlength=len(at))
        alone = np.setdiff1d(np.arange(len(heads)), several)
        lengths = [windows[heads[alone]], np.diff(np.append(places, len(first)))]
        docs = [least[alone], first[places]]
        owner = [alone, several[segment[places]]]
    owner = np.concatenate(owner)
    by_owner = np.argsort(owner, kind="stable")
    mine = np.empty(len(order), np.int64)
    mine[order] = group
    return mine, runs, np.concatenate(lengths)[by_owner].astype(np.uint8), np.concatenate(docs)[by_owner]


def _slices(key: np.ndarray, windows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of whole keys, of some ``most`` windows at a time."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    part = (np.cumsum(windows[order]) - windows[order])[begin] // most
    edges = begin[np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))]
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield order[low:high]


def _resolve(rows: pa.Table) -> pa.Table:
    """Each block's records with runs of windows and the least document that holds each."""
    lists = {c: rows.column(c).to_pylist() for c in rows.column_names}
    keys = [_unpack_keys(x) for x in lists["keys"]]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    doc = np.concatenate([np.frombuffer(_unsqueeze(x, 8 * n), np.int64) for x, n in zip(lists["docs"], sizes, strict=True)])
    windows = np.frombuffer(b"".join(lists["windows"]), np.uint8).astype(np.int64)
    data = np.empty(int(windows.sum()) + len(windows) * (WINDOW - 1), np.uint8)
    low = at = 0
    for x, n in zip(lists.pop("bytes"), sizes, strict=True):
        size = int(windows[low : low + n].sum()) + n * (WINDOW - 1)
        data[at : at + size] = np.frombuffer(_unsqueeze(x, size), np.uint8)
        low, at = low + n, at + size
    size = windows + WINDOW - 1
    start = np.cumsum(size) - size
    # anchors do not meet, so the index is of some of them at a time, however many of the contents are repeated
    mine = np.empty(len(key), np.int64)
    runs, lengths, docs, many = [], [], [], 0
    for own in _slices(key, windows, SLICE_WINDOWS):
        content, *found = _firsts(key[own], doc[own], _gathered(data, start[own], size[own]), np.cumsum(size[own]) - size[own], windows[own])
        mine[own] = content + many
        many += len(found[0])
        for x, y in zip((runs, lengths, docs), found, strict=True):
            x.append(y)
    runs, lengths, docs = (np.concatenate(x) for x in (runs, lengths, docs))
    begin = np.cumsum(runs) - runs
    out, low = [], 0
    for block, bucket, n in zip(lists["block"], lists["bucket"], sizes, strict=True):
        own = mine[low : low + n]
        low += n
        many = runs[own]
        at = np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append((block, bucket, many.astype(np.uint8).tobytes(), lengths[at].tobytes(), _squeeze(docs[at].tobytes())))
    return _table(_LEAST, out)


def _cover(cover: np.ndarray, block: Block, record: np.ndarray, place: np.ndarray, runs: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> None:
    """Adds 1 to ``cover`` where a long match begins and takes 1 where it ends; a record's runs go for all segments that have it."""
    by_record = np.argsort(block.record, kind="stable")
    begin = np.searchsorted(block.record[by_record], np.arange(len(block.first) + 1))
    times = np.diff(begin)[record]
    ends = np.cumsum(runs, dtype=np.int64)
    parts = (np.cumsum(runs * times) - 1) // SLICE_RUNS
    edges = np.flatnonzero(np.diff(parts, prepend=-1))
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(record)], strict=True):
        own, r = slice(int(ends[low] - runs[low]), int(ends[high - 1])), runs[low:high].astype(np.int64)
        length = lengths[own].astype(np.int64)
        # by record: its runs of windows (offset, length, least document)
        ahead = np.cumsum(length) - length
        offset = ahead - np.repeat(ahead[np.cumsum(r) - r], r) + np.repeat(np.maximum(place[low:high], 0), r)
        # and by segment that has it
        many = np.repeat(times[low:high], r)
        at = np.repeat(np.arange(len(length)), many)
        segment = by_record[np.repeat(np.repeat(begin[record[low:high]], r), many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        gone = np.flatnonzero(firsts[own][at] < block.docs[block.found.owner[segment]])
        first = block.found.start[segment[gone]] + offset[at[gone]]
        np.add.at(cover, first, 1)
        np.subtract.at(cover, first + length[at[gone]] + WINDOW - 1, 1)


def _mark(buckets: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_RESULT, [])
        block = Block.of(docs)
        cover = np.zeros(len(block.data) + 1, np.int32)
        status, least = {}, {}
        for state, bucket, *row in zip(*(answers.column(c).to_pylist() for c in ("status", "bucket", "runs", "lengths", "docs")), strict=True):
            if state is not None:
                status[bucket] = state
            else:
                least[bucket] = row
        if least:
            record, place, _ = block.chosen(_statuses(block, status, buckets), buckets)
            runs, lengths, firsts = zip(*(least[b] for b in sorted(least)), strict=True)
            firsts = np.concatenate([np.frombuffer(_unsqueeze(x, 8 * len(n)), np.int64) for x, n in zip(firsts, lengths, strict=True)])
            runs, lengths = (np.frombuffer(b"".join(x), np.uint8) for x in (runs, lengths))
            _cover(cover, block, record, place, runs, lengths, firsts)
        covered = np.cumsum(cover[:-1], out=cover[:-1]) > 0
        out, low = [], 0
        for doc_id, size in zip(block.ids, block.sizes.tolist(), strict=True):
            own = covered[low : low + size]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))) if own.any() else np.zeros(0, np.int64)
            kept = block.data[low : low + size]
            out.append((doc_id, size, edges.tolist(), hashlib.sha256((kept[~own] if len(edges) else kept).tobytes()).hexdigest()))
            low += size
        return _table(_RESULT, out)

    return f


def repeated_spans(docs: DataFrame, heavy: int = HEAVY, block_bytes: int = BLOCK_BYTES, heavy_windows: int = HEAVY_WINDOWS) -> DataFrame:
    """(doc_id, n_bytes, edges, kept_sha256) of every row of ``docs``.

    edges holds starts and ends, in bytes of UTF-8, of the maximal runs that WINDOW-byte
    strings cover which also start in a document of a smaller id; kept_sha256 is of the
    bytes left. A null or empty text has no bytes, an empty table gives no rows, and a
    text longer than a block makes a block of its own; a null id is greater than all
    others; rows of equal ids take nothing from one another; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of())
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(1, -(-total // block_bytes)))
    buckets = max(2 * common.shuffle_width(spark), blocks)
    # by text too, so that one id does not make one block
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    source = source.mapInArrow(_gather, _TEXTS)
    # one query to the end: the blocks' texts are shuffled once, squeezed, and read three times, which costs
    # least disk; a lost executor's part of any step is made again from the step before
    anchors = source.groupBy("block").applyInArrow(_name_anchors(buckets), _ANCHORS)
    statuses = anchors.groupBy("bucket").applyInArrow(_find_repeated(heavy, heavy_windows), _STATUS)
    contents = source.groupBy("block").cogroup(statuses.groupBy("block")).applyInArrow(_send_contents(buckets), _CONTENTS)
    least = contents.groupBy("bucket").applyInArrow(_resolve, _LEAST)
    none = F.lit(None).cast("binary")
    answers = statuses.select("block", "bucket", "status", none.alias("runs"), none.alias("lengths"), none.alias("docs")).unionByName(least.select("block", "bucket", none.alias("status"), "runs", "lengths", "docs"))
    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_mark(buckets), _RESULT)


def report(spans: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate(F.transform("edges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("edges") / 2).cast("long").alias("n_spans"), "kept_sha256")


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    """Reference for tests: (n_removed, n_spans, kept_sha256) of each document, from a map of all strings."""
    first: dict[bytes, int] = {}
    texts = [(_LAST_DOC if d is None else d, (t or "").encode()) for d, t in docs]
    for d, t in texts:
        for i in range(len(t) - WINDOW + 1):
            w = t[i : i + WINDOW]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - WINDOW + 1):
            if first[t[i : i + WINDOW]] < d:
                gone[i : i + WINDOW] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


#: The query's rows in DuckDB (ids unique and not null).
ORACLE = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM docs, LATERAL unnest(range(0, length(h) // 2 - 49)) u(p)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT w.doc_id, w.p FROM windows w JOIN firsts f ON w.s = f.s WHERE f.first < w.doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
