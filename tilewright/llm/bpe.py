"""Byte-level BPE encoding and decoding with a public rank file.

A text is cut by the tokenizer's pattern; each distinct word is a byte array whose
neighbouring pieces are merged by least rank until no neighbours have a rank.
Decoding concatenates the ids' binary pieces. Two forms of the fold give the same
ids: ``fold_native`` is a Spark higher-order-function fold over a literal rank map;
``RankFold`` does it in Arrow batches, and is what ``encode_documents`` uses
because the native form is many times over the CPU limit (figures: README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

#: Most distinct chunks that a worker keeps between batches; beyond it the cache starts anew.
CACHE = 200_000
#: Words longer than this merge through a heap, in n log n steps.
LONG = 64
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class RankFold:
    """Ids of words by ranked merges of byte pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [bytes([i]) for i in range(256)]

    def ids(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._long(word) if len(word) > LONG else self._short(word)

    def _short(self, word: bytes) -> list[int]:
        get, parts = self.ranks.get, [self.bytes[b] for b in word]
        pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < _NONE:
            i = pairs.index(best)  # the leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        return [self.ranks[p] for p in parts]

    def _long(self, word: bytes) -> list[int]:
        get, n = self.ranks.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a piece starts at i, ends at end[i]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    """Whole texts to ids, each distinct chunk folded once.

    Texts are first cut at single spaces, which are always word boundaries of the
    pattern when no white space stands next to them; other texts are cut by the
    pattern itself. Chunks' ids lie in one array, so that a batch's ids are one gather.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fold, self.pattern = RankFold(ranks), regex.compile(pattern)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.flat, self.starts, self.sizes, self.odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _number(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks; new ones are folded."""
        numbers = self.numbers
        missing = [c for c in dict.fromkeys(chunks) if c not in numbers]
        if missing:
            words, fold, findall = self.words, self.fold.ids, self.pattern.findall
            made = []
            for chunk in missing:
                parts = []
                for word in findall(chunk):
                    known = words.get(word)
                    if known is None:
                        known = words[word] = np.array(fold(word.encode()), np.uint32).tobytes()
                    parts.append(known)
                made.append(b"".join(parts))
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            bodies = [c[1:] if c[:1] == " " else c for c in missing]
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), np.uint32)])
            self.odd = np.concatenate([self.odd, np.array([not b or b[0].isspace() or b[-1].isspace() for b in bodies], bool)])
            numbers.update(zip(missing, range(len(numbers), len(numbers) + len(missing)), strict=True))
        return np.fromiter(map(numbers.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's."""
        if len(self.numbers) > CACHE:
            self._reset()
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        parts = lists.flatten()
        code = parts.dictionary_encode()
        # a part stands for itself and the space before it, but for a text's first
        order = self._number([" " + p for p in code.dictionary.to_pylist()])[code.indices.to_numpy()]
        firsts = offsets[:-1]
        order[firsts] = self._number(parts.take(pa.array(firsts)).to_pylist())
        many = np.diff(offsets)
        odd = np.flatnonzero((np.add.reduceat(self.odd[order], firsts) > 0) & (many > 1)) if len(many) else many
        if len(odd):
            rows = np.split(order, offsets[1:-1])
            for i in odd.tolist():
                rows[i] = self._number(self.pattern.findall(texts[i].as_py()))
            order, many = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        sizes = self.sizes[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[order] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(many)])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker process, kept between batches and tasks."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(load_ranks(ranks_path), pattern)
    return _encoders[key]


def _slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[slice]:
    """Runs of texts of bounded bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(start, stop)
        start = stop


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of each whole text.

    Special tokens' strings are ordinary text. A null text is the empty text, which
    has no ids; repeated rows and ids stay as they are; an empty table gives no rows; a
    text or a word of any length is encoded whole; other columns are ignored.
    The decoded bytes are the text's UTF-8 bytes.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for part in _slices(texts):
                ids, offsets = enc.encode(texts[part])
                rows = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                decoded = [enc.decode(x) for x in rows]
                columns = [
                    doc_ids[part].cast(pa.int64()),
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                if keep_decoded:
                    columns.append(pa.array(decoded, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", common.text_of()).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids array<int>); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            out = [enc.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


_BUCKETS = 1 << 18


def _bucket(a: int, b: int) -> int:
    return (a * 40503 + b * 2654435) % _BUCKETS


def fold_native(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a binary word as one higher-order-function fold over a literal rank map.

    The map takes a pair of neighbouring pieces' ids to the rank of their union. It
    is an array of small maps by a hash of the pair, as Spark searches a map in
    linear time. Each step of the fold merges the leftmost pair of least rank.
    """
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                buckets[_bucket(a, b)].append(f'"{a * 65536 + b}":{rank}')
    pair_ranks = F.from_json(F.lit("[" + ",".join("{" + ",".join(x) + "}" for x in buckets) + "]"), "array<map<string,int>>")
    byte_ids = F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<int>")

    def rank(a: Column, b: Column) -> Column:
        a, b = a.cast("long"), b.cast("long")
        return F.get(pair_ranks, F.pmod(a * 40503 + b * 2654435, F.lit(_BUCKETS)).cast("int"))[(a * 65536 + b).cast("string")]

    def merged(parts: Column, found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        return F.when(F.array_min(found).isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), F.array(F.array_min(found)), F.slice(parts, at + 2, F.size(parts))))

    def step(parts: Column, _: Column) -> Column:
        found = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: rank(x, F.get(parts, i + 1)))
        return F.get(F.transform(F.array(found), lambda r: merged(parts, r)), 0)

    n = F.length(word)
    first = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(byte_ids, F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, step))
