"""Alignment of two tokenizers' tokens over the same bytes, with counts of linked id pairs in all documents.

A transducer reads whichever side trails. Its state is the side that leads and the bytes by which it does, its
dangling suffix; a step from a state by the next token's bytes is worked out once and kept. An empty suffix closes a
group. Each token read at a dangling suffix overlaps the token that leads, which is a link. Texts are cut at
single spaces between other characters, where tokens of both sides end, and each distinct chunk is aligned once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import common

#: Most distinct chunks that a worker keeps between batches; beyond it the cache starts anew.
CACHE = 200_000
#: Bytes of text whose links are counted together, and that are worked on together.
BLOCK_BYTES, TOGETHER = 8 << 20, 1 << 20
#: Bits of a second id in a pair's number.
SHIFT = 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """States (side that leads, dangling bytes) and steps between them, kept as they are met. State 0 has none dangling."""

    #: Chunks of more tokens are read one by one.
    MANY = 64

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.steps: dict[tuple[int, int], int] = {}
        self.keys, self.targets, self.leads = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, bool)

    def step(self, state: int, token: int) -> int:
        """The state after the trailing side's ``token`` (the first side's from state 0), or -1 where the bytes differ."""
        lead, left = self.states[state]
        side = 1 - lead if left else 0
        own = self.bytes[side][token]
        if left.startswith(own):
            key = (lead, left[len(own) :])
        elif own.startswith(left):
            key = (side, own[len(left) :])
        else:
            key = None
        if key is None:
            to = -1
        else:
            key = key if key[1] else (0, b"")
            to = self.numbers.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
        self.steps[state, token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]] | None:
        """The group of each token of either side, and the numbers of linked pairs; None where the sides' bytes differ."""
        steps, states, own_a, own_b, links = self.steps, self.states, [], [], []
        state = i = j = lead = 0
        group = -1
        while True:
            ahead = states[state][0]
            if state and not ahead:
                if j == len(b):
                    return None
                token = b[j]
                j += 1
                own_b.append(group)
                links.append(lead << SHIFT | token)
            else:
                if i == len(a):
                    return None if state or j < len(b) else (own_a, own_b, links)
                token = a[i]
                i += 1
                group += not state
                own_a.append(group)
                if state:
                    links.append(token << SHIFT | lead)
            to = steps.get((state, token))
            if to is None:
                to = self.step(state, token)
            if to < 0:
                return None
            if not state or states[to][0] != ahead:
                lead = token
            state = to

    def _to(self, key: np.ndarray) -> np.ndarray:
        """Steps for many (state << SHIFT | token) at once."""
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = np.unique(key[self.keys[at] != key]) if len(self.keys) else np.unique(key)
        if len(new):
            made = [self.step(k >> SHIFT, k & ((1 << SHIFT) - 1)) for k in new.tolist()]
            self.keys, self.targets = np.append(self.keys, new), np.append(self.targets, made)
            by = np.argsort(self.keys)
            self.keys, self.targets = self.keys[by], self.targets[by]
            self.leads = np.array([lead for lead, _ in self.states], bool)
            at = np.searchsorted(self.keys, key)
        return self.targets[at]

    def align_many(self, a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``align`` for many chunks, a token of each at a time: groups of either side's tokens, links' chunks and numbers, chunks that differ."""
        groups = [np.zeros(len(x), np.int64) for x in (a, b)]
        wrong = np.zeros(len(a_offsets) - 1, bool)
        owners, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = np.diff(a_offsets) + np.diff(b_offsets)
        for chunk in np.flatnonzero(size > self.MANY).tolist():
            (low, high), (bottom, top) = a_offsets[chunk : chunk + 2], b_offsets[chunk : chunk + 2]
            found = self.align(a[low:high].tolist(), b[bottom:top].tolist())
            if found is None:
                wrong[chunk] = True
            else:
                groups[0][low:high], groups[1][bottom:top] = found[:2]
                owners.append(np.full(len(found[2]), chunk))
                links.append(np.array(found[2], np.int64))
        chunk = np.flatnonzero(size <= self.MANY)
        i, j, i_end, j_end = a_offsets[chunk], b_offsets[chunk], a_offsets[chunk + 1], b_offsets[chunk + 1]
        state, lead, group = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64), np.full(len(chunk), -1)
        while len(chunk):
            of_b = (state > 0) & ~self.leads[state]
            over = np.where(of_b, j >= j_end, i >= i_end)
            if over.any():
                wrong[chunk[over & ((state > 0) | (j < j_end))]] = True
                chunk, i, j, i_end, j_end, state, lead, group, of_b = (x[~over] for x in (chunk, i, j, i_end, j_end, state, lead, group, of_b))
            fresh = state == 0
            group += fresh
            token = np.empty(len(chunk), np.int64)
            token[of_b], token[~of_b] = b[j[of_b]], a[i[~of_b]]
            groups[0][i[~of_b]], groups[1][j[of_b]] = group[~of_b], group[of_b]
            i += ~of_b
            j += of_b
            owners.append(chunk[~fresh])
            links.append(np.where(of_b, lead << SHIFT | token, token << SHIFT | lead)[~fresh])
            to = self._to(state << SHIFT | token)
            lead = np.where(fresh | (self.leads[to] != self.leads[state]), token, lead)
            if (bad := to < 0).any():
                wrong[chunk[bad]] = True
                chunk, i, j, i_end, j_end, to, lead, group = (x[~bad] for x in (chunk, i, j, i_end, j_end, to, lead, group))
            state = to
        owners, links = np.concatenate(owners), np.concatenate(links)
        by = np.argsort(owners, kind="stable")
        return *groups, owners[by], links[by], wrong


class Digits:
    """Decimal strings of many numbers below a bound, each with a sign after it."""

    def __init__(self, bound: int):
        texts = [str(i).encode() for i in range(bound)]
        self.width = len(texts[-1]) + 1
        self.sizes = np.fromiter(map(len, texts), np.int64, bound)
        self.table = np.frombuffer(b"".join(t.ljust(self.width) for t in texts), np.uint8)

    def joined(self, numbers: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each number with its sign ends."""
        sizes = self.sizes[numbers] + 1
        ends = np.cumsum(sizes)
        out = self.table[np.repeat(numbers * self.width - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        out[ends - 1] = signs
        return out, ends


class Aligner:
    """Whole texts to groups and links, each distinct chunk aligned once. A chunk has a space before it, a text's first the added one."""

    TOGETHER = 100

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        entries = {v: k for k, v in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = [bytes(letters[c] for c in entries[i]) if i in entries else b"" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        self.digits = Digits(max(len(a_bytes), len(b_bytes)))
        self.sizes = tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        # a piece that goes on over a space would tie a chunk to the next
        self.cuts = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.transducer.clear()
        #: a chunk's tokens of either side, groups and links, or -1 links where the sides differ; where its links begin; its groups' text
        self.counts, self.starts = np.zeros((0, 4), np.int32), np.zeros(0, np.int64)
        self.links, self.texts = np.zeros(0, np.int32), pa.array([], pa.string())

    def _encoded(self, chunks: list[str]) -> list[list[np.ndarray]]:
        """Both sides' ids of chunks, and how many each has; some are encoded together where they can be told apart by their bytes."""
        texts = [" ".join(chunks[low : low + self.TOGETHER]) for low in range(0, len(chunks), self.TOGETHER)]
        both = [[x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)]
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        out = []
        for ids, sizes in zip(both, self.sizes, strict=True):
            ids = np.fromiter(chain.from_iterable(ids), np.int64)
            place = np.cumsum(sizes[ids])
            at = np.minimum(np.searchsorted(place, ends), len(place) - 1)
            if len(chunks) > 1 and (not len(place) or place[-1] != ends[-1] or (place[at] != ends).any()):
                one = [self._encoded([c]) for c in chunks]
                return [[np.concatenate([x[side][k] for x in one]) for k in range(2)] for side in range(2)]
            out.append([ids, np.diff(at + 1, prepend=0) if len(chunks) > 1 else np.array([len(ids)])])
        return out

    def _learn(self, chunks: list[str], odd: np.ndarray) -> None:
        """Align new chunks; ``odd`` ones begin or end with white space and are encoded alone."""
        plain = [c for c, o in zip(chunks, odd.tolist(), strict=True) if not o]
        alone = [c for c, o in zip(chunks, odd.tolist(), strict=True) if o]
        parts = [self._encoded(plain)] * bool(plain) + [self._encoded([c]) for c in alone]
        chunks = plain + alone
        (a, a_many), (b, b_many) = ([np.concatenate([x[side][k] for x in parts]) for k in range(2)] for side in range(2))
        a_offsets, b_offsets = (np.concatenate([[0], np.cumsum(x)]) for x in (a_many, b_many))
        a_group, b_group, owner, link, wrong = self.transducer.align_many(a, a_offsets, b, b_offsets)
        # the model's mark in a text is read as a space
        wrong |= np.fromiter((_MARK in c for c in chunks), bool, len(chunks))
        a_chunk, b_chunk = np.repeat(np.arange(len(chunks)), a_many), np.repeat(np.arange(len(chunks)), b_many)
        a, a_group, a_chunk = (x[~wrong[a_chunk]] for x in (a, a_group, a_chunk))
        b, b_group, b_chunk = (x[~wrong[b_chunk]] for x in (b, b_group, b_chunk))
        owner, link = owner[~wrong[owner]], link[~wrong[owner]]
        last = _lasts(a_chunk)
        n_groups = np.zeros(len(chunks), np.int64)
        n_groups[a_chunk[last]] = a_group[last] + 1
        # all tokens by group, the first side's before the second's
        base = np.cumsum(n_groups) - n_groups
        a_group, b_group = a_group + base[a_chunk], b_group + base[b_chunk]
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group, side="left")
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
        numbers, signs = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        numbers[a_place], numbers[b_place] = a, b
        for place, group, sign in ((a_place, a_group, b"|"), (b_place, b_group, b";")):
            signs[place] = np.where(_lasts(group), sign[0], b","[0])
        data, ends = self.digits.joined(numbers, signs)
        tokens = np.where(wrong, 0, a_many + b_many)
        final = ends[np.cumsum(tokens)[tokens > 0] - 1] - 1  # no sign after a chunk's last group
        kept = np.ones(len(data), bool)
        kept[final] = False
        offsets = np.zeros(len(chunks) + 1, np.int64)
        offsets[1:][tokens > 0] = final - np.arange(len(final))
        texts = pa.Array.from_buffers(pa.string(), len(chunks), [None, pa.py_buffer(np.maximum.accumulate(offsets).astype(np.int32)), pa.py_buffer(data[kept])])
        pairs, place = np.unique(link, return_inverse=True)
        known = np.fromiter((self.pairs.setdefault(x, len(self.pairs)) for x in pairs.tolist()), np.int32, len(pairs))
        n_links = np.bincount(owner, minlength=len(chunks))
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.counts = np.concatenate([self.counts, np.stack([a_many, b_many, n_groups, np.where(wrong, -1, n_links)], 1).astype(np.int32)])
        self.links = np.concatenate([self.links, known[place]])
        self.texts = pa.concat_arrays([self.texts, texts])
        self.numbers.update(zip(chunks, range(len(self.numbers), len(self.numbers) + len(chunks)), strict=True))

    def _number(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks; new ones are aligned."""
        numbers = self.numbers
        if missing := [c for c in dict.fromkeys(chunks) if c not in numbers]:
            self._learn(missing, _bordered(pa.array(missing, pa.string())))
        return np.fromiter(map(numbers.__getitem__, chunks), np.int64, len(chunks))

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' chunks, and where each text's begin."""
        if len(self.numbers) > CACHE:
            self._reset()
        if not self.cuts:
            return self._number(texts.to_pylist()), np.arange(len(texts) + 1)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        code = lists.flatten().dictionary_encode()
        place = code.indices.to_numpy()
        # parts that white space borders on do not stand alone
        odd = np.logical_or.reduceat(_bordered(code.dictionary)[place], offsets[:-1]) if len(texts) else np.zeros(0, bool)
        many = np.diff(offsets)
        used = np.unique(place[np.repeat(~odd, many)])
        number = np.full(len(code.dictionary), -1, np.int64)
        number[used] = self._number(code.dictionary.take(pa.array(used)).to_pylist())
        order = number[place]
        if odd.any():
            rows = np.split(order, offsets[1:-1])
            for i in np.flatnonzero(odd).tolist():
                rows[i] = self._number(_CUT.split(texts[i].as_py()))
            order, many = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return order, np.concatenate([[0], np.cumsum(many)])


def _lasts(values: np.ndarray) -> np.ndarray:
    """The last of each stretch of equal values."""
    out = np.ones(len(values), bool)
    out[:-1] = values[1:] != values[:-1]
    return out


def _bordered(parts: pa.Array) -> np.ndarray:
    """Parts that are empty or begin or end with white space."""
    size = pc.binary_length(parts).to_numpy(zero_copy_only=False)
    return (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(parts)).to_numpy(zero_copy_only=False) != size)


def _slices(texts: pa.Array) -> Iterator[slice]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
        yield slice(start, stop)
        start = stop


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their first bytes together, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}
_DOC = "doc_ids array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, digests array<string>, groups array<string>, sizes array<int>, links binary, repeats binary"
_BLOCK = f"block long, {_DOC}, pairs array<long>, holders array<int>"
_KINDS = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.string())] * 2, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _aligned(aligner: Aligner, doc_ids: pa.Array, texts: pa.Array, keep_groups: bool) -> tuple:
    """Of a slice: ids, token and group counts, digests, groups, distinct pairs a text, the pairs and their repeats."""
    order, offsets = aligner.chunks(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    wrong = np.zeros(n, bool)
    wrong[row[aligner.counts[order, 3] < 0]] = True
    wrong |= pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    keep = ~wrong[row]
    order, row = order[keep], row[keep]
    sums = [np.bincount(row, aligner.counts[order, k], n).astype(np.int64) for k in range(3)]
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), aligner.texts.take(pa.array(order))), ";").to_pylist()
    digests = ["" if w else hashlib.sha256(g.encode()).hexdigest() for g, w in zip(groups, wrong.tolist(), strict=True)]
    many = aligner.counts[order, 3].astype(np.int64)
    link = aligner.links[np.repeat(aligner.starts[order] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    codes = np.fromiter(aligner.pairs, np.int64, len(aligner.pairs))
    key, repeats = np.unique(np.repeat(row, many) * max(len(codes), 1) + link, return_counts=True)
    owner, pair = np.divmod(key, max(len(codes), 1))
    return doc_ids.to_pylist(), *sums, digests, groups if keep_groups else [None] * n, np.bincount(owner, minlength=n), codes[pair], repeats


def _block_row(block: int, parts: list[tuple]) -> pa.RecordBatch:
    """One row of a block's texts, with its distinct pairs, how many of its texts hold each, and each text's pairs by their places."""
    doc_ids, n_a, n_b, n_groups, digests, groups, sizes, codes, repeats = zip(*parts, strict=True)
    sizes = np.concatenate(sizes)
    pairs, place, holders = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((place, owner))
    place = place[by]
    gaps = np.diff(place, prepend=0)
    first = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]
    gaps[first] = place[first]
    flat = [sum(doc_ids, []), *(np.concatenate(x) for x in (n_a, n_b, n_groups)), sum(digests, []), sum(groups, []), sizes]
    values = [block, *flat, _packed(gaps), _packed(np.concatenate(repeats)[by]), pairs, holders]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _scored(keep_groups: bool):
    def f(docs: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts.column("place").to_numpy()
        count, best = (np.zeros(len(place), np.int64) for _ in range(2))
        count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        out = []
        for row in docs.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            gaps, repeats = (_unpacked(row[c], int(sizes.sum())) for c in ("links", "repeats"))
            total = np.cumsum(gaps)
            first = np.cumsum(sizes) - sizes
            before = np.concatenate([[0], total])[first]
            own = total - np.repeat(before, sizes)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(first, len(own))]) for x in (repeats, repeats * best[own], repeats * count[own])]
            columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], *sums, row["digests"]] + [row["groups"]] * keep_groups
            kinds = [pa.int64()] * 7 + [pa.string()] * (1 + keep_groups)
            out.append(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")] + ["groups"] * keep_groups))
        return pa.concat_tables(out)

    return f


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of each whole text.

    ``a_path`` is a byte-level BPE file, which encodes a space and the text, ``b_path`` a piece model that adds the space
    itself; special tokens' strings are plain text. Groups end where tokens of both end; a link is two tokens that overlap;
    a pair's count is the number of rows that hold it linked, n_best the links whose count no other partner of their first id exceeds,
    count_sum the sum of counts over links. A null or empty text, or one whose tokens' bytes differ from the
    space and the text (it holds U+2581), has zeros and an empty digest. Repeated rows and ids are rows of
    their own; an empty table gives no rows; texts and words of any length are aligned whole; other columns are ignored.

    Rows are aligned where they are read, in blocks of some BLOCK_BYTES. Only a block's distinct pairs are shuffled
    to be counted and to come back; what its texts hold goes with the block. The first ids' best counts are broadcast: no more than the
    first vocabulary has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path)
        if key not in _aligners:
            _aligners[key] = Aligner(a_path, b_path)
        block, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in _slices(batch.column("text")):
                texts = batch.column("text")[part]
                parts.append(_aligned(_aligners[key], batch.column("doc_id")[part], texts, keep_groups))
                size += pc.sum(pc.binary_length(texts)).as_py()
                if size >= BLOCK_BYTES:
                    yield _block_row(block, parts)
                    block, parts, size = block + 1, [], 0
        if parts:
            yield _block_row(block, parts)

    blocks = common.written(docs.select(F.col("doc_id").cast("long"), common.text_of()).mapInArrow(run, _BLOCK), "alignment")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = common.written(pairs.groupBy("pair").agg(F.sum("holders").alias("count")), "alignment-counts")
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    rated = counts.join(F.broadcast(most), first == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.select("block", "place", "pair").join(rated, "pair").select("block", "place", "count", "best")
    texts = blocks.select(F.col("block").alias("own"), *[c.split()[0] for c in _DOC.split(", ")])
    return texts.groupBy("own").cogroup(answers.groupBy("block")).applyInArrow(_scored(keep_groups), _RESULT + ", groups string" * keep_groups)
