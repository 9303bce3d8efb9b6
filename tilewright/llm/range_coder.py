"""Token-ID output: an adaptive context-mixing range coder in independent blocks.

A block starts from an empty model and carries checksums, so it can be read alone.
Its ids lie in lanes that are coded side by side: at each step every lane codes
one id under the model of all earlier steps, so that the arithmetic runs over whole
arrays and all lanes teach one model. Order 2 and order 1 contexts predict the id
that last followed; how often such predictions hold, by the confidence of both,
is the mixture's weight; the rest goes to adaptive order-0 frequencies.

Block layout (little-endian): 4-byte magic, version 1 byte, vocabulary u32, ids u64,
lanes u32, steps u32, CRC-32 of the ids u32, CRC-32 of the payload u32; payload: digits of each
lane u32 each, then the lanes' 16-bit digits.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

MAGIC = b"TWRC"
_HEAD = struct.Struct("<4sBIQIIII")
#: Ids of one block at most; a longer document is spread over several.
BLOCK_IDS = 8_000_000
LANES, LANE_LEAST = 16384, 128
_CHOICE, _PLAIN = 12, 20  # bits of the choice's and of order 0's frequencies, which make one interval
_DIGIT, _DIGITS = 16, 4
_TOP = np.uint64(1 << 48)
_SLOTS = 19  # log2 of the order-2 table
_U16, _U32, _U48, _TOTAL, _MOST = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(_CHOICE + _PLAIN), np.uint64(0xFFFFFFFF)
_MIX1, _MIX2 = np.uint32(0x9E3779B1), np.uint32(0x2545F491)


class Mixer:
    """Predictions and their weights; encoder and decoder drive it alike. Ids count from 1 in here, 0 is none."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.one, self.two = np.zeros(vocabulary + 1, np.uint32), np.zeros(1 << _SLOTS, np.uint32)  # id and 3 bits of confidence
        self.last = np.zeros(lanes, np.uint32)
        self.before, self.row = self.last, self.last.astype(np.intp)
        self.seen: list[np.ndarray] = []
        self.tried: list[np.ndarray] = []
        self.counts = np.full(vocabulary, 1 / 16)
        self.stats = np.zeros((128, 3))
        self.stats[:] = (0.2, 0.1, 1.7)
        self.step = 0
        self._plain()
        self._weigh()

    def _plain(self) -> None:
        """Order-0 frequencies of the ids seen; every id keeps a share."""
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary + 1)[1:]
            self.seen.clear()
        spare = (1 << _PLAIN) - self.vocabulary
        sums = np.cumsum(self.counts)
        self.cumulative = np.zeros(self.vocabulary + 1, np.uint32)
        self.cumulative[1:] = np.floor(sums * (spare / sums[-1])).astype(np.uint32) + np.arange(1, self.vocabulary + 1, dtype=np.uint32)
        self.cumulative[-1] = 1 << _PLAIN
        self.inverse = None
        # by id: size in the lower half of a word, start in the upper
        self.plain = np.zeros(self.vocabulary + 1, np.uint64)
        self.plain[1:] = (self.cumulative[:-1].astype(np.uint64) << _U32) | np.diff(self.cumulative).astype(np.uint64)

    def _weigh(self) -> None:
        """Shares of (order 2 holds, order 1 holds, neither) for each pair of confidences."""
        if self.tried:
            self.stats += np.bincount(np.concatenate(self.tried), minlength=384).reshape(128, 3)
            self.tried.clear()
        share = self.stats / self.stats.sum(1, keepdims=True)
        ends = np.zeros((128, 4), np.uint64)
        ends[:, 1:3] = (np.cumsum(share[:, :2], axis=1) * ((1 << _CHOICE) - 3)).astype(np.uint64) + np.array([1, 2], np.uint64)
        ends[:, 3] = 1 << _CHOICE
        self.first, self.second = ends[:, 1].copy(), ends[:, 2].copy()
        self.low, self.share = (ends[:, :3] << np.uint64(_PLAIN)).ravel(), np.diff(ends, axis=1).ravel()

    def predict(self) -> None:
        # places are of the type that numpy indexes by, as they are used several times
        self.slot = ((self.before * _MIX2 + self.last * _MIX1) >> np.uint32(32 - _SLOTS)).astype(np.intp)
        self.slot1 = self.row
        self.entry2, self.entry1 = self.two[self.slot], self.one[self.slot1]
        self.guess2, self.guess1 = self.entry2 >> 3, self.entry1 >> 3
        self.level2, self.level1 = self.entry2 & 7, self.entry1 & 7
        self.key = ((self.level2 << 4) | (self.level1 << 1) | (self.guess1 == self.guess2)).astype(np.intp)

    def choose(self, ids: np.ndarray) -> np.ndarray:
        """Which guess each id is: 0 order 2's, 1 order 1's, 2 neither."""
        self.hit2, self.hit1 = self.guess2 == ids, self.guess1 == ids
        return np.where(self.hit2, np.uint32(0), np.uint32(2) - self.hit1)

    def interval(self, choice: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's id in 2 ** (_CHOICE + _PLAIN): a guess's share whole, else the id's part of the rest."""
        self.row, self.place = ids.astype(np.intp), self.key * 3 + choice
        share = self.share[self.place]
        plain = self.plain[self.row]
        plain[choice != 2] = 1 << _PLAIN
        return self.low[self.place] + share * (plain >> _U32), share * (plain & _MOST)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold ``value``."""
        top, second = value >> np.uint64(_PLAIN), self.second[self.key]
        ids = np.where(top < self.first[self.key], self.guess2, self.guess1)
        rest = np.flatnonzero(top >= second)
        low = second[rest]
        inside = (value[rest] - (low << np.uint64(_PLAIN))) // (np.uint64(1 << _CHOICE) - low)
        if self.inverse is None:  # the id of every place, for as long as the frequencies stand
            self.inverse = np.repeat(np.arange(1, self.vocabulary + 1, dtype=np.uint16 if self.vocabulary < 65535 else np.uint32), np.diff(self.cumulative))
        ids[rest] = self.inverse[inside]
        return ids

    def learn(self, ids: np.ndarray) -> None:
        fresh = ids << np.uint32(3)
        self.two[self.slot] = np.where(self.hit2, self.entry2 + (self.level2 != 7), np.where(self.level2 > 0, self.entry2 - np.uint32(1), fresh))
        self.one[self.slot1] = np.where(self.hit1, self.entry1 + (self.level1 != 7), np.where(self.level1 > 0, self.entry1 - np.uint32(1), fresh))
        self.seen.append(self.row)
        self.tried.append(self.place)
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step < 16 or self.step % 8 == 0:
            self._weigh()
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self._plain()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_LEAST))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of ids below ``vocabulary``."""
    n = len(ids)
    lanes, steps = _shape(n)
    rows = np.ones(lanes * steps, np.uint32)
    rows[:n] = ids
    rows[:n] += np.uint32(1)
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    mixer = Mixer(vocabulary, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    # the lanes' first digits, then their second ones: lanes keep step, so what is written lies together
    room = 2 * steps + _DIGITS + 1
    digits = np.zeros(lanes * room, np.uint32)
    first = np.arange(lanes, dtype=np.intp)
    at = first.copy()
    for row in rows:
        mixer.predict()
        choice = mixer.choose(row)
        start, size = mixer.interval(choice, row)
        unit = width >> _TOTAL
        added = low + start * unit
        over = np.flatnonzero(added < low)
        if over.size:  # a carry goes into the last digit; settled at the end
            digits[at[over] - lanes] += 1
        low, width = added, size * unit
        short = width < _TOP
        digits[at] = low >> _U48  # where nothing is due, the next digit overwrites it
        at += short * lanes
        shift = short * _U16
        low, width = low << shift, width << shift
        if (few := np.flatnonzero(width < _TOP)).size:  # an id of more than a digit's bits
            digits[at[few]] = low[few] >> _U48
            at[few] += lanes
            low[few] <<= _U16
            width[few] <<= _U16
        mixer.learn(row)
    for _ in range(_DIGITS):
        digits[at] = low >> _U48
        at += lanes
        low <<= _U16
    used = (at - first) // lanes
    grid = digits.reshape(room, lanes)[: int(used.max())]
    for k in range(len(grid) - 1, 0, -1):
        grid[k - 1] += grid[k] >> _DIGIT
    body = np.ascontiguousarray(grid.astype("<u2").T)[np.arange(len(grid)) < used[:, None]].tobytes()
    payload = used.astype("<u4").tobytes() + body
    head = _HEAD.pack(MAGIC, 1, vocabulary, n, lanes, steps, zlib.crc32(np.asarray(ids).astype("<u4").tobytes()), zlib.crc32(payload))
    return head + payload


def decode_block(block: bytes) -> np.ndarray:
    """The block's ids; ValueError if either checksum fails."""
    magic, version, vocabulary, n, lanes, steps, ids_sum, payload_sum = _HEAD.unpack_from(block)
    payload = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or version != 1 or zlib.crc32(payload) != payload_sum:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, np.uint32)
    used = np.frombuffer(payload[: 4 * lanes], "<u4").astype(np.int64)
    grid = np.zeros((lanes, int(used.max()) + 2), np.uint16)
    grid[np.arange(grid.shape[1]) < used[:, None]] = np.frombuffer(payload[4 * lanes :], "<u2")
    digits = grid.T.ravel()  # the lanes' first digits, then their second ones
    code, at = np.zeros(lanes, np.uint64), np.arange(lanes, dtype=np.intp)
    for _ in range(_DIGITS):
        code = (code << _U16) | digits[at]
        at = at + lanes
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    mixer = Mixer(vocabulary, lanes)
    out = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        mixer.predict()
        unit = width >> _TOTAL
        row = mixer.find(np.minimum(code // unit, _MOST))
        choice = mixer.choose(row)
        start, size = mixer.interval(choice, row)
        code, width = code - start * unit, size * unit
        short = width < _TOP
        shift = short * _U16
        code, width = (code << shift) | (digits[at] * short), width << shift
        at += short * lanes
        if (few := np.flatnonzero(width < _TOP)).size:
            code[few] = (code[few] << _U16) | digits[at[few]]
            at[few] += lanes
            width[few] <<= _U16
        out[t] = row - np.uint32(1)
        mixer.learn(row)
    ids = out.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_sum:
        raise ValueError("damaged block")
    return ids


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)} | {32: " "}


@cache
def _mixed_letters() -> str:
    """Pattern of letters whose normal form or lower case is not letters alone: a mark after one may belong to its token."""
    letters = (c for c in map(chr, range(0x80, 0x110000)) if c.isalpha())
    return "[" + "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha()) + "]"


class TextEncoder:
    """Ids of whole texts by the tokenizers library, at its defaults but for the special tokens that it would add.

    The library's normaliser and pre-tokenizer act within white-space-separated
    chunks, so each distinct chunk between spaces or line feeds is encoded once.
    Chunks that are one word of letters with marks after it share that word's ids;
    such words go to the library many at a time, as each ends with the one id that
    the vocabulary ends words with. Words of Latin letters are lower-cased in Arrow and
    need the library's model alone, without its normal form and pattern.
    """

    #: Words, marks and other chunks that are kept between batches; beyond it the cache starts anew.
    CACHE = 1_500_000
    TOGETHER = 64
    MARKS = ".,!?"
    #: Letters that are their own normal form and have a lower case of one letter (so not U+0130).
    LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        parts = json.loads(self.tokenizer.to_str())
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.letters = _byte_letters()
        suffix = parts["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.vocabulary, bool)
        if suffix:
            self.ends[[i for token, i in parts["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        """Units are strings of one Arrow column, their ids a piece of one array; unit 0 is empty."""
        self.units = pa.array([""], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, texts: list[str]) -> list[list[int]]:
        """The same for lower-case Latin words."""
        letters = [t if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in texts]
        return [x.ids for x in self.bare.encode_batch_fast(letters, add_special_tokens=False)]

    def _singly(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of units' ids, and the ids."""
        made = self._library(units)
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        return sizes, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))

    def _together(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, many at a time and parted by spaces: each ends with the one id that ends a word."""
        sizes, ids = [], []
        runs = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for run, made in zip(runs, encode([" ".join(run) for run in runs]), strict=True):
            made = np.array(made, np.int32)
            cuts = np.flatnonzero(self.ends[made]) + 1
            size = np.concatenate([cuts[:1], cuts[1:] - cuts[:-1]])
            if len(cuts) != len(run):  # a word that the library splits after all
                size, made = self._singly(run)
            sizes.append(size)
            ids.append(made)
        return np.concatenate(sizes), np.concatenate(ids)

    def _number(self, column: pa.Array, kinds: np.ndarray) -> np.ndarray:
        """Numbers of distinct units; new ones are encoded, each kind (2 Latin words, 1 other words, 0 others) its way, and kept."""
        found = pc.index_in(column, value_set=self.units)
        number = found.fill_null(-1).to_numpy().astype(np.int32)
        for kind in (2, 1, 0):
            fresh = np.flatnonzero((number < 0) & (kinds == kind))
            if len(fresh):
                own = column.take(pa.array(fresh))
                units = own.to_pylist()
                sizes, ids = self._together(units, self._model if kind == 2 else self._library) if kind else self._singly(units)
                sizes = sizes.astype(np.int32)
                number[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
                self.units = pa.concat_arrays([self.units, own])
                self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes])
                self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        return number

    def _kinds(self, words: pa.Array) -> np.ndarray:
        """2 for words of Latin letters, 1 for other letters whose normal form is letters, else 0."""
        if not self.ends.any():
            return np.zeros(len(words), np.int8)
        latin = pc.match_substring_regex(words, self.LATIN).to_numpy(zero_copy_only=False)
        kinds = latin.astype(np.int8) * 2
        if len(others := np.flatnonzero(~latin)):
            own = words.take(pa.array(others))
            kinds[others] = pc.and_not(pc.utf8_is_alpha(own), pc.match_substring_regex(own, _mixed_letters())).to_numpy(zero_copy_only=False)
        return kinds

    def _chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after the other, of distinct chunks: those of its word and of the marks after it, or its own."""
        word = pc.utf8_rtrim(column, characters=self.MARKS)
        kinds = self._kinds(word)
        # the library's own lower case of other letters depends on its normal form
        names = pc.if_else(pa.array(kinds > 0), pc.if_else(pa.array(kinds == 2), pc.utf8_lower(word), word), column).dictionary_encode()
        place = names.indices.to_numpy()
        kind = np.zeros(len(names.dictionary), np.int8)
        kind[place] = kinds
        cut = np.where(kinds > 0, pc.utf8_length(column).to_numpy() - pc.utf8_length(word).to_numpy(), 0)
        # one look-up for words, marks and other chunks together
        parts, rows, tails = [names.dictionary], [], []
        for n in np.unique(cut[cut > 0]).tolist():
            rows.append(np.flatnonzero(cut == n))
            own = pc.utf8_slice_codeunits(column.take(pa.array(rows[-1])), -n).dictionary_encode()
            tails.append(own.indices.to_numpy() + sum(map(len, parts)))
            parts.append(own.dictionary)
        number = self._number(pa.concat_arrays(parts), np.concatenate([kind, np.zeros(sum(map(len, parts[1:])), np.int8)]))
        pairs = np.zeros((len(column), 2), np.int32)
        pairs[:, 0] = number[place]
        if rows:
            pairs[np.concatenate(rows), 1] = number[np.concatenate(tails)]
        sizes, ids = _pieces(self.flat, self.starts, self.sizes, pairs.ravel())
        return sizes.reshape(-1, 2).sum(1, dtype=np.int32), ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end`` after each text, and each text's number of ids."""
        if len(self.units) > self.CACHE:
            self._reset()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        code = lists.flatten().dictionary_encode()
        chunk_sizes, flat = self._chunks(code.dictionary)
        # the end stands as one more chunk after each text's
        starts = np.cumsum(chunk_sizes, dtype=np.int32) - chunk_sizes
        flat, starts, chunk_sizes = (np.append(x, v).astype(np.int32) for x, v in ((flat, end), (starts, len(flat)), (chunk_sizes, 1)))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ends = offsets[1:] - offsets[0] + np.arange(len(offsets) - 1)
        inside = np.ones(len(code) + len(ends), bool)
        inside[ends] = False
        order = np.full(len(inside), len(starts) - 1, np.int32)
        order[inside] = code.indices.to_numpy()
        many, ids = _pieces(flat, starts, chunk_sizes, order)
        return ids, np.diff(np.cumsum(many, dtype=np.int64)[ends], prepend=0)


def _pieces(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the pieces in ``order``, and their values one after the other."""
    many = sizes[order]
    ends = np.cumsum(many, dtype=np.int32)
    return many, flat[np.repeat(starts[order] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]


def _joined(batches: Iterator[pa.RecordBatch], least: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``least`` bytes, as each look-up among the kept units costs as much as there are units."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_encoders: dict[str, TextEncoder] = {}
_FILE = "shard int, block long, first long, doc_ids array<long>, sizes array<long>, data array<binary>"


def write_ids(docs: DataFrame, path: str, end: int = 1, shards: int | None = None) -> DataFrame:
    """Write every row's ids in ascending order of doc_id (nulls first; equal ids by text); the table of blocks.

    A null or empty text is ``end`` alone; repeated rows are written each time; a text of more than
    a block's ids takes several blocks of one row; an empty table gives no row; other columns,
    whatever their names, are ignored. Shards are ranges of doc_id. A row holds whole documents of BLOCK_IDS ids together, or
    one longer document in several blocks: its place, the ids before it in its shard, the
    documents' ids and sizes, and the blocks.
    """
    shards = shards or common.shuffle_width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = TextEncoder(path)
        enc = _encoders[path]
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]

        def row(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal block, first
            data = [encode_block(ids[low : low + BLOCK_IDS], enc.vocabulary) for low in range(0, len(ids), BLOCK_IDS)]
            values = (shard, block, first, doc_ids, sizes.tolist(), data)
            block, first = block + 1, first + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _FILE.split(", ")])

        doc_ids: list = []
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in _joined(batches):
            more, lengths = enc.encode(batch.column("text"), end)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes, ids = np.concatenate([sizes, lengths]), np.concatenate([ids, more])
            while len(ids) >= BLOCK_IDS:
                ends = np.cumsum(sizes)
                n = max(1, int(np.searchsorted(ends, BLOCK_IDS, side="right")))
                at = int(ends[n - 1])
                yield row(doc_ids[:n], sizes[:n], ids[:at])
                doc_ids, sizes, ids = doc_ids[n:], sizes[n:], ids[at:]
        if doc_ids:
            yield row(doc_ids, sizes, ids)

    rows = docs.select(F.col("doc_id").cast("long"), common.text_of()).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(rows.mapInArrow(run, _FILE), "token-ids")


def read_ids(files: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from a table of blocks, a row for each document written.

    No blocks give no rows; a damaged block is a ValueError. The driver sees one count for each shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([decode_block(x) for x in row["data"]])
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)]
                n = len(sizes)
                columns = [pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))) if keep_ids else pa.array([None] * n, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])

    parts = files.mapInArrow(run, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long, ids array<int>")
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    before, offsets = 0, []
    for shard in sorted(totals):
        offsets.append((shard, before))
        before += totals[shard]
    offsets = files.sparkSession.createDataFrame(offsets, "shard int, before long")
    placed = parts.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("first"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)
