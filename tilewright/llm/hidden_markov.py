"""Language-model scoring with a hidden Markov model.

Documents become blocks of numbered tokens (a written table). Each block's distinct
words and training counts go to hash buckets, where all blocks' counts meet, and
the totals return to the blocks that hold the words; no word table is ever
gathered in one place. The model's symbols are the MOST most frequent words and
GROUPS groups of the others by their last bytes; within a group a word has its
share of the group's count, whatever the state. Baum-Welch counts of each partition
are summed by ranges of symbols, so that one round moves a fixed amount per
partition. A text's likelihood is the scaled forward recursion over all its tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

STATES, ROUNDS = 12, 6
MOST, GROUPS = 16384, 2048
#: Text of one block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text whose words one hash bucket holds at most, in bytes: buckets grow in number with the corpus, never in size.
BUCKET_BYTES = 64 << 20
#: Tokens of the pieces that Baum-Welch trains on; texts up to that are trained on whole.
PIECE = 1024
#: Texts scored at once, tokens trained on at once, and partitions' counts summed at once.
LANES, TOKENS, TREE = 4096, 1 << 19, 64
_SINGLE = 1 << 15
_RANGES = 16

END = b""


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end (the empty word)."""
    words = text.encode().lower().split()
    words.append(END)
    return words


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_BLOCK = "block_id long, doc_ids array<long>, held binary, sizes binary, tokens binary, words array<struct<bucket: int, words: array<binary>, counts: binary>>"


def _pack(block_id: int, docs: list[tuple[int, bool, np.ndarray]], words: list[bytes], buckets: int) -> pa.RecordBatch:
    """A block's row; its words are numbered anew, in the order of their buckets."""
    held = np.array([d[1] for d in docs], bool)
    sizes = np.array([len(d[2]) for d in docs], np.int32)
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words), dtype=np.int32)
    tokens = number[np.concatenate([d[2] for d in docs])]
    counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
    own, edges = np.unique(bucket[order], return_index=True)
    edges = np.append(edges, len(words)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(edges), pa.array([words[i] for i in order.tolist()], pa.binary()))
    parts = pa.StructArray.from_arrays([pa.array(own, pa.int32()), listed, pa.array([c.tobytes() for c in np.split(counts.astype(np.int64), edges[1:-1])], pa.binary())], ["bucket", "words", "counts"])
    columns = [pa.array([block_id]), pa.array([[d[0] for d in docs]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (held, sizes, tokens)), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), parts)]
    return pa.RecordBatch.from_arrays(columns, names=["block_id", "doc_ids", "held", "sizes", "tokens", "words"])


def token_blocks(docs: DataFrame, modulus: int, remainder: int, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of numbered tokens with their distinct words by bucket; rows whose id has the remainder do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_id = TaskContext.get().partitionId() << 32
        numbers, block, size = _Numbers(), [], 0
        for batch in batches:
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                if block and size + len(text) > block_bytes:
                    yield _pack(block_id, block, list(numbers), buckets)
                    block_id, numbers, block, size = block_id + 1, _Numbers(), [], 0
                size += len(text) + 16
                words = tokens_of(text)
                block.append((doc_id, held, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
        if block:
            yield _pack(block_id, block, list(numbers), buckets)

    return docs.select(F.col("doc_id").cast("long"), (common.crc_mod("doc_id", modulus) == remainder).alias("held"), common.text_of()).mapInArrow(run, _BLOCK)


_TOTALS = "block_id long, bucket int, counts binary, n long, v long, groups binary, top array<struct<word: binary, c: long>>, rest long"
_TOP = pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())]))


def _counted(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of one bucket's lists of words: place of each word among the distinct ones, those, their total counts, and the lists' sizes."""
    lists = rows.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    code = lists.flatten().dictionary_encode()
    index = code.indices.to_numpy()
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()])
    return index, code.dictionary, np.bincount(index, counts, minlength=len(code.dictionary)).astype(np.int64), np.diff(lists.offsets.to_numpy())


def _bucket_words(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("words").alias("w")).select("w.bucket", "w.words", "w.counts")


def word_totals(blocks: DataFrame, most: int, groups: int, buckets: int) -> DataFrame:
    """For each bucket: every block's words with their totals over all blocks, and a row of the bucket's sums (block_id null)."""
    # a bucket's fair part twice over; what is left out is known by its greatest count (see frequent_words)
    share = -(-2 * most // buckets)

    def count(rows: pa.Table) -> pa.Table:
        index, words, total, sizes = _counted(rows)
        mine = np.split(total[index], np.cumsum(sizes)[:-1])
        seen = np.flatnonzero(total)
        own = total[seen]
        by_group = np.bincount(groups_of(words.take(pa.array(seen)), groups), own, minlength=groups).astype(np.int64)
        # words that may be among the first ``share``, and the greatest count after those
        low, rest = (int(x) for x in -np.partition(-own, [share - 1, share])[share - 1 : share + 1]) if len(own) > share else (1, 0)
        likely = seen[own >= low]
        # the order of equal counts must not depend on the order of the blocks
        top = sorted(zip((-total[likely]).tolist(), words.take(pa.array(likely)).to_pylist(), strict=True))[:share]
        n = len(mine)
        columns = [
            pa.array([*rows.column("block_id").to_pylist(), None], pa.int64()),
            pa.array([rows.column("bucket")[0].as_py()] * (n + 1), pa.int32()),
            pa.array([*(x.tobytes() for x in mine), None], pa.binary()),
            pa.array([None] * n + [int(total.sum())], pa.int64()),
            pa.array([None] * n + [len(seen)], pa.int64()),
            pa.array([None] * n + [by_group.tobytes()], pa.binary()),
            pa.array([None] * n + [[{"word": w, "c": -c} for c, w in top]], _TOP),
            pa.array([None] * n + [rest], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=[c.split(" ")[0] for c in _TOTALS.split(", ")][:6] + ["top", "rest"])

    rows = blocks.select("block_id", F.explode("words").alias("w")).select("block_id", "w.bucket", "w.words", "w.counts")
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, _TOTALS)


def frequent_words(blocks: DataFrame, totals: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words of the greatest counts of all (ties: the least word), however words fall into buckets.

    Buckets hand on their own most frequent words. A bucket whose first word left out
    could be among the ``most`` is counted again for all its words of such counts.
    """
    own = totals.filter("block_id is null")
    if not most:
        return []
    top = [(bytes(r["word"]), r["c"]) for r in own.select(F.explode("top").alias("t")).select("t.word", "t.c").orderBy(F.desc("c"), "word").limit(most).collect()]
    least = top[-1][1] if len(top) == most else 1
    short = [r["bucket"] for r in own.filter(F.col("rest") >= least).select("bucket").collect()]
    if not short:
        return top

    def again(rows: pa.Table) -> pa.Table:
        _, words, total, _ = _counted(rows)
        seen = np.flatnonzero(total >= least)
        return pa.table({"word": words.take(pa.array(seen)), "c": pa.array(total[seen])})

    more = _bucket_words(blocks).filter(F.col("bucket").isin(short)).groupBy("bucket").applyInArrow(again, "word binary, c long")
    known = own.filter(~F.col("bucket").isin(short)).select(F.explode("top").alias("t")).select("t.word", "t.c")
    return [(bytes(r["word"]), r["c"]) for r in known.unionByName(more).orderBy(F.desc("c"), "word").limit(most).collect()]


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[-3:]) % groups


#: What a byte does to a CRC-32.
_CRC = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)


def groups_of(words: pa.Array, groups: int) -> np.ndarray:
    """``group_of`` of each word."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    ends, at = offsets[1:], np.maximum(offsets[1:] - 3, offsets[:-1])
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for _ in range(3):
        crc = np.where(at < ends, _CRC[(crc & np.uint32(255)) ^ data[np.minimum(at, len(data) - 1)]] ^ (crc >> np.uint32(8)), crc)
        at = at + 1
    return (~crc).astype(np.int64) % groups


@dataclass
class Lexicon:
    """What all tasks need of the corpus counts; its size is fixed by MOST and GROUPS."""

    n: int
    v: int
    frequent: dict[bytes, int]
    counts: np.ndarray
    group_counts: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.frequent) + len(self.group_counts) + 1

    @classmethod
    def of(cls, blocks: DataFrame, totals: DataFrame, most: int, groups: int) -> Lexicon:
        sums = totals.filter("block_id is null").select("n", "v", "groups").collect()
        top = frequent_words(blocks, totals, most)
        words = [w for w, _ in top]
        counts = np.array([c for _, c in top], np.int64)
        group_counts = np.zeros(groups, np.int64)
        for r in sums:
            group_counts += np.frombuffer(bytes(r["groups"]), np.int64)
        if words:
            group_counts -= np.bincount([group_of(w, groups) for w in words], counts, minlength=groups).astype(np.int64)
        return cls(sum(r["n"] for r in sums), sum(r["v"] for r in sums), {w: i for i, w in enumerate(words)}, counts, group_counts)


_SYMBOLS = "block_id long, doc_ids array<long>, held binary, sizes binary, symbols binary, known binary, base binary, fixed binary"


def symbol_blocks(blocks: DataFrame, totals: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Blocks of symbols, with each document's known tokens, base score and state-free part of the score."""
    shared = blocks.sparkSession.sparkContext.broadcast(lexicon)

    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        lex: Lexicon = shared.value
        groups, first = len(lex.group_counts), len(lex.frequent)
        words = pa.concat_arrays([c.flatten().field("words").flatten() for c in block.column("words").chunks])
        # the block's words lie in the order of their buckets
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in totals.sort_by("bucket").column("counts").to_pylist()])
        found = pc.fill_null(pc.index_in(words, pa.array(list(lex.frequent), pa.binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbol = np.where(found >= 0, found, first + groups_of(words, groups))
        fixed = np.zeros(len(words))
        known = counts > 0
        in_group = (symbol >= first) & known
        fixed[in_group] = np.log10(counts[in_group] / lex.group_counts[symbol[in_group] - first])
        symbol[~known] = lex.symbols - 1
        fixed[~known] = -np.log10(lex.v + 1.0)  # an unseen word is one of as many as were seen
        base = np.log10((counts + 1.0) / (lex.n + lex.v + 1.0))
        symbol |= np.where(counts == 1, _SINGLE, 0)
        tokens, sizes = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in ("tokens", "sizes"))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        sums = [np.add.reduceat(x[tokens], starts).tobytes() for x in (known.astype(np.int64), base, fixed)]
        made = [pa.array([x], pa.binary()) for x in (symbol.astype(np.uint16)[tokens].tobytes(), *sums)]
        return pa.table([*(block.column(c) for c in ("block_id", "doc_ids", "held", "sizes")), *made], names=["block_id", "doc_ids", "held", "sizes", "symbols", "known", "base", "fixed"])

    # a task holds one block and its totals at a time
    back = totals.filter("block_id is not null").select("block_id", "bucket", "counts")
    return blocks.groupBy("block_id").cogroup(back.groupBy("block_id")).applyInArrow(run, _SYMBOLS)


@dataclass
class Model:
    """start: first token's states; again: a later piece's first states; step: transitions; emit: symbol rows by state."""

    start: np.ndarray
    again: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def fresh(cls, lexicon: Lexicon, states: int, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram(lexicon)[:, None] * np.exp(rng.normal(0, 1, (lexicon.symbols, states)))
        step = rng.random((states, states)) * 0.2 + np.eye(states) * 2 + 0.1
        even = np.full(states, 1 / states)
        return cls(even, even, step / step.sum(1, keepdims=True), emit / np.maximum(emit.sum(0), 1e-300))


def unigram(lexicon: Lexicon) -> np.ndarray:
    x = np.concatenate([lexicon.counts, lexicon.group_counts, [0]]).astype(float)
    return x / max(1.0, x.sum())


@dataclass
class Counts:
    """Expected counts of one partition."""

    start: np.ndarray
    again: np.ndarray
    step: np.ndarray
    single: np.ndarray
    emit: np.ndarray
    log: float

    @classmethod
    def zero(cls, model: Model) -> Counts:
        k = len(model.start)
        return cls(np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(model.emit.shape), 0.0)

    def add(self, model: Model, symbols: np.ndarray, sizes: np.ndarray, piece: int = PIECE, tokens: int = TOKENS) -> None:
        """Baum-Welch counts of whole texts, in pieces of ``piece`` tokens, of which as many go side by side as have ``tokens``."""
        many = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), many)
        part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        begin = (np.cumsum(sizes) - sizes)[text] + part * piece
        length = np.minimum(piece, sizes[text] - part * piece)
        order = np.argsort(-length, kind="stable")
        low, ends = 0, np.cumsum(length[order])
        while low < len(order):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + tokens, side="right")))
            own = order[low:high]
            self._lanes(model, symbols, begin[own], length[own], part[own] == 0)
            low = high

    def _lanes(self, model: Model, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray) -> None:
        """Tokens lie step by step, lane by lane, and states apart, so that each step's arithmetic runs along the lanes."""
        steps, k = int(length[0]), len(model.start)
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # lanes longer than t; lengths fall
        edges = np.concatenate([[0], np.cumsum(active)]).tolist()
        lane = np.arange(edges[-1]) - np.repeat(edges[:-1], active)
        raw = symbols[begin[lane] + np.repeat(np.arange(steps), active)]
        mark = (raw & (_SINGLE - 1)).astype(np.intp)
        out = np.take(np.ascontiguousarray(model.emit.T, np.float32), mark, axis=1)
        alpha, totals = np.empty_like(out), np.empty(out.shape[1], np.float32)
        onward, back = np.ascontiguousarray(model.step.T, np.float32), model.step.astype(np.float32)
        for t in range(steps):
            own = slice(edges[t], edges[t + 1])
            come = onward @ a[:, : active[t]] if t else np.where(first, model.start[:, None], model.again[:, None]).astype(np.float32)
            a, b, total = alpha[:, own], out[:, own], totals[own]
            np.multiply(come, b, out=a)
            np.add.reduce(a, 0, out=total)
            b /= total
            np.multiply(come, b, out=a)
        self.log += float(np.log10(totals, dtype=np.float64).sum())
        moves, beta = np.zeros((k, k)), np.ones((k, active[-1]), np.float32)
        for t in range(steps - 1, 0, -1):
            low, high, before = edges[t], edges[t + 1], edges[t - 1]
            alpha[:, low:high] *= beta
            ahead = out[:, low:high]
            ahead *= beta
            moves += alpha[:, before : before + high - low] @ ahead.T
            beta = np.ones((k, low - before), np.float32)
            beta[:, : high - low] = back @ ahead
        gamma = alpha
        gamma[:, : edges[1]] *= beta
        gamma /= gamma.sum(0)
        self.step += moves * model.step
        self.start += gamma[:, : edges[1]][:, first].sum(1, dtype=np.float64)
        self.again += gamma[:, : edges[1]][:, ~first].sum(1, dtype=np.float64)
        self.single += gamma[:, raw >= _SINGLE].sum(1, dtype=np.float64)
        for s in range(k):
            self.emit[:, s] += np.bincount(mark, gamma[s], minlength=len(self.emit))

    def rows(self) -> pa.RecordBatch:
        """The counts as rows (range, values): the emission rows in ranges of symbols, then all others."""
        parts = [x.ravel() for x in np.array_split(self.emit, _RANGES)]
        rest = np.concatenate([self.start, self.again, self.step.ravel(), self.single, [self.log]])
        return pa.RecordBatch.from_arrays([pa.array(range(_RANGES + 1), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in (*parts, rest)], pa.binary())], names=["part", "values"])

    @classmethod
    def of(cls, rows: dict[int, bytes], shape: tuple[int, int]) -> Counts:
        k = shape[1]
        emit = np.concatenate([np.frombuffer(rows[i]) for i in range(_RANGES)]).reshape(shape)
        rest = np.frombuffer(rows[_RANGES])
        return cls(rest[:k], rest[k : 2 * k], rest[2 * k : 2 * k + k * k].reshape(k, k), rest[-k - 1 : -1], emit, float(rest[-1]))

    def model(self, lexicon: Lexicon, smooth: float = 2.0) -> Model:
        """The next parameters, each distribution drawn slightly to the corpus's or the even one."""
        k = len(self.start)
        norm = lambda x: x / x.sum(-1, keepdims=True)
        usage = self.emit.sum(0)
        emit = (self.emit + smooth * unigram(lexicon)[:, None]) / (usage + smooth)
        unseen = (self.single + 1) / (usage + 2)  # the share of words seen once foretells that of unseen ones
        emit *= 1 - unseen
        emit[-1] = unseen
        return Model(norm(self.start + 0.1), norm(self.again + 0.1), norm(self.step + 0.1), emit.reshape(-1, k))


def train(symbols: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; only summed counts of fixed size come to the driver."""
    context = symbols.sparkSession.sparkContext
    model = Model.fresh(lexicon, states)
    for _ in range(rounds):
        shared = context.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            counts = Counts.zero(model)
            for batch in batches:
                for row in batch.to_pylist():
                    held, sizes = np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                    marks = np.frombuffer(row["symbols"], np.uint16)[np.repeat(~held, sizes)]
                    if len(marks):
                        counts.add(model, marks, sizes[~held])
            yield counts.rows()

        def total(rows: pa.Table) -> pa.Table:
            values = sum(np.frombuffer(x) for x in rows.column("values").to_pylist())
            return pa.table({"part": rows.column("part").slice(0, 1), "values": pa.array([values.tobytes()], pa.binary())})

        made = symbols.select("held", "sizes", "symbols").mapInArrow(expect, "part int, values binary")
        # summed in a tree, so that no group holds more than some TREE counts of a fixed size
        left = symbols.rdd.getNumPartitions()
        while left > TREE:
            left = -(-left // TREE)
            made = made.withColumn("slice", F.spark_partition_id() % left).groupBy("part", "slice").applyInArrow(total, "part int, values binary")
        summed = made.groupBy("part").applyInArrow(total, "part int, values binary").collect()
        if not summed:
            break
        model = Counts.of({r["part"]: bytes(r["values"]) for r in summed}, model.emit.shape).model(lexicon)
        shared.unpersist()
    return model


def log_likelihood(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text's symbols: the scaled forward recursion over all its tokens."""
    order = np.argsort(-sizes, kind="stable")
    begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    out = np.zeros(len(sizes))
    for low in range(0, len(order), LANES):
        own_begin, own_length = begin[low : low + LANES], length[low : low + LANES]
        active = np.searchsorted(-own_length, -np.arange(int(own_length[0])), side="left")
        logs, alpha = np.zeros(len(own_begin)), None
        for t, n in enumerate(active):
            b = model.emit[symbols[own_begin[:n] + t] & (_SINGLE - 1)]
            alpha = (model.start if t == 0 else alpha[:n] @ model.step) * b
            total = alpha.sum(1)
            logs[:n] += np.log10(total)
            alpha /= total[:, None]
        out[order[low : low + LANES]] = logs
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(symbols: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    shared = symbols.sparkSession.sparkContext.broadcast((lexicon.n, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, model = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                base, fixed = np.frombuffer(row["base"]), np.frombuffer(row["fixed"])
                own = log_likelihood(model, np.frombuffer(row["symbols"], np.uint16), sizes) + fixed if n else base
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.frombuffer(row["held"], bool)), pa.array(sizes), pa.array(np.frombuffer(row["known"], np.int64)), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return symbols.mapInArrow(run, _SCORES)


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, states: int = STATES, rounds: int = ROUNDS, most: int = MOST, groups: int = GROUPS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Base and model scores of every row, learned from the rows whose id's CRC-32 has another remainder.

    A null text is the empty text, whose only token is the end; a null id counts as
    the empty id; repeated rows count each time; other columns are ignored. Without
    any training row the score is the base score. An empty table gives no rows. For
    corpora of many terabytes take larger blocks: each sends a row to each bucket, of
    which there are as many as keep one to the words of BUCKET_BYTES of text.
    """
    if most + groups + 1 > _SINGLE:
        raise ValueError("more symbols than fit 15 bits")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(common.shuffle_width(docs.sparkSession), -(-total // BUCKET_BYTES))
    blocks = common.written(token_blocks(docs, modulus, remainder, buckets, block_bytes), "hmm-blocks")
    totals = common.written(word_totals(blocks, most, groups, buckets), "hmm-totals")
    lexicon = Lexicon.of(blocks, totals, most, groups)
    symbols = common.written(symbol_blocks(blocks, totals, lexicon), "hmm-symbols")
    common.discard(blocks, totals)
    model = train(symbols, lexicon, states, rounds) if lexicon.n else Model.fresh(lexicon, states)
    return score(symbols, lexicon, model)
