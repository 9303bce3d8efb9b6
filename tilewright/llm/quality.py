"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of PASSAGE bytes of its UTF-8 text). Every
passage is encoded from its bytes and words, gated attention weights the encoded
passages, and the weighted sum gives the document's score. Only document labels
train it: encoder, attention and output are fitted together on a bounded, hashed
sample of labelled rows; scoring is one Arrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

PASSAGE = 512
#: Most labelled ids whose passages fit the classifier (the least hashes of the ids).
SAMPLE = 3000
#: Most passages of one text that fit the classifier, evenly spaced; scoring takes all.
FIT_PASSAGES = 128
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12

#: Classes of bytes whose shares describe a passage.
_CLASSES = [
    [*range(97, 123)], [*range(65, 91)], [*range(48, 58)], [32], [10], [*range(128, 192)], [*range(192, 256)],
    [46], [44], [33, 63], [124], [60, 62, 47, 92, 123, 125, 91, 93], [64, 35, 36, 37, 38, 42, 95, 61, 43, 126], [58, 59], [34, 39, 40, 41], [45],
]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS[_bytes] = _i
_N_CLASSES = len(_CLASSES) + 1
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64)
_WORD_BINS = 64
N_FEATURES = _N_CLASSES + 8 + _WORD_BINS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and each text's first row (offsets, one more at the end).

    An empty text is one passage of zeros.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    rows = int(offsets[-1])
    out = np.zeros((rows, N_FEATURES), np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return out, offsets
    # even passages of each text, so that a short tail is not one of its own
    text_start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    which = np.repeat(np.arange(len(texts)), counts)
    part = np.arange(rows) - offsets[:-1][which]
    starts = text_start[which] + part * sizes[which] // counts[which]
    lengths = np.diff(np.append(starts, len(data)))
    passage = np.repeat(np.arange(rows), lengths)
    shares = np.bincount(passage * _N_CLASSES + _CLASS[data], minlength=rows * _N_CLASSES).reshape(rows, _N_CLASSES)
    size = np.maximum(lengths, 1)[:, None]
    out[:, :_N_CLASSES] = np.sqrt(shares / size)
    # words: begin after white space or at a passage's start
    space = _SPACE[data]
    begins = ~space & np.concatenate([[True], space[:-1] | (passage[1:] != passage[:-1])])
    at = np.flatnonzero(begins)
    extra = np.zeros((rows, 8), np.float64)
    if len(at):
        number = np.cumsum(begins) - 1
        inside = np.flatnonzero(~space)
        word = number[inside]
        place = np.minimum(inside - at[word], 63)
        hashes = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _RANDOM[place], np.searchsorted(inside, at))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        length = np.bincount(word, minlength=len(at))
        owner = passage[at]
        words = np.maximum(np.bincount(owner, minlength=rows), 1)
        mean = np.bincount(owner, length, minlength=rows) / words
        extra[:, 0] = np.log1p(mean)
        extra[:, 1] = np.log1p(np.maximum(np.bincount(owner, length.astype(float) ** 2, minlength=rows) / words - mean**2, 0))
        for k, lag in enumerate((1, 2, 3)):
            same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
            extra[:, 2 + k] = np.bincount(owner[lag:], same, minlength=rows) / words
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        extra[:, 5] = np.bincount(o, new, minlength=rows) / words
        bins = (hashes >> np.uint64(58)).astype(np.int64)
        spread = np.bincount(owner * _WORD_BINS + bins, minlength=rows * _WORD_BINS).reshape(rows, _WORD_BINS)
        out[:, _N_CLASSES + 8 :] = np.sqrt(spread / words[:, None])
    extra[:, 6] = np.log1p(lengths) / 10
    extra[:, 7] = np.log1p(sizes[which]) / 10
    out[:, _N_CLASSES : _N_CLASSES + 8] = extra
    return out, offsets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """h = tanh(xW + b); attention softmax(w . (tanh(hV) * sigmoid(hU))); score sigmoid(c . sum(a h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        n = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        weights = {"W": n(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, GATE), "U": n(HIDDEN, GATE), "w": n(GATE), "c": n(HIDDEN), "d": np.zeros(1)}
        return cls(x.mean(0), x.std(0) + 1e-3, weights)

    def forward(self, x: np.ndarray, offsets: np.ndarray):
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        bag = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        a = np.exp(e - np.maximum.reduceat(e, offsets[:-1])[bag])
        a /= np.add.reduceat(a, offsets[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, offsets[:-1])
        return x, h, t, g, bag, a, z, _sigmoid(z @ w["c"] + w["d"])

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(x, offsets)[-1]

    def gradients(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x, h, t, g, bag, a, z, p = self.forward(x, offsets)
        d = weight * (p - y) / weight.sum()
        dz = d[:, None] * w["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, offsets[:-1])[bag])
        dtg = de[:, None] * w["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "d": d.sum(keepdims=True)}


def fit(x: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = 12, seed: int = 11, decay: float = 1e-4) -> Model:
    """Adam over shuffled minibatches of bags; with one label only, the model scores its share everywhere."""
    model = Model.fresh(x, seed)
    if labels.min() == labels.max():
        for k in ("c", "d"):
            model.weights[k][:] = 0
        model.weights["d"][:] = 4 if labels[0] else -4
        return model
    rng, state, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}, 0
    batch = 32 if len(labels) < 2000 else 64
    epochs = max(epochs, min(60, 12_000 // max(1, len(labels) // batch) // 10))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            pick = order[low : low + batch]
            rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in pick])
            bags = np.concatenate([[0], np.cumsum(offsets[pick + 1] - offsets[pick])])
            step += 1
            for k, grad in model.gradients(x[rows], bags, labels[pick], np.ones(len(pick))).items():
                grad = grad + decay * model.weights[k] * (k not in "bd")
                m, v = state[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                model.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, offsets and labels of at most ``sample`` labelled ids outside the held-out fold, by least hash of the id.

    Conflicting labels of an id go by their mean; of several rows of an id the one of the least text hash counts.
    Executors encode the texts, so that only features of at most ``sample`` times FIT_PASSAGES passages reach the driver.
    """
    own = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    picked = own.filter(common.crc_mod("doc_id", held_out) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", common.text_of()).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column("text").to_pylist():
                x = passages([t.encode()])[0]
                made.append(x[np.unique(np.linspace(0, len(x) - 1, FIT_PASSAGES).astype(int))].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array(made, pa.binary())], names=["doc_id", "quality", "x"])

    # the order of partitions must not matter
    rows = sorted((r["doc_id"], bytes(r["x"]), r["quality"]) for r in texts.mapInArrow(encode, "doc_id long, quality int, x binary").collect())
    parts = [np.frombuffer(r[1], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)
    return x, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array([r[2] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE) -> Model | None:
    """The fitted model; None if no row is labelled."""
    x, offsets, marks = training_rows(docs, labels, held_out, sample)
    return fit(x, offsets, marks) if len(marks) else None


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) and the ``keep`` columns for every row.

    Scores come from texts alone. A null text is the empty text, which is scored as
    one passage of zeros; without a model every score is 0.5; equal texts have equal
    scores; rows are never dropped.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some kilobytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            scores = np.full(len(texts), 0.5)
            low = 0
            while model is not None and low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= 2_000_000):
                    size += len(texts[high])
                    high += 1
                x, offsets = passages([t.encode() for t in texts[low:high]])
                scores[low:high] = model.score(x, offsets)
                low = high
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    names = ["doc_id", *[c for c in keep if c not in ("doc_id", "score", "predicted")]]
    column = "text" if "text" in names else "__text"
    source = docs.select(*names, *([] if column == "text" else [F.col("text").alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return source.mapInArrow(run, f"{fields}, score double, predicted int")
