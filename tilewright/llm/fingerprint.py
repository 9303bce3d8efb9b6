"""Document fingerprints from prefix polynomial hashes.

A text is held as two modular prefix arrays, so the hash of any span of code
points is one subtraction and one product; span equality is two comparisons and
the longest common extension of two positions is a binary search over spans.
The fingerprint keeps the smallest span hash of each of ``BINS`` hash ranges
(one-permutation MinHash over all spans of ``SPAN`` code points), which makes the
likeness of two fingerprints an estimate of the Jaccard likeness of their spans.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

#: Prime moduli below 2**31 and their bases: products stay within 64 bits.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 16
BINS = 64
_EMPTY = np.uint32(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown by doubling."""
    p, b = MODULI[which], BASES[which]
    fore, back = _powers.get(which, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    inverse = pow(b, p - 2, p)
    while len(fore) < size:
        n = len(fore)
        fore = np.concatenate([fore, fore * np.uint64(pow(b, n, p)) % np.uint64(p)])
        back = np.concatenate([back, back * np.uint64(pow(inverse, n, p)) % np.uint64(p)])
    _powers[which] = fore, back
    return fore, back


class PrefixHashes:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix, self.back = [], []
        for which, p in enumerate(MODULI):
            fore, back = _power_table(which, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            # each term is below 2**31, so 2**33 terms fit before the sum wraps
            np.cumsum(points * fore[: self.n] % np.uint64(p), out=sums[1:])
            self.prefix.append(sums % np.uint64(p))
            self.back.append(back)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of text[start:end], independent of its position."""
        return tuple((int(s[end]) - int(s[start])) % p * int(b[start]) % p for s, b, p in zip(self.prefix, self.back, MODULI, strict=True))

    def equal(self, start: int, end: int, other: PrefixHashes, at: int) -> bool:
        return at + end - start <= other.n and self.span(start, end) == other.span(at, at + end - start)

    def extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common extension of two positions."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start + low, start + mid) == other.span(at + low, at + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of ``length`` (of the whole text if it is shorter): 31 bits of each modulus, so equal ones are equal spans."""
        length = min(length, self.n)
        if not length:
            return np.zeros(0, np.uint64)
        out = np.zeros(self.n + 1 - length, np.uint64)
        for s, b, p in zip(self.prefix, self.back, map(np.uint64, MODULI), strict=True):
            out = (out << np.uint64(31)) | (s[length:] + p - s[:-length]) * b[: self.n + 1 - length] % p
        return out


def sketch(hashes: PrefixHashes) -> np.ndarray:
    """The least mixed span hash in each of BINS equal ranges, all ones where a range is empty."""
    mixed = hashes.spans(SPAN) * _MIX
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX2
    values = np.sort((mixed >> np.uint64(32)).astype(np.uint32))
    edges = (np.arange(BINS + 1, dtype=np.uint64) << np.uint64(26)).clip(max=0xFFFFFFFF).astype(np.uint32)
    at = np.searchsorted(values, edges)
    out = np.full(BINS, _EMPTY, np.uint32)
    full = at[:-1] < at[1:]
    out[full] = values[at[:-1][full]]
    return out


def render(hashes: PrefixHashes, bins: np.ndarray) -> str:
    """Whole-text hash, then 16 bits a bin (all ones: empty)."""
    whole = "".join(f"{x:08x}" for x in hashes.span(0, hashes.n))
    short = ((bins >> np.uint32(10)) & np.uint32(0xFFFF)).astype(np.uint16)
    short[(short == 0xFFFF) & (bins != _EMPTY)] = 0xFFFE
    short[bins == _EMPTY] = 0xFFFF
    return f"{hashes.n:x}:{whole}:{short.astype('>u2').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints' spans, 0 to 1; equal fingerprints have 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(":")[2]), ">u2") for f in (a, b))
    either = (x != 0xFFFF) | (y != 0xFFFF)
    return float(((x == y) & either).sum() / max(1, either.sum()))


def fingerprint(text: str) -> tuple[PrefixHashes, str]:
    hashes = PrefixHashes(text)
    return hashes, render(hashes, sketch(hashes))


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the falling ``cuts`` are not below ``key``: a binary search as a fold over a literal array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        above = F.get(table, middle) >= key
        open_ = span["low"] < span["high"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(span["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(span["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda span: span["low"])


def _neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, marker, doc_id, text), so that sorting a bucket by (doc_id desc, text) puts each document before its next.

    A marker row repeats the first document of the following bucket at a bucket's end.
    Only cut points and one id per bucket reach the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = docs.select("doc_id", common.text_of(), key.alias("key"))
    cuts = docs.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10000).alias("q")).first()["q"] if buckets > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    docs = docs.withColumn("bucket", _place(F.col("key"), cuts))
    firsts = {r["bucket"]: r["key"] for r in docs.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    order = sorted(firsts)
    if not order:
        return docs.withColumn("marker", F.lit(0))
    # the bucket whose end needs a copy of this bucket's first document; the first bucket's goes to the last
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = spark.createDataFrame([(b, firsts[b], before[b]) for b in order], "bucket int, key long, before int")
    # of documents that share the greatest id, the least text is first
    markers = (
        docs.join(F.broadcast(heads), ["bucket", "key"])
        .groupBy("bucket", "before", "key")
        .agg(F.min(F.struct("text", "doc_id")).alias("m"))
        .select("m.doc_id", "m.text", "key", F.col("before").alias("bucket"), F.lit(1).alias("marker"))
    )
    return docs.withColumn("marker", F.lit(0)).unionByName(markers)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_extension long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        rows = []
        for bucket, marker, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "marker", "doc_id", "text")), strict=True):
            hashes, print_ = fingerprint(text)
            if last is not None and last[0] == bucket:
                _, before_id, before, before_hashes, before_print = last
                k = len(before) // 2
                edited = before[: len(before) - k] + text[:k]
                edited_hashes, edited_print = fingerprint(edited)
                rows.append((before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), before_print, edited_print, likeness(before_print, edited_print), likeness(before_print, print_), before_hashes.extension(0, edited_hashes, 0)))
            last = None if marker else (bucket, doc_id, text, hashes, print_)
        if rows:
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprint_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, and compare them and the next document's.

    The next document is the one with the next smaller doc_id; the last one's is
    the first. Null texts are empty, a null doc_id sorts last, equal ids go by text
    (the first of a bucket is the least text), a single document follows itself, an
    empty table gives no rows, other columns are ignored.
    """
    buckets = buckets or common.shuffle_width(docs.sparkSession)
    rows = _neighbours(docs.select("doc_id", "text"), buckets)
    # a bucket a task: hashing would put several together, and more of them the more there are
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "marker", F.desc("key"), "text").select("bucket", "marker", "doc_id", "text").mapInArrow(_compare, _SCHEMA)
