"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents of equal shingle sets are one node. Each tree of the forest is a prefix
trie of MinHash values, held as sorted keys. Neighbours in the tries' orders tell how
unlike linked nodes get; from DEPTH values, matched prefixes are shortened until a pair
as unlike as those meets in some tree with the target recall. Nodes below one prefix are
a bucket. Buckets that hang together are verified as a whole where that compares few more
pairs than the buckets hold, else each for itself, a pair in its first common tree. All pairs
of a block are compared exactly where its texts are, and only each node's link count
and a spanning set of links leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.999
#: Nodes of one block of a candidate group.
BLOCK = 256
#: A group of buckets is compared as a whole if it has no more pairs than this many times its buckets' own.
DENSE = 2.0
#: Likeness that neighbours' signatures may fall short of the threshold by and still tell of a pair at it.
MARGIN = 0.1
#: Candidates are broadcast up to this many bytes of ids, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20

_R = np.random.default_rng(5).integers(1, 2**63, (3, max(TREES * DEPTH, 8)), dtype=np.uint64) | np.uint64(1)
_A = (_R[0] >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_B = (_R[1] >> np.uint64(31)).astype(np.uint32)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingles of texts: runs of SHINGLE words (ASCII white space apart, A-Z lower-cased), or all words of fewer."""

    LIMIT = 400_000

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def _hash(self, word: bytes) -> int:
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        words, get = text.encode().lower().split(), self.known.get
        h = np.array([get(w) or self._hash(w) for w in words], np.uint64)
        size = min(self.size, len(h))
        if not size:
            return np.zeros(0, np.uint64)
        n = len(h) - size + 1
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = _mix(total + h[k : k + n])
        return np.unique(total)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of linear hashes of the shingles' upper halves."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 256):
        np.minimum(best, (x[low : low + 256, None] * _A + _B).min(axis=0), out=best)
    # the low bits of a linear hash are weak; minima are spread again before they are compared
    return (_mix(best.astype(np.uint64) + np.arange(len(best), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node binary, n_shingles, minima binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            nodes, sizes, minima = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                nodes.append(set_name(s))
                sizes.append(len(s))
                minima.append(minhash(s).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(minima, pa.binary())], names=["doc_id", "text_key", "node", "n_shingles", "minima"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, node binary, n_shingles long, minima binary")


def _members(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, key, id, near) of nodes that share a prefix of ``depth`` values with another: ``near`` is the one before in the trie's order.

    The first below a prefix has none.
    """
    keys = nodes.select("id", F.posexplode(F.array(*[F.substring("minima", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])).alias("tree", "key"))
    width = common.shuffle_width(nodes.sparkSession)
    # a prefix's keys lie together, in the order of the trie
    tries = keys.repartition(width, "tree", F.substring("key", 1, 4 * depth)).sortWithinPartitions("tree", "key", "id").select("tree", "key", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row, and whether it has the prefix of the one before

        def rows(own: pa.RecordBatch, more: bool) -> pa.RecordBatch:
            """Rows that share a prefix with a neighbour, but for the last if more follow."""
            nonlocal held, met
            ids = own.column("id").to_numpy()
            heads = np.column_stack([np.frombuffer(b"".join(own.column("key").to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)[:, : 4 * depth], own.column("tree").to_numpy().astype(np.uint8)])
            same = np.concatenate([[met], (heads[1:] == heads[:-1]).all(axis=1)])
            near = np.concatenate([[before], ids[:-1]])
            kept = same | np.concatenate([same[1:], [False]])
            if more:
                kept[-1], held, met = False, own.slice(len(ids) - 1), bool(same[-1])
            at = np.flatnonzero(kept)
            out = own.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(near[at], mask=~same[at])], names=["tree", "key", "id", "near"])

        before = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if held is None else pa.concat_batches([held, batch])
            out = rows(joined, True)
            if joined.num_rows > 1:
                before = joined.column("id")[-2].as_py()
            yield out
        if held is not None:
            yield rows(held, False)

    return common.written(tries.mapInArrow(walk, "tree int, key binary, id long, near long"), "near-members")


def least_likeness(members: DataFrame, nodes: DataFrame, threshold: float) -> float:
    """The least likeness, by signatures, of neighbours in some trie that may be linked; 1 if there are none."""
    pairs = members.filter("near is not null").select("near", "id").distinct()
    pairs = pairs.join(nodes.select(F.col("id").alias("near"), F.col("minima").alias("one")), "near").join(nodes.select("id", F.col("minima").alias("other")), "id")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH) for c in ("one", "other"))
            likeness = (one == other).mean(axis=1)
            likeness = likeness[likeness >= threshold - MARGIN]
            yield pa.RecordBatch.from_arrays([pa.array([likeness.min()] if len(likeness) else [], pa.float64())], names=["likeness"])

    found = pairs.select("one", "other").mapInArrow(agree, "likeness double").agg(F.min("likeness")).first()[0]
    return 1.0 if found is None else max(threshold, found)


def _buckets(members: DataFrame, depth: int) -> DataFrame:
    """(tree, first, id, n): each bucket's nodes, named by the least, and how many they are."""
    prefixed = members.select("tree", F.substring("key", 1, 4 * depth).alias("prefix"), "id")
    # written, as are others below, so that the join has two plain inputs, of which adaptive execution splits a hot key
    own = common.written(prefixed.groupBy("tree", "prefix").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "near-prefixes")
    buckets = common.written(prefixed.join(own, ["tree", "prefix"]).select("tree", "first", "id", "n"), "near-buckets")
    common.discard(own)
    return buckets


def _units(buckets: DataFrame) -> DataFrame:
    """(unit, tree, id, n): groups of nodes to be compared; tree is -1 for what hangs together as a whole."""
    edges = buckets.filter("first != id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    groups = common.written(common.components(edges, "near-candidates"), "near-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    # a bucket of n nodes has n rows of n
    own = buckets.join(groups, "id").groupBy("component").agg(F.sum(F.col("n").cast("double")).alias("pairs"))
    sizes = common.written(sizes.join(own, "component").withColumn("whole", (F.col("size") <= BLOCK) | (F.col("size").cast("double") * F.col("size") <= F.lit(DENSE) * F.col("pairs"))), "near-sizes")
    placed = groups.join(sizes, "component")
    whole = placed.filter("whole").select(F.col("component").alias("unit"), F.lit(-1).alias("tree"), "id", F.col("size").alias("n"))
    parts = buckets.join(placed.filter("not whole").select("id"), "id").select(F.col("first").alias("unit"), "tree", "id", "n")
    units = common.written(whole.unionByName(parts), "near-units")
    common.discard(groups, sizes)
    return units


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections: rare shingles pair by pair, common ones by matrix product."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] if len(flat) else column
    rare = (often > 1) & (often <= 12)
    c, r = column[rare], row[rare]
    for lag in range(1, 12):
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        out += np.bincount(r[:-lag][same] * n + r[lag:][same], minlength=n * n).reshape(n, n)
    c, r = column[often > 12], row[often > 12]
    if len(c):
        c = np.cumsum(np.concatenate([[True], c[1:] != c[:-1]])) - 1
        for low in range(0, int(c[-1]) + 1, 4096):
            here = slice(*np.searchsorted(c, [low, low + 4096]))
            dense = np.zeros((n, 4096), np.float32)
            dense[r[here], c[here] - low] = 1
            out += np.triu(dense @ dense.T, 1)
    return out + out.T


_LINKS = "id long, links long, root long"


def met_before(minima: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Which pairs share a prefix in a tree before ``tree``."""
    out = np.zeros((len(minima), len(minima)), bool)
    prefixes = minima.reshape(len(minima), TREES, DEPTH)[:, :, :depth]
    for t in range(tree):
        own = np.unique(prefixes[:, t], axis=0, return_inverse=True)[1].ravel()
        out |= own[:, None] == own
    return out


def _verify(threshold: float, depth: int):
    def verify(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, tree, one, other = (k.as_py() for k in key)
        shingle, seen, texts = Shingler(), set(), []
        for id_, block, copies, node, text in zip(*(rows.column(c).to_pylist() for c in ("id", "block", "copies", "node", "text")), strict=True):
            if id_ in seen:
                continue
            s = shingle(text)
            if set_name(s) == node:  # not another text of the same hash
                seen.add(id_)
                texts.append((id_, block, copies, s))
        texts.sort(key=lambda x: x[0])
        ids = np.array([t[0] for t in texts], np.int64)
        block = np.array([t[1] for t in texts], np.int64)
        copies = np.array([t[2] for t in texts], np.int64)
        sizes = np.array([len(t[3]) for t in texts], np.float64)
        both = intersections([t[3] for t in texts])
        linked = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
        np.fill_diagonal(linked, False)
        if one != other:
            linked &= block[:, None] != block
        if tree > 0:
            linked &= ~met_before(np.stack([minhash(t[3]) for t in texts]), tree, depth)
        links = linked @ copies
        # the least node each hangs together with here
        root = np.arange(len(ids))
        while True:
            near = np.where(linked, root, len(ids)).min(axis=1, initial=len(ids))
            least = np.minimum(root, near)
            least = least[least]
            if (least == root).all():
                break
            root = least
        return pa.table([pa.array(ids), pa.array(links), pa.array(ids[root])], names=["id", "links", "root"])

    return verify


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row of ``docs``.

    Documents whose shingle sets have a Jaccard likeness of the threshold or more are
    linked; a class is what links connect, named by its least doc_id. n_links counts
    the other rows that a row is linked to, n_copies those of an equal shingle set.
    Texts without words (null, empty, white space) have equal, empty sets and are
    copies of each other alone. Repeated rows and ids are rows of their own; a
    class of null ids alone has a null name; an empty table gives no rows; texts
    are taken whole at any length; other columns are ignored.
    """
    return _classified(docs, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without those whose class has a row with a smaller id (ties: smaller hash of the text).

    Of repeated rows one stays; all columns stay.
    """
    found = common.written(_classified(docs, threshold, recall).select("doc_id", "text_key", "component"), "near-found")
    first = common.written(found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "near-first")
    gone = common.written(found.join(first, "component").filter(~F.struct("doc_id", "text_key").eqNullSafe(F.col("first"))).select("doc_id", "text_key").distinct(), "near-gone")
    repeated = found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    key, id_, other = common.unused(docs.columns, "key", "id", "other")
    keyed = docs.withColumn(key, F.xxhash64(common.text_of()))
    few = gone.count() * 40 <= BROADCAST_BYTES
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(other))
    left = keyed.join(F.broadcast(gone) if few else gone, (F.col(other) == F.col(key)) & F.col(id_).eqNullSafe(F.col("doc_id")), "left_anti")
    return (left.dropDuplicates(["doc_id", key]) if repeated else left).drop(key)


def _texts(source: DataFrame, picked: DataFrame, repeated: bool) -> DataFrame:
    """``picked`` nodes with the text of one row each, which its id and its text's hash name."""
    homes = picked.select("*", F.col("home.doc_id").alias("home_id"), F.col("home.text_key").alias("home_key")).drop("home")
    few = homes.count() * 100 <= BROADCAST_BYTES
    found = source.withColumn("text_key", F.xxhash64("text"))
    if repeated:  # of equal rows one is enough
        found = found.join(homes.select("home_id", "home_key").distinct(), F.col("home_id").eqNullSafe(F.col("doc_id")) & (F.col("home_key") == F.col("text_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return found.join(F.broadcast(homes) if few else homes, F.col("home_id").eqNullSafe(F.col("doc_id")) & (F.col("home_key") == F.col("text_key")))


def _classified(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(doc_id, text_key, component, class_id, n_links, n_copies) of every row."""
    source = docs.select("doc_id", common.text_of())
    sets = common.written(_sets(source), "near-sets")
    names = sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("home"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    numbered = common.ranked(names, ["node"]).withColumnRenamed("rank", "id")
    nodes = common.written(names.join(numbered, "node"), "near-nodes")
    # one row a node: its least, as any row of the node has the same minima
    first = sets.filter("n_shingles > 0").join(nodes.select("node", "home", "id"), "node").filter(F.struct("doc_id", "text_key").eqNullSafe(F.col("home"))).select("id", "minima").dropDuplicates(["id"])
    repeated = sets.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    first = common.written(first, "near-minima")
    members = _members(first, prefix_depth(threshold, recall=recall))
    depth = prefix_depth(least_likeness(members, first, threshold), recall=recall)
    buckets = _buckets(members, depth)
    units = _units(buckets)

    known = nodes.select("id", "copies", "node", "home")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    picked = common.written(units.select("unit", "tree", "id", blocks).join(known, "id"), "near-picked")
    texts = _texts(source, picked, repeated).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = texts.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("unit", "tree", F.least("block", "peer").alias("one"), F.greatest("block", "peer").alias("other"), "id", "block", "copies", "node", "text")
    verified = common.written(dealt.groupBy("unit", "tree", "one", "other").applyInArrow(_verify(threshold, depth), _LINKS), "near-links")
    common.discard(first, members, buckets, units, picked)

    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    joined = common.components(verified.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")), "near-classes")
    classes = nodes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = common.written(classes.groupBy("component").agg(F.min("least").alias("class_id")), "near-least")
    known = classes.join(least, "component").join(links, "id", "left")
    known = known.select("node", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return sets.select("doc_id", "text_key", "node").join(known, "node").select("doc_id", "text_key", "component", "class_id", "n_links", "n_copies")


#: The same rows in DuckDB (ids unique and not null).
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s
    FROM words, LATERAL unnest(range(1, len(w) - least(5, len(w)) + 2)) u(i) WHERE len(w) > 0
),
sizes AS (SELECT w.doc_id, count(s.s) AS n FROM words w LEFT JOIN shingles s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b, s.n = x.n AND s.n = y.n AS equal FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
    WHERE s.n * 10 >= 8 * (x.n + y.n - s.n)
    UNION ALL SELECT x.doc_id, y.doc_id, TRUE FROM sizes x JOIN sizes y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE equal) AS n_copies FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, coalesce(n.n_copies, 0) AS n_copies FROM classes c LEFT JOIN counts n ON c.doc_id = n.doc_id
"""
