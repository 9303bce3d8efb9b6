"""Line dedup: a suffix array over line-number sequences by distributed prefix doubling.

Every line gets a rank among the repeated lines; a round turns the ranks of all
2^k-line prefixes into those of 2^(k+1)-line prefixes by ranking pairs with a
distributed sort. A position whose prefix occurs once leaves the array, as no longer
prefix of it can repeat; rounds end when no rank repeats. Equal ranks of a round are
an interval of the suffix array whose longest common prefix is 2^k lines at least. A
position that is the first of its interval in round k + 1 but not in round k repeats an
earlier one for 2^k lines or more, and less than 2^(k+1); intervals are then parted by
the ranks of the 2^j lines that follow, for falling j, down to the position's exact
longest common prefix with an earlier one. Those are the maximal repeated runs, and
later copies go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import common

MIN_LINES = 2
#: A line of so many words is a passage of its own.
LONG_WORDS = 50
#: A text, of equal ids by its hash, and a line of it; the order of places is that of the table.
_DOC = ["id", "text_key"]
_PLACE = [*_DOC, "pos"]


def _met_id() -> Column:
    """The id, or a stand-in for null that comes first, where ids must be equal to meet."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _place() -> Column:
    return F.struct(*_PLACE)


def _positions(docs: DataFrame, long_words: int | None) -> DataFrame:
    """(id, text_key, pos, long, h1, h2): a row for each line; equal rows of the table count once.

    Lines are named by 128 bits, so that unequal lines of any corpus differ.
    """
    lines = docs.select(_met_id().alias("id"), F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    rows = lines.select(*_DOC, F.posexplode("lines").alias("pos", "line"))
    long = F.lit(False) if long_words is None else F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= long_words
    rows = rows.select(*_PLACE, long.alias("long"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return rows.dropDuplicates(_PLACE)


def _ranked(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows whose key occurs more than once, with its rank, the first place of its interval and whether that is another."""
    # partial counts before the shuffle, so a line that is everywhere is one row a task
    keys = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(_place()).alias("head")).filter("n > 1").drop("n")
    ranks = common.ranked(keys, [*key, "head"])
    return common.written(rows.join(ranks, key).drop(*key).withColumn("later", _place() != F.col("head")), label)


def prefix_ranks(docs: DataFrame, long_words: int | None = None) -> list[DataFrame]:
    """Written tables (id, text_key, pos, long, rank, head, later), the k-th of positions whose 2^k-line prefix is repeated.

    Equal ranks are equal prefixes, and ranks follow their order. ``head`` is the first
    place of that rank. ``long`` tells lines of at least ``long_words`` words, on their own.
    """
    rows = common.written(_positions(docs, long_words), "line-positions")
    levels = [_ranked(rows, ["h1", "h2"], "line-ranks")]
    common.discard(rows)
    while not levels[-1].isEmpty():
        # no partner: the text ends, or the second half occurs once and so does the whole
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(1 << (len(levels) - 1), 1 << (len(levels) - 1))
        pairs = levels[-1].select(*_PLACE, F.lit(False).alias("long"), F.col("rank").alias("first"), F.max("rank").over(ahead).alias("next")).filter("next is not null")
        pairs = common.written(pairs, "line-pairs")
        levels.append(_ranked(pairs, ["first", "next"], "line-ranks"))
        common.discard(pairs)
    common.discard(levels.pop())
    return levels


def repeated_runs(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """(id, text_key, pos, length) of the places from which at least ``min_lines`` lines also start earlier, and how many at most do."""
    least = min_lines.bit_length() - 1
    if len(levels) <= least:
        return common.written(levels[0].select(*_PLACE, F.lit(0).alias("length")).limit(0), "line-runs") if levels else None
    # of a place: its last interval in which it is not the first, and those after, in which it stands for all that follow it
    marks = None
    for k in range(least, len(levels)):
        own = levels[k].select(*_PLACE, F.struct(F.lit(k).alias("level"), "later", "head").alias("mark"))
        marks = own if marks is None else marks.unionByName(own)
    last = F.coalesce(F.array_max(F.transform(F.filter("marks", lambda m: m["later"]), lambda m: m["level"])), F.lit(-1))
    marks = marks.groupBy(*_PLACE).agg(F.collect_list("mark").alias("marks"))
    marks = marks.select(*_PLACE, F.explode(F.filter("marks", lambda m: m["level"] >= last)).alias("m"))
    # a group: places with the first ``length`` lines of ``head`` in common, among them head
    items = marks.select(*_PLACE, "m.head", "m.level", F.expr("shiftleft(1, m.level)").alias("length"))
    items = common.written(items, "line-items")
    for j in range(len(levels) - 2, -1, -1):
        group = ["head", "level", "length"]
        part = items.filter(F.col("level") > j)
        follow = levels[j].select(*_DOC, F.col("pos").alias("at"), F.col("rank").alias("next"))
        part = common.written(part.withColumn("at", F.col("pos") + F.col("length")).join(follow, [*_DOC, "at"], "left").drop("at"), "line-next")
        heads = part.filter("next is not null").groupBy(*group, "next").agg(F.min(_place()).alias("sub"), F.count("*").alias("n")).filter("n > 1").drop("n")
        heads = common.written(heads, "line-heads")  # a plain input, so that adaptive execution can split a hot part
        met = part.filter("next is not null").join(heads, [*group, "next"], "left")
        longer = (F.col("length") + (1 << j)).alias("length")
        stays = F.struct("head", F.col("length").alias("length"))
        goes = F.struct(F.col("sub").alias("head"), longer)
        # the first of a part stays for the group's sake and leads the part
        ways = F.when(F.col("sub").isNull(), F.array(stays)).when(F.col("sub") == _place(), F.array(stays, goes)).otherwise(F.array(goes))
        moved = met.select(*_PLACE, "level", F.explode(ways).alias("w")).select(*_PLACE, "w.head", "level", "w.length")
        alone = part.filter("next is null").select(*_PLACE, "head", "level", "length")
        before, items = items, common.written(moved.unionByName(alone).unionByName(items.filter(F.col("level") <= j)), "line-items")
        common.discard(before, part, heads)
    runs = common.written(items.filter((F.col("head") != _place()) & (F.col("length") >= min_lines)).select(*_PLACE, "length"), "line-runs")
    common.discard(items)
    return runs


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The rows of ``docs`` with the text that is left, and n_lines, n_removed, n_runs, longest_run.

    A line is removed if it lies in a run of at least ``min_lines`` lines that also starts
    earlier, in a document with a smaller id or above in the same one; with
    ``long_words``, also if the line alone stands earlier and has at least that many
    words (parted by ASCII white space), whatever its neighbours. n_runs counts the
    maximal such runs (those that no run from the line before holds), longest_run is the
    longest's lines. Lines end at a line feed and compare exactly. A null text is the
    empty text: one empty line. Of equal (id, text) rows each gets the same result; null
    ids come first; equal ids go by a hash of the text. An empty table gives no rows; a
    text or a line of any length is taken whole. n_chars, if there, is set anew; other
    columns stay, but for those that carry the names of results, which are replaced.
    """
    results = ("n_lines", "n_removed", "n_runs", "longest_run")
    keep = [c for c in docs.columns if c not in (*results, "text", "n_chars")]
    source = docs.select(*keep, common.text_of())
    levels = prefix_ranks(source.select("doc_id", "text"), long_words)
    starts = repeated_runs(levels, min_lines)
    if long_words is not None and min_lines > 1 and levels:
        alone = common.written(levels[0].filter("later and long").select(*_PLACE, F.lit(1).alias("length")), "line-runs")
        starts = starts.unionByName(alone)
    common.discard(*levels)
    empty = docs.sparkSession.createDataFrame([], "__id long, __text_key long, __starts array<struct<pos: int, length: int>>")
    gone = starts.groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "length")).alias("__starts")).withColumnsRenamed({"id": "__id", "text_key": "__text_key"}) if levels else empty  # at most a document's own lines
    joined = source.withColumn("__text_key", F.xxhash64("text")).withColumn("__id", _met_id()).join(gone, ["__id", "__text_key"], "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + ["n_chars long"] * ("n_chars" in docs.columns) + ["n_lines long", "n_removed long", "n_runs long", "longest_run long"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, begins in zip(batch.column("text").to_pylist(), batch.column("__starts").to_pylist(), strict=True):
                lines, removed, runs, longest = text.split("\n"), 0, 0, 0
                if begins:
                    cover = np.zeros(len(lines) + 1, np.int64)
                    at, length = np.array([(b["pos"], b["length"]) for b in begins], np.int64).T
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    most = np.zeros(len(lines) + 1, np.int64)
                    np.maximum.at(most, at + 1, length)
                    removed, runs, longest = int(covered.sum()), int((most[1:] > np.maximum(most[:-1] - 1, 0)).sum()), int(length.max())
                    total = len(lines)
                    lines = [lines[i] for i in np.flatnonzero(~covered)]
                else:
                    total = len(lines)
                left = "\n".join(lines)
                for column, value in zip(out, (left, len(left), total, removed, runs, longest), strict=True):
                    column.append(value)
            columns = [batch.column(c) for c in keep] + [pa.array(out[0], pa.string())]
            if sets_chars:
                columns.append(pa.array(out[1], pa.int64()))
            columns += [pa.array(c, pa.int64()) for c in out[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    sets_chars = "n_chars" in docs.columns
    names = [*keep, "text", *["n_chars"] * sets_chars, *results]
    return joined.select(*keep, "text", "__starts").mapInArrow(cut, ", ".join(fields))


def report(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows for MIN_LINES and LONG_WORDS in DuckDB.
ORACLE = r"""
WITH lines AS (
    SELECT doc_id, u.pos - 1 AS pos, l[u.pos] AS line, len(l) AS n_lines
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, LATERAL unnest(range(1, len(l) + 1)) u(pos)
),
pairs AS (
    SELECT b.doc_id, b.pos, a.doc_id AS one, b.pos - a.pos AS shift
    FROM lines a JOIN lines b ON a.line = b.line AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, one, shift ORDER BY pos) AS island FROM pairs),
matches AS (SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id, one, shift, island) - pos + 1 AS length FROM islands),
longest AS (SELECT doc_id, pos, max(length) AS length FROM matches GROUP BY doc_id, pos),
starts AS (
    SELECT m.doc_id, m.pos, m.length FROM longest m JOIN lines l ON m.doc_id = l.doc_id AND m.pos = l.pos
    WHERE m.length >= 2 OR len(list_filter(regexp_split_to_array(l.line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 50
),
per AS (
    SELECT s.doc_id, count(*) FILTER (WHERE s.length > coalesce(b.length, 1) - 1) AS n_runs, max(s.length) AS longest_run
    FROM starts s LEFT JOIN starts b ON s.doc_id = b.doc_id AND s.pos = b.pos + 1 GROUP BY s.doc_id
),
gone AS (SELECT DISTINCT doc_id, pos + u.k AS pos FROM starts, LATERAL unnest(range(0, length)) u(k)),
kept AS (
    SELECT l.doc_id, any_value(l.n_lines) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT k.doc_id, CAST(n_lines AS BIGINT) AS n_lines, n_removed, coalesce(n_runs, 0) AS n_runs,
       CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(k.text) AS kept_sha256
FROM kept k LEFT JOIN per p ON k.doc_id = p.doc_id
"""
