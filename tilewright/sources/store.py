"""The feature store: a parquet table of records with checked schema and lengths, commits and an index."""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.config import StoreConfig
from tilewright.operators import report, search
from tilewright.schemas import NUCLEUS_RECORD

#: Where files that slides share are. Not hidden, so that a reader of the whole folder gets an error and not some of the slides.
_SHARED = "shared/"


class FeatureStore:
    """Records foldered by slide, so that a slide's query prunes to its folder; scores sort within files for skipping.

    A batch of more than ``folders`` slides is not foldered, as a file or more a slide would each be moved and listed: its slides share files of
    ranges of (slide, score), and a slide's query skips by the bounds in them. A write of folders stages its files and moves them into place, one of
    ranges writes a folder of its own; either then names its files in a commit, a file of its own that appears at
    once; readers see the files of commits alone, so what a failed write leaves is never read. A commit has the name of its batch, and a batch
    that was committed is not written again. ``create_index`` keeps a copy foldered by the nearest of ``lists`` centroids
    beside the table, which searches of ``probes`` lists read instead of all records; files that came since are searched whole.
    """

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _exists(self, path: str) -> bool:
        files, place = self._place(path)
        return files.exists(place)

    def create(self) -> None:
        """Make the table if there is none; an existing one must have the record schema."""
        if not self._exists(self.path):
            # a table foldered by slide has no files as long as it has no rows; readers pass over names with an underscore
            self.spark.createDataFrame([(NUCLEUS_RECORD.json(),)], "schema string").coalesce(1).write.text(f"{self.path}/_schema")
            return
        if self._exists(f"{self.path}/_schema"):
            schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/_schema").first()[0]))
        else:
            schema = self.spark.read.parquet(self.path).schema
        found = {f.name: f.dataType.simpleString() for f in schema}
        wanted = {f.name: f.dataType.simpleString() for f in NUCLEUS_RECORD.fields}
        if found != wanted:
            raise ValueError(f"{self.path} holds other columns: {sorted(set(found.items()) ^ set(wanted.items()))}")

    # -- commits

    def _read_json(self, path: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def _write_json(self, path: str, content: dict) -> bool:
        """Whether ``content`` is at ``path`` now, whole, and was not before."""
        files, own = self._place(f"{path}.{uuid.uuid4().hex}.new")
        files.mkdirs(own.getParent())
        out = files.create(own)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        final = self._place(path)[1]
        if not files.exists(final) and files.rename(own, final):
            return True
        files.delete(own, False)
        return False

    def commits(self) -> list[dict]:
        """What was written, in order: batch, rows, added and removed files (relative to the table)."""
        files, folder = self._place(f"{self.path}/_commits")
        if not files.exists(folder):
            return []
        names = [str(s.getPath()) for s in files.listStatus(folder) if str(s.getPath()).endswith(".json")]
        return sorted((self._read_json(n) for n in names), key=lambda c: (c["time"], c["batch"]))

    def _found(self, folder: str) -> list[str]:
        """Parquet files below a folder, relative to it."""
        files, root = self._place(folder)
        out = []
        for status in files.listStatus(root) if files.exists(root) else ():
            name = status.getPath().getName()
            if status.isDirectory() and "=" in name:
                out += [f"{name}/{s.getPath().getName()}" for s in files.listStatus(status.getPath()) if s.getPath().getName().endswith(".parquet")]
        return sorted(out)

    def _files(self) -> list[str]:
        """Files that readers see."""
        live: dict[str, None] = {}
        for commit in self.commits():
            for f in commit["removed"]:
                live.pop(f, None)
            live |= dict.fromkeys(commit["added"])
        return list(live)

    def _of(self, names: list[str]) -> DataFrame:
        """Records of files, each with its ``source_file`` (see _source)."""
        file, reader, parts = F.col("_metadata.file_name"), self.spark.read.schema(NUCLEUS_RECORD), []
        if shared := [n for n in names if _slide(n) is None]:
            parts.append(reader.parquet(*[f"{self.path}/{n}" for n in shared]).select(*NUCLEUS_RECORD.names, file.alias("source_file")))
        if own := [n for n in names if _slide(n) is not None]:
            rows = reader.option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in own])
            parts.append(rows.select(*NUCLEUS_RECORD.names, F.concat_ws("/", "wsi_name", file).alias("source_file")))
        if not parts:
            return self.spark.createDataFrame([], NUCLEUS_RECORD).withColumn("source_file", F.lit(None).cast("string"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _commit(self, rows: DataFrame, batch: str | None, removed: list[str], moved: int = 0) -> int:
        """Write ``rows`` and make them visible, and ``removed`` files invisible, at once; the number of rows without the ``moved`` ones of those files."""
        batch, seen = uuid.uuid4().hex if batch is None else batch, Observation("inserted")
        many = rows.select("wsi_name").distinct().limit(self.config.folders + 1).count() > self.config.folders
        # ranges of (slide, score), so that a large slide is spread over tasks and a task's files over few slides
        ranges = rows.repartitionByRange("wsi_name", F.desc("abnormality_score")).sortWithinPartitions("wsi_name", F.desc("abnormality_score"))
        # observed after the ranges, as what lies before them also runs to find their bounds
        write = ranges.observe(seen, F.count(F.lit(1)).alias("n")).write
        added = self._write_shared(write) if many else self._write_folders(write)
        count = int(seen.get["n"]) - moved
        if not self._write_json(f"{self.path}/_commits/{quote(batch, safe='')}.json", {"batch": batch, "time": time.time_ns(), "rows": count, "added": added, "removed": removed}):
            for name in added:  # another writer was first with this batch
                files, place = self._place(f"{self.path}/{name}")
                files.delete(place, False)
        return count

    def _write_shared(self, write: DataFrameWriter) -> list[str]:
        """The files of a write whose slides share them, in a folder of its own where they stay."""
        folder = f"{_SHARED}{uuid.uuid4().hex}"
        files, place = self._place(f"{self.path}/{folder}")
        files.mkdirs(self._place(f"{self.path}/_commits")[1])  # a table that has commits is not read whole, whatever becomes of this one
        write.parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def _write_folders(self, write: DataFrameWriter) -> list[str]:
        """The files of a write with a folder a slide."""
        staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        write.partitionBy("wsi_name").parquet(staging)
        files, root = self._place(staging)
        added = self._found(staging)
        for name in added:
            target = self._place(f"{self.path}/{name}")[1]
            files.mkdirs(target.getParent())
            if not files.rename(self._place(f"{staging}/{name}")[1], target):
                raise OSError(f"cannot move {name} into {self.path}")
        files.delete(root, True)
        return added

    def _checked(self, records: DataFrame) -> DataFrame:
        bad = report.overlong(records).select("record_id").unionByName(records.filter(F.size("feature_vector") != self.config.dim).select("record_id"))
        named = [r["record_id"] for r in bad.limit(10).collect()]
        if named:
            raise ValueError(f"records that do not fit: {named}")
        return records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NUCLEUS_RECORD.fields])

    def _done(self, batch: str | None) -> int | None:
        """Rows of a batch that was committed before."""
        if not self._exists(f"{self.path}/_commits") and (before := self._found(self.path)):
            # a table of before there were commits
            self._write_json(f"{self.path}/_commits/first.json", {"batch": "first", "time": 0, "rows": -1, "added": before, "removed": []})
        path = f"{self.path}/_commits/{quote(batch, safe='')}.json" if batch is not None else ""
        return self._read_json(path)["rows"] if path and self._exists(path) else None

    def insert(self, records: DataFrame, batch: str | None = None) -> int:
        """Append records and return how many; overlong strings or vectors of another length are refused with their rows' ids.

        A ``batch`` is written once, however often it is tried. Rows of a record_id that is there stay beside the new one; see ``upsert``.
        """
        done = self._done(batch)
        return done if done is not None else self._commit(self._checked(records), batch, [])

    def upsert(self, records: DataFrame, batch: str | None = None) -> int:
        """Insert records in place of those of the same record_id; of equal ids within ``records`` the highest score stays.

        Only files that hold such a record are written anew, with their other rows, in the same commit.
        """
        done = self._done(batch)
        if done is not None:
            return done
        first = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("abnormality_score"), F.xxhash64(*NUCLEUS_RECORD.names)))
        rows = self._checked(records).withColumn("__first", first).filter("__first = 1").drop("__first")
        ids, live = rows.select("record_id"), self._files()
        places = self._of(live).select("record_id", "source_file") if live else None
        touched = {r["source_file"] for r in places.join(ids, "record_id", "left_semi").select("source_file").distinct().collect()} if live else set()
        removed = [n for n in live if _source(n) in touched]
        kept = self._of(removed).join(ids, "record_id", "left_anti").select(*NUCLEUS_RECORD.names)
        before = kept.count() if removed else 0
        return self._commit(rows.unionByName(kept) if removed else rows, batch, removed, before)

    def insert_stream(self, batch: DataFrame, number: int, stream: str = "stream") -> None:
        """For ``writeStream.foreachBatch``: a batch that a restarted stream brings again is not written again."""
        self.insert(batch, f"{stream}-{number}")

    def records(self) -> DataFrame:
        if not self._exists(f"{self.path}/_commits"):
            return self.spark.read.schema(NUCLEUS_RECORD).parquet(self.path).select(*NUCLEUS_RECORD.names)
        return self._of(self._files()).select(*NUCLEUS_RECORD.names)

    # -- index

    def create_index(self, sample: int = 50_000, lists: int | None = None) -> None:
        """Centroids of a bounded sample (the least hashes of record_id), and every record in the folder of its nearest."""
        live = self._files() or self._found(self.path)
        rows = self._of(live)
        centres = search.coarse_centroids(rows, lists or self.config.lists, sample)
        table = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(table, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}.centres")
        self._fill_lists(live, centres, "overwrite")
        self._note(live, rows.count())

    def _fill_lists(self, names: list[str], centres: np.ndarray, mode: str) -> None:
        search.index_lists(self._of(names), centres).repartitionByRange("list", "record_id").write.mode(mode).partitionBy("list").parquet(f"{self.path}.lists")

    def _note(self, names: list[str], rows: int) -> None:
        files, own = self._place(f"{self.path}.indexed")
        files.delete(own, False)
        self._write_json(f"{self.path}.indexed", {"files": names, "rows": rows})

    def refresh_index(self) -> None:
        """Put what came since into the lists; a table of four times its size at the last build is built anew, with twice the lists."""
        if not self._exists(f"{self.path}.indexed"):
            self.create_index()
            return
        note, live = self._read_json(f"{self.path}.indexed"), self._files()
        centres = self._index()[1]
        if self.records().count() >= 4 * max(1, note["rows"]):
            self.create_index(lists=2 * len(centres))
            return
        known = set(note["files"])
        if fresh := [n for n in live if n not in known]:
            self._fill_lists(fresh, centres, "append")
            self._note(note["files"] + fresh, note["rows"])

    def _index(self) -> tuple[DataFrame, np.ndarray] | None:
        """The lists' rows that are still live, and the centroids."""
        if not self._exists(f"{self.path}.centres"):
            return None
        centres = np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}.centres").orderBy("list").collect()])
        lists = self.spark.read.parquet(f"{self.path}.lists")
        live = set(self._files())
        gone = [(_source(n),) for n in self._read_json(f"{self.path}.indexed")["files"] if live and n not in live]
        if gone:
            lists = lists.join(self.spark.createDataFrame(gone, "source_file string"), "source_file", "left_anti")
        return lists.drop("source_file"), centres.reshape(len(centres), self.config.dim)

    def _unindexed(self) -> DataFrame | None:
        known = set(self._read_json(f"{self.path}.indexed")["files"])
        fresh = [n for n in self._files() if n not in known]
        return self._of(fresh).select(*NUCLEUS_RECORD.names) if fresh else None

    def query_abnormal(self, min_score: float = 0.6, wsi_name: str = "", limit: int | None = None) -> DataFrame:
        return search.query_abnormal(self.records(), min_score, wsi_name, limit or self.config.limit)

    def search_similar(self, vector, top_k: int | None = None, wsi_name: str = "", exact: bool = True) -> DataFrame:
        """The most similar records: of all, or with ``exact=False`` of the index's ``probes`` nearest lists and of all that came since."""
        where = F.col("wsi_name") == F.lit(wsi_name) if wsi_name else None
        index, k = None if exact else self._index(), top_k or self.config.top_k
        if index is None:
            return search.search_similar(self.records(), vector, k, where)
        indexed, centres = index
        found = search.search_lists(indexed, centres, vector, self.config.probes, k, where=where).drop("list")
        fresh = self._unindexed()
        if fresh is None:
            return found
        return found.unionByName(search.search_similar(fresh, vector, k, where)).orderBy(F.desc("distance"), "record_id").limit(k)

    def recall(self, queries: DataFrame, top_k: int | None = None) -> float:
        """Mean share of the exact ``top_k`` of each query record that the index finds."""
        indexed, centres = self._index()
        k = top_k or self.config.top_k
        found = search.search_lists_each(indexed, centres, queries, self.config.probes, k).select("query_id", "record_id")
        every = search.search_lists_each(indexed, centres, queries, len(centres), k).select("query_id", "record_id")
        hits = found.join(every, ["query_id", "record_id"], "left_semi").count()
        return hits / max(1, every.count())


def _slide(name: str) -> str | None:
    """The slide of a file's folder; None where slides share the file."""
    return None if name.startswith(_SHARED) else unquote(name.split("/", 1)[0].split("=", 1)[1])


def _source(name: str) -> str:
    """What tells a file's records from others: its name, which tells the write, with the slide where one write gives each slide files."""
    slide, file = _slide(name), name.rsplit("/", 1)[1]
    return file if slide is None else f"{slide}/{file}"
