"""Service calls as functions: each returns a DataFrame or a count."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import EngineConfig
from tilewright.operators import jobs, report
from tilewright.plans import pipeline
from tilewright.sources import slides, tiff
from tilewright.sources.store import FeatureStore


class Engine:
    """A session with a folder of slides, a task log (parquet of TASK rows) and a feature store."""

    def __init__(self, spark: SparkSession, uploads: str, log: str, store: str, config: EngineConfig = EngineConfig()):
        self.spark, self.uploads, self.log, self.config = spark, uploads, log, config
        self.store = FeatureStore(spark, store, config.store)

    def ingest_slides(self) -> DataFrame:
        """Admitted uploads with a suffix and a size within bounds."""
        listing = slides.list_files(self.spark, self.uploads, ("*",))
        return slides.admissible(listing, self.config.ingest.suffixes, self.config.ingest.max_bytes)

    def _tasks(self) -> DataFrame:
        return self.spark.read.parquet(self.log)

    def list_tasks(self, limit: int = 50) -> DataFrame:
        latest = jobs.task_status(self._tasks())
        return jobs.list_tasks(latest.filter("state = 'PROGRESS'").select("task_id"), latest.filter("state = 'PENDING'").select("task_id"), limit)

    def task_status(self, task_id: str) -> DataFrame:
        return jobs.task_status(self._tasks().filter(F.col("task_id") == task_id)).withColumn("state", jobs.state_name())

    def run_metadata(self, task_id: str) -> DataFrame:
        return self._tasks().filter(F.col("task_id") == task_id)

    def result_paths(self, folder: str) -> DataFrame:
        return slides.find_result(self.spark, folder)

    def cancel(self, task_id: str) -> None:
        """Stop the jobs that run under the task's tag, in whatever thread."""
        self.spark.sparkContext.cancelJobsWithTag(task_id)

    @contextmanager
    def running(self, task_id: str) -> Iterator[None]:
        """Jobs of this thread belong to the task meanwhile, so that it can be cancelled."""
        context = self.spark.sparkContext
        context.addJobTag(task_id)
        try:
            yield
        finally:
            context.removeJobTag(task_id)

    def system_info(self) -> DataFrame:
        g = self.config.grid
        settings = {"tile_size": str(g.tile_size), "overlap": str(g.overlap), "scale": str(g.scale), "suffixes": ",".join(self.config.ingest.suffixes), "cores": str(self.spark.sparkContext.defaultParallelism)}
        return self.spark.createDataFrame(list(settings.items()), "setting string, value string")

    def slide_path(self, slide: str) -> str:
        """An admitted upload by its path or by its name without the suffix; FileNotFoundError if there is none."""
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        found = self.ingest_slides().filter((stem == slide) | F.col("path").isin(slide, f"file:{slide}", f"file://{slide}")).orderBy("path").select("path").first()
        if found is None:
            raise FileNotFoundError(slide)
        return found["path"].removeprefix("file://").removeprefix("file:")

    def process_slide(self, slide: DataFrame | str, model=None, block: int = 2048) -> DataFrame:
        """Blended blocks of a slide's upscaled image: of a table of tiles, or of an upload by name or path."""
        if isinstance(slide, str):
            return pipeline.process_file(self.spark, self.slide_path(slide), model, self.config, block)[0]
        return pipeline.process_slide(slide, model, self.config, block)

    def export_slide(self, slide: str, target: str, model=None, block: int = 2048, levels: int = 4, compression: str = "deflate") -> int:
        """Process an upload and write the result as one pyramid file; its number of bytes."""
        blocks, (w, h), mpp = pipeline.process_file(self.spark, self.slide_path(slide), model, self.config, block)
        return tiff.write_pyramid(pipeline.block_tiles(blocks, w, h, block), target, w, h, block, levels, mpp, compression)

    def screen(self, tiles: DataFrame, task_id: str, detector=None, keep: bool = True, dedup: bool | str = False) -> DataFrame:
        """Scored objects; the abnormal ones go to the store if ``keep``."""
        found = pipeline.screen(tiles, detector, self.config, dedup).withColumn("task_id", F.lit(task_id))
        if keep:
            with self.running(task_id):
                self.store.create()
                self.store.insert(report.feature_records(found.filter("is_abnormal")))
        return found

    def screening_results(self, found: DataFrame) -> DataFrame:
        return report.screening_summary(found, "wsi_name")

    def query_abnormal(self, wsi_name: str = "", min_score: float = 0.6, limit: int = 100) -> DataFrame:
        return self.store.query_abnormal(min_score, wsi_name, limit)

    def search_similar(self, vector, top_k: int = 20, wsi_name: str = "") -> DataFrame:
        return self.store.search_similar(vector, top_k, wsi_name)
