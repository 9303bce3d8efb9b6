"""The task log: latest states, results and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATES = {"PENDING": "pending", "PROGRESS": "processing", "SUCCESS": "completed", "FAILURE": "failed"}


def task_status(log: DataFrame) -> DataFrame:
    """Each task's latest entry by ``seq``."""
    return log.groupBy("task_id").agg(F.max_by(F.struct("state", "progress"), "seq").alias("last")).select("task_id", "last.state", "last.progress")


def list_tasks(active: DataFrame, scheduled: DataFrame, limit: int = 50) -> DataFrame:
    """Active tasks, then scheduled ones, by id within each."""
    both = active.withColumn("status", F.lit("active")).unionByName(scheduled.withColumn("status", F.lit("scheduled")))
    return both.orderBy("status", "task_id").limit(limit)


def with_results(requested: DataFrame, finished: DataFrame) -> DataFrame:
    return requested.join(finished, "task_id", "left_semi")


def pending(requested: DataFrame, finished: DataFrame) -> DataFrame:
    return requested.join(finished, "task_id", "left_anti")


def results_or_null(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Every requested id, null where it has no result."""
    return requested.join(results, "task_id", "left")


def completed_batches(batches: DataFrame) -> DataFrame:
    return batches.filter(F.col("status") == "completed")


def batch_progress(batches: DataFrame) -> DataFrame:
    return batches.withColumn("progress", (F.col("batch_idx") + 1) / F.col("total_batches") * 100)


def worker_stats(log: DataFrame) -> DataFrame:
    """Tasks, states and completed ones of each worker."""
    return log.groupBy("worker").agg(F.count("*").alias("total_tasks"), F.countDistinct("state").alias("states"), F.count_if(F.col("state") == "SUCCESS").alias("completed_tasks"))


def state_name(column: str = "state"):
    """API names of the log's states; others pass through in lower case."""
    out = F.lower(F.col(column))
    for state, name in _STATES.items():
        out = F.when(F.col(column) == state, F.lit(name)).otherwise(out)
    return out
