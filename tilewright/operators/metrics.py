"""Training metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_losses(losses: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mean over batches of the batches' means, whatever their sizes."""
    by_batch = losses.groupBy("epoch", "batch").agg(*[F.avg(c).alias(c) for c in columns])
    return by_batch.groupBy("epoch").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def psnr_of(mse: Column) -> Column:
    """10 log10(1 / mse), infinite where there is no error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(mse))


def psnr(errors: DataFrame) -> DataFrame:
    """Squared errors to images' PSNR, to batches' means, to epochs' means."""
    image = errors.groupBy("epoch", "batch", "image").agg(F.avg("squared_error").alias("mse"))
    batch = image.groupBy("epoch", "batch").agg(F.avg(psnr_of(F.col("mse"))).alias("psnr"))
    return batch.groupBy("epoch").agg(F.avg("psnr").alias("psnr"))


def best_checkpoints(epochs: DataFrame, value: str = "psnr", every: int = 10) -> DataFrame:
    """Mark epochs that beat all before (and 0), and every ``every``-th. A row an epoch, so one window."""
    before = F.coalesce(F.max(value).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    best = F.greatest(before, F.lit(0.0))
    return epochs.withColumn("is_best", F.col(value) > best).withColumn("is_periodic", (F.col("epoch") + 1) % every == 0)


def learning_rate(epoch: Column, base: float = 1e-4, gamma: float = 0.5, every: int = 100) -> Column:
    return F.lit(base) * F.pow(F.lit(gamma), F.floor(epoch / every))
