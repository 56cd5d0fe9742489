"""Additive sums kept up to date as pages land.

Everything the metrics need is a sum, so a micro-batch writes its own partial
sums and readers add them up. A repeated batch overwrites its own folder: the
result is the same after any number of retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelgrid.operators.metrics import sums_expr


def confusion_counts(cells: DataFrame) -> DataFrame:
    """Per class sums of ``(image_id, class_id, g, p)`` cells."""
    return cells.groupBy("class_id").agg(*sums_expr())


def index_counts(cells: DataFrame) -> DataFrame:
    """Pixels per (class, image)."""
    return cells.where("g <> 0").groupBy("class_id", "image_id").agg(F.count(F.lit(1)).alias("n_pixels"))


def accumulate(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write the partial sums of every micro-batch under ``path`` until the input is drained."""
    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current totals."""
    parts = spark.read.parquet(path)
    sums = [c for c in parts.columns if c not in (*keys, "batch_id")]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
