"""Combining the predictions of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.operators.align import CELL, PIXEL
from labelgrid.operators.banding import attach_image


def ensemble_mean(predictions: DataFrame, manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Mean over the models that have the layer, blank layers included.

    ``manifest (model_id, image_id, class_id)`` lists existing layers; its counts
    are joined by page band, so one large page does not fill one task.
    """
    models = manifest.groupBy("image_id", "class_id").agg(F.countDistinct("model_id").alias("models"))
    counted = models.join(images.select("image_id", "height"), "image_id")
    sums = predictions.groupBy(*CELL).agg(F.sum("v").alias("v"))
    return attach_image(sums, counted, ["models"], by=["class_id"]).select(*CELL, (F.col("v") / F.col("models")).alias("v"))


def argmax_by_model(predictions: DataFrame) -> DataFrame:
    """Winning class per model and pixel, lowest class on ties."""
    best = F.max(F.struct("v", (-F.col("class_id")).alias("nc"))).alias("best")
    return predictions.groupBy("model_id", *PIXEL).agg(best).select("model_id", *PIXEL, (-F.col("best.nc")).alias("class_id"))


def ensemble_vote(predictions: DataFrame, n_models: int, how: str = "median") -> DataFrame:
    """Per pixel, the median or the most frequent winning class over ``n_models`` models.

    A model without a row at a pixel votes for class 0. At most ``n_models``
    votes meet per pixel. ``mode`` takes the lowest class on ties.
    """
    votes = argmax_by_model(predictions).groupBy(*PIXEL).agg(F.collect_list("class_id").alias("c"))
    every = F.sort_array(F.concat("c", F.array_repeat(F.lit(0), F.lit(n_models) - F.size("c"))))
    if how == "median":
        mid = n_models // 2
        value = F.element_at("c", mid + 1).cast("double") if n_models % 2 else (F.element_at("c", mid) + F.element_at("c", mid + 1)) / 2
        return votes.withColumn("c", every).select(*PIXEL, value.alias("class_id"))
    counts = F.transform(F.array_distinct("c"), lambda k: F.struct(F.size(F.filter("c", lambda v: v == k)).alias("n"), (-k).alias("nc")))
    return votes.withColumn("c", every).select(*PIXEL, (-F.array_max(counts)["nc"]).alias("class_id"))
