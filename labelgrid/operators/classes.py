"""Class index, class weights and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_index(cells: DataFrame) -> DataFrame:
    """Non-zero pixels per (class, image)."""
    return cells.where("v <> 0").groupBy("class_id", "image_id").agg(F.count(F.lit(1)).alias("n_pixels"))


def class_summary(index: DataFrame) -> DataFrame:
    """Images, pixels and share of all pixels per class."""
    by_class = index.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_images"), F.sum("n_pixels").alias("n_pixels"))
    # one row per class from here on
    return by_class.withColumn("share", F.col("n_pixels") / F.sum("n_pixels").over(W.partitionBy()))


def sqrt_weights(summary: DataFrame) -> DataFrame:
    """Inverse square-root loss weights: sum of sqrt(n) over sqrt(n_c)."""
    root = F.sqrt("n_pixels")
    return summary.select("class_id", (F.sum(root).over(W.partitionBy()) / root).alias("weight"))


def log_weights(summary: DataFrame) -> DataFrame:
    """1 + ln(sum n / n_c), classes ranked by it."""
    weight = 1 + F.log(F.sum("n_pixels").over(W.partitionBy()) / F.col("n_pixels"))
    out = summary.select("class_id", weight.alias("weight"))
    return out.withColumn("rank", F.row_number().over(W.orderBy("weight", "class_id")))


def missing_classes(classes: DataFrame, index: DataFrame) -> DataFrame:
    """Declared classes no image contains."""
    return classes.join(index.select("class_id").distinct(), "class_id", "left_anti")


def verify_binary(layers: DataFrame, files: list[str]) -> DataFrame:
    """Files that are not black-and-white: more than two grey values, or neither 0 nor 255.

    ``layers`` has one grey value ``v`` (0..255) per row. Distinct values are
    found first, so a file contributes at most 256 rows to the second step.
    """
    values = layers.select(*files, F.col("v").cast("int").alias("v")).distinct()
    seen = values.groupBy(*files).agg(
        F.count(F.lit(1)).alias("n_values"), F.max(F.col("v").isin(0, 255).cast("int")).alias("_extreme"),
        F.sort_array(F.collect_list("v")).alias("grey_values"),
    )
    return seen.where((F.col("n_values") > 2) | (F.col("_extreme") == 0)).drop("_extreme")


def all_binary(layers: DataFrame, files: list[str]) -> DataFrame:
    """One row: whether every file passes :func:`verify_binary`."""
    return verify_binary(layers, files).agg((F.count(F.lit(1)) == 0).alias("ok"))
