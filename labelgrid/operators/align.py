"""Pairing two label tables pixel by pixel, and looking pixels up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.operators.banding import attach_image

PIXEL = ["image_id", "y", "x"]
CELL = [*PIXEL, "class_id"]


def common_extent(gt_images: DataFrame, pred_images: DataFrame) -> DataFrame:
    """Smaller height, width and class count of each page present on both sides."""
    right = pred_images.select("image_id", *[F.col(c).alias(f"_{c}") for c in ("height", "width", "n_classes")])
    return gt_images.join(right, "image_id").select(
        "image_id", *[F.least(c, f"_{c}").alias(c) for c in ("height", "width", "n_classes")]
    )


def trim(cells: DataFrame, images: DataFrame) -> DataFrame:
    """Drop cells outside the page extent."""
    out = attach_image(cells, images, ["height", "width", "n_classes"])
    keep = (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    if "class_id" in cells.columns:
        keep = keep & (F.col("class_id") < F.col("n_classes"))
    return out.where(keep).select(*cells.columns)


def align(gt: DataFrame, pred: DataFrame, images: DataFrame | None = None, keys: list[str] = CELL) -> DataFrame:
    """Ground truth ``g`` next to prediction ``p`` with zero fill.

    Both sides are stacked and summed per cell: one hash aggregation with
    map-side combine instead of a sorted full outer join, and no key is hotter
    than a cell. ``images`` (see :func:`common_extent`) trims to the common size.
    """
    left = gt.select(*keys, F.col("v").alias("g"), F.lit(0e0).alias("p"))
    right = pred.select(*keys, F.lit(0e0).alias("g"), F.col("v").alias("p"))
    stacked = left.unionByName(right)
    if images is not None:
        stacked = trim(stacked, images)
    return stacked.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def clip_pairs(pairs: DataFrame) -> DataFrame:
    """Clip both values to [0, 1]."""
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0e0)), F.lit(1e0))
    return pairs.withColumns({"g": unit("g"), "p": unit("p")})


def abs_diff(pairs: DataFrame) -> DataFrame:
    """|g - p| per cell, non-zero cells only."""
    return pairs.select(*CELL, F.abs(F.col("g") - F.col("p")).alias("v")).where("v <> 0")


def pair_folders(gt_files: DataFrame, pred_files: DataFrame) -> DataFrame:
    """Ground-truth and predicted files of the same stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    left = gt_files.select(stem.alias("stem"), F.col("path").alias("gt_path"))
    right = pred_files.select(stem.alias("stem"), F.col("path").alias("pred_path"))
    return left.join(right, "stem")


def lookup(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each requested pixel; pixels without a row are class 0."""
    return coords.join(labels, PIXEL, "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def mask_cells(cells: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """Multiply cells by a per-pixel mask ``w``; pixels without a mask row become 0."""
    cols = cells.columns
    return cells.join(mask.select(*PIXEL, "w"), PIXEL).withColumn(value, F.col(value) * F.col("w")).select(*cols)


def union_splits(parts: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """Pool named tables, keeping the name in a column."""
    named = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def crop(samples: DataFrame, cells: DataFrame, tile: int = 256) -> DataFrame:
    """Cells inside each sampled window, shifted to the window's origin.

    ``samples`` has ``sample_id, image_id, left, top, size``. Windows and cells
    meet on page tiles, so the range condition becomes an equi join whose keys
    are small page areas rather than whole pages.
    """
    hi = lambda c: F.floor((F.col(c) + F.col("size") - 1) / tile).cast("int")
    lo = lambda c: F.floor(F.col(c) / tile).cast("int")
    windows = (
        samples.select("sample_id", "image_id", "left", "top", "size")
        .withColumn("_ty", F.explode(F.sequence(lo("top"), hi("top"))))
        .withColumn("_tx", F.explode(F.sequence(lo("left"), hi("left"))))
    )
    tiled = cells.withColumns({
        "_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int"),
    })
    inside = (
        (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("size"))
        & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("size"))
    )
    keep = [c for c in cells.columns if c not in ("image_id", "y", "x")]
    return tiled.join(windows, ["image_id", "_ty", "_tx"]).where(inside).select(
        "sample_id", "image_id", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), *keep
    )
