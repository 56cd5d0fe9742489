"""Per-pixel arithmetic on label and intensity tables.

Label tables are sparse (no row = 0). Intensity tables
``(image_id, y, x, c, v)`` are dense: a pixel without a row is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import uniform
from labelgrid.operators.align import CELL, PIXEL
from labelgrid.operators.banding import attach_image, small_side

# fixed values
BRIGHTNESS = 0.99
GREY_WEIGHTS = {0: 0.114, 1: 0.587, 2: 0.299}  # blue, green, red
NOISE_SCALES = [1, 2, 4, 8, 16]


def cells_to_bitmask(cells: DataFrame) -> DataFrame:
    """One mask per pixel; class k sets bit k."""
    bit = F.when(F.col("v") > 0, F.pow(F.lit(2e0), F.col("class_id"))).otherwise(0e0)
    return cells.groupBy(*PIXEL).agg(F.sum(bit).cast("int").alias("mask"))


def bitmask_to_cells(masks: DataFrame, n: int) -> DataFrame:
    """Inverse of :func:`cells_to_bitmask`."""
    return masks.select(*PIXEL, "mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class_id")).where(
        F.getbit("mask", F.col("class_id")) == 1
    ).select(*CELL, F.lit(1e0).alias("v"))


def foreground_mask(cells: DataFrame) -> DataFrame:
    """min(1, 255 * sum of classes) per pixel."""
    return cells.groupBy(*PIXEL).agg(F.least(F.lit(1e0), 255 * F.sum("v")).alias("w")).where("w > 0")


def threshold_predictions(cells: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5) -> DataFrame:
    """``v >= t`` becomes 1, all else 0; per-class thresholds with a default."""
    if thresholds is None:
        return cells.where(F.col("v") >= default).withColumn("v", F.lit(1e0))
    t = small_side(thresholds.select("class_id", F.col("threshold").alias("_t")))
    return cells.join(t, "class_id", "left").where(F.col("v") >= F.coalesce("_t", F.lit(default))).withColumn("v", F.lit(1e0)).select(*cells.columns)


def drop_unseen_classes(cells: DataFrame, summary: DataFrame) -> DataFrame:
    """Move the mass of classes without training pixels to class 0."""
    seen = small_side(summary.where("n_pixels > 0").select("class_id", F.lit(True).alias("_seen")))
    moved = cells.join(seen, "class_id", "left").withColumn("class_id", F.when(F.col("_seen"), F.col("class_id")).otherwise(0))
    return moved.groupBy(*CELL).agg(F.sum("v").alias("v"))


def _rescaled(df: DataFrame, images: DataFrame, col: str = "v") -> DataFrame:
    """Divide by the page's largest value where that exceeds 1."""
    top = images.select("image_id", "height").join(df.groupBy("image_id").agg(F.max(col).alias("_top")), "image_id")
    out = attach_image(df, top, ["_top"])
    return out.withColumn(col, F.when(F.col("_top") > 1, F.col(col) / F.col("_top")).otherwise(F.col(col))).drop("_top")


def blend_masked(intensity: DataFrame, layer: DataFrame, images: DataFrame) -> DataFrame:
    """``layer * image + 1 - layer`` per pixel and channel; white where the layer is 0."""
    img = _rescaled(intensity, images)
    lay = _rescaled(layer.select(*PIXEL, F.col("v").alias("_l")), images, "_l")
    return img.join(lay, PIXEL, "left").withColumn("_l", F.coalesce("_l", F.lit(0e0))).select(
        *PIXEL, "c", (F.col("_l") * F.col("v") + 1 - F.col("_l")).alias("v")
    )


def class_colours(cells: DataFrame, swap: bool = True, brightness: float = BRIGHTNESS) -> DataFrame:
    """Heat map of up to six classes as three colour channels, clipped to 1."""
    per_class = lambda k: F.sum(F.when(F.col("class_id") == k, F.col("v") * brightness).otherwise(0e0))
    v = [per_class(k) for k in range(6)]
    first, last = (v[2], v[0]) if swap else (v[0], v[2])
    mixed_end = v[3] + v[5]
    c0 = first + v[4] + (mixed_end if swap else F.lit(0e0))
    c2 = last + v[4] + (F.lit(0e0) if swap else mixed_end)
    clip = lambda c: F.least(F.greatest(c, F.lit(0e0)), F.lit(1e0))
    return cells.groupBy(*PIXEL).agg(clip(c0).alias("c0"), clip(v[1] + mixed_end).alias("c1"), clip(c2).alias("c2"))


def pad_to_multiple(images: DataFrame, power: int = 5) -> DataFrame:
    """Extents rounded up to a multiple of ``2 ** power``; zero padding needs no rows."""
    step = 2**power
    up = lambda c: (F.ceil(F.col(c) / step) * step).cast("int")
    return images.withColumns({"height": up("height"), "width": up("width")})


def intensity_jitter(intensity: DataFrame, seed: str, noise_probability: float = 0.5, max_noise: float = 0.36, min_contrast: float = 0.3) -> DataFrame:
    """Random contrast and offset per page and channel, additive multi-scale noise per page.

    Every random number is a hash of the seed and its own key (page, channel,
    noise square), so results do not depend on partitioning.
    """
    i, c = F.col("image_id"), F.col("c")
    contrast = min_contrast + (1 - min_contrast) * uniform(f"{seed}-contrast", i, c)
    offset = uniform(f"{seed}-offset", i, c) * (1 - contrast)
    level = uniform(f"{seed}-level", i) * max_noise
    noise = F.lit(0e0)
    for s in NOISE_SCALES:
        swing = 2 * uniform(f"{seed}-swing{s}", i) - 1
        square = uniform(f"{seed}-noise{s}", i, F.floor(F.col("y") / s), F.floor(F.col("x") / s), c)
        noise = noise + level * square * swing * swing * swing
    noisy = uniform(f"{seed}-on", i) < noise_probability
    value = F.col("v") * contrast + offset + F.when(noisy, noise).otherwise(0e0)
    return intensity.withColumn("v", F.least(F.greatest(value, F.lit(0e0)), F.lit(1e0)))


def subtract_background(img: DataFrame, background: DataFrame, images: DataFrame, as_int: bool = True) -> DataFrame:
    """``background - img`` with negatives cut, stretched to 0..255 per page.

    Stacked and summed per pixel; the page's minimum is 0 as soon as one pixel
    of its extent has no row.
    """
    diff = (
        img.select(*PIXEL, (-F.col("v")).alias("v")).unionByName(background.select(*PIXEL, "v"))
        .groupBy(*PIXEL).agg(F.greatest(F.sum("v"), F.lit(0e0)).alias("v"))
    )
    stats = diff.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    page = images.join(stats, "image_id").withColumn(
        "_lo", F.when(F.col("_n") < F.col("height").cast("bigint") * F.col("width"), F.least("_lo", F.lit(0e0))).otherwise(F.col("_lo"))
    )
    out = attach_image(diff, page, ["_lo", "_hi"])
    stretched = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).otherwise(0e0)
    return out.select(*PIXEL, (F.floor(stretched).cast("double") if as_int else stretched).alias("v"))


def to_grey(intensity: DataFrame, weighted: bool = True) -> DataFrame:
    """Channel mean, or the luma weights of blue, green and red."""
    if not weighted:
        return intensity.groupBy(*PIXEL).agg(F.avg("v").alias("v"))
    w = F.lit(0e0)
    for ch, f in GREY_WEIGHTS.items():
        w = F.when(F.col("c") == ch, F.lit(f)).otherwise(w)
    return intensity.groupBy(*PIXEL).agg(F.sum(F.col("v") * w).alias("v"))


def downsample(intensity: DataFrame, rate: int) -> DataFrame:
    """Area average of ``rate x rate`` squares. Pixels are dealt by square first, so a task holds the squares of its part and not some pixel of each."""
    square = intensity.select("image_id", F.floor(F.col("y") / rate).cast("int").alias("y"), F.floor(F.col("x") / rate).cast("int").alias("x"), "c", "v")
    return square.repartition(*PIXEL).groupBy(*PIXEL, "c").agg(F.avg("v").alias("v"))


def infer_scale(path: Column) -> Column:
    """``scale_50`` in a path means stored at 50 %: multiply coordinates by 2."""
    n = F.regexp_extract(path, r"scale_(\d+)", 1)
    return F.when(n != "", F.lit(100e0) / F.nullif(n.try_cast("double"), F.lit(0e0))).otherwise(1e0)


def rescale(cells: DataFrame, factor: Column) -> DataFrame:
    """Coordinates back in the original page."""
    return cells.withColumns({"y": F.floor(F.col("y") * factor).cast("int"), "x": F.floor(F.col("x") * factor).cast("int")})
