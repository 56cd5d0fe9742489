"""Pixel metrics from five additive sums per (image, class).

With absent rows meaning zero, TP, the two masses, the squared and the absolute
error are sums over non-zero cells only; every count of empty pixels follows
from the page extent. One partial aggregation feeds all metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelgrid.functions.arith import harmonic, ratio, smart_div
from labelgrid.operators.align import PIXEL
from labelgrid.operators.banding import small_side

SUMS = ["tp", "gt_mass", "pred_mass", "sq_err", "abs_err", "tpg"]
EPS = 1e-14


def binarize(pairs: DataFrame, gt_threshold: float | None = None, pred_threshold: float | None = None, class_thresholds: DataFrame | None = None) -> DataFrame:
    """Strictly-greater thresholds on g and p; NULL or 0 leaves the values soft.

    ``class_thresholds (class_id, threshold)`` overrides ``pred_threshold``.
    """
    def cut(col: str, t: Column) -> Column:
        return F.when(t.isNull() | (t <= 0), F.col(col)).otherwise((F.col(col) > t).cast("double"))

    gt_t = F.lit(gt_threshold).cast("double")
    if class_thresholds is None:
        out = pairs.withColumns({"g": cut("g", gt_t), "p": cut("p", F.lit(pred_threshold).cast("double"))})
    else:
        out = (
            pairs.join(small_side(class_thresholds.select("class_id", F.col("threshold").alias("_t"))), "class_id", "left")
            .withColumns({"g": cut("g", gt_t), "p": cut("p", F.coalesce(F.col("_t"), F.lit(pred_threshold).cast("double")))})
            .select(*pairs.columns)
        )
    return out.where((F.col("g") != 0) | (F.col("p") != 0))


def sums_expr(g: str = "g", p: str = "p") -> list[Column]:
    gc, pc = F.col(g), F.col(p)
    return [
        F.sum(gc * pc).alias("tp"), F.sum(gc).alias("gt_mass"), F.sum(pc).alias("pred_mass"),
        F.sum((gc - pc) * (gc - pc)).alias("sq_err"), F.sum(F.abs(gc - pc)).alias("abs_err"),
        F.sum(gc * pc * gc).alias("tpg"),
    ]


def cell_sums(pairs: DataFrame) -> DataFrame:
    """Additive sums per (image, class); the state every metric is made from."""
    return pairs.groupBy("image_id", "class_id").agg(*sums_expr())


def image_class_grid(images: DataFrame) -> DataFrame:
    """One row per page and class with ``n`` pixels: blank layers count as well."""
    return images.select(
        "image_id", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)).alias("class_id"),
        (F.col("height").cast("double") * F.col("width")).alias("n"),
    )


def image_sums(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """:func:`cell_sums` completed with all-zero layers and the pixel count."""
    return image_class_grid(images).join(cell_sums(pairs), ["image_id", "class_id"], "left").fillna(0e0, SUMS)


def derive(sums: DataFrame) -> DataFrame:
    """All metrics of E1-E10 as projections of the sums and ``n``."""
    tp, gm, pm, n = (F.col(c) for c in ("tp", "gt_mass", "pred_mass", "n"))
    return (
        sums.withColumns({"fp": pm - tp, "fn": gm - tp, "tn": n - gm - pm + tp})
        .withColumns({
            "recall": smart_div(tp, gm), "precision": smart_div(tp, pm), "union_mass": gm + pm - tp,
            "accuracy": ratio(tp + F.col("tn"), n), "mse": ratio(F.col("sq_err"), n),
            "gt_mean": ratio(gm, n), "pred_mean": ratio(pm, n),
        })
        .withColumns({"f1": harmonic(F.col("precision"), F.col("recall"), EPS), "iou": smart_div(tp, F.col("union_mass"))})
    )


def metrics_by_image(pairs: DataFrame, images: DataFrame) -> DataFrame:
    return derive(image_sums(pairs, images))


def metrics_by_class(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pooled over pages: sums per class first, then the extent of all pages."""
    extents = image_class_grid(images).groupBy("class_id").agg(F.sum("n").alias("n"))
    sums = pairs.groupBy("class_id").agg(*sums_expr())
    return derive(extents.join(sums, "class_id", "left").fillna(0e0, SUMS))


def global_metrics(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """All classes merged into one layer, per page."""
    per_image = image_sums(pairs, images).groupBy("image_id").agg(*[F.sum(c).alias(c) for c in [*SUMS, "n"]])
    return derive(per_image).withColumn("foreground_accuracy", F.col("tpg") / F.greatest("gt_mass", F.lit(EPS)))


def folder_report(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Mean of the per-page metrics for each class, then the mean over classes (NULL class)."""
    names = ["precision", "recall", "f1", "accuracy", "iou"]
    by_class = metrics_by_image(pairs, images).groupBy("class_id").agg(*[F.avg(c).alias(c) for c in names])
    overall = by_class.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit(None).cast("int").alias("class_id"), *names)
    return by_class.unionByName(overall)


def blank_truth(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pages whose ground truth is empty."""
    mass = pairs.groupBy("image_id").agg(F.sum("g").alias("mass"))
    return images.select("image_id").join(mass, "image_id", "left").where(F.coalesce("mass", F.lit(0e0)) == 0).select("image_id")


def pixel_masks(pairs: DataFrame) -> DataFrame:
    """Per pixel: class sums of g and p, any-class flags, clipped background."""
    out = pairs.groupBy(*PIXEL).agg(F.sum("g").alias("gt_mask"), F.sum("p").alias("pred_mask"))
    bg = lambda c: F.greatest(1 - F.col(c), F.lit(0e0))
    return out.withColumns({
        "gt_any": (F.col("gt_mask") > 0).cast("int"), "pred_any": (F.col("pred_mask") > 0).cast("int"),
        "gt_bg": bg("gt_mask"), "pred_bg": bg("pred_mask"),
    })


def overlap_histogram(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels by number of ground-truth classes; bucket 0 comes from the page extent."""
    per_pixel = pairs.where("g <> 0").groupBy(*PIXEL).agg(F.sum("g").alias("classes"))
    counts = per_pixel.groupBy("classes").agg(F.count(F.lit(1)).alias("pixels"))
    moved = F.array(*[F.struct(c.alias("classes"), n.alias("pixels")) for c, n in ((F.col("classes"), F.col("pixels")), (F.lit(0e0), -F.col("pixels")))])
    page = images.agg(F.sum(F.col("height").cast("bigint") * F.col("width")).alias("pixels")).select(F.lit(0e0).alias("classes"), "pixels")
    return counts.select(F.explode(moved).alias("e")).select("e.*").unionByName(page).groupBy("classes").agg(F.sum("pixels").alias("pixels"))


def overlap_share(pairs: DataFrame) -> DataFrame:
    """Per page: pixels with more than one class, and their share of each class's mass."""
    over = (
        pairs.groupBy(*PIXEL).agg(F.sum("g").alias("s"))
        .groupBy("image_id").agg(F.sum((F.col("s") > 1).cast("bigint")).alias("overlapped"))
    )
    mass = pairs.groupBy("image_id", "class_id").agg(F.sum("g").alias("gt_mass"))
    return mass.join(over, "image_id").select(
        "image_id", "class_id", "overlapped", (F.col("overlapped") / F.greatest("gt_mass", F.lit(0.01))).alias("share")
    )


def weighted_metrics(pairs: DataFrame, images: DataFrame, precision_w: DataFrame | None = None, recall_w: DataFrame | None = None, grain: list[str] = ("class_id",)) -> DataFrame:
    """Precision and recall under separate per-pixel weight maps ``(image, y, x, w)``.

    A missing map means plain precision or recall; a pixel without a row weighs
    1. Both maps ride along one aggregation keyed by pixel.
    """
    out = pairs
    for name, table in (("wp", precision_w), ("wr", recall_w)):
        if table is None:
            out = out.withColumn(name, F.lit(1e0))
        else:
            out = out.join(table.select(*PIXEL, F.col("w").alias(name)), PIXEL, "left").fillna(1e0, [name])
    g, p, wp, wr = (F.col(c) for c in ("g", "p", "wp", "wr"))
    sums = out.groupBy(*grain).agg(
        F.sum(g * p * wp).alias("_tp_p"), F.sum(p * wp).alias("_p"), F.sum(g * p * wr).alias("_tp_r"), F.sum(g * wr).alias("_r"),
    )
    grid = image_class_grid(images).select(*grain).distinct()
    return (
        grid.join(sums, list(grain), "left").fillna(0e0)
        .select(*grain, smart_div(F.col("_tp_p"), F.col("_p")).alias("w_precision"), smart_div(F.col("_tp_r"), F.col("_r")).alias("w_recall"))
        .withColumn("w_f1", harmonic(F.col("w_precision"), F.col("w_recall"), EPS))
    )


def confusion(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """(C+1) x (C+1) sums of g_i * p_j per page, last row and column background.

    The classes of one pixel (at most C) are gathered and multiplied in place;
    products are summed before the second shuffle. Background is clipped per
    pixel. Every page starts as all background on both sides, and each pixel
    that has rows takes itself out of that count.
    """
    per_pixel = pairs.groupBy(*PIXEL).agg(
        F.collect_list(F.when(F.col("g") != 0, F.struct("class_id", F.col("g").alias("v")))).alias("gs"),
        F.collect_list(F.when(F.col("p") != 0, F.struct("class_id", F.col("p").alias("v")))).alias("ps"),
    )
    bg = lambda a: F.struct(
        F.lit(-1).alias("class_id"), F.greatest(1 - F.aggregate(a, F.lit(0e0), lambda s, e: s + e["v"]), F.lit(0e0)).alias("v")
    )
    entry = lambda g, p, v: F.struct(g.alias("gt_class"), p.alias("pred_class"), v.alias("v"))
    full = per_pixel.select("image_id", F.concat("gs", F.array(bg(F.col("gs")))).alias("gs"), F.concat("ps", F.array(bg(F.col("ps")))).alias("ps"))
    products = F.flatten(F.transform("gs", lambda g: F.transform("ps", lambda p: entry(g["class_id"], p["class_id"], g["v"] * p["v"]))))
    own = F.array(entry(F.lit(-1), F.lit(-1), F.lit(-1e0)))
    sums = full.select("image_id", F.explode(F.concat(products, own)).alias("e")).select("image_id", "e.*").groupBy("image_id", "gt_class", "pred_class").agg(F.sum("v").alias("v"))
    axis = F.sequence(F.lit(-1), F.col("n_classes") - 1)
    page = F.when((F.col("gt_class") == -1) & (F.col("pred_class") == -1), F.col("height").cast("double") * F.col("width")).otherwise(0e0)
    grid = images.select("image_id", "height", "width", F.explode(axis).alias("gt_class"), axis.alias("_a")).withColumn("pred_class", F.explode("_a"))
    grid = grid.select("image_id", "gt_class", "pred_class", page.alias("v"))
    return grid.unionByName(sums).groupBy("image_id", "gt_class", "pred_class").agg(F.sum("v").alias("v"))


def confusion_total(per_image: DataFrame) -> DataFrame:
    """Confusion matrices of all pages added up."""
    return per_image.groupBy("gt_class", "pred_class").agg(F.sum("v").alias("v"))


def confusion_display(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """sqrt of each entry over the largest sqrt of its predicted column."""
    top = matrix.groupBy(*by, "pred_class").agg(F.max(F.sqrt("v")).alias("_top"))
    return matrix.join(top, [*by, "pred_class"]).withColumn("shade", ratio(F.sqrt("v"), F.col("_top"))).drop("_top")


SLICES = 1000


def _below(bounds: str, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending ``bounds`` are below ``value``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) < value), at + step).otherwise(at))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population standard deviation and exact median of numeric columns.

    Values are counted, and the counts added up by value range; ranges come from a mergeable quantile sketch, so they hold about equal shares.
    Running totals over the ranges name the one or two that hold the middle, and only their values are put in order.
    """
    longed = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("e")).select("e.*").where("value IS NOT NULL")
    bounds = longed.groupBy("name").agg(F.percentile_approx("value", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("_bounds"))
    counted = longed.groupBy("name", "value").agg(F.count(F.lit(1)).alias("k"))
    sliced = counted.join(F.broadcast(bounds), "name").withColumn("_slice", _below("_bounds", F.col("value"), SLICES - 1)).drop("_bounds")
    name = W.partitionBy("name")
    sums = sliced.groupBy("name", "_slice").agg(F.sum("k").alias("_k"), F.sum(F.col("value") * F.col("k")).alias("_s"), F.sum(F.col("value") * F.col("value") * F.col("k")).alias("_s2"))
    placed = sums.withColumn("_before", F.sum("_k").over(name.orderBy("_slice")) - F.col("_k")).withColumn("_n", F.sum("_k").over(name))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = placed.where((F.col("_before") <= high) & (F.col("_before") + F.col("_k") > low)).select("name", "_slice", "_before", "_n")
    upto = F.sum("k").over(W.partitionBy("name", "_slice").orderBy("value")) + F.col("_before")
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("k") <= rank) & (rank < F.col("_upto")), F.col("value")))
    medians = sliced.join(middle, ["name", "_slice"]).withColumn("_upto", upto).groupBy("name").agg(((at(low) + at(high)) / 2).alias("median"))
    means = sums.groupBy("name").agg((F.sum("_s") / F.sum("_k")).alias("mean"), (F.sum("_s2") / F.sum("_k")).alias("_m2"))
    std = F.sqrt(F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0e0)))
    return means.join(medians, "name").select("name", "mean", std.alias("std"), "median")


