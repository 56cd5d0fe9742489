"""Loss values as table aggregates (evaluation only).

Every loss is an additive sum per class, completed with what empty cells
contribute, and combined over the few class rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import ratio
from labelgrid.operators.align import PIXEL, align
from labelgrid.operators.banding import attach_image, merge_rows
from labelgrid.operators.metrics import image_class_grid
from labelgrid.operators.stencil import gaussian_smooth_pairs

# fixed values: margins, class weights and epsilons of the loss definitions
MARGIN_PLUS, MARGIN_NEG, LAMBDA = 0.9, 0.1, 0.5
PSEUDO_EPS, PSEUDO_WEIGHT, PSEUDO_FROM = 1e-8, 8.0, 2
CE_EPS, WEIGHTED_CE_EPS, KERAS_EPS = 1e-9, 1e-8, 1e-7
COMPOSITE_WEIGHTS = [1.0, 1.0, 2.0, 3.0, 1.0, 1.0]


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0e0)), F.lit(1e0))


def _clip(c: Column, eps: float) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))


def recall_map(pairs: DataFrame) -> DataFrame:
    """Continuous recall g*p and precision 1-(1-g)(1-p) per cell."""
    g, p = F.col("g"), _unit(F.col("p"))
    return pairs.withColumns({"recall_map": g * p, "precision_map": 1 - (1 - g) * (1 - p)})


def with_foreground(pairs: DataFrame) -> DataFrame:
    """Add ``fg``, the any-class ground-truth mask of the pixel, and the pixel's clipped score sum.

    The classes of one pixel are gathered (at most C) and spread out again: one shuffle.
    """
    cell = F.struct("class_id", "g", "p")
    return pairs.groupBy(*PIXEL).agg(F.collect_list(cell).alias("cs"), F.sum("g").alias("gs"), F.sum(_clip(F.col("p"), CE_EPS)).alias("ps")).select(
        *PIXEL, _unit(F.col("gs") * 255).alias("fg"), F.col("ps"), F.size("cs").alias("rows"), F.explode("cs").alias("c"),
    ).select(*PIXEL, "fg", "ps", "rows", "c.*")


def class_pixels(images: DataFrame) -> DataFrame:
    return image_class_grid(images).groupBy("class_id").agg(F.sum("n").alias("n"))


def layer_pixels(images: DataFrame) -> DataFrame:
    """One row ``n``: pixels of all layers of all pages."""
    return images.agg(F.sum(F.col("height").cast("double") * F.col("width") * F.col("n_classes")).alias("n"))


def _class_weight(weights: list[float] | None) -> Column:
    if weights is None:
        return F.lit(1e0)
    return F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("class_id")), F.lit(1e0))


def continuous_f_loss(pairs: DataFrame, images: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Weighted mean over classes of (1 - mean recall*precision) ** 1/4."""
    maps = recall_map(pairs).groupBy("class_id").agg(F.sum(F.col("recall_map") * F.col("precision_map")).alias("s"))
    w = _class_weight(weights)
    per_class = class_pixels(images).join(maps, "class_id", "left").select(
        w.alias("w"), F.pow((F.col("n") - F.coalesce("s", F.lit(0e0))) / F.col("n"), F.lit(0.25)).alias("loss"),
    )
    return per_class.agg((F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("loss"))


def blurred_f_loss(gt: DataFrame, pred: DataFrame, images: DataFrame, sigma: float = 5.0, weights: list[float] | None = None) -> DataFrame:
    """:func:`continuous_f_loss` of both sides after the same Gaussian blur."""
    return continuous_f_loss(gaussian_smooth_pairs(gt, pred, images, sigma), images, weights)


def margin_map(g: Column, p: Column, floor: float = 0.1, gap: float = 0.9) -> Column:
    """Squared margin of one cell; empty cells contribute 0."""
    miss = F.greatest(floor * g, MARGIN_PLUS - p)
    stray = F.greatest(floor * g, p - MARGIN_NEG)
    return g * miss * miss + LAMBDA * (gap - g) * stray * stray


def margin_loss(pairs: DataFrame, images: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Class margins averaged over pixels, weighted and added."""
    sums = pairs.groupBy("class_id").agg(F.sum(margin_map(F.col("g"), F.col("p"))).alias("s"))
    return class_pixels(images).join(sums, "class_id", "left").agg(
        F.sum(F.coalesce("s", F.lit(0e0)) / F.col("n") * _class_weight(weights)).alias("loss")
    )


def masked_losses(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Margin and squared error with predictions zeroed outside the any-class foreground."""
    pm = F.col("fg") * F.col("p")
    sums = with_foreground(pairs).agg(
        F.sum(margin_map(F.col("g"), pm, floor=0.0, gap=1.0)).alias("masked_margin"), F.sum((F.col("g") - pm) * (F.col("g") - pm)).alias("sq"),
    )
    return merge_rows(sums, layer_pixels(images)).select("masked_margin", (F.col("sq") / F.col("n")).alias("masked_mse"))


def _surrogate(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = tp / (tp + fp + PSEUDO_EPS), tp / (tp + fn + PSEUDO_EPS)
    return {"precision": p, "recall": r, "f": 2 * p * r / (p + r + PSEUDO_EPS)}


def surrogate_scores(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Soft precision, recall and F, macro (F squared, later classes weighing 8) and micro."""
    on = _unit(F.col("g") * 255)
    sums = with_foreground(pairs).groupBy("class_id").agg(
        F.sum(on * F.abs(F.col("p"))).alias("tp"), F.sum(on * (1 - _unit(F.col("p")))).alias("fn"), F.sum((1 - on) * F.abs(F.col("p")) * F.col("fg")).alias("fp"),
    )
    full = class_pixels(images).select("class_id").join(sums, "class_id", "left").fillna(0e0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    heavy = F.when(F.col("class_id") >= PSEUDO_FROM, F.lit(PSEUDO_WEIGHT)).otherwise(1e0)
    s = _surrogate(tp, fp, fn)
    per_class = full.select("tp", "fp", "fn", heavy.alias("w"), s["precision"].alias("pc"), s["recall"].alias("rc"), (s["f"] * s["f"] * heavy).alias("fc"))
    out = per_class.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "w", "pc", "rc", "fc")])
    micro = _surrogate(tp, fp, fn)
    return out.select(
        (F.col("pc") / F.col("w")).alias("macro_precision"), (F.col("rc") / F.col("w")).alias("macro_recall"), (F.col("fc") / F.col("w")).alias("macro_f"),
        micro["precision"].alias("micro_precision"), micro["recall"].alias("micro_recall"), micro["f"].alias("micro_f"),
    ).withColumn("loss", 2 - F.col("macro_f") - F.col("micro_f"))


def log_loss(pairs: DataFrame, images: DataFrame, class_weights: list[float] | None = None) -> DataFrame:
    """Pixel cross-entropy: plain (scores renormalised over classes) or class-weighted.

    Absent classes of a pixel hold the clip value, so a pixel's score sum is its
    rows plus ``(C - rows) * eps``.
    """
    if class_weights is None:
        p = _clip(F.col("p"), CE_EPS)
        per_pixel = pairs.groupBy(*PIXEL).agg(
            F.sum(F.col("g") * F.log(p)).alias("gl"), F.sum("g").alias("g"), F.sum(p).alias("s"), F.count(F.lit(1)).alias("rows"),
        )
        mass = F.col("s") + (F.col("n_classes") - F.col("rows")) * CE_EPS
        sums = attach_image(per_pixel, images, ["n_classes"]).agg(F.sum(F.col("gl") - F.col("g") * F.log(mass)).alias("s"))
    else:
        logs = F.col("g") * F.log(_clip(F.col("p"), WEIGHTED_CE_EPS))
        sums = pairs.agg(F.sum(logs * _class_weight(class_weights)).alias("s"))
    return merge_rows(sums, layer_pixels(images)).select((-F.col("s") / F.col("n")).alias("loss"))


def cost_weighted_log_loss(df: DataFrame, truth: Column, probs: Column, costs: DataFrame) -> DataFrame:
    """Cross-entropy times the cost of (true class, winning class); ``costs (truth, pred, cost)``."""
    mass = F.aggregate(probs, F.lit(0e0), lambda a, v: a + v)
    p = _clip(F.element_at(probs, (truth + 1).cast("int")) / mass, KERAS_EPS)
    rows = df.select(truth.cast("int").alias("truth"), (F.array_position(probs, F.array_max(probs)) - 1).cast("int").alias("pred"), (-F.log(p)).alias("ce"))
    by_pair = rows.groupBy("truth", "pred").agg(F.sum("ce").alias("ce"), F.count(F.lit(1)).alias("k"))
    return by_pair.join(costs, ["truth", "pred"]).agg((F.sum(F.col("ce") * F.col("cost")) / F.sum("k")).alias("loss"))




def argmax_f_loss(pairs: DataFrame) -> DataFrame:
    """2 - P - R from products of argmax indices, as written; columns ``truth, pred``."""
    t, p = F.col("truth"), F.col("pred")
    hit = lambda a, b: F.sum(((a * b) != 0).cast("double"))
    s = pairs.agg(hit(p, t).alias("tp"), hit(p, t - 1).alias("fp"), hit(p - 1, t).alias("fn"))
    return s.select((2 - ratio(F.col("tp"), F.col("tp") + F.col("fp")) - ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("loss"))


def composite_loss(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """0.1(1 - macro P * macro R) + 0.1 weighted cross-entropy + class margins."""
    s = surrogate_scores(pairs, images).select("macro_precision", "macro_recall")
    ce = log_loss(pairs, images, COMPOSITE_WEIGHTS).withColumnRenamed("loss", "ce")
    margin = margin_loss(pairs, images).withColumnRenamed("loss", "margin")
    return merge_rows(s, ce, margin).select(
        (0.1 * (1 - F.col("macro_precision") * F.col("macro_recall")) + 0.1 * F.col("ce") + F.col("margin")).alias("loss")
    )
