"""Scores of class vectors against a true label, one row per pixel or sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import ratio
from labelgrid.functions.codec import onehot_to_enum
from labelgrid.operators.banding import merge_rows

KERAS_EPS = 1e-7


def argmax_pairs(df: DataFrame, truth: Column, scores: Column) -> DataFrame:
    return df.withColumns({"truth": truth.cast("int"), "pred": onehot_to_enum(scores)})


def argmax_cells(cells: DataFrame) -> DataFrame:
    """Winning class per pixel of a sparse table, lowest class on ties."""
    best = F.max(F.struct("v", (-F.col("class_id")).alias("nc"))).alias("best")
    return cells.groupBy("image_id", "y", "x").agg(best).select(
        "image_id", "y", "x", F.when(F.col("best.v") > 0, -F.col("best.nc")).otherwise(0).alias("class_id")
    )


def argmax_scores(pairs: DataFrame, n_classes: int, by: list[str] = ()) -> DataFrame:
    """Single-label precision, recall, F and accuracy (IoU) per class.

    Rows collapse to (truth, pred) counts first; everything else works on those.
    """
    by = list(by)
    counts = pairs.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("k"))
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("class_id"), F.when(F.col("truth") == F.col("pred"), F.col("k")).otherwise(0).alias("tp"), F.col("k").alias("gt"), F.lit(0).cast("bigint").alias("pr")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("gt"), F.col("k").alias("pr")),
    )).alias("e")).select(*by, "e.*")
    groups = counts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class_id")).distinct()
    sums = sides.groupBy(*by, "class_id").agg(F.sum("tp").alias("tp"), F.sum("gt").alias("gt_mass"), F.sum("pr").alias("pred_mass"))
    full = groups.join(sums, [*by, "class_id"], "left").fillna(0, ["tp", "gt_mass", "pred_mass"])
    union = F.col("gt_mass") + F.col("pred_mass") - F.col("tp")
    return full.withColumns({
        "recall": F.when(F.col("gt_mass") != 0, F.col("tp") / F.col("gt_mass")).otherwise(1e0),
        "precision": F.when(F.col("pred_mass") != 0, F.col("tp") / F.col("pred_mass")).otherwise(1e0),
        "accuracy": F.when(union != 0, F.col("tp") / union).otherwise(1e0),
    }).withColumn(
        "f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0e0))
    )


def overall_correct(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of rows whose argmax is the truth (categorical accuracy)."""
    return pairs.groupBy(*by).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("correct"))


def single_class_accuracy(pairs: DataFrame, class_id: int = 3) -> DataFrame:
    """Share of rows predicted ``class_id`` that truly are."""
    said = F.col("pred") == class_id
    return pairs.agg((F.sum((said & (F.col("truth") == class_id)).cast("double")) / F.greatest(F.sum(said.cast("double")), F.lit(1e0))).alias("accuracy"))


def in_top_k(scores: Column, truth: Column, k: int) -> Column:
    """Whether fewer than ``k`` scores beat the true class's score."""
    own = F.element_at(scores, (truth + 1).cast("int"))
    return F.size(F.filter(scores, lambda v: v > own)) < k


def top_k_accuracy(df: DataFrame, truth: Column, scores: Column, k: int = 5) -> DataFrame:
    return df.agg(F.avg(in_top_k(scores, truth, k).cast("double")).alias("accuracy"))


def dense_scores(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Sensitivity, specificity, rounded and exact-match accuracies over all pixels and classes.

    Cells without a row (g = p = 0) agree and are true negatives; they enter as
    ``total - rows``. Rounding is half-to-even.
    """
    g, p = F.col("g"), F.col("p")
    unit = lambda c: F.least(F.greatest(c, F.lit(0e0)), F.lit(1e0))
    same = (g == p).cast("double")
    s = pairs.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.sum(F.bround(unit(g * p))).alias("tp"), F.sum(F.bround(unit(g))).alias("pos"),
        F.sum(F.bround(unit((1 - g) * (1 - p)))).alias("tn"), F.sum(F.bround(unit(1 - g))).alias("neg"),
        F.sum((g == F.bround(p)).cast("double")).alias("eq"), F.sum(g * same).alias("fg"), F.sum((1 - g) * same).alias("bg"), F.sum(g).alias("mass"),
    )
    n = images.agg(F.sum(F.col("height").cast("double") * F.col("width") * F.col("n_classes")).alias("n"))
    rest = F.col("n") - F.col("rows")
    return merge_rows(s, n).select(
        (F.col("tp") / (F.col("pos") + KERAS_EPS)).alias("sensitivity"), ((F.col("tn") + rest) / (F.col("neg") + rest + KERAS_EPS)).alias("specificity"),
        ((F.col("eq") + rest) / F.col("n")).alias("binary_accuracy"), ratio(F.col("fg"), F.col("mass")).alias("foreground_accuracy"),
        ratio(F.col("bg") + rest, F.col("mass")).alias("background_accuracy"),
    )
