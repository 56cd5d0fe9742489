"""Cross-validation over authors and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.operators.align import CELL
from labelgrid.operators.metrics import derive, sums_expr


def cross_validate(gt: DataFrame, predictions: DataFrame, gt_key: str, pred_key: str, sources: list[str], images: DataFrame | None = None) -> DataFrame:
    """Metrics of every trained source against every validation source.

    ``gt`` carries its source in ``gt_key``, ``predictions`` in ``pred_key``. The
    sources of one cell become two short maps (at most one entry per source), so
    all combinations come from one aggregation over cells. With ``images`` the pixels of all pages stand for ``n``, which true negatives,
    accuracy and squared error need; they are NULL without.
    """
    flag = lambda key, i, name: F.max(F.when(F.col(key) == name, F.col("v"))).alias(f"_{key}{i}")
    stacked = gt.select(gt_key, F.lit(None).cast("string").alias(pred_key), *CELL, "v").unionByName(
        predictions.select(F.lit(None).cast("string").alias(gt_key), pred_key, *CELL, "v"))
    wide = stacked.groupBy(*CELL).agg(*[flag(gt_key, i, s) for i, s in enumerate(sources)], *[flag(pred_key, i, s) for i, s in enumerate(sources)])
    combos = F.array(*[
        F.struct(F.lit(a).alias(gt_key), F.lit(b).alias(pred_key), F.coalesce(F.col(f"_{gt_key}{i}"), F.lit(0e0)).alias("g"), F.coalesce(F.col(f"_{pred_key}{j}"), F.lit(0e0)).alias("p"))
        for i, a in enumerate(sources) for j, b in enumerate(sources)
    ])
    rows = wide.select("class_id", F.explode(combos).alias("e")).select("class_id", "e.*")
    sums = rows.groupBy(gt_key, pred_key, "class_id").agg(*sums_expr())
    if images is None:
        return derive(sums.withColumn("n", F.lit(None).cast("double")))
    pixels = images.agg(F.sum(F.col("height").cast("double") * F.col("width")).alias("n")).withColumn("_all", F.lit(1))
    return derive(sums.withColumn("_all", F.lit(1)).join(pixels, "_all").drop("_all"))


def leave_one_out(samples: DataFrame, splits: list[str], split: str = "split") -> DataFrame:
    """Training folds ``not<X>``: everything outside split X (no join: each row knows its folds)."""
    folds = F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s != F.col(split))
    return samples.withColumn("left_out", F.explode(folds)).withColumn("fold", F.concat(F.lit("not"), F.col("left_out")))


def pool_authors(samples: DataFrame, author: str = "author", name: str = "image_id") -> DataFrame:
    """All authors in one set, names prefixed by their author."""
    return samples.withColumn(name, F.concat_ws("_", F.col(author), F.col(name).cast("string")))
