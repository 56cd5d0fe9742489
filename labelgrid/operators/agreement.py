"""Annotator agreement and consensus from one bit per annotator and cell.

Annotators are a short declared list, so "who marked this cell" is a bitmask.
Cells are grouped once; every pairwise score, cumulative IoU and consensus set
then reads the counts per (page, class, mask) - at most ``2 ** annotators`` rows
per layer - and no pair of annotations is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import ratio
from labelgrid.operators.align import CELL


def _bit(authors: list[str]):
    if len(authors) > 62:
        raise ValueError("at most 62 annotators per mask")
    out = F.lit(None).cast("bigint")
    for i, name in enumerate(authors):
        out = F.when(F.col("author") == name, F.lit(1 << i).cast("bigint")).otherwise(out)
    return out


def author_masks(annotations: DataFrame, authors: list[str]) -> DataFrame:
    """Per cell, which annotators marked it."""
    return annotations.groupBy(*CELL).agg(F.bit_or(_bit(authors)).alias("mask")).where("mask IS NOT NULL")


def mask_counts(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image_id", "class_id", "mask").agg(F.count(F.lit(1)).alias("n"))


def _layers(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)).alias("class_id"))


def annotator_pairs(counts: DataFrame, images: DataFrame, authors: list[str]) -> DataFrame:
    """Scores of every ordered pair of annotators on every page and class.

    Blank against blank agrees (1); F is 0 where precision and recall are 0.
    """
    couples = F.array(*[
        F.struct(F.lit(a).alias("author"), F.lit(b).alias("other"), F.lit(1 << i).cast("bigint").alias("am"), F.lit(1 << j).cast("bigint").alias("bm"))
        for i, a in enumerate(authors) for j, b in enumerate(authors)
    ])
    has = lambda m: F.col("mask").bitwiseAND(F.col(f"e.{m}")) != 0
    take = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = counts.withColumn("e", F.explode(couples)).groupBy("image_id", "class_id", F.col("e.author").alias("author"), F.col("e.other").alias("other")).agg(
        take(has("am") & has("bm")).alias("tp"), take(has("am")).alias("gt"), take(has("bm")).alias("pr"),
    )
    grid = _layers(images).withColumn("e", F.explode(couples)).select("image_id", "class_id", "e.author", "e.other")
    full = grid.join(sums, ["image_id", "class_id", "author", "other"], "left").fillna(0, ["tp", "gt", "pr"])
    tp, gt, pr = (F.col(c) for c in ("tp", "gt", "pr"))
    share = lambda num, den: F.when(den > 0, num / den).otherwise(1e0)
    return full.select(
        "image_id", "class_id", "author", "other", "tp", "gt", "pr", share(tp, pr).alias("precision"), share(tp, gt).alias("recall"), share(tp, gt + pr - tp).alias("iou"),
    ).withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0e0)))


def agreement_report(pairs: DataFrame) -> DataFrame:
    """Mean F and IoU over ordered pairs of different annotators, marked pixels of all; NULL class = overall F."""
    different = F.col("author") != F.col("other")
    by_class = pairs.groupBy("class_id").agg(
        F.avg(F.when(different, F.col("f1"))).alias("mean_f1"), F.avg(F.when(different, F.col("iou"))).alias("mean_iou"),
        F.sum(F.when(~different, F.col("gt"))).alias("pixels"), F.sum(F.when(different, F.col("f1"))).alias("_f"), F.sum(different.cast("bigint")).alias("_k"),
    )
    overall = by_class.agg((F.sum("_f") / F.sum("_k")).alias("mean_f1")).select(
        F.lit(None).cast("int").alias("class_id"), "mean_f1", F.lit(None).cast("double").alias("mean_iou"), F.lit(None).cast("bigint").alias("pixels"),
    )
    return by_class.drop("_f", "_k").unionByName(overall)


def fscore_table(pairs: DataFrame, authors: list[str]) -> DataFrame:
    """F of each annotator (row) against each other one (column) per page and class."""
    return pairs.groupBy("image_id", "class_id", "author").pivot("other", authors).agg(F.first("f1"))


def consensus_layers(masks: DataFrame, authors: list[str]) -> DataFrame:
    """Per cell: mean layer, intersection, conflict (union minus intersection) and one flag per annotator."""
    n = F.bit_count("mask")
    everyone = (1 << len(authors)) - 1
    flags = [F.getbit("mask", F.lit(i)).cast("int").alias(name) for i, name in enumerate(authors)]
    return masks.select(
        *CELL, (n / F.lit(float(len(authors)))).alias("mean"), (F.col("mask") == everyone).cast("int").alias("agreed"), (F.col("mask") != everyone).cast("int").alias("conflict"), *flags,
    )


def cumulative_iou(counts: DataFrame, images: DataFrame, authors: list[str]) -> DataFrame:
    """IoU of the first k annotators, k = 2 .. all."""
    firsts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((1 << k) - 1).cast("bigint").alias("m")) for k in range(2, len(authors) + 1)])
    common = F.col("mask").bitwiseAND(F.col("e.m"))
    sums = counts.withColumn("e", F.explode(firsts)).groupBy("image_id", "class_id", F.col("e.k").alias("n_authors")).agg(
        F.sum(F.when(common == F.col("e.m"), F.col("n")).otherwise(0)).alias("intersection"), F.sum(F.when(common != 0, F.col("n")).otherwise(0)).alias("union_area"),
    )
    grid = _layers(images).withColumn("n_authors", F.explode(F.array(*[F.lit(k) for k in range(2, len(authors) + 1)])))
    return grid.join(sums, ["image_id", "class_id", "n_authors"], "left").fillna(0, ["intersection", "union_area"]).withColumn(
        "iou", F.when(F.col("union_area") > 0, F.col("intersection") / F.col("union_area")).otherwise(1e0)
    )


def consensus_sets(masks: DataFrame, authors: list[str], subsets: dict[str, list[str]]) -> DataFrame:
    """Training layers agreed by all, or marked by any, of each named group of annotators."""
    named = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(sum(1 << authors.index(a) for a in group)).cast("bigint").alias("m")) for name, group in subsets.items()
    ])
    common = F.col("mask").bitwiseAND(F.col("e.m"))
    return masks.withColumn("e", F.explode(named)).where(common != 0).select(
        F.col("e.name").alias("authors"), *CELL, (common == F.col("e.m")).cast("int").alias("in_intersection"), F.lit(1).alias("in_union"),
    )
