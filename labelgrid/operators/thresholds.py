"""Threshold search in one pass: histogram by threshold, then suffix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import harmonic, smart_div, total
from labelgrid.operators.banding import merge_rows

STEPS = 20


def threshold_sweep(pairs: DataFrame, steps: int = STEPS, by: list[str] = ("class_id",)) -> DataFrame:
    """Precision, recall and F of ``p >= t`` for t = 1/steps .. (steps-1)/steps.

    Each cell is counted once, at the highest threshold it reaches; sums for a
    threshold are the sums of all buckets at or above it. The page data is
    shuffled once whatever the number of thresholds; the ordered step sees at
    most ``steps`` rows per class.
    """
    by = list(by)
    reached = total([(F.col("p") >= k / steps).cast("int") for k in range(1, steps)])
    hist = pairs.groupBy(*by, reached.alias("k")).agg(
        F.sum("g").alias("g"), F.count(F.lit(1)).cast("double").alias("n"),
    )
    # at most `steps` buckets per class meet in one array; thresholds no cell stops at get a row as well
    gathered = hist.groupBy(*by).agg(F.collect_list(F.struct("k", "g", "n")).alias("h"))
    upward = lambda k, m: F.aggregate(F.filter("h", lambda e: e["k"] >= k), F.lit(0e0), lambda a, e: a + e[m])
    sums = gathered.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select(
        *by, "k", upward(F.col("k"), "g").alias("tp"), upward(F.col("k"), "n").alias("pred_mass"), upward(F.lit(0), "g").alias("gt_mass"),
    )
    return sums.select(
        *by, (F.col("k") / F.lit(float(steps))).alias("threshold"), "tp", "pred_mass", "gt_mass",
        smart_div(F.col("tp"), F.col("pred_mass")).alias("precision"), smart_div(F.col("tp"), F.col("gt_mass")).alias("recall"),
    ).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def best_thresholds(sweep: DataFrame, by: list[str] = ("class_id",)) -> DataFrame:
    """Lowest threshold with the highest positive F per class."""
    top = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt"))).alias("best")
    return sweep.where("f1 > 0").groupBy(*by).agg(top).select(*by, (-F.col("best.nt")).alias("threshold"), F.col("best.f1").alias("f1"))


def best_overall(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """Gains of one tuned threshold over the default, and of class-wise thresholds over it."""
    overall = sweep.groupBy("threshold").agg(F.avg("f1").alias("f1"))
    best = overall.agg(
        F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt"))).alias("best"),
        F.max(F.when(F.abs(F.col("threshold") - default) < 1e-9, F.col("f1"))).alias("default_f1"),
    ).select((-F.col("best.nt")).alias("threshold"), F.col("best.f1").alias("f1"), "default_f1")
    by_class = sweep.groupBy("class_id").agg(F.max("f1").alias("f1")).agg(F.avg("f1").alias("class_f1"))
    return merge_rows(best, by_class).select(
        "threshold", "f1", (F.col("f1") - F.col("default_f1")).alias("gain_over_default"), "class_f1",
        (F.col("class_f1") - F.col("f1")).alias("gain_by_class"),
    )


def sweep_values(df: DataFrame, values: list[float], column: str = "threshold") -> DataFrame:
    """Repeat rows once per threshold of a literal list (no join)."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def level_bits(value: Column, levels: list[float]) -> Column:
    """Bit k is set where ``value`` reaches the k-th of ``levels`` (at most 62)."""
    return total([F.when(value >= float(v), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, v in enumerate(levels)])


def on_level(bits: str, levels: list[float], column: str = "threshold") -> Column:
    """Whether the bit of a row's level, named by :func:`sweep_values`, is set."""
    at = F.array_position(F.array(*[F.lit(float(v)) for v in levels]), F.col(column)) - 1
    return F.getbit(bits, at.cast("int")) == 1
