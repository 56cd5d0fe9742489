"""Run monitoring: count-based windows over run histories, in bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.arith import ratio
from labelgrid.operators.banding import lookback_window, row_index, running_before

WINDOW = 10
HISTORY = 30
METRICS = ["precision", "recall", "f1", "accuracy"]


def rolling_metrics(history: DataFrame, metrics: list[str] = METRICS, window: int = WINDOW) -> DataFrame:
    """Mean and population deviation over the last ``window`` steps per run and class."""
    keys = ["run_id", "class_id"]
    indexed = row_index(history, keys, "step")

    def cols(w):
        back = w.rowsBetween(1 - window, 0)
        return {f"{m}_{s}": f(m).over(back) for m in metrics for s, f in (("mean", F.avg), ("std", F.stddev_pop))}

    return lookback_window(indexed, keys, window - 1, cols).select(*keys, "step", *[f"{m}_{s}" for m in metrics for s in ("mean", "std")])


def smoothed_loss(losses: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean loss of the last ``window`` steps of a run."""
    indexed = row_index(losses, ["run_id"], "step")
    out = lookback_window(indexed, ["run_id"], window - 1, lambda w: {"smoothed": F.avg("loss").over(w.rowsBetween(1 - window, 0))})
    return out.select("run_id", "step", "loss", "smoothed")


def macro_scores(history: DataFrame) -> DataFrame:
    """Mean F over the classes of a step."""
    return history.groupBy("run_id", "step").agg(F.avg("f1").alias("f1"))


def best_so_far(macro: DataFrame) -> DataFrame:
    """Best earlier macro F (0 at first) and whether the step beats it strictly."""
    indexed = row_index(macro, ["run_id"], "step")
    best = F.coalesce("_best", F.lit(0e0))
    out = running_before(indexed, ["run_id"], "f1", "_best", F.max)
    return out.select("run_id", "step", "f1", F.greatest(best, F.lit(0e0)).alias("best_before"), (F.col("f1") > F.greatest(best, F.lit(0e0))).alias("is_best"))


def snapshot_trigger(losses: DataFrame, back: int = 4) -> DataFrame:
    """Steps whose loss is below each of the previous ``back``; the first ``back`` steps never are."""
    indexed = row_index(losses, ["run_id"], "step")
    # the smallest of the previous rows is all that matters
    prev = lookback_window(indexed, ["run_id"], back, lambda w: {"_min": F.min("loss").over(w.rowsBetween(-back, -1))})
    return prev.select("run_id", "step", "loss", ((F.col("idx") >= back) & (F.col("loss") < F.col("_min"))).alias("snapshot"))


def throughput(batches: DataFrame, batch_size: int = 6, width: int = 224) -> DataFrame:
    """Batch duration and rates, current and since the start of the run.

    ``batches (run_id, step, ts_us)``; durations telescope, so the running total
    is the time since the run's first row and needs no running sum.
    """
    indexed = row_index(batches, ["run_id"], "step", firsts={"start_us": F.min("ts_us")})
    timed = lookback_window(indexed, ["run_id"], 1, lambda w: {"_prev": F.lag("ts_us").over(w)})
    took = (F.col("ts_us") - F.col("_prev")) / F.lit(1e6)
    total = (F.col("ts_us") - F.col("start_us")) / F.lit(1e6)
    per_second = ratio(F.col("idx").cast("double"), total)
    return timed.where("idx > 0").select(
        "run_id", "step", took.alias("batch_seconds"), per_second.alias("batches_per_s"), (per_second * batch_size).alias("samples_per_s"),
        (per_second * (batch_size * width * width / 1e6)).alias("megapixels_per_s"), ratio(F.lit(1e0), took).alias("current_batches_per_s"),
        ratio(F.lit(float(batch_size)), took).alias("current_samples_per_s"),
    )


def threshold_history(samples: DataFrame, window: int = HISTORY, literal: bool = False) -> DataFrame:
    """Pixel-weighted mean of the best thresholds of the last ``window`` samples per class.

    ``literal`` divides the mean instead of the sum of the weighted thresholds
    by the pixels. Samples without pixels of the class do not count.
    """
    keys = ["run_id", "class_id"]
    indexed = row_index(samples.where("pixels > 0"), keys, "step").withColumn("_w", F.col("pixels") * F.col("threshold"))
    fold = F.avg if literal else F.sum

    def cols(w):
        back = w.rowsBetween(1 - window, 0)
        return {"averaged_threshold": fold("_w").over(back) / F.sum("pixels").over(back)}

    return lookback_window(indexed, keys, window - 1, cols).select(*keys, "step", "averaged_threshold")
