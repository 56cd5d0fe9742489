"""Run monitoring on streams of validation rows.

Best scores, snapshots and throughput are additive sums per micro-batch (see ``incremental``), finished on read: complete after any
order of files. ``rolling_metrics`` keeps the last values of each run and class as state and answers at once; it needs rows in step order
over micro-batches, and orders those of one micro-batch in memory, so bound them with the source's trigger limits. Where files may come in any
order, append the rows and run the batch operator on what has been appended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelgrid.operators import monitor as M

WINDOW = 10
METRICS = ["precision", "recall", "f1", "accuracy"]


def _rolling(window: int, metrics: list[str]):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values("step")
        kept = state.get if state.exists else tuple([] for _ in metrics)
        out = new[["run_id", "class_id", "step"]].copy()
        after = []
        for m, old in zip(metrics, kept):
            values = np.concatenate([np.asarray(old, dtype=float), new[m].to_numpy(dtype=float)])
            # windows that reach before the first row see NaN there
            padded = np.concatenate([np.full(window - 1, np.nan), values])
            back = np.lib.stride_tricks.sliding_window_view(padded, window)[len(old):]
            out[f"{m}_mean"], out[f"{m}_std"] = np.nanmean(back, axis=1), np.nanstd(back, axis=1)
            after.append(values[len(values) - min(window - 1, len(values)):].tolist())
        state.update(tuple(after))
        yield out

    return update


def rolling_metrics(stream: DataFrame, window: int = WINDOW, metrics: list[str] = METRICS) -> DataFrame:
    """Mean and deviation of the last ``window`` steps per run and class, as rows arrive."""
    cols = ", ".join(f"{m}_mean double, {m}_std double" for m in metrics)
    state = ", ".join(f"{m} array<double>" for m in metrics)
    rows = stream.select("run_id", "class_id", "step", *metrics)
    return rows.groupBy("run_id", "class_id").applyInPandasWithState(
        _rolling(window, metrics), f"run_id string, class_id int, step long, {cols}", state, "append", GroupStateTimeout.NoTimeout,
    )


def step_sums(rows: DataFrame) -> DataFrame:
    """Additive sums per run and step from ``(run_id, step, f1, loss)`` rows, one row per class."""
    return rows.groupBy("run_id", "step").agg(F.sum("f1").alias("f1_sum"), F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("classes"))


def best_and_snapshots(sums: DataFrame, back: int = 4) -> DataFrame:
    """New-best and snapshot events per run from merged :func:`step_sums`: best by the mean F over classes, snapshot by the mean loss.

    Events depend on order, sums do not: micro-batches only add up sums, in whatever order files arrive, and the windows run over the merged
    table in blocks, so neither a run nor a micro-batch is held by one task.
    """
    steps = sums.select("run_id", "step", (F.col("f1_sum") / F.col("classes")).alias("f1"), (F.col("loss_sum") / F.col("classes")).alias("loss"))
    best = M.best_so_far(steps.select("run_id", "step", "f1"))
    snap = M.snapshot_trigger(steps.select("run_id", "step", "loss"), back).drop("loss")
    return best.join(snap, ["run_id", "step"]).select("run_id", "step", "f1", "best_before", "is_best", "snapshot")


def interval_counts(every: str = "1 hour") -> Callable[[DataFrame], DataFrame]:
    """Additive counts of ``(run_id, ts)`` rows per run and interval of event time, for every micro-batch."""
    def counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("run_id", F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("batches")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "batches")

    return counts


def throughput(counts: DataFrame, batch_size: int = 6) -> DataFrame:
    """Batches and samples per second from merged :func:`interval_counts`; every interval seen so far is there, late rows included."""
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    return counts.select("run_id", "start", "batches", (F.col("batches") / seconds).alias("batches_per_s"), (F.col("batches") * batch_size / seconds).alias("samples_per_s"))
