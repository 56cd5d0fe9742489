"""Rolling metrics of run histories whose rows arrive late and out of order.

Every run and class keeps a buffer of rows sorted by step: all rows newer than the watermark, and the ``window - 1`` rows before them. A new
row takes its place in the buffer, and it and the rows whose window it enters are answered (again) at once, so an answer is a
version: readers take the one of the last micro-batch (:func:`latest`). A timer of event time trims the buffer when the watermark has
passed its rows, so state is bounded by the rows of one delay and a window, however long a run is. Rows older than the watermark are
dropped by Spark, which is what the delay says. The buffers of many runs share one key of state (:class:`RollingBuckets`), as a call of
Python for each run costs more than its rows.

Steps of a run and class must rise with event time; rows that repeat a step replace the earlier one while it is buffered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from labelgrid.streaming.monitor import METRICS, WINDOW

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Runs and classes are dealt to this many keys of state by a hash, so that a call of Python and its state calls serve many of them.
BUCKETS = 1024
#: Rows in one entry of a bucket's state.
ENTRY_ROWS = 100_000
IDS = ["run_id", "class_id"]


def in_order(rows: pd.DataFrame, ids: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by run and step, the last of those that repeat a step, and the number of each row's run (0, 1, ..)."""
    codes = rows.groupby(ids, dropna=False, sort=False).ngroup().to_numpy() if ids else np.zeros(len(rows), np.int64)
    step = rows["step"].to_numpy()
    order = np.lexsort((step, codes))
    codes, step = codes[order], step[order]
    last = np.ones(len(rows), bool)
    last[:-1] = (codes[1:] != codes[:-1]) | (step[1:] != step[:-1])
    return rows.iloc[order[last]].reset_index(drop=True), codes[last]


def answers(rows: pd.DataFrame, codes: np.ndarray, fresh: np.ndarray, ids: list[str], metrics: list[str], window: int) -> pd.DataFrame:
    """Mean and deviation of each window in which a fresh row stands; ``rows`` and ``codes`` as from ``in_order``."""
    starts = np.searchsorted(codes, codes)
    # A row answers again if a new row stands in its window.
    news = np.concatenate([[0], np.cumsum(fresh)])
    at = np.arange(len(rows))
    seen = np.flatnonzero(news[1:] > news[np.maximum(starts, at - window + 1)])
    back = seen[:, None] + np.arange(1 - window, 1)
    outside = back < starts[seen][:, None]
    out = rows.iloc[seen][[*ids, "step"]].reset_index(drop=True)
    for m in metrics:
        values = rows[m].to_numpy(dtype=float)[np.maximum(back, 0)]
        values[outside] = np.nan
        out[f"{m}_mean"], out[f"{m}_std"] = np.nanmean(values, axis=1), np.nanstd(values, axis=1)
    return out


def trimmed(rows: pd.DataFrame, codes: np.ndarray, window: int, watermark: int) -> tuple[pd.DataFrame, int | None]:
    """Of each run the rows above the watermark and ``window - 1`` before, and when the last of them falls under it."""
    ms = rows["ms"].to_numpy()
    newer = np.flatnonzero(ms > watermark)
    first = np.searchsorted(codes, codes, "right")  # where the run ends, if it has no newer row
    of_run = np.full(codes.max() + 1 if len(codes) else 0, len(rows))
    of_run[codes[newer][::-1]] = newer[::-1]
    first = np.minimum(first, of_run[codes])
    return rows[np.arange(len(rows)) >= first - window + 1], int(ms[newer].max()) + 1 if len(newer) else None


class RollingBuffer(StatefulProcessor):
    """The buffer of one run and class, a row of state for each of its rows."""

    ids: list[str] = []

    def __init__(self, window: int, metrics: list[str]):
        self.window, self.metrics = window, metrics

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{m} double" for m in self.metrics)
        self.handle, self.rows = handle, handle.getListState("rows", f"step long, ms long, {fields}")

    def kept(self) -> pd.DataFrame:
        rows = list(self.rows.get()) if self.rows.exists() else []
        return pd.DataFrame([tuple(r) for r in rows], columns=["step", "ms", *self.metrics]).astype({m: float for m in self.metrics})

    def entries(self, rows: pd.DataFrame) -> list[tuple]:
        return [tuple(r) for r in rows.astype(object).itertuples(index=False, name=None)]

    def store(self, rows: pd.DataFrame, codes: np.ndarray, watermark: int) -> None:
        """Rows above the watermark and ``window - 1`` before; a timer for when the last of them falls under it."""
        rows, due = trimmed(rows, codes, self.window, watermark)
        self.rows.put(self.entries(rows))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[[*self.ids, "step", "ms", *self.metrics]] for r in rows], ignore_index=True).assign(fresh=True)
        old = self.kept()
        every, codes = in_order(pd.concat([old.assign(fresh=False), new], ignore_index=True) if len(old) else new, self.ids)
        fresh = every["fresh"].to_numpy(dtype=bool)
        every = every.drop(columns="fresh")
        out = answers(every, codes, fresh, self.ids, self.metrics, self.window)
        if not self.ids:
            out = pd.concat([pd.DataFrame({"run_id": key[0], "class_id": key[1]}, index=out.index), out], axis=1)
        self.store(every, codes, timerValues.getCurrentWatermarkInMs())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.store(*in_order(self.kept(), self.ids), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


class RollingBuckets(RollingBuffer):
    """The buffers of all runs and classes of a bucket; its rows are kept as Arrow streams of many rows each."""

    ids = IDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "part binary")
        kinds = {"run_id": pa.string(), "class_id": pa.int32(), "step": pa.int64(), "ms": pa.int64()} | dict.fromkeys(self.metrics, pa.float64())
        self.schema = pa.schema(list(kinds.items()))

    def kept(self) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(r[0]).read_all() for r in self.rows.get()] if self.rows.exists() else []
        return pa.concat_tables([self.schema.empty_table(), *parts]).to_pandas()

    def entries(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for at in range(0, len(rows), ENTRY_ROWS):
            part = pa.Table.from_pandas(rows.iloc[at : at + ENTRY_ROWS], self.schema, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as stream:
                stream.write_table(part.replace_schema_metadata(None))
            out.append((sink.getvalue().to_pybytes(),))
        return out


def rolling_metrics(stream: DataFrame, delay: str, window: int = WINDOW, metrics: list[str] = METRICS) -> DataFrame:
    """Versions of the mean and deviation over the last ``window`` steps per run and class, from rows (run_id, class_id, step, ts, metrics)
    that arrive at most ``delay`` late. The session needs the RocksDB state store (:func:`start` sees to it)."""
    cols = ", ".join(f"{m}_mean double, {m}_std double" for m in metrics)
    ids = [F.col("run_id").cast("string").alias("run_id"), F.col("class_id").cast("int").alias("class_id")]
    values = [F.col("step").cast("long").alias("step"), "ts", F.unix_millis("ts").alias("ms"), *(F.col(m).cast("double").alias(m) for m in metrics)]
    bucket = F.pmod(F.xxhash64(*ids), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = stream.withWatermark("ts", delay).select(bucket, *ids, *values)
    return rows.groupBy("bucket").transformWithStateInPandas(RollingBuckets(window, metrics), f"run_id string, class_id int, step long, {cols}", "Update", "EventTime")


def start(versions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch's versions to a folder of its own under ``path`` until the input is drained; a repeated batch overwrites its folder."""
    spark = versions.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return versions.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
