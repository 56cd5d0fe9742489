"""Streams with late rows (rolling metrics) and replaced pages (sums with retraction)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import classes as C
from labelgrid.operators import metrics as M
from labelgrid.operators import monitor
from labelgrid.plans import views as V
from labelgrid.streaming import incremental as I
from labelgrid.streaming import pages as P
from labelgrid.streaming import rolling as R


class Cell:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


class Handle:
    """What the processor needs of Spark's handle: one list and its timers."""

    def __init__(self):
        self.cell, self.timers = Cell(), set()

    def getListState(self, name, schema):
        return self.cell

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def plain(values, window):
    return [(np.mean(values[max(0, i - window + 1) : i + 1]), np.std(values[max(0, i - window + 1) : i + 1])) for i in range(len(values))]


@pytest.mark.parametrize("seed", range(4))
def test_buffer_is_bounded_and_answers_are_final(seed):
    """2000 rows at most 60 ms late, in batches of 25: the last answers are those of the sorted history, and the buffer holds the rows of one
    delay and a window, not the history."""
    rng, window, delay = np.random.default_rng(seed), 5, 60
    values = rng.random(2000)
    arrival = np.argsort(np.arange(2000) + rng.uniform(0, delay - 1, 2000), kind="stable")
    handle, processor = Handle(), R.RollingBuffer(window, ["f1"])
    processor.init(handle)
    answers, watermark, most = {}, 0, 0
    for at in range(0, 2000, 25):
        steps = arrival[at : at + 25]
        rows = pd.DataFrame({"run_id": "r", "class_id": 0, "step": steps, "ms": 1000 + steps, "f1": values[steps]})
        assert (rows["ms"] > watermark).all()
        for out in processor.handleInputRows(("r", 0), iter([rows]), Clock(watermark)):
            answers |= dict(zip(out["step"], zip(out["f1_mean"], out["f1_std"])))
        watermark = max(watermark, int(rows["ms"].max()) - delay)
        most = max(most, len(handle.cell.rows))
        assert len(handle.timers) == 1
    want = plain(values, window)
    assert len(answers) == 2000 and all(answers[i] == pytest.approx(want[i], abs=1e-12) for i in range(2000))
    assert most <= 2 * delay + 25 + window
    # When the watermark passes all rows, the timer leaves the window's rows and no timer.
    list(processor.handleExpiredTimer(("r", 0), Clock(5000), None))
    assert len(handle.cell.rows) == window - 1 and not handle.timers


def test_repeated_steps_replace_and_others_stay():
    handle, processor = Handle(), R.RollingBuffer(3, ["f1"])
    processor.init(handle)
    feed = lambda *rows: pd.concat(list(processor.handleInputRows(("r", 0), iter([pd.DataFrame(rows, columns=["step", "ms", "f1"])]), Clock(0))))
    assert feed((1, 1, 1.0), (3, 3, 3.0), (4, 4, 4.0), (9, 9, 9.0))["f1_mean"].tolist() == [1, 2, pytest.approx(8 / 3), pytest.approx(16 / 3)]
    late = feed((2, 2, 5.0))
    assert late["step"].tolist() == [2, 3, 4] and late["f1_mean"].tolist() == [3, 3, 4]
    again = feed((9, 9, 0.0))
    assert again["step"].tolist() == [9] and again["f1_mean"].tolist() == [pytest.approx(7 / 3)]


def test_a_bucket_answers_as_its_runs_do():
    """Runs of one bucket, with late rows, repeated steps and runs without name or class: one call gives what a buffer for each run gives."""
    rng, shared = np.random.default_rng(4), Handle()
    bucket, single = R.RollingBuckets(3, ["f1", "loss"]), {}
    bucket.init(shared)
    assert list(bucket.handleExpiredTimer((0,), Clock(1), None)) == []
    watermark, left, right = 0, {}, {}
    plainly = lambda v: None if v is None or v != v else v if isinstance(v, str) else int(v)
    told = lambda out: {tuple(map(plainly, r[:3])): tuple(map(str, r[3:])) for r in out.itertuples(index=False, name=None)}
    for at in range(0, 120, 10):
        rows = pd.DataFrame({"bucket": 0, "run_id": rng.choice(["a", "b", None], 60), "class_id": rng.choice([0, 1, None], 60), "step": rng.integers(at, at + 25, 60), "f1": rng.random(60), "loss": rng.random(60)})
        rows["ms"] = 1000 + rows["step"]
        rows.loc[rng.integers(60), "loss"] = np.nan
        rows = rows[rows["ms"] > watermark]
        for out in bucket.handleInputRows((0,), iter([rows.iloc[:20], rows.iloc[20:]]), Clock(watermark)):
            left |= told(out)
        for key, own in rows.groupby(["run_id", "class_id"], dropna=False):
            key = tuple(map(plainly, key))
            if key not in single:
                single[key] = Handle(), R.RollingBuffer(3, ["f1", "loss"])
                single[key][1].init(single[key][0])
            for out in single[key][1].handleInputRows(key, iter([own]), Clock(watermark)):
                right |= told(out)
        watermark = 1000 + at - 5
    assert left == right and len(single) == 9
    assert len(shared.cell.rows) == 1 and len(shared.timers) == 1
    list(bucket.handleExpiredTimer((0,), Clock(9999), None))
    assert len(bucket.kept()) == 9 * 2 and not shared.timers
    bucket.rows.put([])
    assert bucket.kept().empty


COLUMNS = ["run_id", "class_id", "step", "precision", "recall", "f1", "accuracy", "ts"]


def rolled(spark, path, schema, delay, tmp_path, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = R.start(R.rolling_metrics(stream, delay), str(tmp_path / name / "out"), str(tmp_path / name / "ckpt"))
    query.awaitTermination()
    return R.latest(spark, str(tmp_path / name / "out"), ["run_id", "class_id", "step"]), query


def test_files_in_no_order_equal_the_batch(spark, sf, tmp_path):
    """Four micro-batches of shuffled files: as the batch operator says; with a short delay the rows that are too late are missing."""
    df = V.run_metrics(spark, sf).withColumn("ts", F.timestamp_micros("ts_us")).select(*COLUMNS)
    path = str(tmp_path / "runs")
    for k in (2, 0, 3, 1):
        df.where(F.pmod(F.xxhash64("step"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
    provider = spark.conf.get(R.PROVIDER)
    got, query = rolled(spark, path, df.schema, "40 days", tmp_path, "all")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4 and spark.conf.get(R.PROVIDER) == provider
    key = ["run_id", "class_id", "step"]
    left, right = ({tuple(r[k] for k in key): r.asDict() for r in x.collect()} for x in (got, monitor.rolling_metrics(df).select(*got.columns)))
    assert left.keys() == right.keys() and all(left[k] == pytest.approx(right[k], abs=1e-9) for k in left)
    short, _ = rolled(spark, path, df.schema, "1 hour", tmp_path, "short")
    assert 0 < short.count() < df.count()


def deliveries(spark, sf):
    """Pages in three versions each, one row a page: the last as the tables say, the earlier ones with other cells."""
    images = V.images(spark, sf)
    cells = M.binarize(V.pairs(spark, sf), 0.5, 0.5)
    page = images.join(cells.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", "class_id", "g", "p")).alias("cells")), "image_id")
    wrong = [F.transform("cells", lambda c: F.struct(c["y"], c["x"], ((c["class_id"] + 1) % 3).alias("class_id"), c["p"].alias("g"), c["g"].alias("p"))), F.slice("cells", 1, 3), F.col("cells")]
    return [page.withColumns({"version": F.lit(k).cast("long"), "cells": w}) for k, w in enumerate(wrong)], cells, images


def exploded(pages):
    return pages.select("image_id", F.explode("cells").alias("c")).select("image_id", "c.*")


def confusion(pages):
    return M.confusion(exploded(pages).where("g <> 0 OR p <> 0"), pages)


def table(df, *keys):
    return {tuple(r[k] for k in keys): r[-1] for r in df.collect()}


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 2, 0)])
def test_replaced_pages_equal_the_last_versions(spark, sf, tmp_path, order):
    """Any order of versions, batches that repeat, a base every two batches: totals and page sums of the newest versions."""
    versions, cells, images = deliveries(spark, sf)
    some = lambda v, k: versions[v].where(F.pmod("image_id", F.lit(2)) == k)
    batches = [some(v, k) for v in order for k in (0, 1)]
    batches.append(versions[0].unionByName(versions[2]))  # one batch with two versions of a page
    total = P.PageSums(spark, str(tmp_path / "conf"), confusion, ["gt_class", "pred_class"], versions[0], compact=2)
    for k, batch in enumerate(batches):
        total.write(batch, k)
        if k % 3 == 1:
            total.write(batch, k)
    want = table(M.confusion_total(M.confusion(cells, images)), "gt_class", "pred_class")
    assert table(total.total().select("gt_class", "pred_class", "v"), "gt_class", "pred_class") == pytest.approx(want)
    want = table(M.confusion(cells, images).where("v <> 0"), "image_id", "gt_class", "pred_class")
    assert table(total.by_page().where("v <> 0"), "image_id", "gt_class", "pred_class") == pytest.approx(want)


def test_class_index_of_a_stream_with_replaced_pages(spark, sf, tmp_path):
    versions, cells, _ = deliveries(spark, sf)
    for part in (versions[0], versions[2], versions[1]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    sums = P.PageSums(spark, str(tmp_path / "index"), lambda pages: I.index_counts(exploded(pages)), ["class_id"], versions[0], compact=2)
    stream = spark.readStream.schema(versions[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    sums.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    index = C.class_index(cells.withColumnRenamed("g", "v"))
    assert table(sums.by_page().select("class_id", "image_id", "n_pixels"), "class_id", "image_id") == table(index, "class_id", "image_id")
    want = table(index.groupBy("class_id").agg(F.sum("n_pixels").alias("n")), "class_id")
    assert table(sums.total().select("class_id", "n_pixels"), "class_id") == want
    # A page that turns blank takes its pixels out.
    first = versions[2].limit(1).withColumns({"version": F.lit(9).cast("long"), "cells": F.slice("cells", 1, 0)})
    sums.write(first, 3)
    gone = first.first().image_id
    assert sums.by_page().where(F.col("image_id") == gone).count() == 0
    left = table(index.where(F.col("image_id") != gone).groupBy("class_id").agg(F.sum("n_pixels").alias("n")), "class_id")
    assert {k: v for k, v in table(sums.total().select("class_id", "n_pixels"), "class_id").items() if v} == left
