import numpy as np
import pytest
from dense import cells, images, layer
from pyspark.sql import functions as F

from labelgrid.operators import monitor as M
from labelgrid.operators.metrics import sums_expr
from labelgrid.plans import jobs as J
from labelgrid.plans import views as V
from labelgrid.streaming import incremental as I
from labelgrid.streaming import monitor as S

COLUMNS = ["run_id", "class_id", "step", "precision", "recall", "f1", "accuracy", "loss", "ts"]


@pytest.fixture(scope="module")
def history(spark, sf, tmp_path_factory):
    """The run history in five files, in order of time, and as a table."""
    path = str(tmp_path_factory.mktemp("runs"))
    df = V.run_metrics(spark, sf).withColumn("ts", F.timestamp_micros("ts_us")).select(*COLUMNS)
    bounds = [r[0] for r in df.selectExpr("explode(percentile(step, array(0.2, 0.4, 0.6, 0.8)))").collect()]
    edges = [-1, *bounds, 1 << 60]
    for lo, hi in zip(edges, edges[1:]):
        df.where((F.col("step") > lo) & (F.col("step") <= hi)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, out, tmp_path):
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def same(a, b, keys, tol=1e-9):
    left, right = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k in left:
        assert left[k].asDict() == pytest.approx(right[k].asDict(), abs=tol)


def test_rolling_stream_equals_batch(spark, history, tmp_path):
    path, df = history
    out = run(spark, S.rolling_metrics(stream(spark, path, df.schema)), tmp_path)
    same(out, M.rolling_metrics(df).select(*out.columns), ["run_id", "class_id", "step"])


@pytest.fixture(scope="module")
def shuffled(history, tmp_path_factory):
    """The same rows in five files in no order of time."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    for k in range(5):
        history[1].where(F.pmod(F.xxhash64("step"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(path)
    return path, history[1]


def gathered(spark, path, schema, partial, keys, tmp_path):
    I.accumulate(stream(spark, path, schema), partial, str(tmp_path / "sums"), str(tmp_path / "ckpt")).awaitTermination()
    return I.merged(spark, str(tmp_path / "sums"), keys)


def test_events_stream_equals_batch(spark, shuffled, tmp_path):
    path, df = shuffled
    out = S.best_and_snapshots(gathered(spark, path, df.schema, S.step_sums, ["run_id", "step"], tmp_path))
    steps = df.groupBy("run_id", "step").agg(F.avg("f1").alias("f1"), F.avg("loss").alias("loss"))
    best = M.best_so_far(steps.select("run_id", "step", "f1"))
    snap = M.snapshot_trigger(steps.select("run_id", "step", "loss"))
    same(out, best.join(snap.drop("loss"), ["run_id", "step"]).select(*out.columns), ["run_id", "step"])


def test_throughput_stream_is_complete(spark, shuffled, tmp_path):
    path, df = shuffled
    out = S.throughput(gathered(spark, path, df.schema, S.interval_counts("1 day"), ["run_id", "start", "end"], tmp_path)).collect()
    want = {(r["run_id"], r["w"]["start"]): r["count"] for r in df.groupBy("run_id", F.window("ts", "1 day").alias("w")).count().collect()}
    assert {(r["run_id"], r["start"]): r["batches"] for r in out} == want


def test_incremental_sums_equal_batch(spark, sf, tmp_path):
    pairs = V.pairs(spark, sf)
    src = str(tmp_path / "cells")
    pairs.repartition(4).write.parquet(src)
    sums, index = str(tmp_path / "sums"), str(tmp_path / "index")
    I.accumulate(stream(spark, src, pairs.schema), I.confusion_counts, sums, str(tmp_path / "c1")).awaitTermination()
    I.accumulate(stream(spark, src, pairs.schema), I.index_counts, index, str(tmp_path / "c2")).awaitTermination()
    same(I.merged(spark, sums, ["class_id"]), pairs.groupBy("class_id").agg(*sums_expr()), ["class_id"])
    same(I.merged(spark, index, ["class_id", "image_id"]), I.index_counts(pairs), ["class_id", "image_id"])


def test_score_images(spark):
    def halve(tile):
        return tile[:, :, :2] / 2 + (tile.sum() == 0) * 0.25

    rng = np.random.default_rng(0)
    a = rng.random((40, 20, 3)) + 0.01
    intensity = cells(spark, a).withColumnRenamed("class_id", "c")
    blank = spark.createDataFrame([("e", 8, 8, 2)], "image_id string, height int, width int, n_classes int")
    both = images(spark, a).unionByName(blank)
    out = J.score_images(intensity, both, halve, size=16, stride=8)
    got = out.where("image_id = 'i' AND class_id = 1")
    assert np.allclose(layer(got, (40, 20)), a[:, :, 1] / 2)
    # a page without any intensity row is scored as well, and padding is cut off
    empty = out.where("image_id = 'e'").collect()
    assert len(empty) == 8 * 8 * 2 and {r["v"] for r in empty} == {0.25}


def test_validate_and_preops(spark):
    a = np.zeros((20, 20, 3))
    a[2:9, 3:7, 0] = 1
    gt = cells(spark, a[:, :, :2])
    intensity = cells(spark, a).withColumnRenamed("class_id", "c")
    rows = {r["class_id"]: r["f1"] for r in J.validate(gt, intensity, images(spark, a[:, :, :2]), lambda t: t[:, :, :2], size=16, stride=8).collect()}
    # class 1 is blank on both sides: precision and recall 1
    assert rows[0] == 1.0 and rows[1] == 1.0
    both = J.with_preops(gt, gt, gt_ops=[lambda d: d.withColumn("v", F.col("v") / 4)]).first()
    assert (both["g"], both["p"]) == (0.25, 1.0)
