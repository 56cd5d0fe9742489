import numpy as np
import pytest
from dense import cells, images, stack
from pyspark.sql import functions as F

from labelgrid.operators import metrics as M
from labelgrid.operators.align import align, common_extent
from labelgrid.operators.align import abs_diff

PRED = stack([[0, 0], [1, 1]], [[1, 1], [0, 0]], [[0, 0], [0, 1]], [[1, 1], [1, 0]])
GT = stack([[0, 1], [0, 0]], [[1, 0], [0, 0]], [[0, 0], [0, 0]], [[1, 1], [1, 0]])
GT2 = stack([[0, 1], [0, 1]], [[1, 0], [0, 0]], [[0, 0], [0, 0]], [[1, 1], [1, 0]])


def by_class(df, col):
    return [r[col] for r in df.orderBy("class_id").collect()]


def test_confusion_golden(spark):
    pairs = align(cells(spark, GT), cells(spark, PRED))
    out = np.zeros((5, 5))
    for r in M.confusion(pairs, images(spark, GT)).collect():
        out[r["gt_class"], r["pred_class"]] = r["v"]  # -1 is the last row / column
    assert out.tolist() == [[0, 1, 0, 1, 0], [0, 1, 0, 1, 0], [0, 0, 0, 0, 0], [1, 2, 0, 3, 0], [1, 0, 1, 0, 0]]


def test_f1_and_iou_goldens(spark):
    m = M.metrics_by_class(align(cells(spark, GT2), cells(spark, PRED)), images(spark, GT2))
    assert by_class(m, "f1") == pytest.approx([0.5, 2 / 3, 0, 1])
    assert by_class(m, "iou") == pytest.approx([1 / 3, 1 / 2, 0, 1])


def test_weighted_golden(spark):
    gt, pred = np.array([[[0, 1, 0, 1], [0, 1, 1, 0]]]), np.array([[[1, 0, 0, 1], [0, 1, 0, 1]]])
    wr = spark.createDataFrame([("i", 0, 0, 2.0), ("i", 0, 1, 0.5)], "image_id string, y int, x int, w double")
    wp = spark.createDataFrame([("i", 0, 0, 1.0), ("i", 0, 1, 0.2)], "image_id string, y int, x int, w double")
    m = M.weighted_metrics(align(cells(spark, gt), cells(spark, pred)), images(spark, gt), wp, wr)
    # a class without truth recalls everything (0/0 = 1)
    assert by_class(m, "w_recall") == pytest.approx([1, 0.5 / 2.5, 0, 1])
    assert by_class(m, "w_precision") == pytest.approx([0, 1, 1, 1 / 1.2])


def test_planted_counts(spark):
    rng = np.random.default_rng(1234)
    gt, pred = np.zeros((10, 10, 6)), np.zeros((10, 10, 6))
    want = []
    for c in range(6):
        spots = rng.permutation(100)
        tp, fp, fn = (int(v) for v in rng.integers(0, 30, 3)) if c else (0, 0, 0)
        for i, s in enumerate(spots[: tp + fp + fn]):
            gt[s // 10, s % 10, c] = i < tp or i >= tp + fp
            pred[s // 10, s % 10, c] = i < tp + fp
        want.append((tp, fp, fn))
    rows = M.metrics_by_image(align(cells(spark, gt), cells(spark, pred)), images(spark, gt)).orderBy("class_id").collect()
    for r, (tp, fp, fn) in zip(rows, want):
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, 100 - tp - fp - fn)
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 1)
        assert r["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 1)
        assert r["accuracy"] == pytest.approx((100 - fp - fn) / 100)


def test_soft_values_match_dense_arithmetic(spark):
    rng = np.random.default_rng(5)
    g, p = rng.random((6, 7, 3)) * (rng.random((6, 7, 3)) > 0.5), rng.random((6, 7, 3)) * (rng.random((6, 7, 3)) > 0.4)
    rows = M.metrics_by_image(align(cells(spark, g), cells(spark, p)), images(spark, g)).orderBy("class_id").collect()
    for c, r in enumerate(rows):
        a, b = g[:, :, c], p[:, :, c]
        assert r["tn"] == pytest.approx(((1 - a) * (1 - b)).sum())
        assert r["fp"] == pytest.approx(((1 - a) * b).sum())
        assert r["mse"] == pytest.approx(((a - b) ** 2).mean())
        assert r["abs_err"] == pytest.approx(np.abs(a - b).sum())


def test_no_truth(spark):
    gt, pred = np.zeros((4, 4, 2)), np.zeros((4, 4, 2))
    pred[0, 0, 1] = 1
    r = M.metrics_by_image(align(cells(spark, gt), cells(spark, pred)), images(spark, gt)).orderBy("class_id").collect()
    assert [(x["precision"], x["recall"]) for x in r] == [(1, 1), (0, 1)]
    assert [x["image_id"] for x in M.blank_truth(align(cells(spark, gt), cells(spark, pred)), images(spark, gt)).collect()] == ["i"]


def test_align_trims_to_the_common_extent(spark):
    gt, pred = np.ones((4, 5, 2)), np.ones((3, 9, 3))
    both = align(cells(spark, gt), cells(spark, pred), common_extent(images(spark, gt), images(spark, pred)))
    rows = both.collect()
    assert len(rows) == 3 * 5 * 2 and all(r["g"] == 1 and r["p"] == 1 for r in rows)
    assert abs_diff(both).count() == 0


def test_binarize_is_strict_and_class_thresholds_override(spark):
    p = np.array([[[0.5, 0.3]]])
    pairs = align(cells(spark, np.zeros((1, 1, 2))), cells(spark, p))
    assert M.binarize(pairs, 0.5, 0.5).count() == 0
    t = spark.createDataFrame([(1, 0.2)], "class_id int, threshold double")
    assert [(r["class_id"], r["p"]) for r in M.binarize(pairs, None, 0.5, t).collect()] == [(1, 1.0)]
    assert M.binarize(pairs).count() == 2


def test_byclass_false_merges_layers(spark):
    r = M.global_metrics(align(cells(spark, GT), cells(spark, PRED)), images(spark, GT)).first()
    assert r["tp"] == (GT * PRED).sum() and r["n"] == GT.size
    assert r["foreground_accuracy"] == pytest.approx((GT * PRED * GT).sum() / GT.sum())


def test_slices_are_found_by_halving(spark):
    """The slice of a value is the number of bounds below it, with repeated bounds and at both ends, without a pass over all bounds."""
    df = spark.createDataFrame([([], 1.0), ([2.0], 1.0), ([2.0], 3.0), ([1.0, 1.0, 1.0, 4.0], 1.0), ([1.0, 1.0, 1.0, 4.0], 2.0), ([float(i) for i in range(999)], 998.5)], "b array<double>, v double")
    assert [r[0] for r in df.select(M._below("b", F.col("v"), 999)).collect()] == [0, 0, 1, 0, 3, 999]


def test_column_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 7)], "a double")
    r = M.column_summary(df, ["a"]).first()
    assert (r["mean"], r["median"]) == (3.0, 2.0) and r["std"] == pytest.approx(np.std([1, 2, 2, 7]))
