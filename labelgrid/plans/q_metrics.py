"""Pixel-metric queries (E, C10, B11-B14, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.operators import align as A
from labelgrid.operators import metrics as M
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views

BASE = with_views(O.PAIRS, O.IMAGES, O.BINARY, O.GRID, O.SUMS)


def binary(spark, sf):
    return M.binarize(V.pairs(spark, sf), 0.5, 0.5)


@query("pixel_metrics_by_class", BASE + O.metric_select("class_id", """(
    SELECT class_id, sum(n) AS n, sum(tp) AS tp, sum(gt_mass) AS gt_mass, sum(pred_mass) AS pred_mass, sum(sq_err) AS sq_err, sum(abs_err) AS abs_err
    FROM sums GROUP BY 1)"""), rounded=O.METRICS)
def pixel_metrics_by_class(spark, sf):
    return M.metrics_by_class(binary(spark, sf), V.images(spark, sf)).select("class_id", *O.METRICS)


@query("pixel_metrics_by_image", BASE + O.metric_select("image_id, class_id", "sums"), rounded=O.METRICS)
def pixel_metrics_by_image(spark, sf):
    return M.metrics_by_image(binary(spark, sf), V.images(spark, sf)).select("image_id", "class_id", *O.METRICS)


@query("soft_metrics_by_class", with_views(O.PAIRS, O.IMAGES, O.BINARY.replace("CAST(g > 0.5 AS DOUBLE) AS g, CAST(p > 0.5 AS DOUBLE) AS p", "g, p"), O.GRID, O.SUMS)
       + O.metric_select("class_id", """(
    SELECT class_id, sum(n) AS n, sum(tp) AS tp, sum(gt_mass) AS gt_mass, sum(pred_mass) AS pred_mass, sum(sq_err) AS sq_err, sum(abs_err) AS abs_err
    FROM sums GROUP BY 1)"""), rounded=O.METRICS)
def soft_metrics_by_class(spark, sf):
    """Two separate tables, aligned by :func:`labelgrid.operators.align.align`."""
    both = A.clip_pairs(A.align(V.gt_cells(spark, sf), V.pred_cells(spark, sf)))
    return M.metrics_by_class(both, V.images(spark, sf)).select("class_id", *O.METRICS)


@query("global_metrics", BASE + """
  SELECT image_id, tp, tn, gt_mass AS foreground_mass, (tp + tn) / n AS accuracy, tp / greatest(gt_mass, 1e-14) AS foreground_accuracy FROM (
    SELECT image_id, sum(n) AS n, sum(tp) AS tp, sum(gt_mass) AS gt_mass, sum(n - gt_mass - pred_mass + tp) AS tn FROM sums GROUP BY 1)""",
       rounded=["tp", "tn", "foreground_mass", "accuracy", "foreground_accuracy"])
def global_metrics(spark, sf):
    out = M.global_metrics(binary(spark, sf), V.images(spark, sf))
    return out.select("image_id", "tp", "tn", F.col("gt_mass").alias("foreground_mass"), "accuracy", "foreground_accuracy")


@query("folder_report", BASE + f""", per_image AS ({O.metric_select("image_id, class_id", "sums")}),
  by_class AS (SELECT class_id, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(accuracy) AS accuracy, avg(iou) AS iou FROM per_image GROUP BY 1)
  SELECT * FROM by_class UNION ALL
  SELECT NULL, avg(precision), avg(recall), avg(f1), avg(accuracy), avg(iou) FROM by_class""", rounded=["precision", "recall", "f1", "accuracy", "iou"])
def folder_report(spark, sf):
    return M.folder_report(binary(spark, sf), V.images(spark, sf))


@query("pixel_masks", with_views(O.PAIRS) + """
  SELECT image_id, y, x, gt_mask, pred_mask, CAST(gt_mask > 0 AS INT) AS gt_any, CAST(pred_mask > 0 AS INT) AS pred_any,
    greatest(1 - gt_mask, 0) AS gt_bg, greatest(1 - pred_mask, 0) AS pred_bg
  FROM (SELECT image_id, y, x, sum(g) AS gt_mask, sum(p) AS pred_mask FROM pairs GROUP BY 1, 2, 3)""", rounded=["gt_mask", "pred_mask", "gt_bg", "pred_bg"])
def pixel_masks(spark, sf):
    return M.pixel_masks(V.pairs(spark, sf))


CONFUSION = """
  px_all AS (SELECT image_id, y, x, greatest(1 - sum(g), 0) AS gb, greatest(1 - sum(p), 0) AS pb FROM bin GROUP BY 1, 2, 3),
  gs AS (SELECT image_id, y, x, class_id, g FROM bin WHERE g <> 0 UNION ALL SELECT image_id, y, x, -1, gb FROM px_all),
  ps AS (SELECT image_id, y, x, class_id, p FROM bin WHERE p <> 0 UNION ALL SELECT image_id, y, x, -1, pb FROM px_all),
  seen AS (SELECT gs.class_id AS gt_class, ps.class_id AS pred_class, sum(g * p) AS v FROM gs JOIN ps USING (image_id, y, x) GROUP BY 1, 2),
  blank AS (SELECT (SELECT sum(CAST(height AS DOUBLE) * width) FROM images) - (SELECT count(*) FROM px_all) AS n),
  axes AS (SELECT CAST(a - 1 AS INT) AS gt_class, CAST(b - 1 AS INT) AS pred_class FROM range(4) r(a), range(4) s(b)),
  conf AS (SELECT gt_class, pred_class, coalesce(v, 0) + CASE WHEN gt_class = -1 AND pred_class = -1 THEN (SELECT n FROM blank) ELSE 0 END AS v
           FROM axes LEFT JOIN seen USING (gt_class, pred_class))"""


@query("confusion_matrix", with_views(O.PAIRS, O.IMAGES, O.BINARY, CONFUSION) + "SELECT * FROM conf", rounded=["v"])
def confusion_matrix(spark, sf):
    return M.confusion_total(M.confusion(binary(spark, sf), V.images(spark, sf)))


@query("confusion_display", with_views(O.PAIRS, O.IMAGES, O.BINARY, CONFUSION) + """
  SELECT gt_class, pred_class, v, sqrt(v) / nullif(max(sqrt(v)) OVER (PARTITION BY pred_class), 0) AS shade FROM conf""", rounded=["v", "shade"])
def confusion_display(spark, sf):
    return M.confusion_display(M.confusion_total(M.confusion(binary(spark, sf), V.images(spark, sf)))).select("gt_class", "pred_class", "v", "shade")


@query("overlap_histogram", with_views(O.PAIRS, O.IMAGES) + """,
  per_pixel AS (SELECT sum(g) AS classes FROM pairs WHERE g <> 0 GROUP BY image_id, y, x)
  SELECT classes, count(*) AS pixels FROM per_pixel GROUP BY 1 UNION ALL
  SELECT 0e0, CAST((SELECT sum(height * width) FROM images) - (SELECT count(*) FROM per_pixel) AS BIGINT)""", rounded=["classes"])
def overlap_histogram(spark, sf):
    return M.overlap_histogram(V.pairs(spark, sf), V.images(spark, sf))


@query("overlap_share", with_views(O.PAIRS) + """,
  over AS (SELECT image_id, CAST(count(*) FILTER (s > 1) AS BIGINT) AS overlapped FROM (SELECT image_id, sum(g) AS s FROM pairs GROUP BY image_id, y, x) GROUP BY 1)
  SELECT image_id, class_id, overlapped, overlapped / greatest(gt_mass, 0.01) AS share
  FROM (SELECT image_id, class_id, sum(g) AS gt_mass FROM pairs GROUP BY 1, 2) JOIN over USING (image_id)""", rounded=["share"])
def overlap_share(spark, sf):
    return M.overlap_share(V.pairs(spark, sf))


@query("weighted_metrics", with_views(O.PAIRS, O.IMAGES, O.BINARY) + """,
  w AS (SELECT image_id, y, x, max(l_quantity) / 50 AS wr, max(l_tax) + 0.5 AS wp FROM px GROUP BY 1, 2, 3),
  s AS (SELECT class_id, sum(g * p * wp) / sum(p * wp) AS w_precision, sum(g * p * wr) / sum(g * wr) AS w_recall FROM bin JOIN w USING (image_id, y, x) GROUP BY 1)
  SELECT class_id, w_precision, w_recall, 2 * w_precision * w_recall / greatest(w_precision + w_recall, 1e-14) AS w_f1 FROM s""", rounded=["w_precision", "w_recall", "w_f1"])
def weighted_metrics(spark, sf):
    w = V.weights(spark, sf)
    return M.weighted_metrics(binary(spark, sf), V.images(spark, sf), w.withColumnRenamed("wp", "w"), w.withColumnRenamed("wr", "w"))


@query("blank_truth_pages", with_views(O.PAIRS, O.IMAGES) + """
  SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM px WHERE l_quantity = 50 AND l_discount = 0 AND l_tax = 0.08)""")
def blank_truth_pages(spark, sf):
    """Truth = a rare mark: full quantity, no discount, top tax."""
    marks = V.line_pixels(spark, sf).where("l_quantity = 50 AND l_discount = 0 AND l_tax = 0.08").withColumn("g", F.lit(1e0))
    return M.blank_truth(marks, V.images(spark, sf))


@query("abs_diff_layer", with_views(O.PAIRS) + "SELECT image_id, y, x, class_id, abs(g - p) AS v FROM pairs WHERE g <> p", rounded=["v"])
def abs_diff_layer(spark, sf):
    return A.abs_diff(V.pairs(spark, sf))


@query("class_means", with_views(O.PAIRS, O.IMAGES) + """
  SELECT class_id, sum(g) / (SELECT sum(CAST(height AS DOUBLE) * width) FROM images) AS gt_mean,
         sum(p) / (SELECT sum(CAST(height AS DOUBLE) * width) FROM images) AS pred_mean FROM pairs GROUP BY 1""", rounded=["gt_mean", "pred_mean"])
def class_means(spark, sf):
    return M.metrics_by_class(V.pairs(spark, sf), V.images(spark, sf)).select("class_id", "gt_mean", "pred_mean")


@query("column_summary", """
  SELECT name, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median FROM (
    SELECT 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1""",
       rounded=["mean", "std", "median"])
def column_summary(spark, sf):
    return M.column_summary(V.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
