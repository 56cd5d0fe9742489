"""Class statistics, checks, thresholds, codecs and vector scores (E16-E28, C1, C9, I, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions import codec as K
from labelgrid.operators import classes as C
from labelgrid.operators import pixels as P
from labelgrid.operators import thresholds as T
from labelgrid.operators import vectors as X
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views

INDEX = """idx AS (SELECT class_id, image_id, count(*) AS n_pixels FROM (SELECT DISTINCT image_id, y, x, class_id FROM px) GROUP BY 1, 2),
summ AS (SELECT class_id, count(*) AS n_images, CAST(sum(n_pixels) AS BIGINT) AS n_pixels FROM idx GROUP BY 1)"""


def summary(spark, sf):
    return C.class_summary(C.class_index(V.gt_cells(spark, sf)))


@query("class_index", with_views(O.PX, INDEX) + "SELECT class_id, image_id, n_pixels FROM idx")
def class_index(spark, sf):
    return C.class_index(V.gt_cells(spark, sf))


@query("class_summary", with_views(O.PX, INDEX) + "SELECT *, n_pixels / sum(n_pixels) OVER () AS share FROM summ", rounded=["share"])
def class_summary(spark, sf):
    return summary(spark, sf)


@query("sqrt_class_weights", with_views(O.PX, INDEX) + "SELECT class_id, sum(sqrt(n_pixels)) OVER () / sqrt(n_pixels) AS weight FROM summ", rounded=["weight"])
def sqrt_class_weights(spark, sf):
    return C.sqrt_weights(summary(spark, sf))


@query("log_class_weights", with_views(O.PX, INDEX) + """
  SELECT *, CAST(row_number() OVER (ORDER BY weight, class_id) AS INT) AS rank FROM (SELECT class_id, 1 + ln(sum(n_pixels) OVER () / n_pixels) AS weight FROM summ)""", rounded=["weight"])
def log_class_weights(spark, sf):
    return C.log_weights(summary(spark, sf))


@query("missing_classes", with_views(O.PX, INDEX) + "SELECT CAST(c AS INT) AS class_id FROM range(6) r(c) WHERE c NOT IN (SELECT class_id FROM idx)")
def missing_classes(spark, sf):
    declared = spark.range(6).select(F.col("id").cast("int").alias("class_id"))
    return C.missing_classes(declared, C.class_index(V.gt_cells(spark, sf)))


@query("binary_check", with_views(O.PAIRS) + """,
  vals AS (SELECT DISTINCT image_id, class_id, CAST(round(p * 255) AS INT) AS v FROM pairs)
  SELECT image_id, class_id, count(*) AS n_values, list_sort(list(v)) AS grey_values FROM vals GROUP BY 1, 2
  HAVING count(*) > 2 OR NOT bool_or(v IN (0, 255))""", lists=["grey_values"])
def binary_check(spark, sf):
    layers = V.pairs(spark, sf).select("image_id", "class_id", F.round(F.col("p") * 255).alias("v"))
    return C.verify_binary(layers, ["image_id", "class_id"])


SWEEP = """sweep AS (
  SELECT class_id, threshold, tp, pred_mass, gt_mass, precision, recall, 2 * precision * recall / greatest(precision + recall, 1e-14) AS f1 FROM (
    SELECT *, CASE WHEN pred_mass = 0 AND tp = 0 THEN 1e0 ELSE tp / pred_mass END AS precision, CASE WHEN gt_mass = 0 AND tp = 0 THEN 1e0 ELSE tp / gt_mass END AS recall FROM (
      SELECT class_id, k / 20e0 AS threshold, sum(CASE WHEN p >= k / 20e0 THEN g ELSE 0 END) AS tp, CAST(count(*) FILTER (p >= k / 20e0) AS DOUBLE) AS pred_mass, sum(g) AS gt_mass
      FROM pairs, range(1, 20) r(k) GROUP BY 1, 2)))"""


@query("threshold_sweep", with_views(O.PAIRS, SWEEP) + "SELECT * FROM sweep", rounded=["threshold", "tp", "pred_mass", "gt_mass", "precision", "recall", "f1"])
def threshold_sweep(spark, sf):
    return T.threshold_sweep(V.pairs(spark, sf))


@query("best_thresholds", with_views(O.PAIRS, SWEEP) + """
  SELECT class_id, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY f1 DESC, threshold) AS r FROM sweep WHERE f1 > 0) WHERE r = 1""",
       rounded=["threshold", "f1"])
def best_thresholds(spark, sf):
    return T.best_thresholds(T.threshold_sweep(V.pairs(spark, sf)))


@query("threshold_gains", with_views(O.PAIRS, SWEEP) + """,
  overall AS (SELECT threshold, avg(f1) AS f1 FROM sweep GROUP BY 1),
  best AS (SELECT * FROM overall ORDER BY f1 DESC, threshold LIMIT 1),
  cls AS (SELECT avg(m) AS class_f1 FROM (SELECT max(f1) AS m FROM sweep GROUP BY class_id))
  SELECT threshold, f1, f1 - (SELECT f1 FROM overall WHERE threshold = 0.5) AS gain_over_default, class_f1, class_f1 - f1 AS gain_by_class FROM best, cls""",
       rounded=["threshold", "f1", "gain_over_default", "class_f1", "gain_by_class"])
def threshold_gains(spark, sf):
    return T.best_overall(T.threshold_sweep(V.pairs(spark, sf)))


@query("classwise_binarize", with_views(O.PAIRS) + """
  SELECT class_id, count(*) AS cells FROM pairs WHERE p >= CASE class_id WHEN 0 THEN 0.3 WHEN 1 THEN 0.7 ELSE 0.5 END GROUP BY 1""")
def classwise_binarize(spark, sf):
    t = spark.createDataFrame([(0, 0.3), (1, 0.7)], "class_id int, threshold double")
    return P.threshold_predictions(V.pred_cells(spark, sf), t).groupBy("class_id").agg(F.count(F.lit(1)).alias("cells"))


MASKS = """cells AS (SELECT DISTINCT image_id, y, x, class_id FROM px),
masks AS (SELECT image_id, y, x, CAST(sum(1 << class_id) AS INT) AS mask FROM cells GROUP BY 1, 2, 3)"""


@query("bitmask_encode", with_views(O.PX, MASKS) + "SELECT * FROM masks")
def bitmask_encode(spark, sf):
    return P.cells_to_bitmask(V.gt_cells(spark, sf))


@query("bitmask_decode", with_views(O.PX, MASKS) + "SELECT class_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx FROM cells GROUP BY 1")
def bitmask_decode(spark, sf):
    cells = P.bitmask_to_cells(P.cells_to_bitmask(V.gt_cells(spark, sf)), 3)
    return cells.groupBy("class_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("x").alias("sx"))


@query("mask_codecs", with_views(O.PX, MASKS) + """
  SELECT image_id, y, x, [CAST(mask & 1 AS INT), CAST((mask >> 1) & 1 AS INT), CAST((mask >> 2) & 1 AS INT)] AS multihot,
    CAST(floor(log2(mask * 2)) AS INT) AS top_class, CAST(mask * 65 & 255 AS INT) AS b0, CAST((mask * 65) >> 8 & 255 AS INT) AS b1, CAST((mask * 65) >> 16 & 255 AS INT) AS b2 FROM masks""", lists=["multihot"])
def mask_codecs(spark, sf):
    """Multi-hot, enum and byte forms of each mask (bytes of the mask set twice, 6 bits apart)."""
    m = P.cells_to_bitmask(V.gt_cells(spark, sf))
    back = K.multihot_to_bitmask(K.bitmask_to_multihot(F.col("mask"), 3))
    rgb = K.pack_bits_rgb(back * 65)
    return m.select("image_id", "y", "x", K.bitmask_to_multihot(F.col("mask"), 3).alias("multihot"), K.bitmask_to_enum(F.col("mask")).alias("top_class"),
                    rgb["b0"].alias("b0"), rgb["b1"].alias("b1"), rgb["b2"].alias("b2"))


@query("enum_codecs", with_views(O.VECTORS) + """
  SELECT vec_id, list_position(scores, list_max(scores)) - 1 AS argmax, list_transform(range(0, 64), lambda k: CAST(k = label AS INT)) AS onehot,
    list_transform(range(0, 63), lambda k: CAST(k = greatest(label - 1, 0) AS INT)) AS onehot_fg, list_transform(range(0, 63), lambda k: CAST(k + 1 = label AS INT)) AS multihot_fg,
    CASE WHEN label > 0 THEN 1 << (label - 1) ELSE 0 END AS mask FROM vec""", lists=["onehot", "onehot_fg", "multihot_fg"])
def enum_codecs(spark, sf):
    label = F.col("label")
    return V.class_vectors(spark, sf).select(
        "vec_id", K.onehot_to_enum(F.col("scores")).alias("argmax"), K.enum_to_onehot(label, 64).alias("onehot"),
        K.enum_to_onehot(label, 64, ignore_first=True).alias("onehot_fg"), K.enum_to_multihot(label, 63, ignore_first=True).alias("multihot_fg"),
        K.enum_to_bitmask(label).alias("mask"),
    )


VEC_PAIRS = O.VECTORS + """, ap AS (SELECT vec_id, label AS truth, list_position(scores, list_max(scores)) - 1 AS pred, scores FROM vec)"""


def vec_pairs(spark, sf):
    return X.argmax_pairs(V.class_vectors(spark, sf), F.col("label"), F.col("scores"))


@query("argmax_scores", with_views(VEC_PAIRS) + """
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT class_id, tp, gt_mass, pred_mass, CASE WHEN gt_mass = 0 THEN 1 ELSE tp / gt_mass END AS recall, CASE WHEN pred_mass = 0 THEN 1 ELSE tp / pred_mass END AS precision,
      CASE WHEN gt_mass + pred_mass - tp = 0 THEN 1 ELSE tp / (gt_mass + pred_mass - tp) END AS accuracy
    FROM (SELECT CAST(c AS INT) AS class_id, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth = c) AS gt_mass, count(*) FILTER (pred = c) AS pred_mass
          FROM ap, range(64) r(c) GROUP BY 1))""", rounded=["recall", "precision", "accuracy", "f1"])
def argmax_scores(spark, sf):
    return X.argmax_scores(vec_pairs(spark, sf), 64)


@query("argmax_accuracy", with_views(VEC_PAIRS) + "SELECT avg(CAST(truth = pred AS DOUBLE)) AS correct FROM ap", rounded=["correct"])
def argmax_accuracy(spark, sf):
    return X.overall_correct(vec_pairs(spark, sf))


@query("single_class_accuracy", with_views(VEC_PAIRS) + "SELECT count(*) FILTER (pred = 3 AND truth = 3) / greatest(count(*) FILTER (pred = 3), 1) AS accuracy FROM ap", rounded=["accuracy"])
def single_class_accuracy(spark, sf):
    return X.single_class_accuracy(vec_pairs(spark, sf), 3)


@query("top_k_accuracy", with_views(O.VECTORS) + "SELECT avg(CAST(len(list_filter(scores, lambda v: v > scores[label + 1])) < 5 AS DOUBLE)) AS accuracy FROM vec", rounded=["accuracy"])
def top_k_accuracy(spark, sf):
    return X.top_k_accuracy(V.class_vectors(spark, sf), F.col("label"), F.col("scores"), 5)


@query("argmax_layer", with_views(O.PAIRS) + """
  SELECT image_id, y, x, class_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY p DESC, class_id) AS r FROM pairs WHERE p <> 0) WHERE r = 1""")
def argmax_layer(spark, sf):
    return X.argmax_cells(V.pred_cells(spark, sf))


@query("dense_scores", with_views(O.PAIRS, O.IMAGES) + """,
  s AS (SELECT count(*) AS r, sum(round_even(g * p, 0)) AS tp, sum(round_even(g, 0)) AS pos, sum(round_even((1 - g) * (1 - p), 0)) AS tn, sum(round_even(1 - g, 0)) AS neg,
    sum(CAST(g = round_even(p, 0) AS DOUBLE)) AS eq, sum(CASE WHEN g = p THEN g ELSE 0 END) AS fg, sum(CASE WHEN g = p THEN 1 - g ELSE 0 END) AS bg, sum(g) AS mass FROM pairs),
  n AS (SELECT sum(CAST(height AS DOUBLE) * width * n_classes) AS n FROM images)
  SELECT tp / (pos + 1e-7) AS sensitivity, (tn + n - r) / (neg + n - r + 1e-7) AS specificity, (eq + n - r) / n AS binary_accuracy,
    fg / mass AS foreground_accuracy, (bg + n - r) / mass AS background_accuracy FROM s, n""",
       rounded=["sensitivity", "specificity", "binary_accuracy", "foreground_accuracy", "background_accuracy"])
def dense_scores(spark, sf):
    return X.dense_scores(V.pairs(spark, sf), V.images(spark, sf))


@query("weight_lists", """
  SELECT o_orderpriority, CAST(i - 1 AS INT) AS class_id, TRY_CAST(trim(parts[i]) AS DOUBLE) AS weight FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT DISTINCT o_orderpriority, string_split('5, 1,.5,' || substr(o_orderpriority, 1, 1), ',') AS parts FROM orders))""", rounded=["weight"])
def weight_lists(spark, sf):
    lists = V.table(spark, sf, "orders").select("o_orderpriority", F.concat(F.lit("5, 1,.5,"), F.substring("o_orderpriority", 1, 1)).alias("w")).distinct()
    return lists.select("o_orderpriority", F.posexplode(K.parse_weight_list(F.col("w"))).alias("class_id", "weight"))
