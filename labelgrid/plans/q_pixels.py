"""Per-pixel arithmetic and loss values (B9-B23, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions import geometry as G
from labelgrid.operators import align as A
from labelgrid.operators import classes as C
from labelgrid.operators import losses as L
from labelgrid.operators import pixels as P
from labelgrid.operators import vectors as X
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views


@query("foreground_mask", with_views(O.PAIRS) + "SELECT image_id, y, x, least(1, 255 * sum(p)) AS w FROM pairs WHERE p <> 0 GROUP BY 1, 2, 3", rounded=["w"])
def foreground_mask(spark, sf):
    return P.foreground_mask(V.pred_cells(spark, sf))


@query("mask_by_weight", with_views(O.PAIRS) + """,
  w AS (SELECT image_id, y, x, max(l_quantity) / 50 AS w FROM px GROUP BY 1, 2, 3)
  SELECT class_id, count(*) AS cells, sum(p * w) AS mass FROM pairs JOIN w USING (image_id, y, x) WHERE p <> 0 GROUP BY 1""", rounded=["mass"])
def mask_by_weight(spark, sf):
    masked = A.mask_cells(V.pred_cells(spark, sf), V.weights(spark, sf).withColumnRenamed("wr", "w"))
    return masked.groupBy("class_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("mass"))


@query("drop_unseen_classes", with_views(O.PAIRS) + """
  SELECT image_id, y, x, class_id, sum(p) AS v FROM (SELECT image_id, y, x, CASE WHEN class_id = 2 THEN 0 ELSE class_id END AS class_id, p FROM pairs WHERE p <> 0) GROUP BY 1, 2, 3, 4""",
       rounded=["v"])
def drop_unseen_classes(spark, sf):
    """Class 2 is taken as unseen in training."""
    seen = C.class_summary(C.class_index(V.gt_cells(spark, sf).where("class_id < 2")))
    return P.drop_unseen_classes(V.pred_cells(spark, sf), seen)


@query("blend_masked", with_views(O.PAIRS, O.INTENSITY) + """,
  it AS (SELECT inten.* REPLACE (CASE WHEN top > 1 THEN v / top ELSE v END AS v) FROM inten JOIN (SELECT image_id, max(v) AS top FROM inten GROUP BY 1) USING (image_id))
  SELECT image_id, y, x, c, coalesce(p, 0) * v + 1 - coalesce(p, 0) AS v FROM it LEFT JOIN (SELECT image_id, y, x, p FROM pairs WHERE class_id = 0 AND p <> 0) USING (image_id, y, x)""",
       rounded=["v"])
def blend_masked(spark, sf):
    layer = V.pred_cells(spark, sf).where("class_id = 0").drop("class_id")
    return P.blend_masked(V.intensity(spark, sf), layer, V.images(spark, sf))


@query("class_colours", with_views(O.PAIRS) + """,
  k AS (SELECT image_id, y, x, (class_id * 2 + 1) % 6 AS class_id, p * 0.99 AS v FROM pairs WHERE p <> 0),
  s AS (SELECT image_id, y, x, sum(v) FILTER (class_id = 1) AS v1, sum(v) FILTER (class_id = 3) AS v3, sum(v) FILTER (class_id = 5) AS v5 FROM k GROUP BY 1, 2, 3)
  SELECT image_id, y, x, least(coalesce(v3, 0) + coalesce(v5, 0), 1) AS c0, least(coalesce(v1, 0) + coalesce(v3, 0) + coalesce(v5, 0), 1) AS c1, 0e0 AS c2 FROM s""",
       rounded=["c0", "c1", "c2"])
def class_colours(spark, sf):
    cells = V.pred_cells(spark, sf).withColumn("class_id", (F.col("class_id") * 2 + 1) % 6)
    return P.class_colours(cells)


@query("pad_to_multiple", with_views(O.PX, O.IMAGES) + "SELECT image_id, CAST(ceil(height / 32e0) * 32 AS INT) AS height, CAST(ceil(width / 32e0) * 32 AS INT) AS width, n_classes FROM images")
def pad_to_multiple(spark, sf):
    return P.pad_to_multiple(V.images(spark, sf), 5)


def _jitter_sql():
    noise = " + ".join(
        f"level * {O.uniform(f's1-noise{s}', 'image_id', f'y // {s}', f'x // {s}', 'c')} * (2 * {O.uniform(f's1-swing{s}', 'image_id')} - 1) ** 3" for s in (1, 2, 4, 8, 16)
    )
    return with_views(O.PX, O.INTENSITY) + f"""
  SELECT image_id, y, x, c, greatest(least(v * contrast + off * (1 - contrast) + CASE WHEN u < 0.5 THEN {noise} ELSE 0 END, 1), 0) AS v FROM (
    SELECT *, 0.3 + 0.7 * {O.uniform('s1-contrast', 'image_id', 'c')} AS contrast, {O.uniform('s1-offset', 'image_id', 'c')} AS off,
      {O.uniform('s1-level', 'image_id')} * 0.36 AS level, {O.uniform('s1-on', 'image_id')} AS u FROM inten)"""


@query("intensity_jitter", _jitter_sql(), rounded=["v"])
def intensity_jitter(spark, sf):
    return P.intensity_jitter(V.intensity(spark, sf), "s1")


@query("subtract_background", with_views(O.PX, O.IMAGES, O.INTENSITY) + """,
  d AS (SELECT image_id, y, x, greatest(sum(CASE c WHEN 0 THEN -v ELSE v END), 0) AS v FROM inten WHERE c < 2 GROUP BY 1, 2, 3),
  s AS (SELECT image_id, CASE WHEN count(*) < any_value(height * width) THEN 0e0 ELSE min(v) END AS lo, max(v) AS hi FROM d JOIN images USING (image_id) GROUP BY 1)
  SELECT image_id, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 255 ELSE 0 END AS v FROM d JOIN s USING (image_id)""", rounded=["v"])
def subtract_background(spark, sf):
    it = V.intensity(spark, sf)
    return P.subtract_background(it.where("c = 0"), it.where("c = 1"), V.images(spark, sf), as_int=False)


@query("grey_levels", with_views(O.PX, O.INTENSITY) + """
  SELECT image_id, y, x, sum(v * CASE c WHEN 0 THEN 0.114 WHEN 1 THEN 0.587 ELSE 0.299 END) AS v FROM inten GROUP BY 1, 2, 3""", rounded=["v"])
def grey_levels(spark, sf):
    return P.to_grey(V.intensity(spark, sf))


@query("downsample", with_views(O.PX, O.INTENSITY) + "SELECT image_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, c, avg(v) AS v FROM inten GROUP BY 1, 2, 3, 4", rounded=["v"])
def downsample(spark, sf):
    return P.downsample(V.intensity(spark, sf), 4)


@query("letterbox", with_views(O.BOXES) + """
  SELECT page_id, box_id, l * s + floor((224 - floor(2100 * s)) / 2) AS l, t * s + floor((224 - floor(2030 * s)) / 2) AS t,
    r * s + floor((224 - floor(2100 * s)) / 2) AS r, b * s + floor((224 - floor(2030 * s)) / 2) AS b FROM gt, (SELECT least(224 / 2030e0, 224 / 2100e0) AS s)""", rounded=["l", "t", "r", "b"])
def letterbox(spark, sf):
    out = G.letterbox(G.box(), F.lit(2030), F.lit(2100), 224, 224)
    return V.gt_boxes(spark, sf).select("page_id", "box_id", *[c.alias(n) for n, c in out._asdict().items()])


@query("infer_scale", """
  SELECT doc_id, CASE WHEN regexp_extract(path, 'scale_([0-9]+)', 1) = '' THEN 1e0 ELSE 100e0 / CAST(regexp_extract(path, 'scale_([0-9]+)', 1) AS DOUBLE) END AS scale FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'scans/p' || doc_id ELSE 'scans/scale_' || (doc_id % 7 + 1) * 10 || '/p' || doc_id END || '.jpg' AS path FROM documents)""", rounded=["scale"])
def infer_scale(spark, sf):
    d = F.col("doc_id")
    scaled = F.concat(F.lit("scans/scale_"), ((d % 7 + 1) * 10).cast("string"), F.lit("/p"), d.cast("string"))
    path = F.concat(F.when(d % 3 == 0, F.concat(F.lit("scans/p"), d.cast("string"))).otherwise(scaled), F.lit(".jpg"))
    return V.table(spark, sf, "documents").select("doc_id", P.infer_scale(path).alias("scale"))


CLASS_N = """, cn AS (SELECT CAST(c AS INT) AS class_id, (SELECT sum(CAST(height AS DOUBLE) * width) FROM images) AS n FROM range(3) r(c))"""


@query("continuous_f_loss", with_views(O.PAIRS, O.IMAGES) + CLASS_N + """
  SELECT sum(w * l) / sum(w) AS loss FROM (SELECT CASE class_id WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0.5 END AS w, ((n - s) / n) ** 0.25 AS l
    FROM cn JOIN (SELECT class_id, sum(g * p * (1 - (1 - g) * (1 - p))) AS s FROM pairs GROUP BY 1) USING (class_id))""", rounded=["loss"])
def continuous_f_loss(spark, sf):
    return L.continuous_f_loss(V.pairs(spark, sf), V.images(spark, sf), [5, 1, 0.5])


@query("blurred_f_loss", with_views(O.PAIRS, O.IMAGES) + CLASS_N + """,
  k0 AS (SELECT CAST(i - 10 AS INT) AS d, exp(-((i - 10) ** 2) / 50e0) AS w FROM range(21) r(i)), k AS (SELECT d, w / (SELECT sum(w) FROM k0) AS w FROM k0),
  sm AS (SELECT image_id, y, x, class_id, sum(g) AS g, sum(p) AS p FROM (
    SELECT image_id, y + a.d AS y, x, class_id, g * a.w AS g, p * a.w AS p FROM (SELECT image_id, y, x + b.d AS x, class_id, sum(g * b.w) AS g, sum(p * b.w) AS p FROM pairs, k b GROUP BY ALL), k a) JOIN images USING (image_id)
    WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3, 4)
  SELECT avg(((n - s) / n) ** 0.25) AS loss FROM cn JOIN (SELECT class_id, sum(g * p * (1 - (1 - g) * (1 - p))) AS s FROM sm GROUP BY 1) USING (class_id)""", rounded=["loss"])
def blurred_f_loss(spark, sf):
    return L.blurred_f_loss(V.gt_cells(spark, sf), V.pred_cells(spark, sf), V.images(spark, sf))


@query("margin_loss", with_views(O.PAIRS, O.IMAGES) + CLASS_N + """
  SELECT sum(s / n) AS loss FROM cn JOIN (
    SELECT class_id, sum(g * greatest(0.1 * g, 0.9 - p) ** 2 + 0.5 * (0.9 - g) * greatest(0.1 * g, p - 0.1) ** 2) AS s FROM pairs GROUP BY 1) USING (class_id)""", rounded=["loss"])
def margin_loss(spark, sf):
    return L.margin_loss(V.pairs(spark, sf), V.images(spark, sf))


MASKED = """, m AS (SELECT *, least(1, 255 * sum(g) OVER (PARTITION BY image_id, y, x)) AS fg FROM pairs),
  tot AS (SELECT sum(CAST(height AS DOUBLE) * width * n_classes) AS n FROM images)"""


@query("masked_losses", with_views(O.PAIRS, O.IMAGES) + MASKED + """
  SELECT sum(g * greatest(0, 0.9 - fg * p) ** 2 + 0.5 * (1 - g) * greatest(0, fg * p - 0.1) ** 2) AS masked_margin, sum((g - fg * p) ** 2) / any_value(n) AS masked_mse FROM m, tot""",
       rounded=["masked_margin", "masked_mse"], digits=6)
def masked_losses(spark, sf):
    return L.masked_losses(V.pairs(spark, sf), V.images(spark, sf))


SURROGATE = """, sc AS (SELECT class_id, sum(least(g * 255, 1) * p) AS tp, sum(least(g * 255, 1) * (1 - p)) AS fn, sum((1 - least(g * 255, 1)) * p * fg) AS fp FROM m GROUP BY 1),
  pc AS (SELECT *, 2 * p * r / (p + r + 1e-8) AS f, CASE WHEN class_id >= 2 THEN 8e0 ELSE 1e0 END AS w FROM (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM sc)),
  mac AS (SELECT sum(p) / sum(w) AS macro_precision, sum(r) / sum(w) AS macro_recall, sum(f * f * w) / sum(w) AS macro_f, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM pc),
  sur AS (SELECT *, 2 * micro_precision * micro_recall / (micro_precision + micro_recall + 1e-8) AS micro_f FROM (
    SELECT macro_precision, macro_recall, macro_f, tp / (tp + fp + 1e-8) AS micro_precision, tp / (tp + fn + 1e-8) AS micro_recall FROM mac))"""


@query("surrogate_scores", with_views(O.PAIRS, O.IMAGES) + MASKED + SURROGATE + "SELECT *, 2 - macro_f - micro_f AS loss FROM sur",
       rounded=["macro_precision", "macro_recall", "macro_f", "micro_precision", "micro_recall", "micro_f", "loss"])
def surrogate_scores(spark, sf):
    return L.surrogate_scores(V.pairs(spark, sf), V.images(spark, sf))


@query("log_loss", with_views(O.PAIRS, O.IMAGES) + MASKED + """,
  e AS (SELECT image_id, y, x, class_id, g, greatest(least(p, 1 - 1e-9), 1e-9) AS p FROM pairs),
  z AS (SELECT image_id, y, x, sum(p) + (3 - count(*)) * 1e-9 AS s FROM e GROUP BY 1, 2, 3)
  SELECT -sum(g * ln(p / s)) / (SELECT n FROM tot) AS loss FROM e JOIN z USING (image_id, y, x)""", rounded=["loss"])
def log_loss(spark, sf):
    return L.log_loss(V.pairs(spark, sf), V.images(spark, sf))


@query("composite_loss", with_views(O.PAIRS, O.IMAGES) + MASKED + SURROGATE + CLASS_N + """
  SELECT 0.1 * (1 - macro_precision * macro_recall) + 0.1 * (SELECT -sum(g * ln(greatest(least(p, 1 - 1e-8), 1e-8)) * CASE class_id WHEN 2 THEN 2 ELSE 1 END) FROM pairs) / (SELECT n FROM tot)
    + (SELECT sum(s / n) FROM cn JOIN (SELECT class_id, sum(g * greatest(0.1 * g, 0.9 - p) ** 2 + 0.5 * (0.9 - g) * greatest(0.1 * g, p - 0.1) ** 2) AS s FROM pairs GROUP BY 1) USING (class_id)) AS loss
  FROM sur""", rounded=["loss"])
def composite_loss(spark, sf):
    return L.composite_loss(V.pairs(spark, sf), V.images(spark, sf))


@query("cost_weighted_log_loss", with_views(O.VECTORS) + """,
  pr AS (SELECT label, list_position(scores, list_max(scores)) - 1 AS pred, list_transform(scores, lambda s: exp(s)) AS e FROM vec)
  SELECT sum(-ln(greatest(least(e[label + 1] / list_sum(e), 1 - 1e-7), 1e-7)) * (1 + abs(label - pred))) / count(*) AS loss FROM pr""", rounded=["loss"])
def cost_weighted_log_loss(spark, sf):
    """The cost of a confusion is one plus the distance of the classes."""
    ids = spark.range(64).select(F.col("id").cast("int").alias("truth"))
    costs = ids.withColumn("pred", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("cost", 1e0 + F.abs(F.col("truth") - F.col("pred")))
    return L.cost_weighted_log_loss(V.probabilities(spark, sf), F.col("label"), F.col("probs"), costs)


@query("argmax_f_loss", with_views(O.VECTORS) + """,
  ap AS (SELECT label AS t, list_position(scores, list_max(scores)) - 1 AS p FROM vec)
  SELECT 2 - tp / (tp + fp) - tp / (tp + fn) AS loss FROM (
    SELECT CAST(count(*) FILTER (p * t <> 0) AS DOUBLE) AS tp, count(*) FILTER (p * (t - 1) <> 0) AS fp, count(*) FILTER ((p - 1) * t <> 0) AS fn FROM ap)""", rounded=["loss"])
def argmax_f_loss(spark, sf):
    return L.argmax_f_loss(X.argmax_pairs(V.class_vectors(spark, sf), F.col("label"), F.col("scores")))
