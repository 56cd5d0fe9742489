"""Sampling and cross-validation (H, C7, C8, D11, D13, D14, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.operators import align as A
from labelgrid.operators import classes as C
from labelgrid.operators import folds as FO
from labelgrid.operators import metrics as M
from labelgrid.operators import sampling as S
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.q_classes import INDEX
from labelgrid.plans.registry import query, with_views

U = O.uniform
DRAWS = 5000
IMG_DRAWS = f"""listed AS (SELECT image_id, row_number() OVER (ORDER BY {U('i1-order', 'image_id')}, image_id) - 1 AS idx, count(*) OVER () AS n FROM images),
img_draws AS (SELECT d.sample_id, image_id FROM (SELECT s AS sample_id, floor({U('i1', 's')} * (SELECT any_value(n) FROM listed)) AS idx FROM range({DRAWS}) r(s)) d JOIN listed USING (idx))"""


@query("sample_images", with_views(O.PX, O.IMAGES, IMG_DRAWS) + "SELECT * FROM img_draws")
def sample_images(spark, sf):
    return S.sample_images(V.images(spark, sf), DRAWS, "i1")


PERF = f"""f AS (SELECT class_id, 2 * tp / (gm + pm) AS f1 FROM (SELECT class_id, sum(g * p) AS tp, sum(g) AS gm, sum(p) AS pm FROM bin GROUP BY 1)),
pr AS (SELECT class_id, sum(p) OVER (ORDER BY class_id) - p AS lo, CASE WHEN class_id = 2 THEN 1 ELSE sum(p) OVER (ORDER BY class_id) END AS hi FROM (SELECT class_id, (1 - f1) / (SELECT sum(1 - f1) FROM f) AS p FROM f)),
cls AS (SELECT s AS sample_id, class_id, {U('p1-image', 's')} AS u2 FROM (SELECT s, {U('p1', 's')} AS u FROM range({DRAWS}) r(s)), pr WHERE u >= lo AND u < hi),
lst AS (SELECT class_id, image_id, row_number() OVER (PARTITION BY class_id ORDER BY {U('p1-order', 'class_id', 'image_id')}, image_id) - 1 AS idx, count(*) OVER (PARTITION BY class_id) AS n FROM idx),
perf_draws AS (SELECT sample_id, class_id, image_id FROM (SELECT c.*, floor(u2 * n) AS idx FROM cls c JOIN (SELECT DISTINCT class_id, n FROM lst) USING (class_id)) JOIN lst USING (class_id, idx))"""


def performance_draws(spark, sf):
    """Class F of the predictions is the feedback that drives the sampler."""
    scores = M.metrics_by_class(M.binarize(V.pairs(spark, sf), 0.5, 0.5), V.images(spark, sf)).select("class_id", "f1")
    return S.sample_by_performance(scores, C.class_index(V.gt_cells(spark, sf)), DRAWS, "p1")


@query("sample_by_performance", with_views(O.PAIRS, O.BINARY, INDEX, PERF) + "SELECT * FROM perf_draws")
def sample_by_performance(spark, sf):
    return performance_draws(spark, sf)


@query("mix_samplers", with_views(O.PAIRS, O.IMAGES, O.BINARY, INDEX, IMG_DRAWS, PERF) + f"""
  SELECT sample_id, image_id FROM img_draws WHERE {U('mix', 'sample_id')} < 0.25 UNION ALL SELECT sample_id, image_id FROM perf_draws WHERE {U('mix', 'sample_id')} >= 0.25""")
def mix_samplers(spark, sf):
    return S.mix_samplers(S.sample_images(V.images(spark, sf), DRAWS, "i1"), performance_draws(spark, sf).drop("class_id"), 0.25, "mix")


@query("sample_quota", with_views(O.PX, INDEX) + f""",
  o AS (SELECT *, CAST(coalesce(sum(n_pixels) OVER (PARTITION BY class_id ORDER BY {U('q1', 'class_id', 'image_id')}, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM idx)
  SELECT class_id, image_id, n_pixels, before FROM o WHERE before < (SELECT min(n_pixels) FROM summ)""")
def sample_quota(spark, sf):
    return S.sample_quota(C.class_index(V.gt_cells(spark, sf)), "q1")


@query("greedy_draws", with_views(O.PX, INDEX) + f""",
  u AS (SELECT *, {U('q1', 'class_id', 'image_id')} AS u FROM idx),
  o AS (SELECT *, CAST(coalesce(sum(n_pixels) OVER (PARTITION BY class_id ORDER BY u, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM u)
  SELECT row_number() OVER (ORDER BY before, class_id, u, image_id) - 1 AS draw, class_id, image_id, n_pixels, before FROM o WHERE before < (SELECT min(n_pixels) FROM summ)""")
def greedy_draws(spark, sf):
    return S.greedy_draws(C.class_index(V.gt_cells(spark, sf)), "q1")


CROPS = f"""cells AS (SELECT DISTINCT image_id, class_id, y, x FROM px),
spot AS (SELECT image_id, class_id, CAST(d AS INT) AS draw, y, x FROM cells, range(2) r(d) QUALIFY row_number() OVER (PARTITION BY image_id, class_id, d ORDER BY {U('c1-pixel', 'image_id', 'class_id', 'd', 'y', 'x')}, y, x) = 1),
ctr AS (SELECT image_id, class_id, draw, height, width, CASE WHEN {U('c1-coin', 'image_id', 'class_id', 'draw')} > 0.5 THEN floor({U('c1-y', 'image_id', 'class_id', 'draw')} * height) ELSE y END AS y,
  CASE WHEN {U('c1-coin', 'image_id', 'class_id', 'draw')} > 0.5 THEN floor({U('c1-x', 'image_id', 'class_id', 'draw')} * width) ELSE x END AS x FROM spot JOIN images USING (image_id)),
crops AS (SELECT image_id, class_id, draw, CAST(greatest(0, least(x - 2, width - 4)) AS INT) AS "left", CAST(greatest(0, least(y - 2, height - 4)) AS INT) AS top, 4 AS size FROM ctr)"""


def crops(spark, sf):
    return S.class_crops(V.gt_cells(spark, sf), V.images(spark, sf), 4, "c1", per_layer=2)


@query("class_crops", with_views(O.PX, O.IMAGES, CROPS) + "SELECT * FROM crops")
def class_crops(spark, sf):
    return crops(spark, sf)


@query("crop_cells", with_views(O.PX, O.IMAGES, CROPS) + """
  SELECT k.image_id || '-' || k.class_id || '-' || draw AS sample_id, k.image_id, c.class_id, c.y - top AS y, c.x - "left" AS x FROM crops k JOIN cells c
  ON c.image_id = k.image_id AND c.y >= top AND c.y < top + 4 AND c.x >= "left" AND c.x < "left" + 4""")
def crop_cells(spark, sf):
    windows = crops(spark, sf).withColumn("sample_id", F.concat_ws("-", "image_id", "class_id", "draw"))
    return A.crop(windows, V.gt_cells(spark, sf)).drop("v")


@query("uniform_crops", with_views(O.PX, O.IMAGES, IMG_DRAWS) + f"""
  SELECT sample_id, image_id, CAST(floor({U('u1-x', 'sample_id')} * greatest(width - 4, 1)) AS INT) AS "left", CAST(floor({U('u1-y', 'sample_id')} * greatest(height - 4, 1)) AS INT) AS top, 4 AS size
  FROM img_draws JOIN images USING (image_id)""")
def uniform_crops(spark, sf):
    im = V.images(spark, sf)
    return S.uniform_crops(S.sample_images(im, DRAWS, "i1"), im, 4, "u1")


REGIONS = f"""lay AS (SELECT image_id, height, width, CAST(c AS INT) AS class_id, CAST(k AS INT) AS try FROM images, range(3) r(c), range(1, 51) s(k)),
ctr AS (SELECT *, floor({U('r1-x', 'image_id', 'class_id', 'try')} * width) AS cx, floor({U('r1-y', 'image_id', 'class_id', 'try')} * height) AS cy, CAST(2 + floor({U('r1-size', 'image_id', 'class_id', 'try')} * 7) AS INT) AS side FROM lay),
cand AS (SELECT image_id, class_id, try, CAST(side AS INT) AS side, CAST(greatest(0, cx - side // 2) AS INT) AS l, CAST(greatest(0, cy - side // 2) AS INT) AS t, CAST(least(width, cx + side // 2) AS INT) AS r, CAST(least(height, cy + side // 2) AS INT) AS b FROM ctr),
cells AS (SELECT DISTINCT image_id, class_id, y, x FROM px),
rated AS (SELECT k.image_id, k.class_id, try, side, l, t, r, b, count(c.y) AS mass FROM cand k LEFT JOIN cells c ON c.image_id = k.image_id AND c.class_id = k.class_id AND y >= t AND y < b AND x >= l AND x < r GROUP BY ALL),
ok AS (SELECT *, (image_id, class_id) NOT IN (SELECT image_id, class_id FROM cells) OR ((b - t) * (r - l) > 0 AND mass >= 0.6 * (b - t) * (r - l)) AS good FROM rated),
picked AS (SELECT *, CAST(bool_or(good) OVER (PARTITION BY image_id, class_id) AS INT) AS accepted FROM ok QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY good DESC, CASE WHEN good THEN try ELSE -try END) = 1)"""


@query("sample_regions", with_views(O.PX, O.IMAGES, REGIONS) + "SELECT image_id, class_id, try, l, t, r, b, side, accepted FROM picked")
def sample_regions(spark, sf):
    """A strict criterion, so that many tries fail."""
    return S.sample_regions(V.images(spark, sf), V.gt_cells(spark, sf), "r1", 2, 8, criterion=0.6)


VARIED = f"""tries AS (SELECT sample_id, CAST(k AS INT) AS try, image_id, CAST(floor({U('v1-x', 'sample_id', 'k')} * (width - 1)) AS INT) AS "left", CAST(floor({U('v1-y', 'sample_id', 'k')} * (height - 1)) AS INT) AS top, 2 AS size
  FROM img_draws JOIN images USING (image_id), range(1, 4) r(k)),
lim AS (SELECT t.*, k.c, coalesce(min(v) < max(v), false) AS varied FROM tries t CROSS JOIN (SELECT CAST(c AS INT) AS c FROM range(3) r(c)) k LEFT JOIN inten i ON i.image_id = t.image_id AND i.c = k.c AND i.y >= top AND i.y < top + 2 AND i.x >= "left" AND i.x < "left" + 2 GROUP BY ALL)"""


@query("varied_crops", with_views(O.PX, O.IMAGES, O.INTENSITY, IMG_DRAWS, VARIED) + """
  SELECT sample_id * 3 + c AS sample_id, try, "left", top, size, image_id * 3 + c AS image_id, varied FROM lim QUALIFY row_number() OVER (PARTITION BY sample_id, c ORDER BY varied DESC, CASE WHEN varied THEN try ELSE -try END) = 1""")
def varied_crops(spark, sf):
    im = V.images(spark, sf)
    tries = S.sample_images(im, DRAWS, "i1").join(im, "image_id").withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(3))))
    at = lambda what, extent: F.floor(S.uniform(f"v1-{what}", F.col("sample_id"), F.col("try")) * (F.col(extent) - 1)).cast("int")
    windows = tries.select("sample_id", "try", "image_id", at("x", "width").alias("left"), at("y", "height").alias("top"), F.lit(2).alias("size"))
    # every channel is a page of its own
    each = windows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({k: F.col(k) * 3 + F.col("c") for k in ("sample_id", "image_id")}).drop("c")
    return S.first_varied_crop(each, V.intensity(spark, sf).withColumn("image_id", F.col("image_id") * 3 + F.col("c")).drop("c"))


@query("batch_mix", with_views(O.PX, INDEX) + """,
  s AS (SELECT class_id, n_pixels / sum(n_pixels) OVER () AS share FROM summ), c AS (SELECT class_id, share, sum(share) OVER (ORDER BY class_id) AS cum FROM s)
  SELECT class_id, CAST(floor((cum - share) * 64 + 1e-9) AS INT) AS "first", CAST(floor(cum * 64 + 1e-9) AS INT) AS "last" FROM c""")
def batch_mix(spark, sf):
    return S.batch_mix(C.class_summary(C.class_index(V.gt_cells(spark, sf))), 64)


@query("char_regions", with_views(O.BOXES, O.WORDS) + f"""
  SELECT page_id, box_id, pos, ch, CAST(CASE WHEN gap > 0 THEN r + gr - (b - t) ELSE l END AS INT) AS l, CAST(CASE WHEN gap < 0 THEN b + gr - (r - l) ELSE t END AS INT) AS t,
    CAST(CASE WHEN gap > 0 THEN r + gr ELSE r END AS INT) AS r, CAST(CASE WHEN gap < 0 THEN b + gr ELSE b END AS INT) AS b FROM (
    SELECT *, (b - t) - (r - l) AS gap, floor({U('g1', 'page_id', 'box_id', 'pos')} * abs((b - t) - (r - l)) + 0.5) AS gr FROM chars)""")
def char_regions(spark, sf):
    return S.char_regions(V.words(spark, sf), "g1")


@query("subword_samples", with_views(O.BOXES, O.WORDS) + f""",
  s AS (SELECT *, CAST(floor({U('w1-start', 'page_id', 'box_id')} * len(text)) AS INT) AS st FROM words),
  e AS (SELECT *, CAST(st + 1 + floor({U('w1-end', 'page_id', 'box_id')} * (len(text) - st)) AS INT) AS en FROM s)
  SELECT page_id, box_id, st AS "start", en AS "end", CAST(CASE WHEN st > 0 THEN l + (r - l) * st // len(text) ELSE l END AS INT) AS l, t,
    CAST(CASE WHEN en < len(text) THEN l + (r - l) * en // len(text) ELSE r END AS INT) AS r, b, substr(text, st + 1, en - st) AS text FROM e""")
def subword_samples(spark, sf):
    return S.subword_samples(V.words(spark, sf), "w1")


@query("cross_validate", with_views(O.PX, O.IMAGES, O.ANNOTATIONS, O.MODEL_PREDS) + """,
  hit AS (SELECT author, model_id, class_id, sum(v) AS tp FROM ann JOIN mp USING (image_id, y, x, class_id) GROUP BY 1, 2, 3),
  gm AS (SELECT author, class_id, CAST(count(*) AS DOUBLE) AS gt_mass FROM ann GROUP BY 1, 2), pm AS (SELECT model_id, class_id, sum(v) AS pred_mass FROM mp GROUP BY 1, 2),
  s AS (SELECT author, model_id, class_id, coalesce(tp, 0) AS tp, gt_mass, pred_mass FROM gm JOIN pm USING (class_id) LEFT JOIN hit USING (author, model_id, class_id))
  SELECT s.*, tp / gt_mass AS recall, tp / pred_mass AS precision, 2 * tp / (gt_mass + pred_mass) AS f1, n - gt_mass - pred_mass + tp AS tn, (n - gt_mass - pred_mass + 2 * tp) / n AS accuracy
  FROM s, (SELECT sum(CAST(height AS DOUBLE) * width) AS n FROM images) i""", rounded=["tp", "gt_mass", "pred_mass", "recall", "precision", "f1", "tn", "accuracy"])
def cross_validate(spark, sf):
    gt = V.annotations(spark, sf).distinct().withColumn("v", F.lit(1e0))
    out = FO.cross_validate(gt, V.model_predictions(spark, sf), "author", "model_id", V.AUTHORS, V.images(spark, sf))
    return out.select("author", "model_id", "class_id", "tp", "gt_mass", "pred_mass", "recall", "precision", "f1", "tn", "accuracy")


@query("leave_one_out", with_views(O.PX, O.ANNOTATIONS) + """,
  pool AS (SELECT author || '_' || image_id AS image_id, author, class_id FROM ann), w AS (SELECT unnest(['a0', 'a1', 'a2']) AS x)
  SELECT 'not' || x AS fold, class_id, count(*) AS cells, count(DISTINCT image_id) AS pages FROM pool, w WHERE author <> x GROUP BY 1, 2""")
def leave_one_out(spark, sf):
    pooled = FO.pool_authors(V.annotations(spark, sf).distinct())
    folds = FO.leave_one_out(pooled, V.AUTHORS, "author")
    return folds.groupBy("fold", "class_id").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("image_id").alias("pages"))
