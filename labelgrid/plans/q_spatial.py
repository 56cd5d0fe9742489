"""Stencils, distances, binarisation scores, tiles (G, E29-E32, E35, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.operators import binarization as Z
from labelgrid.operators import stencil as S
from labelgrid.operators import tiles as T
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views

V1 = with_views(O.PAIRS, O.IMAGES)
NEAR = "(SELECT CAST(a AS INT) AS dy FROM range(-{r}, {r} + 1) q(a)), (SELECT CAST(b AS INT) AS dx FROM range(-{r}, {r} + 1) q(b))"
INSIDE = "y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1"


@query("dilate", V1 + f"""
  SELECT image_id, y, x, class_id, max(p) AS v FROM (SELECT image_id, y + dy AS y, x + dx AS x, class_id, p FROM pairs, {NEAR.format(r=2)} WHERE p <> 0) JOIN images USING (image_id)
  WHERE {INSIDE} GROUP BY 1, 2, 3, 4""", rounded=["v"])
def dilate(spark, sf):
    """Two passes of a 3x3 maximum."""
    return S.dilate(V.pred_cells(spark, sf), V.images(spark, sf), 2)


@query("dilate_window", V1 + """
  SELECT image_id, y, x, class_id, max(p) AS v FROM (
    SELECT image_id, y + CAST(a AS INT) AS y, x + CAST(b AS INT) AS x, class_id, p FROM pairs, range(-1, 3) q(a), range(-1, 3) s(b) WHERE p <> 0) JOIN images USING (image_id)
  WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3, 4""", rounded=["v"])
def dilate_window(spark, sf):
    """A 4x4 maximum in one pass."""
    return S.dilate_window(V.pred_cells(spark, sf), V.images(spark, sf), 4)


BORDER = f"""sent AS (SELECT image_id, y + dy AS y, x + dx AS x, class_id FROM cells, {NEAR.format(r=1)}),
kept AS (SELECT image_id, y, x, class_id, count(*) AS k FROM sent SEMI JOIN cells USING (image_id, y, x, class_id) GROUP BY 1, 2, 3, 4),
bord AS (SELECT image_id, y, x, class_id FROM kept JOIN images USING (image_id) WHERE k < (least(y + 1, height - 1) - greatest(y - 1, 0) + 1) * (least(x + 1, width - 1) - greatest(x - 1, 0) + 1))"""
CELLS = "cells AS (SELECT DISTINCT image_id, y, x, 0 AS class_id FROM px)"


def ink(spark, sf):
    """Any-class ink as one layer."""
    return V.gt_cells(spark, sf).select("image_id", "y", "x", F.lit(0).alias("class_id"), "v").distinct()


@query("border", with_views(O.PX, O.IMAGES, CELLS, BORDER) + "SELECT *, 1e0 AS v FROM bord")
def border(spark, sf):
    return S.border(ink(spark, sf), V.images(spark, sf))


@query("erode", with_views(O.PX, O.IMAGES, CELLS, BORDER) + "SELECT *, 1e0 AS v FROM cells ANTI JOIN bord USING (image_id, y, x, class_id)")
def erode(spark, sf):
    return S.erode(ink(spark, sf), V.images(spark, sf))


@query("gaussian_smooth", V1 + """,
  k0 AS (SELECT CAST(i - 10 AS INT) AS d, exp(-((i - 10) ** 2) / 50e0) AS w FROM range(21) r(i)), k AS (SELECT d, w / (SELECT sum(w) FROM k0) AS w FROM k0)
  SELECT image_id, y, x, class_id, sum(v) AS v FROM (
    SELECT image_id, y + a.d AS y, x, class_id, v * a.w AS v FROM (SELECT image_id, y, x + b.d AS x, class_id, sum(p * b.w) AS v FROM pairs, k b WHERE p <> 0 GROUP BY ALL), k a) JOIN images USING (image_id)
  WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3, 4""", rounded=["v"])
def gaussian_smooth(spark, sf):
    return S.gaussian_smooth(V.pred_cells(spark, sf), V.images(spark, sf))


def grey(spark, sf):
    """Every channel as a page of its own."""
    return V.intensity(spark, sf).withColumn("image_id", F.col("image_id") * 3 + F.col("c")).drop("c")


def grey_images(spark, sf):
    return V.images(spark, sf).withColumn("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.col("image_id") * 3 + c)))


GREY = """gin AS (SELECT image_id * 3 + c AS image_id, y, x, v FROM inten), gim AS (SELECT image_id * 3 + c AS image_id, height, width FROM images, range(3) r(c))"""


@query("local_variance", with_views(O.PX, O.IMAGES, O.INTENSITY, GREY) + """,
  src AS (SELECT image_id, height, width, v, unnest([y, -1 - y, 2 * height - 1 - y]) AS qy, x FROM gin JOIN gim USING (image_id)),
  src2 AS (SELECT image_id, height, width, v, qy, unnest([x, -1 - x, 2 * width - 1 - x]) AS qx FROM src)
  SELECT image_id, y, x, sum(v * v) / 9 - (sum(v) / 9) ** 2 AS v FROM (
    SELECT image_id, height, width, v, qy + CAST(a AS INT) AS y, qx + CAST(b AS INT) AS x FROM src2, range(-1, 2) r(a), range(-1, 2) s(b))
  WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3""", rounded=["v"])
def local_variance(spark, sf):
    return S.local_variance(grey(spark, sf), grey_images(spark, sf), 3)


PROFILES = """rows_y AS (SELECT image_id, CAST(unnest(range(0, height)) AS INT) AS y, width AS n FROM gim),
cols_x AS (SELECT image_id, CAST(unnest(range(0, width)) AS INT) AS x, height AS n FROM gim),
py AS (SELECT image_id, y, coalesce(s, 0) / n AS mean, coalesce(s2, 0) / n - (coalesce(s, 0) / n) ** 2 AS variance FROM rows_y LEFT JOIN (SELECT image_id, y, sum(v) AS s, sum(v * v) AS s2 FROM gin GROUP BY 1, 2) USING (image_id, y)),
pxx AS (SELECT image_id, x, coalesce(s, 0) / n AS mean, coalesce(s2, 0) / n - (coalesce(s, 0) / n) ** 2 AS variance FROM cols_x LEFT JOIN (SELECT image_id, x, sum(v) AS s, sum(v * v) AS s2 FROM gin GROUP BY 1, 2) USING (image_id, x))"""


@query("row_profile", with_views(O.PX, O.IMAGES, O.INTENSITY, GREY, PROFILES) + "SELECT image_id, y, mean, variance FROM py", rounded=["mean", "variance"], digits=12)
def row_profile(spark, sf):
    return S.profile(grey(spark, sf), grey_images(spark, sf), "y")


@query("column_profile", with_views(O.PX, O.IMAGES, O.INTENSITY, GREY, PROFILES) + "SELECT image_id, x, mean, variance FROM pxx", rounded=["mean", "variance"], digits=12)
def column_profile(spark, sf):
    return S.profile(grey(spark, sf), grey_images(spark, sf), "x")


@query("profile_variance", with_views(O.PX, O.IMAGES, O.INTENSITY, GREY, PROFILES) + """,
  pts AS (SELECT DISTINCT image_id, y, x FROM gin),
  vx AS (SELECT image_id, p.x, var_pop(q.mean) AS var_x FROM pxx p JOIN gim USING (image_id) LEFT JOIN pxx q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 1 AND q.x < width - 1 GROUP BY 1, 2),
  vy AS (SELECT image_id, p.y, var_pop(q.mean) AS var_y FROM py p JOIN gim USING (image_id) LEFT JOIN py q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 2 AND p.y + 1 AND q.y < height - 1 GROUP BY 1, 2)
  SELECT image_id, y, x, coalesce(var_x, 0) * coalesce(var_y, 0) AS v FROM pts JOIN vx USING (image_id, x) JOIN vy USING (image_id, y)""", rounded=["v"])
def profile_variance(spark, sf):
    points = grey(spark, sf).select("image_id", "y", "x").distinct()
    return S.profile_variance(grey(spark, sf), grey_images(spark, sf), points, 2).select("image_id", "y", "x", "v")


@query("nearest_distance", with_views(O.PAIRS) + """
  SELECT image_id, class_id, y, x, least(coalesce(d, 100), 100) AS d FROM (SELECT image_id, class_id, y, x FROM pairs WHERE p <> 0) LEFT JOIN (
    SELECT q.image_id, q.class_id, q.y, q.x, min(sqrt((q.y - m.y) ** 2 + (q.x - m.x) ** 2)) AS d FROM pairs q JOIN pairs m ON q.image_id = m.image_id AND q.class_id = m.class_id AND m.g <> 0 AND abs(q.y - m.y) <= 100
    WHERE q.p <> 0 GROUP BY 1, 2, 3, 4) USING (image_id, class_id, y, x)""", rounded=["d"])
def nearest_distance(spark, sf):
    """From predicted to true pixels of every class, cut at 100."""
    return S.distance_to(V.gt_cells(spark, sf), V.pred_cells(spark, sf), 100, ["image_id", "class_id"])


@query("distance_to_empty", with_views(O.PX, O.IMAGES, CELLS) + """,
  dense AS (SELECT image_id, y, CAST(unnest(range(0, width)) AS INT) AS x FROM (SELECT image_id, width, CAST(unnest(range(0, height)) AS INT) AS y FROM images)),
  empty AS (SELECT * FROM dense ANTI JOIN cells USING (image_id, y, x))
  SELECT image_id, y, x, least(coalesce(d, 100), 100) AS d FROM (SELECT DISTINCT image_id, y, x FROM cells) LEFT JOIN (
    SELECT c.image_id, c.y, c.x, min(sqrt((c.y - e.y) ** 2 + (c.x - e.x) ** 2)) AS d FROM cells c JOIN empty e ON c.image_id = e.image_id AND abs(c.y - e.y) <= 100 GROUP BY 1, 2, 3) USING (image_id, y, x)""", rounded=["d"])
def distance_to_empty(spark, sf):
    """Depth of each inked pixel, cut at 100."""
    return S.distance_to_empty(ink(spark, sf), V.images(spark, sf), 100)


@query("distance_map", with_views(O.PX, O.IMAGES) + """,
  rare AS (SELECT DISTINCT image_id, y, x FROM px WHERE l_quantity = 50),
  dense AS (SELECT image_id, y, CAST(unnest(range(0, width)) AS INT) AS x FROM (SELECT image_id, width, CAST(unnest(range(0, height)) AS INT) AS y FROM images WHERE image_id IN (SELECT image_id FROM rare)))
  SELECT d.image_id, d.y, d.x, sqrt(min((d.y - r.y) ** 2 + (d.x - r.x) ** 2)) AS d FROM dense d JOIN rare r USING (image_id) GROUP BY 1, 2, 3""", rounded=["d"])
def distance_map(spark, sf):
    """Every pixel's distance to the nearest full-quantity mark, any radius."""
    marks = V.line_pixels(spark, sf).where("l_quantity = 50").select("image_id", "y", "x")
    return S.distance_map(marks, V.images(spark, sf))


# every class is a page of its own
BIN0 = """cim AS (SELECT image_id * 3 + k AS image_id, height, width FROM images, range(3) r(k)),
g0 AS (SELECT DISTINCT image_id * 3 + class_id AS image_id, y, x FROM pairs WHERE g <> 0), p0 AS (SELECT DISTINCT image_id * 3 + class_id AS image_id, y, x FROM pairs WHERE p > 0.5),
sk AS (SELECT DISTINCT image_id * 3 + class_id AS image_id, y, x FROM px WHERE l_quantity > 25),
flip AS (SELECT * FROM (SELECT image_id, y, x, CAST(g0.image_id IS NOT NULL AS INT) AS g, CAST(p0.image_id IS NOT NULL AS INT) AS p FROM g0 FULL JOIN p0 USING (image_id, y, x)))"""


def bin_layers(spark, sf):
    v = V.pairs(spark, sf).withColumn("image_id", F.col("image_id") * 3 + F.col("class_id"))
    return v.where("g <> 0"), v.where("p > 0.5")


@query("binarization_scores", with_views(O.PAIRS, O.IMAGES, BIN0) + """,
  c AS (SELECT image_id, CAST(height AS DOUBLE) * width AS n, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(st, 0) AS st, coalesce(sg, 0) AS sg FROM cim
    LEFT JOIN (SELECT image_id, CAST(sum(g * p) AS DOUBLE) AS tp, CAST(sum(p - g * p) AS DOUBLE) AS fp, CAST(sum(g - g * p) AS DOUBLE) AS fn FROM flip GROUP BY 1) USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS sg, count(*) FILTER ((image_id, y, x) IN (SELECT image_id, y, x FROM p0)) AS st FROM sk GROUP BY 1) USING (image_id)),
  r AS (SELECT *, n - tp - fp - fn AS tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, st / nullif(sg, 0) AS pr FROM c)
  SELECT image_id, precision, recall, 2 * recall * precision / nullif(recall + precision, 0) AS f1, 10 * log10(n / nullif(fp + fn, 0)) AS psnr,
    (fn / nullif(fn + tp, 0) + fp / nullif(fp + tn, 0)) / 2 AS nrm, 2 * pr * precision / nullif(pr + precision, 0) AS pseudo_f1 FROM r""", rounded=["precision", "recall", "f1", "psnr", "nrm", "pseudo_f1"])
def binarization_scores(spark, sf):
    """Quantity above 25 stands in for the supplied skeleton."""
    skeleton = V.line_pixels(spark, sf).where("l_quantity > 25").withColumn("image_id", F.col("image_id") * 3 + F.col("class_id"))
    return Z.binarization_scores(*bin_layers(spark, sf), grey_images(spark, sf), skeleton)


@query("drd", with_views(O.PAIRS, O.IMAGES, BIN0) + f""",
  w0 AS (SELECT dy, dx, 1 / sqrt(dy * dy + dx * dx) AS w FROM {NEAR.format(r=2)} WHERE dy <> 0 OR dx <> 0), w AS (SELECT dy, dx, w / (SELECT sum(w) FROM w0) AS w FROM w0),
  look AS (SELECT image_id, y + dy AS y, x + dx AS x, p, w FROM flip JOIN cim USING (image_id), w WHERE g <> p AND y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1),
  dist AS (SELECT look.image_id, sum(CASE WHEN CAST(g0.y IS NOT NULL AS INT) <> p THEN w ELSE 0 END) AS s FROM look LEFT JOIN g0 ON g0.image_id = look.image_id AND g0.y = look.y AND g0.x = look.x GROUP BY 1),
  blk AS (SELECT image_id, count(*) AS blocks FROM (SELECT image_id, y // 8 AS by_, x // 8 AS bx_, count(*) AS k, any_value(height) AS h, any_value(width) AS wd FROM g0 JOIN cim USING (image_id) GROUP BY 1, 2, 3)
    WHERE k < least(8, h - by_ * 8) * least(8, wd - bx_ * 8) GROUP BY 1)
  SELECT image_id, coalesce(s, 0) AS distortion, coalesce(blocks, 0) AS blocks, coalesce(s, 0) / nullif(coalesce(blocks, 0), 0) AS drd FROM cim LEFT JOIN dist USING (image_id) LEFT JOIN blk USING (image_id)""",
       rounded=["distortion", "drd"])
def drd(spark, sf):
    return Z.drd(*bin_layers(spark, sf), grey_images(spark, sf))


@query("misclassification_penalty", with_views(O.PAIRS, O.IMAGES, BIN0) + f""",
  dense AS (SELECT image_id, y, CAST(unnest(range(0, width)) AS INT) AS x FROM (SELECT image_id, width, CAST(unnest(range(0, height)) AS INT) AS y FROM cim)),
  around AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM g0 JOIN cim USING (image_id), {NEAR.format(r=1)} WHERE y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1),
  edge AS (SELECT * FROM around ANTI JOIN g0 USING (image_id, y, x)),
  col AS (SELECT d.image_id, d.y, d.x, min(abs(d.y - b.y)) AS g FROM dense d JOIN edge b ON d.image_id = b.image_id AND d.x = b.x GROUP BY 1, 2, 3),
  dist AS (SELECT d.image_id, d.y, d.x, min(sqrt(c.g ** 2 + (d.x - c.x) ** 2)) AS d FROM dense d JOIN col c ON d.image_id = c.image_id AND d.y = c.y GROUP BY 1, 2, 3),
  e AS (SELECT image_id, sum(d) AS everywhere, coalesce(sum(d) FILTER (g <> p), 0) AS wrong FROM dist LEFT JOIN flip USING (image_id, y, x) GROUP BY 1)
  SELECT cim.image_id, wrong / (2 * everywhere) AS mpm FROM cim LEFT JOIN e USING (image_id)""", rounded=["mpm"])
def misclassification_penalty(spark, sf):
    return Z.misclassification_penalty(*bin_layers(spark, sf), grey_images(spark, sf))


@query("error_saliency", with_views(O.PAIRS, O.IMAGES, O.BINARY) + f""",
  far AS (SELECT f.image_id, f.class_id, f.y, f.x, least(coalesce(min(sqrt((f.y - t.y) ** 2 + (f.x - t.x) ** 2)), 100), 100) AS d FROM bin f
    LEFT JOIN bin t ON t.image_id = f.image_id AND t.class_id = f.class_id AND t.g > 0 AND abs(t.y - f.y) <= 100 WHERE f.p > f.g GROUP BY 1, 2, 3, 4),
  dense AS (SELECT image_id, class_id, y, CAST(unnest(range(0, width)) AS INT) AS x FROM (SELECT image_id, width, CAST(k AS INT) AS class_id, CAST(unnest(range(0, height)) AS INT) AS y FROM images, range(3) r(k))),
  paper AS (SELECT * FROM dense ANTI JOIN (SELECT * FROM bin WHERE g > 0) USING (image_id, class_id, y, x)),
  deep AS (SELECT f.image_id, f.class_id, f.y, f.x, least(coalesce(min(sqrt((f.y - t.y) ** 2 + (f.x - t.x) ** 2)), 100), 100) AS d FROM bin f
    LEFT JOIN paper t ON t.image_id = f.image_id AND t.class_id = f.class_id AND abs(t.y - f.y) <= 100 WHERE f.g > f.p GROUP BY 1, 2, 3, 4),
  e AS (SELECT image_id, class_id, y, x, d AS fp, 0e0 AS fn FROM far UNION ALL SELECT image_id, class_id, y, x, 0e0, d FROM deep),
  t AS (SELECT image_id, class_id, greatest(0.001, max(fp)) AS tp, greatest(0.001, max(fn)) AS tn FROM e GROUP BY 1, 2)
  SELECT image_id, class_id, y, x, fp / tp AS fp, fn / tn AS fn, fp / tp + fn / tn AS saliency FROM e JOIN t USING (image_id, class_id)""", rounded=["fp", "fn", "saliency"])
def error_saliency(spark, sf):
    from labelgrid.operators.metrics import binarize

    return Z.error_saliency(binarize(V.pairs(spark, sf), 0.5, 0.5), V.images(spark, sf))


WIDE = with_views(O.wide(O.PAIRS), O.wide(O.IMAGES))
EACH_SPLIT = f"(SELECT unnest({T.SPLITS}) AS n) r"
SUBDIV = f"""sub AS (
  SELECT image_id, CAST(n AS INT) AS n, CAST(x // (width // n) AS INT) AS cx, CAST(y // (height // n) AS INT) AS cy, CAST(y % (height // n) AS INT) AS y, CAST(x % (width // n) AS INT) AS x, class_id, g AS v
  FROM pairs JOIN images USING (image_id), {EACH_SPLIT} WHERE g <> 0 AND y // (height // n) < n AND x // (width // n) < n)"""
BEST = f"""grid AS (SELECT image_id, CAST(n AS INT) AS n FROM images, {EACH_SPLIT}),
mass AS (SELECT image_id, n, cx, cy, sum(v) AS mass FROM sub WHERE class_id IN (1, 2) GROUP BY 1, 2, 3, 4),
best AS (SELECT image_id, n, coalesce(cx, 0) AS cx, coalesce(cy, 0) AS cy, coalesce(mass, 0) AS mass FROM grid LEFT JOIN (
  SELECT * FROM mass QUALIFY row_number() OVER (PARTITION BY image_id, n ORDER BY mass DESC, cx, cy) = 1) USING (image_id, n))"""


@query("subdivide_pages", WIDE + "," + SUBDIV + "SELECT image_id, n, cx, cy, class_id, sum(v) AS mass, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x) AS BIGINT) AS sx FROM sub GROUP BY 1, 2, 3, 4, 5", rounded=["mass"])
def subdivide_pages(spark, sf):
    return T.subdivide(V.gt_cells(spark, sf, wide=True), V.images(spark, sf, wide=True)).groupBy("image_id", "n", "cx", "cy", "class_id").agg(
        F.sum("v").alias("mass"), F.sum("y").alias("sy"), F.sum("x").alias("sx"))


@query("best_train_tile", WIDE + "," + SUBDIV + "," + BEST + "SELECT * FROM best", rounded=["mass"])
def best_train_tile(spark, sf):
    return T.best_train_tile(V.gt_cells(spark, sf, wide=True), V.images(spark, sf, wide=True))


@query("train_validation_tiles", WIDE + "," + SUBDIV + "," + BEST + """
  SELECT n, class_id, CASE WHEN b.cx IS NULL THEN 'validation' ELSE 'train' END AS split, count(*) AS cells FROM sub s LEFT JOIN best b USING (image_id, n, cx, cy) GROUP BY 1, 2, 3""")
def train_validation_tiles(spark, sf):
    gt, im = V.gt_cells(spark, sf, wide=True), V.images(spark, sf, wide=True)
    parts = T.train_validation_split(T.subdivide(gt, im), T.best_train_tile(gt, im))
    return parts.groupBy("n", "class_id", "split").agg(F.count(F.lit(1)).alias("cells"))


PLAN = """xs AS (SELECT DISTINCT image_id, least(i * 448, greatest(width - 896, 0)) AS s, width FROM images, range(0, 100) r(i) WHERE i <= ceil(greatest(width - 896, 0) / 448e0)),
ys AS (SELECT DISTINCT image_id, least(i * 448, greatest(height - 896, 0)) AS s, height FROM images, range(0, 100) r(i) WHERE i <= ceil(greatest(height - 896, 0) / 448e0))"""


@query("plan_tiles", WIDE + "," + PLAN + """
  SELECT image_id, height, width, CAST(row_number() OVER (PARTITION BY image_id ORDER BY xs.s, ys.s) - 1 AS INT) AS ord, CAST(xs.s AS INT) AS "left", CAST(ys.s AS INT) AS top, 896 AS size FROM xs JOIN ys USING (image_id)""")
def plan_tiles(spark, sf):
    return T.plan_tiles(V.images(spark, sf, wide=True))


@query("stitch_tiles", WIDE + "," + PLAN + """,
  win AS (SELECT image_id, y, x, class_id, p, xs.s AS xs, ys.s AS ys, row_number() OVER (PARTITION BY image_id, y, x, class_id ORDER BY xs.s DESC, ys.s DESC) AS r FROM pairs JOIN xs USING (image_id) JOIN ys USING (image_id)
    WHERE p <> 0 AND x >= xs.s + CASE WHEN xs.s > 0 THEN 224 ELSE 0 END AND x < xs.s + CASE WHEN xs.s + 896 < width THEN 672 ELSE 896 END
      AND y >= ys.s + CASE WHEN ys.s > 0 THEN 224 ELSE 0 END AND y < ys.s + CASE WHEN ys.s + 896 < height THEN 672 ELSE 896 END)
  SELECT image_id, y, x, class_id, p * (1 + ys + 3 * xs) + (y - ys) AS v FROM win WHERE r = 1""", rounded=["v"])
def stitch_tiles(spark, sf):
    """Values that depend on the tile show which tile each pixel was taken from."""
    tiles = T.tile_cells(V.pred_cells(spark, sf, wide=True), V.images(spark, sf, wide=True))
    return T.stitch_tiles(tiles.withColumn("v", F.col("v") * (1 + F.col("top") + 3 * F.col("left")) + F.col("y")))


@query("average_levels", V1 + """,
  half AS (SELECT image_id, y // 2 AS y, x // 2 AS x, class_id, avg(p) AS p FROM pairs WHERE p <> 0 GROUP BY 1, 2, 3, 4),
  lv AS (SELECT image_id, y, x, class_id, p FROM pairs WHERE p <> 0
    UNION ALL SELECT image_id, y * 2 + CAST(a AS INT) + 1, x * 2 + CAST(b AS INT) + 1, class_id, p FROM half, range(2) r(a), range(2) s(b))
  SELECT image_id, y, x, class_id, sum(p) / 3 AS v FROM lv GROUP BY 1, 2, 3, 4""", rounded=["v"])
def average_levels(spark, sf):
    """A full-size level and a half-size one shifted by a pixel."""
    full = V.pred_cells(spark, sf)
    half = full.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "class_id").agg(F.avg("v").alias("v"))
    level = lambda df, scale, off: df.withColumns({"scale": F.lit(scale), "off_y": F.lit(off), "off_x": F.lit(off)})
    return T.average_levels(level(full, 1, 0).unionByName(level(half, 2, 1)), 2)
