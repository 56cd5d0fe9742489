"""Steps that once held a row per pixel and offset, or all groups of a task's input: results over tile edges, with repeats and nulls, and what is shuffled."""

import numpy as np
import pytest
from dense import cells, images, layer
from pyspark.sql import functions as F

from labelgrid.operators import binarization as Z
from labelgrid.operators import losses as L
from labelgrid.operators import pixels as P
from labelgrid.operators import stencil as S
from labelgrid.operators import tiles as T
from labelgrid.operators.align import align
from labelgrid.plans import jobs as J
from labelgrid.sources import layers as LY
from labelgrid.sources import textfiles as X

RNG = np.random.default_rng(8)
INK = np.zeros((600, 530))
INK[490:540, 500:530] = RNG.random((50, 30)) > 0.4
INK[0:3, 0:3] = 1
SOFT = INK * RNG.random(INK.shape)


def one(a):
    return np.asarray(a)[:, :, None]


def plan(df):
    return df._jdf.queryExecution().toString()


def deals_before_it_sums(df):
    """Whether no partial sums are built before the last shuffle."""
    physical = df._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION" in physical and "partial" not in physical[physical.index("REPARTITION"):].split("LocalTableScan")[0].split("Scan ExistingRDD")[0]


def test_stencils_over_tile_edges_shuffle_cells_only(spark):
    soft, ink, im = cells(spark, one(SOFT)), cells(spark, one(INK)), images(spark, one(SOFT))
    padded = np.pad(SOFT, 2)
    wide = np.max([padded[i:i + 600, j:j + 530] for i in range(5) for j in range(5)], axis=0)
    assert np.allclose(layer(S.dilate(soft, im, 2), SOFT.shape), wide)
    solid = np.pad(INK, 1, constant_values=1)
    kept = np.min([solid[i:i + 600, j:j + 530] for i in range(3) for j in range(3)], axis=0)
    assert np.array_equal(layer(S.border(ink, im), INK.shape), INK * (1 - kept))
    assert np.array_equal(layer(S.erode(ink, im), INK.shape), INK * kept)
    mirrored = np.pad(SOFT, 1, mode="symmetric")
    window = np.array([mirrored[i:i + 600, j:j + 530] for i in range(3) for j in range(3)])
    assert np.allclose(layer(S.local_variance(soft.drop("class_id"), im, 3), SOFT.shape), window.var(axis=0))
    for df in (S.dilate(soft, im, 2), S.dilate_window(soft, im, 4), S.local_variance(soft.drop("class_id"), im, 3)):
        assert "FlatMapGroupsInArrow" in plan(df) and "HashAggregate" not in plan(df)


def test_stencils_keep_nulls_and_repeats(spark):
    im = spark.createDataFrame([("a", 4, 4, 1)], "image_id string, height int, width int, n_classes int")
    rows = [("a", 1, 1, 0, None), ("a", 1, 1, 0, 2.0), ("a", 3, 3, None, None), ("a", None, 1, 0, 9.0), ("a", 1, None, 0, 9.0), (None, 1, 1, 0, 9.0), ("b", 1, 1, 0, 9.0)]
    some = spark.createDataFrame(rows, "image_id string, y int, x int, class_id int, v double")
    got = {(r["y"], r["x"], r["class_id"]): r["v"] for r in S.dilate(some, im).collect()}
    assert got == {**{(y, x, 0): 2.0 for y in range(3) for x in range(3)}, **{(y, x, None): None for y in (2, 3) for x in (2, 3)}}
    loose = spark.createDataFrame([("a", 0, None, 0, 1.0), ("a", 1, None, 0, 1.0), ("a", None, 1, 0, 1.0)], some.schema)
    assert {tuple(r) for r in S.border(loose, im).collect()} == {("a", 0, None, 0, 1.0), ("a", 1, None, 0, 1.0)}


def test_distortion_looks_are_no_rows(spark):
    guess = np.where(RNG.random(INK.shape) > 0.999, 1 - INK, INK)
    got = Z.drd(cells(spark, one(INK)), cells(spark, one(guess)), images(spark, one(INK)))
    weights, total = Z.distortion_weights(), 0.0
    for y, x in zip(*np.nonzero(INK != guess)):
        total += sum(w for dy, dx, w in weights if 0 <= y + dy < 600 and 0 <= x + dx < 530 and INK[y + dy, x + dx] != guess[y, x])
    shares = [INK[i:i + 8, j:j + 8].mean() for i in range(0, 600, 8) for j in range(0, 530, 8)]
    row = got.first()
    assert row["distortion"] == pytest.approx(total) and row["blocks"] == sum(0 < s < 1 for s in shares)
    assert plan(got).count("Generate explode(array(") == 0


def test_both_sides_of_a_blurred_loss_meet_in_the_tile(spark):
    gt, pred, im = cells(spark, one(INK)), cells(spark, one(SOFT)), images(spark, one(INK))
    apart = L.continuous_f_loss(align(S.gaussian_smooth(gt, im), S.gaussian_smooth(pred, im)), im).first()["loss"]
    together = L.blurred_f_loss(gt, pred, im)
    assert together.first()["loss"] == pytest.approx(apart)
    assert plan(together).count("FlatMapGroupsInArrow") == plan(L.continuous_f_loss(S.gaussian_smooth_pairs(gt, pred, im), im)).count("FlatMapGroupsInArrow") > 0


def test_levels_squares_and_logs_are_dealt_before_they_are_summed(spark):
    levels = spark.createDataFrame([("a", 0, 0, 0, 3.0, 2, 1, 1), ("a", 1, 1, 0, 6.0, 1, 0, 0)], "image_id string, y int, x int, class_id int, v double, scale int, off_y int, off_x int")
    summed = T.average_levels(levels, 2)
    assert {(r["y"], r["x"]): r["v"] for r in summed.collect()} == {(1, 1): 3.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 1.0}
    squares = P.downsample(spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 3, 3, 0, 2.0), ("a", 4, 0, 0, 5.0)], "image_id string, y int, x int, c int, v double"), 4)
    assert {(r["y"], r["x"]): r["v"] for r in squares.collect()} == {(0, 0): 1.5, (1, 0): 5.0}
    log = "\n".join(["2 score: 0.9"] + ["-"] * 5 + ["2 score: 0.5", "3 score: x"] + ["-"] * 30)
    swept = X.sweep_from_logs(X.parse_validation_logs(spark.createDataFrame([("v.5.txt", log), ("v.6.txt", "a\nb")], "file string, value string")))
    assert {tuple(r) for r in swept.collect()} == {("v.5.txt", 0.5, "2", 0.5, 0.9), ("v.5.txt", 0.5, "3", None, None), ("v.5.txt", 0.5, "-", None, None)}
    assert all(deals_before_it_sums(df) for df in (summed, squares, swept))


def test_tile_scores_outside_the_kept_part_are_not_handed_on(spark):
    """Scorers that write into their tile or give scores everywhere see a clean tile, and give each pixel once."""
    im = spark.createDataFrame([("a", 40, 24, 1)], "image_id string, height int, width int, n_classes int")
    px = spark.createDataFrame([("a", 3, 4, 0, 0.5), ("a", 30, 20, 0, 0.25)], "image_id string, y int, x int, c int, v double")

    def scorer(tile):
        tile += 1
        return tile[:, :, :1]

    got = J.score_images(px, im, scorer, size=16, stride=8, channels=1)
    want = np.ones((40, 24))
    want[3, 4], want[30, 20] = 1.5, 1.25
    assert got.count() == 40 * 24 and np.array_equal(layer(got, want.shape), want)
    handed = spark.createDataFrame([("a", 16, 8, 40, 40, 0, 0, -1, 0.0)], "image_id string, left int, top int, height int, width int, y int, x int, c int, v double").toArrow()
    out = J._tile_scorer(scorer, 16, 8, 1)(handed)
    assert out.num_rows == 8 * 8 and set(out.column("x").to_pylist()) == set(range(4, 12))


def test_saliency_deals_cells_once(spark):
    """Against plain distances over tile edges; repeats add up, nulls and pages without an extent go; both distances come from one pass over tiles."""
    truth, guess = np.zeros((520, 6)), np.zeros((520, 6))
    truth[505:518, 1:5], guess[[2, 500, 510, 515], [0, 5, 2, 5]] = 1, [1, 0.5, 1, 2]
    im = images(spark, one(truth))
    more = spark.createDataFrame([("p", 2, 0, 0, 0.0, 1.0), ("p", None, 0, 0, 0.0, 1.0), ("p", 3, 0, None, 0.0, 1.0), ("nowhere", 1, 1, 0, 0.0, 1.0)], "image_id string, y int, x int, class_id int, g double, p double")
    pairs = align(cells(spark, one(truth)), cells(spark, one(guess)))
    name = im.first()["image_id"]
    some = more.replace("p", str(name)) if isinstance(name, str) else more.withColumn("image_id", F.when(F.col("image_id") == "p", F.lit(name)))
    out = Z.error_saliency(pairs.unionByName(some.select(pairs.columns)), im)
    ys, xs = np.nonzero(truth)
    grid = np.indices(truth.shape)
    near = lambda mask: np.sqrt(((grid[0][..., None] - np.nonzero(mask)[0]) ** 2 + (grid[1][..., None] - np.nonzero(mask)[1]) ** 2).min(axis=2))
    over = np.minimum(np.clip(guess - truth, 0, None), 1)
    over[2, 0] *= 2
    fp, fn = over * np.minimum(near(truth), 100), np.clip(truth - guess, 0, 1) * near(truth == 0)
    rows = {(r["y"], r["x"]): (r["fp"], r["fn"]) for r in out.collect()}
    want = {(int(y), int(x)): (fp[y, x] / fp.max(), fn[y, x] / fn.max()) for y, x in zip(*np.nonzero(guess != truth))}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("FlatMapGroupsInArrow") == 2 and "FlatMapGroupsInPandas" not in logical


def test_strips_cross_to_python_in_small_batches(spark):
    """A batch of strips is bounded, and so is a piece of what comes back."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    page = bytes(range(1, 250)) * 4
    pages = spark.createDataFrame([(f"x/img{k}.png", 4, 249, 1, page) for k in range(3)], "path string, height int, width int, nChannels int, data binary")
    strips = LY.strips(pages)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) * LY.STRIP_BYTES <= 1 << 25
    batch = strips.toArrow().to_batches()[0]
    out = list(LY._per_strip(LY._mask_pixels)(iter([batch] * 200)))
    assert sum(b.num_rows for b in out) == 200 * batch.num_rows * 996 and max(b.num_rows for b in out) <= LY.OUTPUT_ROWS + LY.STRIP_BYTES
