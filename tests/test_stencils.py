import numpy as np
import pytest
from dense import cells, images, layer

from labelgrid.operators import binarization as Z
from labelgrid.operators import stencil as S
from labelgrid.operators import tiles as T
from labelgrid.operators.align import align

RNG = np.random.default_rng(3)
MASK = (RNG.random((23, 17)) > 0.8).astype(float)
SOFT = RNG.random((23, 17)) * MASK


def one(a):
    return np.asarray(a)[:, :, None]


def shifted_max(a, n):
    p = np.pad(a, n)
    return np.max([p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(2 * n + 1) for j in range(2 * n + 1)], axis=0)


@pytest.mark.parametrize("n", [1, 3])
def test_dilate(spark, n):
    assert np.allclose(layer(S.dilate(cells(spark, one(SOFT)), images(spark, one(SOFT)), n), SOFT.shape), shifted_max(SOFT, n))


def test_border_and_erode(spark):
    a = np.zeros((9, 9))
    a[2:7, 0:5] = 1
    inner = np.array([[all(a[yy, xx] for yy in range(max(0, y - 1), min(9, y + 2)) for xx in range(max(0, x - 1), min(9, x + 2))) for x in range(9)] for y in range(9)])
    im = images(spark, one(a))
    assert np.array_equal(layer(S.erode(cells(spark, one(a)), im), a.shape), (a * inner))
    assert np.array_equal(layer(S.border(cells(spark, one(a)), im), a.shape), a * ~inner)


@pytest.mark.parametrize("sigma", [0.5, 1.0, 1.3])
def test_gaussian(spark, sigma):
    side = max(3, int(4 * sigma + 1))
    k = np.array([np.exp(-((i - side // 2) ** 2) / (2 * sigma**2)) for i in range(side)])
    k = np.outer(k, k) / np.outer(k, k).sum()
    lo = (side - 1) // 2
    p = np.pad(SOFT, ((lo, side - 1 - lo),) * 2)
    want = sum(k[i, j] * p[i:i + SOFT.shape[0], j:j + SOFT.shape[1]] for i in range(side) for j in range(side))
    assert np.allclose(layer(S.gaussian_smooth(cells(spark, one(SOFT)), images(spark, one(SOFT)), sigma), SOFT.shape), want)


@pytest.mark.parametrize("k", [3, 4])
def test_local_variance(spark, k):
    p = np.pad(SOFT, ((k // 2, k - 1 - k // 2),) * 2, mode="symmetric")
    win = np.array([p[i:i + SOFT.shape[0], j:j + SOFT.shape[1]] for i in range(k) for j in range(k)])
    assert np.allclose(layer(S.local_variance(cells(spark, one(SOFT)).drop("class_id"), images(spark, one(SOFT)), k), SOFT.shape), win.var(axis=0))


def brute_distance(mask):
    ys, xs = np.nonzero(mask)
    yy, xx = np.indices(mask.shape)
    return np.sqrt(((yy[..., None] - ys) ** 2 + (xx[..., None] - xs) ** 2).min(axis=2))


def test_distances(spark):
    sparse = (RNG.random((40, 11)) > 0.97).astype(float)
    sparse[3, 4] = 1
    want = brute_distance(sparse)
    im, marks = images(spark, one(sparse)), cells(spark, one(sparse))
    assert np.allclose(layer(S.distance_map(marks, im, block=8), sparse.shape, "d"), want)
    everywhere = S.page_pixels(im)
    assert np.allclose(layer(S.distance_to(marks, everywhere, 6), sparse.shape, "d"), np.minimum(want, 6))
    full = (RNG.random((14, 12)) > 0.15).astype(float)
    depth = layer(S.distance_to_empty(cells(spark, one(full)), images(spark, one(full)), 50), full.shape, "d")
    assert np.allclose(depth, brute_distance(1 - full) * full)


def test_lowest_parabolas_of_a_row():
    """Against every pair of places, with columns that hold no mark, ties and steep and flat stretches."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = rng.integers(1, 40)
        squares = rng.integers(0, rng.integers(1, 30), n) ** 2
        squares[rng.random(n) < rng.random()] = -1
        if (squares < 0).all():
            squares[rng.integers(n)] = 4
        k = np.flatnonzero(squares >= 0)
        want = ((np.arange(n)[:, None] - k) ** 2 + squares[k]).min(axis=1)
        assert (S.nearest_in_row(squares) == want).all()


def test_wide_pages_with_marks_far_apart(spark):
    """Pages wider and higher than a tile: halos reach over tiles on both axes, and no tile outside the page is dealt to."""
    marks = np.zeros((70, 150))
    marks[5, 3] = marks[60, 148] = marks[33, 70] = 1
    want = brute_distance(marks)
    im, sparse = images(spark, one(marks)), cells(spark, one(marks))
    assert np.allclose(layer(S.distance_map(sparse, im, block=16), marks.shape, "d"), want)
    assert np.allclose(layer(S.distance_to(sparse, S.page_pixels(im), 40, side=32), marks.shape, "d"), np.minimum(want, 40))
    full = 1 - marks
    depth = layer(S.distance_to_empty(cells(spark, one(full)), im, 30, side=32), marks.shape, "d")
    assert np.allclose(depth, np.minimum(want, 30) * full)
    wide = S.gaussian_smooth(sparse, im, 5.0, side=16)
    assert np.allclose(layer(wide, marks.shape), layer(S.gaussian_smooth(sparse, im, 5.0), marks.shape))
    dealt = S._tiled(sparse.join(im, "image_id"), ["image_id"], 40, 32, lambda rows, y0, x0: rows.iloc[:1][["y", "x"]].assign(y=y0, x=x0), "image_id string, y int, x int").collect()
    assert dealt and all(0 <= r["y"] < 70 and 0 <= r["x"] < 150 for r in dealt)


def test_profile_matches_dense(spark):
    r = {x["y"]: x for x in S.profile(cells(spark, one(SOFT)), images(spark, one(SOFT)), "y").collect()}
    assert [r[y]["mean"] for y in range(23)] == pytest.approx(SOFT.mean(axis=1).tolist())
    assert [r[y]["variance"] for y in range(23)] == pytest.approx(SOFT.var(axis=1).tolist())


def test_drd_against_the_definition(spark):
    gt, pred = (RNG.random((21, 19)) > 0.6).astype(int), (RNG.random((21, 19)) > 0.6).astype(int)
    w = np.array([[0 if (i, j) == (2, 2) else 1 / np.hypot(i - 2, j - 2) for j in range(5)] for i in range(5)])
    w /= w.sum()
    total = 0.0
    for y, x in zip(*np.nonzero(gt != pred)):
        for i in range(5):
            for j in range(5):
                yy, xx = y + i - 2, x + j - 2
                if 0 <= yy < 21 and 0 <= xx < 19:
                    total += w[i, j] * abs(gt[yy, xx] - pred[y, x])
    blocks = sum(0 < gt[y:y + 8, x:x + 8].sum() < gt[y:y + 8, x:x + 8].size for y in range(0, 21, 8) for x in range(0, 19, 8))
    r = Z.drd(cells(spark, one(gt)), cells(spark, one(pred)), images(spark, one(gt))).first()
    assert r["blocks"] == blocks and r["drd"] == pytest.approx(total / blocks)


def test_misclassification_penalty(spark):
    gt, pred = (RNG.random((15, 13)) > 0.7).astype(int), (RNG.random((15, 13)) > 0.7).astype(int)
    edge = (shifted_max(gt.astype(float), 1) > 0) & (gt == 0)
    d = brute_distance(edge)
    want = (d[(gt == 1) & (pred == 0)].sum() + d[(gt == 0) & (pred == 1)].sum()) / d.sum() / 2
    assert Z.misclassification_penalty(cells(spark, one(gt)), cells(spark, one(pred)), images(spark, one(gt))).first()["mpm"] == pytest.approx(want)


def test_binarization_scores(spark):
    gt, pred = (RNG.random((15, 13)) > 0.7).astype(int), (RNG.random((15, 13)) > 0.7).astype(int)
    r = Z.binarization_scores(cells(spark, one(gt)), cells(spark, one(pred)), images(spark, one(gt)), cells(spark, one(gt))).first()
    tp, fp, fn, tn = ((gt & pred).sum(), ((1 - gt) & pred).sum(), (gt & (1 - pred)).sum(), ((1 - gt) & (1 - pred)).sum())
    assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r["pseudo_f1"] == pytest.approx(r["f1"])
    assert r["psnr"] == pytest.approx(10 * np.log10(gt.size / (fp + fn)))
    assert r["nrm"] == pytest.approx((fn / (fn + tp) + fp / (fp + tn)) / 2)


def test_error_saliency(spark):
    gt, pred = (RNG.random((15, 13)) > 0.7).astype(float), (RNG.random((15, 13)) > 0.7).astype(float)
    im = images(spark, one(gt))
    out = Z.error_saliency(align(cells(spark, one(gt)), cells(spark, one(pred))), im)
    fp, fn = np.clip(pred - gt, 0, 1) * brute_distance(gt), np.clip(gt - pred, 0, 1) * brute_distance(1 - gt)
    assert np.allclose(layer(out, gt.shape, "saliency"), fp / fp.max() + fn / fn.max())


def test_tiles_cover_and_stitch_back(spark):
    a = RNG.random((70, 45)) * (RNG.random((70, 45)) > 0.5)
    im = images(spark, one(a))
    tiles = T.tile_cells(cells(spark, one(a)), im, size=32, stride=16)
    assert np.allclose(layer(T.stitch_tiles(tiles, 32, 16), a.shape), a)
    plan = T.plan_tiles(im, 32, 16).collect()
    assert max(r["top"] for r in plan) == 70 - 32 and max(r["left"] for r in plan) == 45 - 32
    small = T.plan_tiles(images(spark, np.zeros((10, 10, 1))), 32, 16).collect()
    assert [(r["left"], r["top"]) for r in small] == [(0, 0)]


def test_best_tile_defaults_and_ties(spark):
    a = np.zeros((8, 8, 3))
    im = images(spark, a)
    assert [(r["cx"], r["cy"]) for r in T.best_train_tile(cells(spark, a), im, [2]).collect()] == [(0, 0)]
    a[6, 1, 1] = a[1, 6, 2] = 1
    assert [(r["cx"], r["cy"]) for r in T.best_train_tile(cells(spark, a), im, [2]).collect()] == [(0, 1)]


def test_distances_shuffle_lists_not_pixels(spark):
    """Wide and narrow pages, blocks that hold no mark, a page without marks; no row per pixel before the last step."""
    rng = np.random.default_rng(3)
    for shape in ((70, 90), (70, 8)):
        mask = rng.random(shape) < 0.01
        mask[20:60] = False
        mask[0, 3] = True
        marks = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask))] * 2, "image_id long, y int, x int")
        sizes = spark.createDataFrame([(1, *shape), (2, *shape)], "image_id long, height int, width int")
        ys, xs = np.nonzero(mask)
        grid = np.indices(shape)
        want = np.sqrt(((grid[0][..., None] - ys) ** 2 + (grid[1][..., None] - xs) ** 2).min(axis=2))
        out = S.distance_map(marks, sizes, block=16)
        rows = out.collect()
        assert len(rows) == want.size and all(r["image_id"] == 1 and abs(r["d"] - want[r["y"], r["x"]]) < 1e-9 for r in rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.strip().split("\n")[1].count("Generate") == 1
