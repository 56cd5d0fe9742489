import numpy as np
import pytest
from dense import images

from labelgrid.operators import agreement as A
from labelgrid.operators import ensemble as E
from labelgrid.operators import folds as FO

AUTHORS = ["x", "y", "z"]
RNG = np.random.default_rng(4)
LAYERS = {a: (RNG.random((12, 9, 2)) > 0.6) for a in AUTHORS}
LAYERS["z"][:, :, 1] = False  # a blank layer


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(a, "i", int(c), int(y), int(x)) for a, m in LAYERS.items() for y, x, c in zip(*np.nonzero(m))]
    ann = spark.createDataFrame(rows, "author string, image_id string, class_id int, y int, x int")
    return A.author_masks(ann, AUTHORS), images(spark, np.zeros((12, 9, 2)))


def test_pairs_and_report(tables):
    masks, im = tables
    pairs = A.annotator_pairs(A.mask_counts(masks), im, AUTHORS)
    rows = pairs.collect()
    assert len(rows) == 2 * 9
    for r in rows:
        g, p = LAYERS[r["author"]][:, :, r["class_id"]], LAYERS[r["other"]][:, :, r["class_id"]]
        tp = (g & p).sum()
        assert r["precision"] == pytest.approx(tp / p.sum() if p.sum() else 1)
        assert r["recall"] == pytest.approx(tp / g.sum() if g.sum() else 1)
        assert r["iou"] == pytest.approx(tp / (g | p).sum() if (g | p).sum() else 1)
    rep = {r["class_id"]: r for r in A.agreement_report(pairs).collect()}
    f = lambda c: [r["f1"] for r in rows if r["class_id"] == c and r["author"] != r["other"]]
    assert rep[0]["mean_f1"] == pytest.approx(np.mean(f(0))) and rep[None]["mean_f1"] == pytest.approx(np.mean(f(0) + f(1)))
    assert rep[0]["pixels"] == sum(m[:, :, 0].sum() for m in LAYERS.values())


def test_consensus(tables):
    masks, im = tables
    cum = {(r["class_id"], r["n_authors"]): r["iou"] for r in A.cumulative_iou(A.mask_counts(masks), im, AUTHORS).collect()}
    x, y, z = (LAYERS[a][:, :, 0] for a in AUTHORS)
    assert cum[(0, 2)] == pytest.approx((x & y).sum() / (x | y).sum())
    assert cum[(0, 3)] == pytest.approx((x & y & z).sum() / (x | y | z).sum())
    layers = A.consensus_layers(masks, AUTHORS).where("class_id = 0").collect()
    assert sum(r["agreed"] for r in layers) == (x & y & z).sum() and len(layers) == (x | y | z).sum()
    sets = A.consensus_sets(masks, AUTHORS, {"xz": ["x", "z"]}).where("class_id = 0").collect()
    assert sum(r["in_intersection"] for r in sets) == (x & z).sum() and len(sets) == (x | z).sum()


def test_ensembles(spark):
    rows = [("m0", "i", 0, 0, 1, 0.5), ("m1", "i", 0, 0, 2, 0.7), ("m1", "i", 0, 0, 1, 0.2), ("m0", "i", 0, 1, 2, 0.4)]
    preds = spark.createDataFrame(rows, "model_id string, image_id string, y int, x int, class_id int, v double")
    manifest = spark.createDataFrame([("m0", "i", 1), ("m1", "i", 1), ("m2", "i", 1), ("m1", "i", 2)], "model_id string, image_id string, class_id int")
    im = images(spark, np.zeros((1, 2, 3)))
    got = {(r["x"], r["class_id"]): r["v"] for r in E.ensemble_mean(preds, manifest, im).collect()}
    assert got == {(0, 1): pytest.approx(0.7 / 3), (0, 2): pytest.approx(0.7), (1, 2): pytest.approx(0.4)}
    votes = {(h, r["x"]): r["class_id"] for h in ("median", "mode") for r in E.ensemble_vote(preds, 3, h).collect()}
    assert votes == {("median", 0): 1.0, ("median", 1): 0.0, ("mode", 0): 0, ("mode", 1): 0}
    assert {r["x"]: r["class_id"] for r in E.ensemble_vote(preds, 2).collect()} == {0: 1.5, 1: 1.0}


def test_folds(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "split string, image_id int")
    got = {(r["fold"], r["image_id"]) for r in FO.leave_one_out(df, ["a", "b", "c"]).collect()}
    assert got == {("nota", 2), ("nota", 3), ("notb", 1), ("notb", 3), ("notc", 1), ("notc", 2)}
    cells = spark.createDataFrame([("a", "i", 0, 0, 0, 1.0), ("b", "i", 0, 1, 0, 1.0)], "src string, image_id string, y int, x int, class_id int, v double")
    out = {(r["src"], r["model"]): (r["tp"], r["gt_mass"]) for r in FO.cross_validate(cells, cells.withColumnRenamed("src", "model"), "src", "model", ["a", "b"]).collect()}
    assert out == {("a", "a"): (1, 1), ("a", "b"): (0, 1), ("b", "a"): (0, 1), ("b", "b"): (1, 1)}
