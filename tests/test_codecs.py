import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.functions import codec as K
from labelgrid.operators import classes as C
from labelgrid.operators import pixels as P
from labelgrid.operators import vectors as X

A = [[0, 1, 0], [1, 0, 0], [0, 0, 0], [0, 0, 1]]
ENUM = [2, 1, 0, 3]
MASK = [2, 1, 0, 4]


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame(list(zip(range(4), A, ENUM, MASK)), "k int, a array<int>, e int, m int")


def col(df, expr):
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_literal_codecs(px):
    a, e, m = F.col("a"), F.col("e"), F.col("m")
    assert col(px, K.onehot_to_enum(a, one_indexed=True)) == ENUM
    assert col(px, K.enum_to_multihot(e, 3, ignore_first=True)) == A
    assert col(px, K.multihot_to_bitmask(a)) == MASK
    assert col(px, K.bitmask_to_multihot(m, 3)) == A
    assert col(px, K.enum_to_bitmask(e)) == MASK
    assert col(px, K.bitmask_to_enum(m)) == ENUM


def test_onehot_ignore_first_collapses_background(spark):
    df = spark.createDataFrame([(i, e) for i, e in enumerate([2, 1, 1, 3])], "k int, e int")
    assert col(df, K.enum_to_onehot(F.col("e"), 4, ignore_first=True)) == [[0, 1, 0], [1, 0, 0], [1, 0, 0], [0, 0, 1]]


def test_random_round_trips(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 2**20, 625))]
    df = spark.createDataFrame(rows, "k int, m int")
    assert col(df, K.multihot_to_bitmask(K.bitmask_to_multihot(F.col("m"), 20))) == [v for _, v in rows]
    s = K.pack_bits_rgb(F.col("m"))
    assert col(df, K.unpack_bits_rgb(s["b0"], s["b1"], s["b2"])) == [v for _, v in rows]
    assert df.agg(F.max(K.bit_length(F.col("m")))).first()[0] == max(v for _, v in rows).bit_length()


def test_cells_and_masks(spark):
    cells = spark.createDataFrame([("i", 0, 0, 1, 1.0), ("i", 0, 0, 4, 0.3), ("i", 2, 1, 0, 1.0)], "image_id string, y int, x int, class_id int, v double")
    masks = P.cells_to_bitmask(cells)
    assert {(r["y"], r["x"]): r["mask"] for r in masks.collect()} == {(0, 0): 18, (2, 1): 1}
    assert P.bitmask_to_cells(masks, 5).count() == 3


def test_binary_check(spark):
    df = spark.createDataFrame([("a", 0), ("a", 255), ("b", 0), ("b", 7), ("b", 255), ("c", 7)], "file string, v int")
    assert sorted(r["file"] for r in C.verify_binary(df, ["file"]).collect()) == ["b", "c"]
    assert not C.all_binary(df, ["file"]).first()["ok"]
    assert C.all_binary(df.where("file = 'a'"), ["file"]).first()["ok"]


def test_class_weights(spark):
    summary = C.class_summary(spark.createDataFrame([(0, "a", 4), (1, "a", 9), (1, "b", 7)], "class_id int, image_id string, n_pixels long"))
    w = {r["class_id"]: r["weight"] for r in C.sqrt_weights(summary).collect()}
    assert w[0] == pytest.approx((2 + 4) / 2) and w[1] == pytest.approx(6 / 4)
    logs = C.log_weights(summary).orderBy("rank").collect()
    assert [r["class_id"] for r in logs] == [1, 0] and logs[1]["weight"] == pytest.approx(1 + np.log(20 / 4))


def test_top_k_and_argmax_ties(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5, 0.1], 1), (1, [0.1, 0.2, 0.3], 0)], "k int, s array<double>, t int")
    assert [r["pred"] for r in X.argmax_pairs(df, F.col("t"), F.col("s")).orderBy("k").collect()] == [0, 2]
    assert X.top_k_accuracy(df, F.col("t"), F.col("s"), 1).first()[0] == 0.5
    assert X.top_k_accuracy(df, F.col("t"), F.col("s"), 3).first()[0] == 1.0


def test_rounding_is_half_to_even(spark):
    pairs = spark.createDataFrame([("i", 0, 0, 0, 1.0, 0.5), ("i", 0, 1, 0, 1.0, 0.6)], "image_id string, y int, x int, class_id int, g double, p double")
    images = spark.createDataFrame([("i", 2, 2, 1)], "image_id string, height int, width int, n_classes int")
    r = X.dense_scores(pairs, images).first()
    assert r["sensitivity"] == pytest.approx(0.5, abs=1e-6) and r["binary_accuracy"] == pytest.approx(3 / 4)


def test_weight_list(spark):
    df = spark.createDataFrame([("5,1,.5",)], "t string")
    assert df.select(K.parse_weight_list(F.col("t"))).first()[0] == [5.0, 1.0, 0.5]


def test_infer_scale_and_pad(spark):
    df = spark.createDataFrame([("x/scale_50/p.jpg",), ("p.jpg",)], "p string")
    assert [r[0] for r in df.select(P.infer_scale(F.col("p"))).collect()] == [2.0, 1.0]
    im = spark.createDataFrame([("i", 33, 64, 1)], "image_id string, height int, width int, n_classes int")
    r = P.pad_to_multiple(im, 5).first()
    assert (r["height"], r["width"]) == (64, 64)
