import numpy as np
import pytest
from dense import cells, images

from labelgrid.operators import losses as L
from labelgrid.operators.align import align

RNG = np.random.default_rng(11)
G = (RNG.random((8, 9, 3)) > 0.7).astype(float)
P = RNG.random((8, 9, 3)) * (RNG.random((8, 9, 3)) > 0.4)


@pytest.fixture(scope="module")
def tables(spark):
    return align(cells(spark, G), cells(spark, P)), images(spark, G)


def margin(g, p, floor, gap):
    return g * np.maximum(floor * g, 0.9 - p) ** 2 + 0.5 * (gap - g) * np.maximum(floor * g, p - 0.1) ** 2


def weighted_ce(w):
    return -(G * np.log(np.clip(P, 1e-8, 1 - 1e-8)) * np.array(w)).mean()


def test_continuous_f(tables):
    w = [5, 1, 0.5]
    per = [(1 - G[..., c] * P[..., c] * (1 - (1 - G[..., c]) * (1 - P[..., c]))).mean() ** 0.25 for c in range(3)]
    assert L.continuous_f_loss(*tables, w).first()[0] == pytest.approx(np.dot(per, w) / sum(w))


def test_margins(tables):
    want = sum(margin(G[..., c], P[..., c], 0.1, 0.9).mean() for c in range(3))
    assert L.margin_loss(*tables).first()[0] == pytest.approx(want)
    mask = np.clip(G.sum(axis=2) * 255, 0, 1)[..., None]
    r = L.masked_losses(*tables).first()
    assert r["masked_margin"] == pytest.approx(margin(G, mask * P, 0.0, 1.0).sum())
    assert r["masked_mse"] == pytest.approx(((G - mask * P) ** 2).mean())


def test_log_losses(tables):
    q = np.clip(P, 1e-9, 1 - 1e-9)
    q = q / q.sum(axis=2, keepdims=True)
    assert L.log_loss(*tables).first()[0] == pytest.approx(-(G * np.log(q)).mean())
    assert L.log_loss(*tables, [1, 2, 3]).first()[0] == pytest.approx(weighted_ce([1, 2, 3]))


def test_surrogates_and_composite(tables):
    mask = np.clip(G.sum(axis=2) * 255, 0, 1)[..., None]
    tp, fn, fp = (G * P).sum(axis=(0, 1)), (G * (1 - P)).sum(axis=(0, 1)), ((1 - G) * P * mask).sum(axis=(0, 1))
    p, r = tp / (tp + fp), tp / (tp + fn)
    f = 2 * p * r / (p + r)
    w = np.array([1, 1, 8])
    s = L.surrogate_scores(*tables).first()
    assert s["macro_precision"] == pytest.approx(p.sum() / 10, rel=1e-6)
    assert s["macro_f"] == pytest.approx((f * f * w).sum() / 10, rel=1e-6)
    assert s["micro_recall"] == pytest.approx(tp.sum() / (tp.sum() + fn.sum()), rel=1e-6)
    want = 0.1 * (1 - s["macro_precision"] * s["macro_recall"]) + 0.1 * weighted_ce([1, 1, 2]) + L.margin_loss(*tables).first()[0]
    assert L.composite_loss(*tables).first()[0] == pytest.approx(want)
