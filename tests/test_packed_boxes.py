"""Pairs as lists by page: the same matches as pairs in rows, over ties, repeats, nulls and crowded pages; levels of a sweep in one pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import boxes as B
from labelgrid.operators import thresholds as TH

SCHEMA = "page_id int, box_id long, l int, t int, r int, b int, text string, confidence double"
LEVELS = [0.2, 0.5, 0.9, 0.95]


def boxes(rng, n, page):
    """Few places and sizes, so ties are common."""
    return [(page, i, (x := 60 * rng.randrange(15)), (y := 60 * rng.randrange(15)), x + 20, y + 20 + 5 * rng.randrange(2), rng.choice(["ab", "c d", "x-y", "abcd"]), rng.randrange(11) / 10) for i in range(n)]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    gt = [row for page in range(12) for row in boxes(rng, rng.randrange(1, 60), page)]
    pred = [row for page in range(2, 14) for row in boxes(rng, rng.randrange(1, 60), page)]
    gt += gt[:40:7] + [(3, None, 0, 0, 10, 10, "ab", 1.0), (None, 5, 0, 0, 10, 10, "ab", 1.0), (4, 900, None, 0, 10, 10, None, 1.0)]
    pred += pred[:200:9] + [(3, None, 0, 0, 10, 10, "ab", 1.0), (None, 5, 0, 0, 10, 10, "ab", 1.0), (4, 901, 0, 0, 10, 10, None, 1.0)]
    return spark.createDataFrame(gt, SCHEMA), spark.createDataFrame(pred, SCHEMA)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_packed_pages_match_as_rows_do(sides):
    g, p = sides
    want = rows(B.match_boxes(B.box_iou_pairs(g, p)))
    assert rows(B.match_boxes(B.box_iou_pairs(g, p, packed=True))) == want and len(want) > 100
    assert rows(B.match_boxes(B.box_iou_pairs(g, p, page_boxes=60, packed=True), page_pairs=100)) == want
    named = [df.withColumn("box_id", F.concat(F.lit("é"), F.lpad(F.col("box_id").cast("string"), 4, "0"))) for df in sides]
    assert {(r[0], int(r[1][1:]), int(r[2][1:])) for r in rows(B.match_boxes(B.box_iou_pairs(*named, packed=True)))} == {r[:3] for r in want}
    halves = [df.withColumn("l", F.col("l") / 2) for df in sides]
    assert "whole" not in B.box_iou_pairs(*halves, packed=True).columns


def test_packed_pairs_are_neither_joined_nor_grouped(sides):
    """Pairs make no rows on their way: one shuffle of boxes, a list a page."""
    packed = B.box_iou_pairs(*sides, packed=True)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    assert packed.count() == packed.select("page_id").distinct().count()


def test_pages_over_several_batches(spark, sides):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(B.match_boxes(B.box_iou_pairs(*sides, packed=True)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == rows(B.match_boxes(B.box_iou_pairs(*sides)))


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_best_first_against_a_plain_loop(monkeypatch, rounds):
    monkeypatch.setattr(B, "ROUNDS", rounds)
    rng = np.random.default_rng(5)
    g, p, v = rng.integers(0, 30, 600), rng.integers(0, 25, 600), rng.integers(1, 9, 600) / 8
    used, want = set(), set()
    for s, a, b in sorted(zip(v.tolist(), g.tolist(), p.tolist()), reverse=True):
        if not {("g", a), ("p", b)} & used:
            used |= {("g", a), ("p", b)}
            want.add((s, a, b))
    at = B._best_first(g, p, v)
    assert {(v[i], g[i], p[i]) for i in at} == want and len(at) == len(want)
    chain = np.arange(40)
    assert sorted(B._best_first(np.r_[chain, chain + 1], np.r_[chain, chain], np.r_[chain * 2 + 2, chain * 2 + 3] / 100)) == list(range(40, 80))


@pytest.mark.parametrize("page_boxes", [2000, 60])
def test_levels_are_matched_and_scored_in_one_pass(sides, page_boxes):
    """Against each level matched and scored by itself."""
    g, p = sides
    swept = g.withColumn("levels", F.lit((1 << len(LEVELS)) - 1).cast("bigint")), p.withColumn("levels", TH.level_bits(F.col("confidence"), LEVELS)).where("levels <> 0")
    matches = B.match_boxes(B.box_iou_pairs(*swept, page_boxes=page_boxes, packed=True))
    got = B.ocr_score(*swept, matches, levels=LEVELS)
    for k, level in enumerate(LEVELS):
        sure = p.where(F.col("confidence") >= level)
        alone = B.match_boxes(B.box_iou_pairs(g, sure))
        assert rows(matches.where(F.getbit("levels", F.lit(k)) == 1).drop("levels")) == rows(alone)
        want = B.ocr_score(g, sure, alone)
        assert rows(got.where(F.col("threshold") == level).select(*want.columns)) == rows(want)
