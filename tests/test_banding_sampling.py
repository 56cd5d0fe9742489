import random
from collections import Counter

import numpy as np
import pytest
from dense import cells, images
from pyspark.sql import functions as F

from labelgrid.functions.arith import uniform
from labelgrid.operators import banding as D
from labelgrid.operators import monitor as M
from labelgrid.operators import sampling as S
from labelgrid.operators.align import crop, union_splits


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(2)
    steps = sorted(rng.sample(range(2000), 300))
    # one run holds most rows
    rows = [("big" if rng.random() < 0.8 else "small", 0, s, rng.random(), rng.random(), s * 1_000_000) for s in steps]
    return rows, spark.createDataFrame(rows, "run_id string, class_id int, step long, f1 double, loss double, ts_us long")


def by_run(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_row_index_and_windows_across_blocks(history):
    rows, df = history
    idx = D.row_index(df, ["run_id"], "step", block=64)
    got = {(r["run_id"], r["step"]): r["idx"] for r in idx.collect()}
    for run, rs in by_run(rows).items():
        assert [got[(run, r[2])] for r in rs] == list(range(len(rs)))
    win = D.lookback_window(idx, ["run_id"], 9, lambda w: {"m": F.avg("f1").over(w.rowsBetween(-9, 0))}, block=16)
    best = D.running_before(idx, ["run_id"], "f1", "best", F.max, block=16)
    total = D.running_before(idx, ["run_id"], "f1", "total", F.sum, block=16)
    m = {(r["run_id"], r["step"]): r["m"] for r in win.collect()}
    b = {(r["run_id"], r["step"]): r["best"] for r in best.collect()}
    t = {(r["run_id"], r["step"]): r["total"] for r in total.collect()}
    assert len(m) == len(rows)
    for run, rs in by_run(rows).items():
        f = [r[3] for r in rs]
        for i, r in enumerate(rs):
            assert m[(run, r[2])] == pytest.approx(np.mean(f[max(0, i - 9): i + 1]))
            assert b[(run, r[2])] == (max(f[:i]) if i else None)
            assert t[(run, r[2])] == (pytest.approx(sum(f[:i])) if i else None)


def test_monitor_events(history):
    rows, df = history
    snap = {(r["run_id"], r["step"]): r["snapshot"] for r in M.snapshot_trigger(df).collect()}
    best = {(r["run_id"], r["step"]): r["is_best"] for r in M.best_so_far(df).collect()}
    rate = {(r["run_id"], r["step"]): r for r in M.throughput(df).collect()}
    for run, rs in by_run(rows).items():
        for i, r in enumerate(rs):
            assert snap[(run, r[2])] == (i >= 4 and all(r[4] < rs[j][4] for j in range(i - 4, i)))
            assert best[(run, r[2])] == (r[3] > max([x[3] for x in rs[:i]], default=0))
            if i:
                assert rate[(run, r[2])]["batches_per_s"] == pytest.approx(i / (r[2] - rs[0][2]))
                assert rate[(run, r[2])]["current_samples_per_s"] == pytest.approx(6 / (r[2] - rs[i - 1][2]))


def test_threshold_history_forms(spark):
    df = spark.createDataFrame([("r", 0, i, p, t) for i, (p, t) in enumerate([(10, 0.2), (0, 0.9), (30, 0.4)])], "run_id string, class_id int, step long, pixels long, threshold double")
    true = [r[0] for r in M.threshold_history(df).orderBy("step").select("averaged_threshold").collect()]
    assert true == pytest.approx([0.2, 14 / 40])
    literal = [r[0] for r in M.threshold_history(df, literal=True).orderBy("step").select("averaged_threshold").collect()]
    assert literal == pytest.approx([0.2, 7 / 40])


def test_shuffled_index_is_a_permutation(spark):
    df = spark.range(5000).withColumn("u", S.uniform("s", F.col("id"))).withColumn("k", F.lit(1) * (F.col("id") % 2))
    got = D.shuffled_index(df, ["k"], "u", ["id"], value="id").collect()
    for k in (0, 1):
        part = sorted((r for r in got if r["k"] == k), key=lambda r: r["idx"])
        assert [r["idx"] for r in part] == list(range(2500)) and all(r["n"] == 2500 for r in part)
        assert [r["u"] for r in part] == sorted(r["u"] for r in part)
        assert [r["before"] for r in part] == np.concatenate([[0], np.cumsum([r["id"] for r in part])[:-1]]).tolist()


def test_attach_image_spreads_but_keeps_rows(spark):
    im = spark.createDataFrame([("a", 1000, 3), ("b", 1, 9)], "image_id string, height int, width int")
    px = spark.createDataFrame([("a", y, 0) for y in range(1000)] + [("b", 0, 5)], "image_id string, y int, x int")
    out = D.attach_image(px, im, ["width"])
    assert Counter(r["width"] for r in out.collect()) == {3: 1000, 9: 1}


def test_performance_sampling_follows_the_scores(spark):
    scores = spark.createDataFrame([(0, 0.9), (1, 0.5), (2, 0.1), (3, 0.0)], "class_id int, f1 double")
    index = spark.createDataFrame([(c, f"i{i}", 5) for c in range(3) for i in range(4)], "class_id int, image_id string, n_pixels long")
    draws = S.sample_by_performance(scores, index, 6000, "x").collect()
    assert len(draws) == 6000
    share = Counter(r["class_id"] for r in draws)
    # class 3 has no image and takes no part
    assert [share[c] / 6000 for c in range(4)] == pytest.approx([0.1 / 1.5, 0.5 / 1.5, 0.9 / 1.5, 0], abs=0.03)
    assert len({(r["class_id"], r["image_id"]) for r in draws}) == 12
    again = S.sample_by_performance(scores, index.repartition(7), 6000, "x").collect()
    assert sorted(map(tuple, draws)) == sorted(map(tuple, again))


def test_uniform_when_all_scores_are_zero(spark):
    p = S.class_probabilities(spark.createDataFrame([(0, 0.0), (1, 0.0)], "class_id int, f1 double")).orderBy("class_id").collect()
    assert [r["p"] for r in p] == [0.5, 0.5] and p[1]["hi"] == 1.0


def test_quota_balances_pixels(spark):
    index = spark.createDataFrame([(0, f"i{i}", 10) for i in range(100)] + [(1, f"i{i}", 7) for i in range(20)], "class_id int, image_id string, n_pixels long")
    got = Counter()
    for r in S.sample_quota(index, "q").collect():
        got[r["class_id"]] += r["n_pixels"]
    assert got == {0: 140, 1: 140}


def test_greedy_draws_follow_a_plain_loop(spark):
    rows = [(c, f"i{i}", 1 + (7 * i + 3 * c) % (5 + c)) for c in range(5) for i in range(40 + 9 * c)]
    index = spark.createDataFrame(rows, "class_id int, image_id string, n_pixels long")
    order = index.withColumn("u", uniform("g", F.col("class_id"), F.col("image_id"))).orderBy("class_id", "u", "image_id").collect()
    lists = {c: [(r["image_id"], r["n_pixels"]) for r in order if r["class_id"] == c] for c in range(5)}
    for quota in (None, 50):
        most = quota or min(sum(n for _, n in x) for x in lists.values())
        held, place, want = dict.fromkeys(lists, 0), dict.fromkeys(lists, 0), []
        while True:
            c = min(lists, key=lambda k: (held[k], k))
            if held[c] >= most or place[c] == len(lists[c]):
                break
            image, n = lists[c][place[c]]
            want.append((len(want), c, image, n, held[c]))
            held[c] += n
            place[c] += 1
        assert [tuple(r) for r in S.greedy_draws(index, "g", quota).orderBy("draw").collect()] == want
    assert S.greedy_draws(index.limit(0), "g").count() == 0


def test_crops_lie_inside_and_cells_shift(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((300, 280, 2)) > 0.995).astype(float)
    win = S.class_crops(cells(spark, a), images(spark, a), 64, "c", per_layer=3)
    rows = win.collect()
    assert len(rows) == 6 and all(0 <= r["left"] <= 280 - 64 and 0 <= r["top"] <= 300 - 64 for r in rows)
    got = crop(win.withColumn("sample_id", F.concat_ws("-", "class_id", "draw")), cells(spark, a), tile=50).collect()
    want = sum(int(a[r["top"]: r["top"] + 64, r["left"]: r["left"] + 64].sum()) for r in rows)
    assert len(got) == want and all(0 <= r["y"] < 64 and 0 <= r["x"] < 64 for r in got)


def test_regions_reach_the_criterion(spark):
    a = np.zeros((60, 60, 3))
    a[10:40, 5:30, 0] = 1
    a[0, 0, 1] = 1
    got = {r["class_id"]: r for r in S.sample_regions(images(spark, a), cells(spark, a), "r", 4, 12, criterion=0.9).collect()}
    r = got[0]
    assert r["accepted"] and a[r["t"]:r["b"], r["l"]:r["r"], 0].mean() >= 0.9
    assert not got[1]["accepted"] and got[1]["try"] == S.MAX_TRIES
    assert got[2]["accepted"] and got[2]["try"] == 1  # class absent: any window


def test_window_masses_by_summed_areas(spark):
    """Windows over several tiles, at the page's edges, without area and outside all cells, against plain sums; one row a tile, however many windows."""
    rng = np.random.default_rng(5)
    a = np.round(rng.random((90, 130, 2)) * (rng.random((90, 130, 2)) > 0.6), 3)
    a[:, 60:100, 1] = 0
    rows = []
    for k in range(120):
        t, le = int(rng.integers(0, 90)), int(rng.integers(0, 130))
        rows.append(("i", k % 2, k, le, t, min(130, le + int(rng.integers(0, 80))), min(90, t + int(rng.integers(0, 60)))))
    rows += [("i", 1, 500, 65, 0, 95, 90), ("other", 0, 501, 0, 0, 9, 9), ("i", 0, 502, 0, 0, 130, 90)]
    windows = spark.createDataFrame(rows, "image_id string, class_id int, try int, l int, t int, r int, b int")
    got = {r["try"]: r["mass"] for r in S.window_masses(windows, cells(spark, a), ["image_id", "class_id"], tile=32).collect()}
    want = {k: a[t:b, le:r, c].sum() for i, c, k, le, t, r, b in rows if i == "i"}
    assert all(got.get(k, 0) == pytest.approx(w, abs=1e-9) for k, w in want.items()) and 501 not in got
    few = S.accept_regions(windows.withColumn("side", F.lit(9)), cells(spark, a), 0.1, tile=32).collect()
    good = lambda c: sorted(k for i, cc, k, le, t, r, b in rows if i == "i" and cc == c and r > le and b > t and a[t:b, le:r, c].mean() >= 0.1)
    assert {r["class_id"]: r["try"] for r in few if r["image_id"] == "i"} == {c: good(c)[0] for c in (0, 1)}


def test_subwords_and_mix(spark):
    words = spark.createDataFrame([(1, i, 100, 0, 140, 10, "abcd", [10, 20, 30]) for i in range(50)], "page_id int, box_id int, l int, t int, r int, b int, text string, charsegs array<int>")
    for r in S.subword_samples(words, "s").collect():
        assert r["text"] == "abcd"[r["start"]:r["end"]] and (r["l"], r["r"]) == (100 + 10 * r["start"], 100 + 10 * r["end"])
    shares = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "class_id int, share double")
    assert [(r["first"], r["last"]) for r in S.batch_mix(shares, 8).orderBy("class_id").collect()] == [(0, 4), (4, 6), (6, 8)]


def test_region_cells_are_rescaled(spark):
    a = np.zeros((20, 20, 1))
    a[4:8, 4:8, 0] = 1
    regions = spark.createDataFrame([("i", 0, 4, 4, 12, 12, 8)], "image_id string, class_id int, l int, t int, r int, b int, side int")
    got = S.region_cells(regions, cells(spark, a), 4).collect()
    assert sorted((r["y"], r["x"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_first_varied_crop(spark):
    a = np.ones((8, 8, 1))
    a[6, 6, 0] = 0.5
    inten = cells(spark, a).drop("class_id")
    tries = spark.createDataFrame([("s", 1, "i", 0, 0, 2), ("s", 2, "i", 6, 6, 2), ("s", 3, "i", 5, 5, 2), ("f", 1, "i", 0, 0, 2), ("f", 2, "i", 1, 1, 2)], "sample_id string, try int, image_id string, left int, top int, size int")
    got = {r["sample_id"]: (r["try"], r["varied"]) for r in S.first_varied_crop(tries, inten).collect()}
    assert got == {"s": (2, True), "f": (2, False)}


def test_union_splits_and_mix(spark):
    a, b = spark.createDataFrame([(1,)], "sample_id long"), spark.createDataFrame([(2,)], "sample_id long")
    assert {(r["split"], r["sample_id"]) for r in union_splits({"a": a, "b": b}).collect()} == {("a", 1), ("b", 2)}
    n = spark.range(1000).withColumnRenamed("id", "sample_id")
    mixed = S.mix_samplers(n.withColumn("s", F.lit(0)), n.withColumn("s", F.lit(1)), 0.3, "m").collect()
    assert len(mixed) == 1000 and 220 < sum(r["s"] == 0 for r in mixed) < 380
