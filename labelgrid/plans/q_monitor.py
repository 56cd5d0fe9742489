"""Run monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.operators import monitor as M
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views

ROLL = [f"{m}_{s}" for m in M.METRICS for s in ("mean", "std")]


@query("rolling_metrics", with_views(O.RUNS) + "SELECT run_id, class_id, step, " + ", ".join(
    f"{f}({m}) OVER w AS {m}_{s}" for m in M.METRICS for s, f in (("mean", "avg"), ("std", "stddev_pop"))
) + " FROM runs WINDOW w AS (PARTITION BY run_id, class_id ORDER BY step ROWS 9 PRECEDING)", rounded=ROLL, digits=11)
def rolling_metrics(spark, sf):
    return M.rolling_metrics(V.run_metrics(spark, sf))


@query("smoothed_loss", with_views(O.RUNS) + "SELECT run_id, step, loss, avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS 9 PRECEDING) AS smoothed FROM runs", rounded=["loss", "smoothed"])
def smoothed_loss(spark, sf):
    return M.smoothed_loss(V.run_metrics(spark, sf).select("run_id", "step", "loss"))


@query("best_so_far", with_views(O.RUNS) + """,
  s AS (SELECT run_id, step // 5 AS step, avg(f1) AS f1 FROM runs GROUP BY 1, 2)
  SELECT *, f1 > best_before AS is_best FROM (SELECT *, greatest(coalesce(max(f1) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best_before FROM s)""",
       rounded=["f1", "best_before"])
def best_so_far(spark, sf):
    """Five events make one validation step."""
    steps = V.run_metrics(spark, sf).withColumn("step", F.floor(F.col("step") / 5))
    return M.best_so_far(M.macro_scores(steps))


@query("snapshot_trigger", with_views(O.RUNS) + """
  SELECT run_id, step, loss, coalesce(loss < least(l1, l2, l3, l4) AND l4 IS NOT NULL, false) AS snapshot FROM (
    SELECT *, lag(loss, 1) OVER w AS l1, lag(loss, 2) OVER w AS l2, lag(loss, 3) OVER w AS l3, lag(loss, 4) OVER w AS l4 FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY step))""", rounded=["loss"])
def snapshot_trigger(spark, sf):
    return M.snapshot_trigger(V.run_metrics(spark, sf).select("run_id", "step", "loss"))


RATES = ["batch_seconds", "batches_per_s", "samples_per_s", "megapixels_per_s", "current_batches_per_s", "current_samples_per_s"]


@query("throughput", with_views(O.RUNS) + """,
  d AS (SELECT run_id, step, (ts_us - lag(ts_us) OVER w) / 1e6 AS took, (ts_us - first(ts_us) OVER w) / 1e6 AS total, row_number() OVER w - 1 AS k FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY step))
  SELECT run_id, step, took AS batch_seconds, k / nullif(total, 0) AS batches_per_s, k * 6 / nullif(total, 0) AS samples_per_s, k * 6 * 224 * 224 / 1e6 / nullif(total, 0) AS megapixels_per_s,
    1 / nullif(took, 0) AS current_batches_per_s, 6 / nullif(took, 0) AS current_samples_per_s FROM d WHERE k > 0""", rounded=RATES)
def throughput(spark, sf):
    return M.throughput(V.run_metrics(spark, sf).select("run_id", "step", "ts_us"))


@query("threshold_history", with_views(O.RUNS) + """,
  s AS (SELECT *, CAST(floor(loss * 10) AS BIGINT) AS pixels, (1 + floor(f1 * 18)) / 20e0 AS threshold FROM runs)
  SELECT run_id, class_id, step, sum(pixels * threshold) OVER w / sum(pixels) OVER w AS averaged_threshold FROM s WHERE pixels > 0 WINDOW w AS (PARTITION BY run_id, class_id ORDER BY step ROWS 29 PRECEDING)""",
       rounded=["averaged_threshold"])
def threshold_history(spark, sf):
    samples = V.run_metrics(spark, sf).withColumns({"pixels": F.floor(F.col("loss") * 10), "threshold": (1 + F.floor(F.col("f1") * 18)) / F.lit(20e0)})
    return M.threshold_history(samples)
