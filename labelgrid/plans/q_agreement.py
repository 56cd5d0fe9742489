"""Annotator agreement and ensembles."""

from __future__ import annotations

from labelgrid.operators import agreement as G
from labelgrid.operators import ensemble as N
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views

PAIRS = """lay AS (SELECT image_id, CAST(c AS INT) AS class_id FROM images, range(3) r(c)),
who AS (SELECT unnest(['a0', 'a1', 'a2']) AS author),
cpl AS (SELECT l.*, a.author, b.author AS other FROM lay l, who a, who b),
masses AS (SELECT image_id, class_id, author, count(*) AS m FROM ann GROUP BY 1, 2, 3),
hits AS (SELECT image_id, class_id, a.author, b.author AS other, count(*) AS tp FROM ann a JOIN ann b USING (image_id, class_id, y, x) GROUP BY 1, 2, 3, 4),
base AS (
  SELECT cpl.*, coalesce(tp, 0) AS tp, coalesce(g.m, 0) AS gt, coalesce(p.m, 0) AS pr FROM cpl LEFT JOIN hits USING (image_id, class_id, author, other)
    LEFT JOIN masses g USING (image_id, class_id, author) LEFT JOIN masses p ON p.image_id = cpl.image_id AND p.class_id = cpl.class_id AND p.author = cpl.other),
ap AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT *, CASE WHEN pr > 0 THEN tp / pr ELSE 1 END AS precision, CASE WHEN gt > 0 THEN tp / gt ELSE 1 END AS recall,
      CASE WHEN gt + pr - tp > 0 THEN tp / (gt + pr - tp) ELSE 1 END AS iou FROM base))"""
ANN = (O.PX, O.IMAGES, O.ANNOTATIONS)


def masks(spark, sf):
    return G.author_masks(V.annotations(spark, sf), V.AUTHORS)


def pairs(spark, sf):
    return G.annotator_pairs(G.mask_counts(masks(spark, sf)), V.images(spark, sf), V.AUTHORS)


@query("annotator_pairs", with_views(*ANN, PAIRS) + "SELECT image_id, class_id, author, other, tp, gt, pr, precision, recall, iou, f1 FROM ap", rounded=["precision", "recall", "iou", "f1"])
def annotator_pairs(spark, sf):
    return pairs(spark, sf)


@query("agreement_report", with_views(*ANN, PAIRS) + """
  SELECT class_id, avg(f1) FILTER (author <> other) AS mean_f1, avg(iou) FILTER (author <> other) AS mean_iou, CAST(sum(gt) FILTER (author = other) AS BIGINT) AS pixels FROM ap GROUP BY 1
  UNION ALL SELECT NULL, avg(f1), NULL, NULL FROM ap WHERE author <> other""", rounded=["mean_f1", "mean_iou"])
def agreement_report(spark, sf):
    return G.agreement_report(pairs(spark, sf))


@query("fscore_table", with_views(*ANN, PAIRS) + """
  SELECT image_id, class_id, author, max(f1) FILTER (other = 'a0') AS a0, max(f1) FILTER (other = 'a1') AS a1, max(f1) FILTER (other = 'a2') AS a2 FROM ap GROUP BY 1, 2, 3""",
       rounded=["a0", "a1", "a2"])
def fscore_table(spark, sf):
    return G.fscore_table(pairs(spark, sf), V.AUTHORS)


@query("consensus_layers", with_views(O.PX, O.ANNOTATIONS) + """
  SELECT image_id, y, x, class_id, count(*) / 3 AS mean, CAST(count(*) = 3 AS INT) AS agreed, CAST(count(*) <> 3 AS INT) AS conflict,
    CAST(bool_or(author = 'a0') AS INT) AS a0, CAST(bool_or(author = 'a1') AS INT) AS a1, CAST(bool_or(author = 'a2') AS INT) AS a2 FROM ann GROUP BY 1, 2, 3, 4""", rounded=["mean"])
def consensus_layers(spark, sf):
    return G.consensus_layers(masks(spark, sf), V.AUTHORS)


@query("cumulative_iou", with_views(*ANN) + """,
  cells AS (SELECT image_id, class_id, y, x, bool_or(author = 'a0') AS a0, bool_or(author = 'a1') AS a1, bool_or(author = 'a2') AS a2 FROM ann GROUP BY 1, 2, 3, 4),
  s AS (SELECT image_id, class_id, CAST(k AS INT) AS n_authors, count(*) FILTER (a0 AND a1 AND (a2 OR k = 2)) AS intersection, count(*) FILTER (a0 OR a1 OR (a2 AND k = 3)) AS union_area
        FROM cells, range(2, 4) r(k) GROUP BY 1, 2, 3)
  SELECT *, CASE WHEN union_area > 0 THEN intersection / union_area ELSE 1 END AS iou FROM s""", rounded=["iou"])
def cumulative_iou(spark, sf):
    return G.cumulative_iou(G.mask_counts(masks(spark, sf)), V.images(spark, sf), V.AUTHORS)


@query("consensus_sets", with_views(O.PX, O.ANNOTATIONS) + """,
  sets AS (SELECT unnest([{'authors': 'a0+a2', 'm': ['a0', 'a2']}, {'authors': 'a1+a2', 'm': ['a1', 'a2']}]) AS s)
  SELECT s.authors AS authors, image_id, y, x, class_id, CAST(count(*) = 2 AS INT) AS in_intersection, 1 AS in_union FROM ann, sets WHERE list_contains(s.m, author) GROUP BY 1, 2, 3, 4, 5""")
def consensus_sets(spark, sf):
    return G.consensus_sets(masks(spark, sf), V.AUTHORS, {"a0+a2": ["a0", "a2"], "a1+a2": ["a1", "a2"]})


@query("ensemble_mean", with_views(O.PX, O.ANNOTATIONS, O.MODEL_PREDS) + """,
  k AS (SELECT image_id, class_id, count(DISTINCT author) AS k FROM ann GROUP BY 1, 2)
  SELECT image_id, y, x, class_id, sum(v) / any_value(k) AS v FROM mp JOIN k USING (image_id, class_id) GROUP BY 1, 2, 3, 4""", rounded=["v"])
def ensemble_mean(spark, sf):
    return N.ensemble_mean(V.model_predictions(spark, sf), V.model_manifest(spark, sf), V.images(spark, sf))


VOTES = """win AS (SELECT model_id, image_id, y, x, arg_max(class_id, v * 100 - class_id) AS c FROM mp GROUP BY 1, 2, 3, 4),
votes AS (SELECT image_id, y, x, list_sort(list_concat(list(c), list_resize(CAST([] AS INT[]), 3 - count(*), 0))) AS cs FROM win GROUP BY 1, 2, 3)"""


@query("ensemble_median", with_views(O.PX, O.MODEL_PREDS, VOTES) + "SELECT image_id, y, x, CAST(cs[2] AS DOUBLE) AS class_id FROM votes")
def ensemble_median(spark, sf):
    return N.ensemble_vote(V.model_predictions(spark, sf), len(V.MODELS), "median")


@query("ensemble_mode", with_views(O.PX, O.MODEL_PREDS, VOTES) + """
  SELECT image_id, y, x, CASE WHEN cs[2] = cs[3] THEN cs[2] ELSE cs[1] END AS class_id FROM votes""")
def ensemble_mode(spark, sf):
    return N.ensemble_vote(V.model_predictions(spark, sf), len(V.MODELS), "mode")
