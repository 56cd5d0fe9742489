"""Text scores, label codecs, boxes and OCR."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.functions.text import labels_to_frames
from labelgrid.operators import boxes as B
from labelgrid.operators import textscore as T
from labelgrid.operators import thresholds as TH
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.jobs import score_ocr
from labelgrid.plans.registry import query, with_views

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
CER = """CASE WHEN len({r}) = 0 AND len({h}) <> 0 THEN 1e0 WHEN len({sr}) = 0 THEN len({sh}) ELSE levenshtein({nr}, {nh}) / len({sr}) END"""


def cer_sql(r: str, h: str, narrow: bool = False) -> str:
    """``narrow``: the table ``letters`` is in scope, and texts may hold more than ASCII."""
    sr, sh = SQUEEZE.format(r), SQUEEZE.format(h)
    one = "translate({}, wide, narrow)" if narrow else "{}"
    return CER.format(r=r, h=h, sr=sr, sh=sh, nr=one.format(sr), nh=one.format(sh))


@query("cer", with_views(O.TEXT, O.LETTERS) + f"SELECT doc_id, line_no, {cer_sql('ref', 'hyp', True)} AS cer FROM txt, letters", rounded=["cer"])
def cer(spark, sf):
    """Every line of every document, whole."""
    return T.error_rates(V.text_lines(spark, sf), ["doc_id", "line_no"]).select("doc_id", "line_no", "cer")


@query("wer")
def wer(spark, sf):
    return T.word_error_rates(V.text_lines(spark, sf), ["doc_id", "line_no"]).select("doc_id", "line_no", F.round("wer", 8).alias("wer"))


@query("bleu", with_views(O.TEXT) + """,
  sides AS (SELECT doc_id, line_no, ref AS s, 1 AS r, 0 AS h FROM txt UNION ALL SELECT doc_id, line_no, hyp, 0, 1 FROM txt),
  grams AS (SELECT doc_id, line_no, n, substr(s, i, n) AS gram, sum(r) AS r, sum(h) AS h FROM (
    SELECT *, unnest(range(1, len(s) - n + 2)) AS i FROM sides, (SELECT CAST(k AS INT) AS n FROM range(1, 50) q(k)) WHERE len(s) >= n) GROUP BY 1, 2, 3, 4),
  hits AS (SELECT doc_id, line_no, n, sum(least(r, h)) AS hit FROM grams GROUP BY 1, 2, 3),
  p AS (SELECT doc_id, line_no, k.n, len(ref) AS rl, len(hyp) AS hl, coalesce(hit, 0) / greatest(len(hyp) - k.n + 1, 1) AS p
        FROM txt CROSS JOIN (SELECT CAST(k AS INT) AS n FROM range(1, 50) q(k)) k LEFT JOIN hits USING (doc_id, line_no, n))
  SELECT doc_id, line_no, n, CASE WHEN min(p) OVER w <= 0 THEN 0 ELSE CASE WHEN hl > rl THEN 1 WHEN hl = 0 THEN 0 ELSE exp(1 - rl / hl) END * exp(sum(ln(greatest(p, 1e-300))) OVER w / n) END AS bleu
  FROM p WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY n)""", rounded=["bleu"])
def bleu(spark, sf):
    return T.bleu(V.text_lines(spark, sf), ["doc_id", "line_no"])


@query("encode_labels", with_views(O.TEXT, O.CHARSET) + """
  SELECT doc_id, line_no, coalesce(labels, []) AS labels FROM txt LEFT JOIN (
    SELECT doc_id, line_no, list(idx ORDER BY i) AS labels FROM (SELECT doc_id, line_no, unnest(range(1, len(ref) + 1)) AS i, ref FROM txt) JOIN charset ON ch = ref[i] GROUP BY 1, 2)
  USING (doc_id, line_no)""", lists=["labels"])
def encode_labels(spark, sf):
    lines = V.text_lines(spark, sf).select("doc_id", "line_no", F.col("ref").alias("text"))
    return T.encode_labels(lines, V.charset(spark, sf), ["doc_id", "line_no"])


@query("decode_labels", with_views(O.TEXT) + """SELECT doc_id, line_no, string_split(ref, 'q')[1] AS text FROM txt""")
def decode_labels(spark, sf):
    """Round trip of every line with ``q`` coded as the end mark 0."""
    lines = V.text_lines(spark, sf).select("doc_id", "line_no", F.col("ref").alias("text"))
    chars = V.charset(spark, sf)
    ended = chars.withColumn("idx", F.when(F.col("ch") == "q", F.lit(0)).otherwise(F.col("idx")))
    return T.decode_labels(T.encode_labels(lines, ended, ["doc_id", "line_no"]), chars, ["doc_id", "line_no"])


@query("labels_to_frames", with_views(O.VECTORS) + """,
  fr AS (SELECT vec_id, CAST(pos AS INT) AS pos, CASE WHEN pos % 2 = 0 THEN 10 WHEN pos = 1 THEN CASE label WHEN 0 THEN 10 ELSE label - 1 END ELSE label END AS hot FROM vec, range(0, 5) r(pos))
  SELECT vec_id, pos, list_transform(range(0, 11), lambda i: CAST(i = hot AS INT)) AS frame FROM fr""", lists=["frame"])
def labels_to_frames_query(spark, sf):
    """Two labels per row with single blank rows around them."""
    rows = labels_to_frames(F.array("label", F.col("label") + 1), 10, 1)
    return V.class_vectors(spark, sf).select("vec_id", F.posexplode(rows).alias("pos", "frame"))


CTC = """kept AS (SELECT line_id, t, sym FROM (SELECT *, lag(sym) OVER (PARTITION BY line_id ORDER BY t) AS prev FROM frames) WHERE sym <> 0 AND (prev IS NULL OR sym <> prev))"""


@query("ctc_decode", with_views(O.FRAMES, CTC) + "SELECT * FROM kept")
def ctc_decode(spark, sf):
    return T.ctc_collapse(V.frames(spark, sf))


@query("ctc_frame_symbols", with_views(O.VECTORS) + """,
  f AS (SELECT label AS line_id, vec_id AS t, list_position(scores, list_max(scores)) - 1 AS sym FROM vec)
  SELECT line_id, t, sym FROM (SELECT *, lag(sym) OVER (PARTITION BY line_id ORDER BY t) AS prev FROM f) WHERE sym <> 0 AND (prev IS NULL OR sym <> prev)""")
def ctc_frame_symbols(spark, sf):
    """From frame scores: a line per label, a frame per vector."""
    frames = V.class_vectors(spark, sf).select(F.col("label").alias("line_id"), F.col("vec_id").alias("t"), "scores")
    return T.ctc_collapse(T.frame_symbols(frames))


IOU = """cand AS (
  SELECT g.page_id, g.box_id AS gt_id, p.box_id AS pred_id,
    (least(g.r, p.r) - greatest(g.l, p.l) + 200) * (least(g.b, p.b) - greatest(g.t, p.t) + 200) AS inter, (g.r - g.l + 200) * (g.b - g.t + 200) AS ag, (p.r - p.l + 200) * (p.b - p.t + 200) AS ap
  FROM gt g JOIN pred p ON g.page_id = p.page_id AND g.l - 100 < p.r + 100 AND p.l - 100 < g.r + 100 AND g.t - 100 < p.b + 100 AND p.t - 100 < g.b + 100),
bp AS (SELECT page_id, gt_id, pred_id, CAST(inter AS DOUBLE) / (ag + ap - inter) AS iou FROM cand)"""

MATCH = """mt AS (
  SELECT page_id, unnest(list_reduce(
    list([{'i': iou, 'g': gt_id, 'p': pred_id}] ORDER BY iou DESC, gt_id DESC, pred_id DESC),
    lambda a, x: CASE WHEN len(list_filter(a, lambda e: e.g = x[1].g OR e.p = x[1].p)) > 0 THEN a ELSE list_concat(a, x) END, CAST([] AS STRUCT(i DOUBLE, g BIGINT, p BIGINT)[]))) AS m
  FROM bp GROUP BY 1),
matches AS (SELECT page_id, m.g AS gt_id, m.p AS pred_id, m.i AS iou FROM mt)"""


def pairs(spark, sf, packed=False):
    return B.box_iou_pairs(V.gt_boxes(spark, sf), V.pred_boxes(spark, sf), packed=packed)


@query("box_iou_pairs", with_views(O.BOXES, IOU) + "SELECT page_id, count(*) AS pairs, sum(iou) AS iou_sum, max(iou) AS iou_max FROM bp GROUP BY 1", rounded=["iou_sum", "iou_max"])
def box_iou_pairs(spark, sf):
    return pairs(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("iou").alias("iou_sum"), F.max("iou").alias("iou_max"))


@query("match_boxes", with_views(O.BOXES, IOU, MATCH) + "SELECT * FROM matches", rounded=["iou"])
def match_boxes(spark, sf):
    return B.match_boxes(pairs(spark, sf, packed=True))


@query("unmatched_boxes", with_views(O.BOXES, IOU, MATCH) + """
  SELECT 'gt' AS side, page_id, box_id FROM gt WHERE (page_id, box_id) NOT IN (SELECT page_id, gt_id FROM matches)
  UNION ALL SELECT 'pred', page_id, box_id FROM pred WHERE (page_id, box_id) NOT IN (SELECT page_id, pred_id FROM matches)""")
def unmatched_boxes(spark, sf):
    m = B.match_boxes(pairs(spark, sf, packed=True))
    side = lambda name, df: B.unmatched_boxes(df, m, name).select(F.lit(name).alias("side"), "page_id", "box_id")
    return side("gt", V.gt_boxes(spark, sf)).unionByName(side("pred", V.pred_boxes(spark, sf)))


SCORE = f"""joined AS (
  SELECT coalesce(g.page_id, p.page_id) AS page_id, g.text AS gt_text, p.text AS pred_text FROM gt g
    LEFT JOIN matches m ON m.page_id = g.page_id AND m.gt_id = g.box_id LEFT JOIN pred p ON p.page_id = m.page_id AND p.box_id = m.pred_id
  UNION ALL SELECT page_id, NULL, text FROM pred p WHERE (page_id, box_id) NOT IN (SELECT page_id, pred_id FROM matches)),
rated AS (SELECT *, CASE WHEN gt_text IS NOT NULL AND pred_text IS NOT NULL THEN {cer_sql('gt_text', 'pred_text')} END AS cer FROM joined)"""
SCORE_COLS = ["word_cer", "word_cer_all", "unmatched_gt_chars", "unmatched_pred_chars", "gt_chars", "pred_chars", "document_cer", "document_cer_all", "character_accuracy"]


@query("ocr_score", with_views(O.BOXES, IOU, MATCH, SCORE) + """,
  s AS (SELECT page_id, avg(cer) AS word_cer, avg(coalesce(cer, 1)) AS word_cer_all, coalesce(sum(len(gt_text)) FILTER (pred_text IS NULL), 0) AS unmatched_gt_chars,
    coalesce(sum(len(pred_text)) FILTER (gt_text IS NULL), 0) AS unmatched_pred_chars, coalesce(sum(len(gt_text)), 0) AS gt_chars, coalesce(sum(len(pred_text)), 0) AS pred_chars,
    count(cer) AS n_matched, count(*) FILTER (pred_text IS NULL) AS n_unmatched_gt, count(*) FILTER (gt_text IS NULL) AS n_unmatched_pred,
    sum(cer * len(gt_text)) AS cw, sum(len(gt_text)) FILTER (cer IS NOT NULL) AS w FROM rated GROUP BY 1)
  SELECT page_id, word_cer, word_cer_all, unmatched_gt_chars, unmatched_pred_chars, gt_chars, pred_chars, n_matched, n_unmatched_gt, n_unmatched_pred, cw / w AS document_cer,
    (cw + unmatched_gt_chars + unmatched_pred_chars) / gt_chars AS document_cer_all, 1 - word_cer AS character_accuracy FROM s""", rounded=SCORE_COLS)
def ocr_score(spark, sf):
    return B.ocr_score(V.gt_boxes(spark, sf), V.pred_boxes(spark, sf), B.match_boxes(pairs(spark, sf, packed=True)))


WORD_CHARS = "regexp_replace({}, '[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}]+', '', 'g')"
LOUD = "CASE WHEN box_id % 3 = 0 THEN upper(text) || '.' ELSE text END"
BARE = O.BOXES.replace("\ngt AS", "\ngt1 AS").replace("\npred AS", "\npred1 AS") + f""",
gt AS (SELECT * REPLACE ({WORD_CHARS.format("text")} AS text) FROM gt1 WHERE len({WORD_CHARS.format("text")}) > 0),
pred AS (SELECT * REPLACE ({WORD_CHARS.format(LOUD)} AS text) FROM pred1 WHERE len({WORD_CHARS.format(LOUD)}) > 0)"""


@query("ocr_score_folded", with_views(BARE, IOU, MATCH, SCORE.replace(cer_sql("gt_text", "pred_text"), cer_sql("lower(gt_text)", "lower(pred_text)"))) + """,
  s AS (SELECT page_id, avg(cer) AS word_cer, avg(coalesce(cer, 1)) AS word_cer_all, count(cer) AS n_matched, count(*) FILTER (pred_text IS NULL) AS n_unmatched_gt, count(*) FILTER (gt_text IS NULL) AS n_unmatched_pred FROM rated GROUP BY 1)
  SELECT * FROM s""", rounded=["word_cer", "word_cer_all"])
def ocr_score_folded(spark, sf):
    """Without regard to case and punctuation; every third predicted text is in capitals and ends in a full stop."""
    loud = F.when(F.col("box_id") % 3 == 0, F.concat(F.upper("text"), F.lit("."))).otherwise(F.col("text"))
    scores = score_ocr(V.gt_boxes(spark, sf), V.pred_boxes(spark, sf).withColumn("text", loud), case_sensitive=False, punctuation=False)
    return scores.select("page_id", "word_cer", "word_cer_all", "n_matched", "n_unmatched_gt", "n_unmatched_pred")


LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]  # fixed values of the sweep


def swept_boxes(spark, sf, levels):
    """Boxes with the confidence levels they live on as bits: a predicted box up to its own confidence, the truth on all."""
    pred = V.pred_boxes(spark, sf).withColumn("levels", TH.level_bits(F.col("confidence"), levels)).where("levels <> 0")
    return V.gt_boxes(spark, sf).withColumn("levels", F.lit((1 << len(levels)) - 1).cast("bigint")), pred


SWEPT = O.BOXES.replace("\ngt AS", "\ngt0 AS").replace("\npred AS", "\npred0 AS") + f""",
level AS (SELECT unnest({LEVELS}) :: DOUBLE AS threshold),
gt AS (SELECT * REPLACE (page_id || '@' || threshold AS page_id) FROM gt0, level),
pred AS (SELECT * REPLACE (page_id || '@' || threshold AS page_id) FROM pred0, level WHERE confidence >= threshold)"""


@query("ocr_confidence_sweep", with_views(SWEPT, IOU, MATCH, SCORE) + """,
  s AS (SELECT page_id, avg(cer) AS word_cer, avg(coalesce(cer, 1)) AS word_cer_all, count(cer) AS n_matched, count(*) FILTER (gt_text IS NULL) AS n_unmatched_pred FROM rated GROUP BY 1)
  SELECT CAST(split_part(page_id, '@', 2) AS DOUBLE) AS threshold, avg(word_cer) AS word_cer, avg(word_cer_all) AS word_cer_all, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_unmatched_pred) AS BIGINT) AS n_unmatched_pred
  FROM s GROUP BY 1""", rounded=["word_cer", "word_cer_all"])
def ocr_confidence_sweep(spark, sf):
    """All levels matched and scored in one job; pairs of boxes and of texts are compared once."""
    gt, pred = swept_boxes(spark, sf, LEVELS)
    scores = B.ocr_score(gt, pred, B.match_boxes(B.box_iou_pairs(gt, pred, packed=True)), levels=LEVELS)
    return scores.groupBy("threshold").agg(
        F.avg("word_cer").alias("word_cer"), F.avg("word_cer_all").alias("word_cer_all"), F.sum("n_matched").alias("n_matched"),
        F.sum("n_unmatched_pred").alias("n_unmatched_pred"))


@query("confidence_filter_sweep", with_views(O.BOXES) + """
  SELECT threshold, count(*) AS words, CAST(sum(len(text)) AS BIGINT) AS chars FROM pred, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) :: DOUBLE AS threshold)
  WHERE confidence >= threshold GROUP BY 1""")
def confidence_filter_sweep(spark, sf):
    swept = TH.sweep_values(V.pred_boxes(spark, sf), LEVELS).where("confidence >= threshold")
    return swept.groupBy("threshold").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"))


@query("prune_punctuation", """
  SELECT * FROM (SELECT doc_id, line_no, regexp_replace(raw, '[^\\pL\\pM\\p{Nd}\\p{Pc}]+', '', 'g') AS text FROM (
    SELECT doc_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS raw FROM (
      SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))) WHERE len(text) > 0""")
def prune_punctuation(spark, sf):
    return B.prune_punctuation(V.text_lines(spark, sf).select("doc_id", "line_no", F.col("ref").alias("text")))


@query("char_boxes", with_views(O.BOXES, O.WORDS) + "SELECT page_id, box_id, pos, ch, l, t, r, b FROM chars")
def char_boxes(spark, sf):
    return B.char_boxes(V.words(spark, sf)).select("page_id", "box_id", "pos", "ch", "l", "t", "r", "b")


def regions(spark, sf):
    """A tall strip on the left, a wide one across the middle of each page."""
    strips = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("region_id", "l", "t", "r", "b"), s)]) for s in ((0, 0, 0, 400, 2030), (1, 0, 900, 2100, 1300))])
    return V.text_pages(spark, sf).select("page_id", F.explode(strips).alias("s")).select("page_id", "s.*")


@query("chars_in_region", with_views(O.BOXES, O.WORDS, O.TEXT_PAGES) + """,
  reg AS (SELECT page_id, unnest([{'region_id': 0, 'l': 0, 't': 0, 'r': 400, 'b': 2030}, {'region_id': 1, 'l': 0, 't': 900, 'r': 2100, 'b': 1300}]) AS s FROM tpages)
  SELECT DISTINCT page_id, s.region_id AS region_id, ch FROM reg JOIN chars c USING (page_id)
  WHERE c.r > c.l AND greatest(least(s.r, c.r) - greatest(s.l, c.l), 0) * greatest(least(s.b, c.b) - greatest(s.t, c.t), 0) >= 0.75 * (c.r - c.l) * (c.b - c.t)""")
def chars_in_region(spark, sf):
    return B.chars_in_region(regions(spark, sf), V.words(spark, sf))


SQUARES = f"""mh AS (SELECT page_id, avg(b - t) AS mean_height FROM gt GROUP BY 1),
draws AS (SELECT page_id, CAST(k AS INT) AS try, height, width, mean_height, {O.uniform('SEED-side', 'page_id', 'k')} AS us, {O.uniform('SEED-x', 'page_id', 'k')} AS ux, {O.uniform('SEED-y', 'page_id', 'k')} AS uy
  FROM tpages JOIN mh USING (page_id), range(1, TRIES) r(k)),
sides AS (SELECT *, CAST(LO + floor(us * (greatest(HI - LO, 0) + 1)) AS INT) AS side FROM draws),
sq0 AS (SELECT *, CAST(floor(ux * greatest(width - side, 1)) AS INT) AS l, CAST(floor(uy * greatest(height - side, 1)) AS INT) AS t FROM sides),
sq AS (SELECT page_id, try, mean_height, l, t, least(l + side, width - 1) AS r, least(t + side, height - 1) AS b FROM sq0)"""


@query("blank_regions", with_views(O.BOXES, O.TEXT_PAGES, SQUARES.replace("SEED", "b1").replace("TRIES", "31").replace("LO", "2").replace("HI", "floor(mean_height)")) + """
  SELECT page_id, try, l, t, r, b FROM sq WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.page_id = sq.page_id AND g.l <= sq.r AND sq.l <= g.r AND g.t <= sq.b AND sq.t <= g.b)""")
def blank_regions(spark, sf):
    return B.blank_regions(V.gt_boxes(spark, sf), V.text_pages(spark, sf), "b1", tries=30)


@query("multiline_regions", with_views(O.BOXES, O.TEXT_PAGES, SQUARES.replace("SEED", "m1").replace("TRIES", "6").replace("LO", "ceil(2 * mean_height)").replace("HI", "(least(height, width) - 1)")) + """
  SELECT sq.page_id, try, sq.l, sq.t, sq.r, sq.b, max(g.b) - min(g.b) AS span FROM sq JOIN gt g ON g.page_id = sq.page_id AND g.l <= sq.r AND sq.l <= g.r AND g.t <= sq.b AND sq.t <= g.b
  GROUP BY 1, 2, 3, 4, 5, 6, mean_height HAVING max(g.b) - min(g.b) > mean_height""")
def multiline_regions(spark, sf):
    return B.multiline_regions(V.gt_boxes(spark, sf), V.text_pages(spark, sf), "m1", tries=5)


@query("valid_words", with_views(O.BOXES, O.WORDS) + "SELECT page_id, box_id, text FROM words WHERE len(text) >= 9")
def valid_words(spark, sf):
    return B.valid_words(V.words(spark, sf), 8).select("page_id", "box_id", "text")


@query("character_samples", with_views(O.BOXES, O.WORDS) + f"""
  SELECT 'char' AS kind, page_id, box_id, pos, l, t, r, b, ch AS label FROM chars
  UNION ALL SELECT 'interchar', page_id, box_id, CAST(i - 1 AS INT), CAST(greatest(l + (r - l) * i // len(text) - 14, 0) AS INT), t, CAST(l + (r - l) * i // len(text) + 14 AS INT), b, '<interchar>'
    FROM (SELECT *, unnest(range(1, len(text))) AS i FROM words)
  UNION ALL SELECT 'multichar', page_id, box_id, 0, l, t, r, b, '<multichar>' FROM words WHERE len(text) > 1
  UNION ALL SELECT 'interline', page_id, box_id, 0, l, greatest(0, t + mv), r, greatest(1, b + mv), '<interline>' FROM (
    SELECT *, CASE WHEN {O.uniform('c1-dir', 'page_id', 'box_id')} < 0.5 THEN -1 ELSE 1 END * CAST(7 + floor({O.uniform('c1-off', 'page_id', 'box_id')} * 9) AS INT) AS mv FROM words)""")
def character_samples(spark, sf):
    w = V.words(spark, sf)
    out = None
    for kind in ("char", "interchar", "multichar", "interline"):
        part = B.character_samples(w, kind, "c1").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("subchar_samples", with_views(O.BOXES, O.WORDS) + f"""
  SELECT page_id, box_id, pos, l + ox AS l, t + oy AS t, l + ox + w AS r, t + oy + w AS b, '<subchar>' AS label FROM (
    SELECT *, CAST(floor({O.uniform('c1-x', 'page_id', 'box_id', 'pos')} * (greatest(1, r - l - w) + 1)) AS INT) AS ox, CAST(floor({O.uniform('c1-y', 'page_id', 'box_id', 'pos')} * (greatest(1, b - t - w) + 1)) AS INT) AS oy FROM (
      SELECT *, CAST(5 + floor({O.uniform('c1-w', 'page_id', 'box_id', 'pos')} * (greatest(6, r - l) - 4)) AS INT) AS w FROM chars))""")
def subchar_samples(spark, sf):
    return B.character_samples(V.words(spark, sf), "subchar", "c1")
