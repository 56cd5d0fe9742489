"""The views of :mod:`labelgrid.plans.views` as SQL text for the checks."""

CLASS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"

NARROW = "l_orderkey // 512 AS image_id, CAST(l_orderkey % 512 AS INT) AS y, l_linenumber AS x"
WIDE = "l_orderkey // 1024 AS image_id, CAST((l_orderkey % 1024) // 256 * 512 + l_partkey % 512 AS INT) AS y, CAST(l_orderkey % 256 * 8 + l_linenumber AS INT) AS x"

PX = f"""px AS (
  SELECT *, {NARROW}, {CLASS} AS class_id
  FROM lineitem)"""

PAIRS = PX + """,
pairs AS (
  SELECT * FROM (
    SELECT image_id, y, x, class_id, max(g) AS g, max(p) AS p FROM (
      SELECT image_id, y, x, class_id, 1e0 AS g, CASE WHEN l_linestatus = 'O' THEN l_discount * 10 ELSE 0e0 END AS p FROM px
      UNION ALL
      SELECT image_id, y, x, (class_id + 1) % 3, 0e0, l_discount * 10 FROM px WHERE l_tax >= 0.07
    ) GROUP BY ALL)
  WHERE g <> 0 OR p <> 0)"""

IMAGES = """images AS (SELECT image_id, max(y) + 1 AS height, 8 AS width, 3 AS n_classes FROM px GROUP BY 1)"""


def wide(view: str) -> str:
    """The same view over wide pages."""
    return view.replace(NARROW, WIDE).replace("8 AS width", "2048 AS width")


BINARY = """bin AS (
  SELECT * FROM (SELECT image_id, y, x, class_id, CAST(g > 0.5 AS DOUBLE) AS g, CAST(p > 0.5 AS DOUBLE) AS p FROM pairs)
  WHERE g <> 0 OR p <> 0)"""

GRID = """grid AS (
  SELECT image_id, CAST(c AS INT) AS class_id, CAST(height AS DOUBLE) * width AS n FROM images, range(3) r(c))"""

SUMS = """sums AS (
  SELECT image_id, class_id, n, coalesce(tp, 0) AS tp, coalesce(gt_mass, 0) AS gt_mass, coalesce(pred_mass, 0) AS pred_mass,
         coalesce(sq_err, 0) AS sq_err, coalesce(abs_err, 0) AS abs_err
  FROM grid LEFT JOIN (
    SELECT image_id, class_id, sum(g * p) AS tp, sum(g) AS gt_mass, sum(p) AS pred_mass, sum((g - p) * (g - p)) AS sq_err, sum(abs(g - p)) AS abs_err
    FROM bin GROUP BY 1, 2) USING (image_id, class_id))"""


def metric_select(keys: str, source: str) -> str:
    """Metrics from sums, as SQL over ``source``."""
    return f"""
  SELECT {keys}, tp, gt_mass, pred_mass, sq_err, abs_err, fp, fn, tn, recall, precision, union_mass, accuracy, mse,
         2 * precision * recall / greatest(precision + recall, 1e-14) AS f1, iou
  FROM (SELECT *, pred_mass - tp AS fp, gt_mass - tp AS fn, n - gt_mass - pred_mass + tp AS tn,
          CASE WHEN gt_mass = 0 AND tp = 0 THEN 1e0 ELSE tp / gt_mass END AS recall,
          CASE WHEN pred_mass = 0 AND tp = 0 THEN 1e0 ELSE tp / pred_mass END AS precision,
          gt_mass + pred_mass - tp AS union_mass,
          (tp + n - gt_mass - pred_mass + tp) / n AS accuracy, sq_err / n AS mse,
          CASE WHEN gt_mass + pred_mass - tp = 0 THEN 1e0 ELSE tp / (gt_mass + pred_mass - tp) END AS iou
        FROM {source})"""


METRICS = ["tp", "gt_mass", "pred_mass", "sq_err", "abs_err", "fp", "fn", "tn", "recall", "precision", "union_mass", "accuracy", "mse", "f1", "iou"]

ANNOTATIONS = """ann AS (
  SELECT DISTINCT image_id, class_id, y, x, author FROM (
    SELECT *, unnest([CASE WHEN l_linestatus = 'F' THEN 'a0' END, CASE WHEN l_linestatus = 'O' THEN 'a1' END, CASE WHEN l_quantity > 25 THEN 'a2' END]) AS author FROM px)
  WHERE author IS NOT NULL)"""

VECTORS = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS scores FROM embeddings)"""

TEXT = """doc_lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS ref FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
txt AS (SELECT *, translate(substr(ref, 1, 2) || substr(ref, 4), 'e', 'c') AS hyp FROM doc_lines)"""

BOXES = """word_rows AS (
  SELECT l_orderkey // 64 AS page_id,
    ((((l_orderkey % 64) * 8 + l_linenumber) * 16777216 + l_partkey) * 32768 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS box_id,
    CAST((l_partkey * 37) % 2000 AS INT) AS l, CAST((l_suppkey * 53 + l_linenumber * 97) % 2000 AS INT) AS t, CAST(l_quantity AS INT) AS q,
    CAST(round(l_tax * 100) AS INT) AS sh, p_name AS text, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey),
gt AS (SELECT page_id, box_id, l, t, l + 20 + q AS r, t + 30 AS b, text FROM word_rows),
pred AS (SELECT page_id, box_id, l + sh AS l, t + sh AS t, l + 20 + q + sh AS r, t + 30 + sh AS b,
    CASE WHEN l_tax > 0.05 THEN substr(text, 2) ELSE text END AS text, l_discount * 10 AS confidence FROM word_rows WHERE l_discount > 0)"""

EVENT_CLASS = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END"

RUNS = f"""runs AS (
  SELECT *, f1 / 2 AS precision, sqrt(f1) AS recall, f1 * f1 AS accuracy FROM (
    SELECT 'u' || user_id AS run_id, event_id AS step, epoch_us(ts) AS ts_us, {EVENT_CLASS} AS class_id, value AS loss, least(value / 100, 1e0) AS f1 FROM events))"""

FRAMES = f"""frames AS (
  SELECT user_id AS line_id, event_id AS t, CASE WHEN event_type = 'view' THEN 0 ELSE {EVENT_CLASS} + 1 END AS sym FROM events)"""

FILES = """files AS (
  SELECT path FROM (SELECT unnest(['img' || doc_id || 'p.jpg', CASE WHEN doc_id % 2 = 0 THEN 'img' || doc_id || 'p_HW.png' END,
    CASE WHEN doc_id % 3 = 0 THEN 'img' || doc_id || 'p_MP.png' END, CASE WHEN doc_id % 10 = 7 THEN 'img' || doc_id || 'p.png' END,
    CASE WHEN doc_id % 5 = 1 THEN 'img' || doc_id || 'p_0.png' END]) AS path FROM documents) WHERE path IS NOT NULL)"""


def uniform(seed: str, *keys: str) -> str:
    """The package's MD5 uniform as SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296e0)"

INTENSITY = """inten AS (
  SELECT image_id, y, x, CAST(c AS INT) AS c, CASE c WHEN 0 THEN q WHEN 1 THEN d ELSE t END AS v FROM (
    SELECT image_id, y, x, max(l_quantity) / 50 AS q, max(l_discount) * 10 AS d, max(l_tax) * 12.5e0 AS t FROM px GROUP BY 1, 2, 3), range(3) r(c))"""

MODEL_PREDS = """mp AS (
  SELECT author AS model_id, image_id, y, x, class_id, max(l_discount * 10) AS v FROM (
    SELECT *, unnest([CASE WHEN l_linestatus = 'F' THEN 'a0' END, CASE WHEN l_linestatus = 'O' THEN 'a1' END, CASE WHEN l_quantity > 25 THEN 'a2' END]) AS author FROM px)
  WHERE author IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING max(l_discount * 10) <> 0)"""

WORDS = """words AS (SELECT page_id, box_id, l, t, r, b, replace(text, ' ', '_') AS text FROM gt),
chars AS (
  SELECT page_id, box_id, CAST(i AS INT) AS pos, replace(text[i + 1], '_', ' ') AS ch, t, b,
    CAST(CASE WHEN i > 0 THEN l + (r - l) * i // len(text) ELSE l END AS INT) AS l, CAST(CASE WHEN i < len(text) - 1 THEN l + (r - l) * (i + 1) // len(text) ELSE r END AS INT) AS r
  FROM (SELECT *, unnest(range(0, len(text))) AS i FROM words))"""

TEXT_PAGES = """tpages AS (SELECT DISTINCT page_id, 2030 AS height, 2100 AS width FROM word_rows)"""

CHARSET = """charset AS (SELECT DISTINCT ch, unicode(ch) AS idx FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '')"""

# levenshtein() counts bytes here, so every character beyond ASCII is first written as a control character of its own
LETTERS = """letters AS (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS wide, coalesce(string_agg(chr(CAST(k + CASE WHEN k > 8 THEN 5 ELSE 0 END AS INT)), '' ORDER BY ch), '') AS narrow FROM (
    SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE unicode(ch) > 127))"""
