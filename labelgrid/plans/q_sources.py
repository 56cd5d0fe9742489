"""Listings, OCR responses, text formats and sinks over derived text (A)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from labelgrid.operators import align as A
from labelgrid.plans import oracle_views as O
from labelgrid.plans import views as V
from labelgrid.plans.registry import query, with_views
from labelgrid.sources import layers as LY
from labelgrid.sources import listing as L
from labelgrid.sources import ocr as R
from labelgrid.sources import sinks as K
from labelgrid.sources import textfiles as T

STEMS = O.FILES + """,
stems AS (SELECT DISTINCT regexp_replace(path, '\\.[^.]*$', '') AS name FROM files),
layers AS (SELECT s.name, regexp_extract(s.name, '_([^_]*)$', 1) AS suffix FROM stems s JOIN stems r ON r.name = regexp_replace(s.name, '_[^_]*$', '') AND s.name LIKE '%\\_%' ESCAPE '\\')"""


@query("discover_classes", with_views(STEMS) + "SELECT suffix, CAST(row_number() OVER (ORDER BY suffix) - 1 AS INT) AS class_id FROM (SELECT DISTINCT suffix FROM layers)")
def discover_classes(spark, sf):
    return L.discover_classes(V.files(spark, sf))


@query("unmatched_files", with_views(STEMS) + """
  SELECT name FROM stems WHERE name NOT IN (SELECT name FROM layers) AND name NOT IN (SELECT regexp_replace(name, '_[^_]*$', '') FROM layers)""")
def unmatched_files(spark, sf):
    return L.unmatched_files(V.files(spark, sf))


@query("label_format", with_views(O.FILES) + """
  SELECT 'img' || doc_id || 'p' AS stem, CASE WHEN doc_id % 10 = 7 THEN 'bit_indexed' WHEN doc_id % 5 = 1 THEN 'numbered' ELSE 'suffix' END AS format FROM documents""")
def label_format(spark, sf):
    return L.detect_label_format(V.files(spark, sf))


@query("training_images", with_views(O.FILES) + "SELECT path FROM files WHERE path LIKE '%.jpg'")
def training_images(spark, sf):
    return L.training_images(V.files(spark, sf))


def responses(spark, sf):
    return R.response_json(V.pred_boxes(spark, sf))


@query("ocr_words", with_views(O.BOXES) + """
  SELECT page_id, l, t, r, b, text, count(*) AS n, sum(confidence) AS confidence FROM pred WHERE confidence >= 0.2 GROUP BY ALL""", rounded=["confidence"])
def ocr_words(spark, sf):
    return R.words(responses(spark, sf)).groupBy("page_id", "l", "t", "r", "b", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))


@query("ocr_symbols", with_views(O.BOXES) + """
  SELECT page_id, CAST(i AS INT) AS n, text[i + 1] AS text, count(*) AS symbols FROM (SELECT page_id, text, unnest(range(0, len(text))) AS i FROM pred WHERE confidence >= 0.5) GROUP BY ALL""")
def ocr_symbols(spark, sf):
    return R.symbols(responses(spark, sf), 0.5).where("text <> ''").groupBy("page_id", "n", "text").agg(F.count(F.lit(1)).alias("symbols"))


@query("ocr_simple_boxes", with_views(O.BOXES) + """
  SELECT page_id, count(*) AS boxes, CAST(sum(l) AS BIGINT) AS sl, CAST(sum(t) AS BIGINT) AS st, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(b) AS BIGINT) AS sb, (count(*) - 1) / 2e0 AS rank_sum FROM pred GROUP BY 1""", rounded=["rank_sum"])
def ocr_simple_boxes(spark, sf):
    return R.simple_boxes(responses(spark, sf)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("boxes"), *[F.sum(c).alias(f"s{c}") for c in "ltrb"], F.sum("rank").alias("rank_sum"))


@query("tesseract_boxes", with_views(O.BOXES, O.WORDS) + "SELECT page_id, text[1] AS ch, l, t, r, b, count(*) AS n FROM words GROUP BY ALL")
def tesseract_boxes(spark, sf):
    """First character of each word, measured from the page bottom and flipped back."""
    up = lambda c: (F.lit(2030) - F.col(c)).cast("string")
    lines = V.words(spark, sf).select("page_id", F.concat_ws(" ", F.substring("text", 1, 1), F.col("l"), up("b"), F.col("r"), up("t"), F.lit("0")).alias("value"))
    return R.tesseract_boxes(lines, V.text_pages(spark, sf)).groupBy("page_id", "ch", "l", "t", "r", "b").agg(F.count(F.lit(1)).alias("n"))


@query("ocr_requests", """
  SELECT page_id, CASE WHEN h * w < 300000 THEN 'TEXT_DETECTION' ELSE 'DOCUMENT_TEXT_DETECTION' END AS feature, len(to_base64(encode(html))) AS payload FROM (
    SELECT *, 400 + page_id % 300 AS h, 500 + page_id % 400 AS w FROM pages)""")
def ocr_requests(spark, sf):
    """Raw page bytes stand in for image files of varying extent."""
    files = V.table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"), (400 + F.col("page_id") % 300).alias("height"), (500 + F.col("page_id") % 400).alias("width"))
    body = F.get_json_object("body", "$.requests[0].image.content")
    return R.ocr_request_table(files).select(F.col("path").alias("page_id"), "feature", F.length(F.regexp_replace(body, "\\s", "")).cast("bigint").alias("payload"))


@query("prediction_lines", with_views(O.PAIRS) + """,
  win AS (SELECT image_id, y, x, class_id FROM pairs WHERE p <> 0 QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY p DESC, class_id) = 1)
  SELECT DISTINCT px.image_id, px.x || chr(9) || px.y || chr(9) || (coalesce(win.class_id, 0) + 1) AS value FROM px LEFT JOIN win ON win.image_id = px.image_id AND win.y = px.y AND win.x = px.x""")
def prediction_lines(spark, sf):
    """Coordinates are parsed from text, one line per inked pixel."""
    text = V.gt_cells(spark, sf).select("image_id", "y", "x").distinct().select("image_id", F.concat_ws("\t", "x", "y").alias("value"))
    return K.prediction_lines(T.parse_coordinates(text), V.pred_cells(spark, sf))


@query("layer_values", with_views(O.PAIRS) + "SELECT image_id, y, x, class_id, CAST(round(p * 255) AS INT) AS grey FROM pairs WHERE p <> 0")
def layer_values(spark, sf):
    return K.layer_values(V.pred_cells(spark, sf))


@query("run_history_json", """
  SELECT 'u' || user_id AS run_id, event_id // 1000 AS part, count(*) AS steps, list(value ORDER BY event_id)[1] AS first_loss, list(value ORDER BY event_id)[-1] AS last_loss FROM events GROUP BY 1, 2""", rounded=["first_loss", "last_loss"])
def run_history_json(spark, sf):
    """A run per user, a document per 1000 steps; the JSON lists are read back."""
    history = V.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    losses = F.from_json("value", "loss array<double>")["loss"]
    return K.history_json(history, ["loss"], 1000).select("run_id", "part", F.size(losses).cast("bigint").alias("steps"), losses[0].alias("first_loss"), F.element_at(losses, -1).alias("last_loss"))


@query("folder_pairs", with_views(O.FILES) + """
  SELECT regexp_replace(p.path, '\\.png$', '') AS stem, p.path AS gt_path, j.path AS pred_path FROM files p JOIN files j ON p.path LIKE '%.png' AND j.path LIKE '%.jpg'
    AND regexp_replace(p.path, '\\.png$', '') = regexp_replace(j.path, '\\.jpg$', '')""")
def folder_pairs(spark, sf):
    """Bit-indexed labels and images of the same stem."""
    files = V.files(spark, sf)
    return A.pair_folders(files.where(F.col("path").endswith(".png")), files.where(F.col("path").endswith(".jpg")))


@query("clean_transcripts", """
  SELECT doc_id, rtrim(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS gt FROM (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10) AS text FROM documents)""")
def clean_transcripts(spark, sf):
    """Whole documents with DOS line ends."""
    dos = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"))
    return V.table(spark, sf, "documents").select("doc_id", T.clean_transcript(dos).alias("gt"))


@query("charset_from_json", with_views(O.CHARSET) + "SELECT ch, idx FROM charset")
def charset_from_json(spark, sf):
    """The characters of all documents as one JSON dictionary, read back to rows."""
    entries = F.map_from_entries(F.collect_list(F.struct("ch", "idx")))  # an alphabet: no more entries than there are characters
    return T.charset_rows(V.charset(spark, sf).agg(F.to_json(F.struct(entries.alias("char_to_idx"))).alias("value")))




@query("validation_logs", """
  SELECT f AS file, thr AS threshold, CAST(class AS VARCHAR) AS class, CASE class WHEN 0 THEN a ELSE a / (class + 1) END AS f1, b / (class + 1) AS accuracy FROM (
    SELECT 'validation.' || c_custkey || '.txt' AS f, CAST('.' || c_custkey AS DOUBLE) AS thr, c_nationkey / 25e0 AS a, (c_nationkey + 1) / 26e0 AS b, CAST(k AS INT) AS class FROM customer, range(5) r(k))""", rounded=["threshold", "f1", "accuracy"])
def validation_logs(spark, sf):
    """One 40-line log per customer, classes listed bottom up."""
    c = V.table(spark, sf, "customer")
    a, b = F.col("c_nationkey") / F.lit(25e0), (F.col("c_nationkey") + 1) / F.lit(26e0)
    line = lambda k, v: F.concat_ws(" ", F.lit(str(k)), F.lit("score:"), (v / (k + 1)).cast("string"))
    from_end = {2: F.concat(F.lit("overall "), a.cast("string"))}
    from_end.update({28 + k: line(k, a) for k in range(5)})
    from_end.update({34 + k: line(k, b) for k in range(5)})
    text = F.concat_ws("\n", *[from_end.get(n, F.lit("-")) for n in range(40, 0, -1)])
    logs = c.select(F.concat(F.lit("validation."), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("file"), text.alias("value"))
    return T.sweep_from_logs(T.parse_validation_logs(logs))


@query("run_table", """
  SELECT 'run' || o_orderkey AS file, unnest(['Trainable params: ' || o_custkey, 'f1_score']) AS what, unnest([NULL, CAST(o_orderkey AS VARCHAR) || ']']) AS "values" FROM orders""")
def run_table(spark, sf):
    """A log per order: a parameter count and a directory average."""
    o = V.table(spark, sf, "orders")
    text = F.concat_ws("\n", F.lit("start"), F.concat(F.lit("Trainable params: "), F.col("o_custkey").cast("string")), F.lit("noise"),
                       F.lit("Averages for entire directory"), F.concat(F.lit("f1_score ["), F.col("o_orderkey").cast("string"), F.lit("]")), F.lit("f1 later"))
    return T.grep_runs(o.select(F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("file"), text.alias("value")))


def rasters(cells, images, keys, channels):
    """Decoded-image rows ``(path, height, width, nChannels, data)`` drawn from ``cells (keys, y, x, c, byte)``; a page is one row, as a decoder gives it."""
    def draw(rows):
        first = rows.iloc[0]
        px = np.zeros((int(first["height"]), int(first["width"]), channels), np.uint8)
        own = rows[rows["y"].notna()]
        px[own["y"].astype(int), own["x"].astype(int), own["c"].astype(int)] = own["byte"].astype(int)
        name = "_".join(str(int(first[k])) for k in keys)
        return pd.DataFrame({"path": [f"mem:/pages/img{name}.png"], "height": [int(first["height"])], "width": [int(first["width"])], "nChannels": [channels], "data": [px.tobytes()]})

    pages = images if keys == ["image_id"] else images.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)))
    sized = pages.select(*keys, "height", "width").join(cells.select(*keys, "y", "x", "c", "byte"), keys, "left")
    return sized.groupBy(*keys).applyInPandas(draw, "path string, height int, width int, nChannels int, data binary")


@query("read_layer_images", with_views(O.PAIRS) + """
  SELECT 'img' || image_id AS image_id, y, x, class_id, round(least(p, 1) * 255) / 255 AS v FROM pairs WHERE round(least(p, 1) * 255) > 0""", rounded=["v"])
def read_layer_images(spark, sf):
    """One grey image per page and class, read back to cells."""
    images = V.images(spark, sf)
    drawn = rasters(V.pred_cells(spark, sf).withColumns({"c": F.lit(0), "byte": F.round(F.least("v", F.lit(1e0)) * 255)}), images, ["image_id", "class_id"], 1)
    name = F.concat(F.lit("img"), F.col("image_id").cast("string"))
    chosen = images.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1))).select(F.concat(name, F.lit("_"), "class_id", F.lit(".png")).alias("path_name"), name.alias("image_id"), "class_id")
    return LY.layer_cells(drawn, chosen)


@query("read_mask_images", with_views(O.PX) + """
  SELECT DISTINCT 'img' || image_id AS image_id, y, x, k.k AS class_id, 1e0 AS v, bool_or(class_id = 0) OVER (PARTITION BY image_id, y, x) AS dont_care
  FROM px, (SELECT unnest([0, 9, 17]) AS k) k WHERE k.k = [0, 9, 17][class_id + 1]""")
def read_mask_images(spark, sf):
    """Classes 0, 9 and 17 as bits of three bytes; bit 0 doubles as the ambiguity flag."""
    bits = F.element_at(F.array(F.lit(0), F.lit(9), F.lit(17)), F.col("class_id") + 1)
    bytes_ = V.gt_cells(spark, sf).withColumns({"c": F.floor(bits / 8).cast("int"), "byte": F.pow(F.lit(2), bits % 8)}).groupBy("image_id", "y", "x", "c").agg(F.sum("byte").alias("byte"))
    return LY.mask_cells(rasters(bytes_, V.images(spark, sf), ["image_id"], 3), 18, 0)


@query("read_channel_images", with_views(O.PX, O.IMAGES, O.INTENSITY) + """,
  dense AS (SELECT image_id, y, CAST(unnest(range(0, width)) AS INT) AS x, c FROM (SELECT image_id, width, CAST(unnest(range(0, height)) AS INT) AS y FROM images), (SELECT CAST(c AS INT) AS c FROM range(3) r(c)) k)
  SELECT 'img' || image_id AS image_id, y, x, c, round(least(coalesce(v, 0), 1) * 255) / 255 AS v FROM dense LEFT JOIN inten USING (image_id, y, x, c)""", rounded=["v"])
def read_channel_images(spark, sf):
    """Colour images, every pixel and channel."""
    bytes_ = V.intensity(spark, sf).withColumn("byte", F.round(F.least("v", F.lit(1e0)) * 255))
    return LY.channel_values(rasters(bytes_, V.images(spark, sf), ["image_id"], 3))
