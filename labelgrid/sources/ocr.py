"""OCR responses and character boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# coordinates and confidences arrive as numbers or strings: read text, cast once
_VERTEX = "struct<x string, y string>"
_SYMBOL = f"struct<confidence string, text string, boundingBox struct<vertices array<{_VERTEX}>>>"
_WORD = f"struct<confidence string, boundingBox struct<vertices array<{_VERTEX}>>, symbols array<{_SYMBOL}>>"
_PAGE = f"struct<blocks array<struct<paragraphs array<struct<words array<{_WORD}>>>>>>"
RESPONSE = (
    f"struct<responses array<struct<fullTextAnnotation struct<text string, pages array<{_PAGE}>>, "
    f"textAnnotations array<struct<boundingPoly struct<vertices array<{_VERTEX}>>>>>>>"
)
SMALL_IMAGE = 300 * 1000
CONFIDENCE = 0.2


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """One response per file as ``page_id, json``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), F.col("value").alias("json"))


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _word_rows(pages: DataFrame) -> DataFrame:
    """One row per word in reading order."""
    parsed = pages.select("page_id", F.from_json("json", RESPONSE)["responses"][0]["fullTextAnnotation"]["pages"].alias("ps"))
    words = parsed.select("page_id", F.posexplode("ps").alias("i", "p")).select("page_id", "i", F.posexplode("p.blocks").alias("j", "b"))
    words = words.select("page_id", "i", "j", F.posexplode("b.paragraphs").alias("k", "g")).select("page_id", "i", "j", "k", F.posexplode("g.words").alias("m", "w"))
    at = lambda n, axis: F.col("w.boundingBox.vertices")[n][axis].cast("int")
    x0, y0, x1, y1 = at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y")
    return words.select(
        "page_id", F.struct("i", "j", "k", "m").alias("pos"), F.coalesce(_num(F.col("w.confidence")), F.lit(0e0)).alias("confidence"),
        F.least(x0, x1).alias("l"), F.least(y0, y1).alias("t"), F.greatest(x0, x1).alias("r"), F.greatest(y0, y1).alias("b"), F.col("w.symbols").alias("symbols"),
    )


def words(pages: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Word boxes and texts at or above the confidence (a missing one is 0)."""
    text = F.array_join(F.transform("symbols", lambda s: s["text"]), "")
    return _word_rows(pages).where(F.col("confidence") >= confidence).select("page_id", "pos", "l", "t", "r", "b", F.coalesce(text, F.lit("")).alias("text"), "confidence")


def symbols(pages: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Symbols of the kept words; their own confidence is reported, not tested; raw vertices."""
    kept = _word_rows(pages).where(F.col("confidence") >= confidence)
    return kept.select("page_id", "pos", F.posexplode("symbols").alias("n", "s")).select(
        "page_id", "pos", "n", F.col("s.text").alias("text"), F.coalesce(_num(F.col("s.confidence")), F.lit(0e0)).alias("confidence"), F.col("s.boundingBox.vertices").alias("vertices"),
    )


def simple_boxes(pages: DataFrame) -> DataFrame:
    """Boxes of the flat annotation list with their relative rank."""
    listed = pages.select("page_id", F.from_json("json", RESPONSE)["responses"][0]["textAnnotations"].alias("a"))
    rows = listed.select("page_id", F.size("a").alias("n"), F.posexplode("a").alias("i", "e"))
    at = lambda k, axis: F.col("e.boundingPoly.vertices")[k][axis].cast("int")
    return rows.select("page_id", "i", at(0, "x").alias("l"), at(0, "y").alias("t"), at(2, "x").alias("r"), at(2, "y").alias("b"), (F.col("i") / F.col("n")).alias("rank"))


def tesseract_boxes(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines ``ch l b r t`` measured from the bottom, flipped with the page height.

    ``lines (page_id, value)``; box sides stay ordered top above bottom.
    """
    p = F.split(F.trim("value"), " ")
    rows = lines.where(F.trim("value") != "").select("page_id", p[0].alias("ch"), *[p[i].try_cast("int").alias(n) for i, n in ((1, "l"), (2, "b0"), (3, "r"), (4, "t0"))])
    return rows.join(pages.select("page_id", "height"), "page_id").select(
        "page_id", "ch", "l", (F.col("height") - F.col("t0")).alias("t"), "r", (F.col("height") - F.col("b0")).alias("b"),
    )


def ocr_request_table(images: DataFrame) -> DataFrame:
    """Request bodies: base64 content and the cheaper feature for small images.

    ``images (path, content, height, width)``; nothing is sent.
    """
    feature = F.when(F.col("height") * F.col("width") < SMALL_IMAGE, "TEXT_DETECTION").otherwise("DOCUMENT_TEXT_DETECTION")
    request = F.struct(F.struct(F.base64("content").alias("content")).alias("image"), F.array(F.struct(feature.alias("type"))).alias("features"))
    return images.select("path", feature.alias("feature"), F.to_json(F.struct(F.array(request).alias("requests"))).alias("body"))


def response_json(words_table: DataFrame, key: str = "page_id") -> DataFrame:
    """A response per page from word boxes: the summary form of an OCR run."""
    vertex = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.struct(F.array(vertex("l", "t"), vertex("r", "t"), vertex("r", "b"), vertex("l", "b")).alias("vertices"))
    syms = F.transform(F.split("text", ""), lambda c: F.struct(c.alias("text")))
    word = F.struct(F.col("confidence"), box.alias("boundingBox"), syms.alias("symbols"))
    pages = words_table.groupBy(key).agg(F.collect_list(word).alias("words"))
    page = F.struct(F.array(F.struct(F.array(F.struct(F.col("words"))).alias("paragraphs"))).alias("blocks"))
    plain = F.transform("words", lambda w: F.struct(w["boundingBox"].alias("boundingPoly")))
    answer = F.struct(F.struct(F.array(page).alias("pages")).alias("fullTextAnnotation"), plain.alias("textAnnotations"))
    return pages.select(key, F.to_json(F.struct(F.array(answer).alias("responses"))).alias("json"))
