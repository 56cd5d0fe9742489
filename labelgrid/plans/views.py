"""Label tables derived from the given parquet tables.

Pages have a bounded extent and their number grows with the data: an order is a
pixel row, 512 orders are a page, a line number is a pixel column. Wide pages,
for tiles and splits, hold 1024 orders: an order is 8 columns by 512 rows, 256 of
them stand side by side and 4 above one another (2048 by 2048 pixels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_ROWS = 512
WIDE_ORDERS, WIDE_WIDTH = 1024, 2048
ORDERS_PER_TEXT_PAGE = 64
N_CLASSES = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_pixels(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """``lineitem`` rows with their page position and class."""
    flag, order = F.col("l_returnflag"), F.col("l_orderkey")
    narrow = {"image_id": F.floor(order / PAGE_ROWS), "y": (order % PAGE_ROWS).cast("int"), "x": F.col("l_linenumber")}
    broad = {
        "image_id": F.floor(order / WIDE_ORDERS),
        "y": (F.floor(order % WIDE_ORDERS / 256) * 512 + F.col("l_partkey") % 512).cast("int"),
        "x": (order % 256 * 8 + F.col("l_linenumber")).cast("int"),
    }
    return table(spark, sf, "lineitem").withColumns({
        **(broad if wide else narrow),
        "class_id": F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2),
    })


def pairs(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """V1: ground truth ``g`` and prediction ``p`` per cell, one scan and one shuffle."""
    score = F.col("l_discount") * 10
    hit = F.struct(
        F.col("class_id"), F.lit(1e0).alias("g"), F.when(F.col("l_linestatus") == "O", score).otherwise(F.lit(0e0)).alias("p"),
    )
    stray = F.struct(((F.col("class_id") + 1) % 3).alias("class_id"), F.lit(0e0).alias("g"), score.alias("p"))
    return (
        line_pixels(spark, sf, wide)
        .select("image_id", "y", "x", F.explode(F.when(F.col("l_tax") >= 0.07, F.array(hit, stray)).otherwise(F.array(hit))).alias("e"))
        .select("image_id", "y", "x", "e.*")
        .groupBy("image_id", "y", "x", "class_id").agg(F.max("g").alias("g"), F.max("p").alias("p"))
        .where("g <> 0 OR p <> 0")
    )


def gt_cells(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    return line_pixels(spark, sf, wide).select("image_id", "y", "x", "class_id").distinct().withColumn("v", F.lit(1e0))


def pred_cells(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    return pairs(spark, sf, wide).where("p <> 0").select("image_id", "y", "x", "class_id", F.col("p").alias("v"))


def images(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    return (
        line_pixels(spark, sf, wide).groupBy("image_id").agg((F.max("y") + 1).alias("height"))
        .select("image_id", "height", F.lit(WIDE_WIDTH if wide else 8).alias("width"), F.lit(N_CLASSES).alias("n_classes"))
    )


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Per-pixel weights: quantity for recall, tax for precision."""
    return line_pixels(spark, sf).groupBy("image_id", "y", "x").agg(
        (F.max("l_quantity") / 50).alias("wr"), (F.max("l_tax") + 0.5e0).alias("wp"),
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """V2: three annotators over the ground-truth cells."""
    who = F.array_compact(F.array(
        F.when(F.col("l_linestatus") == "F", F.lit("a0")), F.when(F.col("l_linestatus") == "O", F.lit("a1")),
        F.when(F.col("l_quantity") > 25, F.lit("a2")),
    ))
    return line_pixels(spark, sf).select("image_id", "class_id", "y", "x", F.explode(who).alias("author"))


AUTHORS = ["a0", "a1", "a2"]


def class_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """V3: a score per class (64) and a true label per embedding."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("scores"),
    )


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """V4: each line of each document and a damaged copy of it.

    The copy loses its third character and gets every ``e`` read as ``c``.
    """
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "ref"))
    return lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "ref").withColumn(
        "hyp", F.translate(F.concat(F.substring("ref", 1, 2), F.expr("substring(ref, 4)")), "e", "c")
    )


def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """V5: word boxes, one per line item; 64 orders share a page."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    left = ((F.col("l_partkey") * 37) % 2000).cast("int")
    top = ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % 2000).cast("int")
    # all columns of a line item packed into one number, unique within a page
    box_id = (F.col("l_orderkey") % ORDERS_PER_TEXT_PAGE) * 8 + F.col("l_linenumber")
    for part, span in ((F.col("l_partkey"), 1 << 24), (F.col("l_suppkey"), 1 << 15), (F.col("l_quantity"), 64)):
        box_id = box_id * span + part.cast("bigint")
    return li.select(
        F.floor(F.col("l_orderkey") / ORDERS_PER_TEXT_PAGE).alias("page_id"), box_id.alias("box_id"),
        left.alias("l"), top.alias("t"), (left + 20 + F.col("l_quantity").cast("int")).alias("r"), (top + 30).alias("b"),
        F.col("p_name").alias("text"), "l_discount", "l_tax",
    )


def gt_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return word_rows(spark, sf).select("page_id", "box_id", "l", "t", "r", "b", "text")


def pred_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Shifted, partly damaged copies of the boxes with a discount, and their confidence."""
    shift = F.round(F.col("l_tax") * 100).cast("int")
    return word_rows(spark, sf).where("l_discount > 0").select(
        "page_id", "box_id", (F.col("l") + shift).alias("l"), (F.col("t") + shift).alias("t"), (F.col("r") + shift).alias("r"), (F.col("b") + shift).alias("b"),
        F.when(F.col("l_tax") > 0.05, F.expr("substring(text, 2)")).otherwise(F.col("text")).alias("text"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_class() -> Column:
    kind = F.col("event_type")
    out = F.lit(-1)
    for i, name in enumerate(EVENT_TYPES):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """V6: one validation row per event, a run per user; the class is the event type's rank."""
    f1 = F.least(F.col("value") / 100, F.lit(1e0))
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("step"), F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"),
        event_class().alias("class_id"), F.col("value").alias("loss"), f1.alias("f1"),
        (f1 / 2).alias("precision"), F.sqrt(f1).alias("recall"), (f1 * f1).alias("accuracy"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """V7: one recognised symbol per event, a line per user; ``view`` is the blank 0."""
    sym = F.when(F.col("event_type") == "view", F.lit(0)).otherwise(event_class() + 1)
    return table(spark, sf, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("t"), sym.alias("sym"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """V8: a folder listing with suffix layers and bit-indexed labels."""
    d = F.col("doc_id")
    stem = F.concat(F.lit("img"), d.cast("string"), F.lit("p"))
    names = F.array_compact(F.array(
        F.concat(stem, F.lit(".jpg")), F.when(d % 2 == 0, F.concat(stem, F.lit("_HW.png"))),
        F.when(d % 3 == 0, F.concat(stem, F.lit("_MP.png"))), F.when(d % 10 == 7, F.concat(stem, F.lit(".png"))),
        F.when(d % 5 == 1, F.concat(stem, F.lit("_0.png"))),
    ))
    return table(spark, sf, "documents").select(F.explode(names).alias("path"))


def intensity(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """Three channels per inked pixel: quantity, discount and tax."""
    px = line_pixels(spark, sf, wide).groupBy("image_id", "y", "x").agg(
        (F.max("l_quantity") / 50).alias("q"), (F.max("l_discount") * 10).alias("d"), (F.max("l_tax") * 12.5e0).alias("t"),
    )
    return px.select("image_id", "y", "x", F.posexplode(F.array("q", "d", "t")).alias("c", "v"))


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """V3 scores as unnormalised class probabilities."""
    return class_vectors(spark, sf).withColumn("probs", F.transform("scores", lambda s: F.exp(s)))


MODELS = AUTHORS


def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """V2 annotators as models: score = best discount at the cell, non-zero cells."""
    who = F.array_compact(F.array(
        F.when(F.col("l_linestatus") == "F", F.lit("a0")), F.when(F.col("l_linestatus") == "O", F.lit("a1")),
        F.when(F.col("l_quantity") > 25, F.lit("a2")),
    ))
    return line_pixels(spark, sf).select("image_id", "y", "x", "class_id", F.explode(who).alias("model_id"), (F.col("l_discount") * 10).alias("v")).groupBy(
        "model_id", "image_id", "y", "x", "class_id").agg(F.max("v").alias("v")).where("v <> 0")


def model_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Layers that exist per model: every class of every page it worked on."""
    return annotations(spark, sf).select(F.col("author").alias("model_id"), "image_id", "class_id").distinct()


def words(spark: SparkSession, sf: str) -> DataFrame:
    """V5 boxes with evenly spaced cut offsets between characters."""
    n, w = F.length("text"), F.col("r") - F.col("l")
    return gt_boxes(spark, sf).withColumn("text", F.translate("text", " ", "_")).withColumn(
        "charsegs", F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.floor(w * i / n).cast("int"))).otherwise(F.array().cast("array<int>")))


def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Extent of each V5 page."""
    return word_rows(spark, sf).select("page_id").distinct().select("page_id", F.lit(2030).alias("height"), F.lit(2100).alias("width"))


def charset(spark: SparkSession, sf: str) -> DataFrame:
    """Every character of the documents with its code point as index."""
    used = table(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    return used.select("ch", F.ascii("ch").alias("idx"))
