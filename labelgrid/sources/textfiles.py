"""Transcripts, coordinates, logs, charsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.sources.listing import PAGE_EXTS, file_name, stem_of


def clean_transcript(text: Column) -> Column:
    """Line ends as ``\\n``, none at the end."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\n\r|\r", "\n"), "\n+\\z", "")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page images with the transcript of the same stem, empty where there is none."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    images = files.where(ext.isin(PAGE_EXTS)).select("path", stem_of(file_name(F.col("path"))).alias("image_id"))
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(
        stem_of(F.regexp_replace(file_name(F.input_file_name()), "%20", " ")).alias("image_id"), clean_transcript(F.col("value")).alias("gt"))
    return images.join(texts, "image_id", "left").select("image_id", "path", F.coalesce("gt", F.lit("")).alias("gt")).orderBy("path")


def parse_coordinates(lines: DataFrame) -> DataFrame:
    """``x<TAB or blank>y`` lines as integer columns; other columns are kept."""
    p = F.split(F.trim("value"), "[\t ]+")
    keep = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(*keep, p[1].try_cast("int").alias("y"), p[0].try_cast("int").alias("x"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return parse_coordinates(spark.read.text(path).withColumn("image_id", stem_of(file_name(F.input_file_name()))))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, value`` with one whole log per row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def log_threshold(file: Column) -> Column:
    """``validation.45.txt`` was run at threshold .45."""
    return F.regexp_extract(file_name(file), r"^[^.]*(\.[^.]*)\.", 1).try_cast("double")


# fixed positions, counted from the end of a validation log
OVERALL_LINE, OVERLAP_LINE, CLASS_F_LINES, CLASS_ACCURACY_LINES = 2, 3, (28, 32), (34, 38)


def parse_validation_logs(logs: DataFrame) -> DataFrame:
    """Per log: threshold, overall and overlap F (``class`` NULL) and per-class F and accuracy, by line position from the end."""
    text = F.regexp_replace("value", "\n\\z", "")
    places = {OVERALL_LINE: "overall_f1", OVERLAP_LINE: "overlap_f1"}
    places |= {at: kind for kind, (low, high) in (("f1", CLASS_F_LINES), ("accuracy", CLASS_ACCURACY_LINES)) for at in range(low, high + 1)}
    lines = logs.select("file", log_threshold(F.col("file")).alias("threshold"), F.reverse(F.split(text, "\n")).alias("lines"))
    # only the lines that count become rows
    wanted = F.array(*[F.struct(F.lit(kind).alias("kind"), F.get("lines", F.lit(at - 1)).alias("line")) for at, kind in sorted(places.items())])
    rows = lines.select("file", "threshold", F.explode(wanted).alias("w")).select("file", "threshold", "w.*").where("line IS NOT NULL")
    words = F.split("line", " ")
    return rows.select(
        "file", "threshold", "kind", F.when(~F.col("kind").isin("overall_f1", "overlap_f1"), words[0]).alias("class"), F.element_at(words, -1).try_cast("double").alias("value"),
    )


def sweep_from_logs(parsed: DataFrame) -> DataFrame:
    """Class F and accuracy side by side per log and class. Lines meet by log before they are grouped, so no task holds the classes of all logs it reads."""
    met = parsed.where("class IS NOT NULL").repartition("file")
    first = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("value")), ignorenulls=True)["value"].alias(kind)
    return met.groupBy("file", "threshold", "class").agg(first("f1"), first("accuracy"))


def grep_runs(logs: DataFrame) -> DataFrame:
    """Parameter counts and the directory-wide averages (line after the heading) of every run in one table."""
    lines = logs.select("file", F.split("value", "\n").alias("ls"))
    rows = lines.select("file", "ls", F.posexplode("ls").alias("p", "line"))
    heads = rows.where(F.col("line").contains("Averages for entire directory") | F.col("line").contains("Trainable params"))
    near = heads.select("file", "p", F.explode(F.array_compact(F.array("line", F.get("ls", F.col("p") + 1)))).alias("line"))
    return near.where(F.col("line").contains("f1") | F.col("line").contains("Trainable params")).select(
        "file", F.trim(F.split("line", " \\[")[0]).alias("what"), F.get(F.split("line", " \\["), F.lit(1)).alias("values"))


CHARSET = T.StructType([
    T.StructField("char_to_idx", T.MapType(T.StringType(), T.IntegerType())), T.StructField("idx_to_char", T.MapType(T.StringType(), T.StringType())),
])


def charset_rows(json: DataFrame) -> DataFrame:
    """``{char_to_idx, idx_to_char}`` as ``ch, idx`` rows."""
    parsed = json.select(F.from_json("value", CHARSET).alias("c"))
    rows = parsed.select(F.explode("c.char_to_idx").alias("ch", "idx")).unionByName(
        parsed.select(F.explode("c.idx_to_char").alias("i", "ch")).select("ch", F.col("i").cast("int").alias("idx")))
    return rows.distinct()


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    return charset_rows(spark.read.text(path, wholetext=True))
