"""Folder listings and what file names say about classes and label formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelgrid.session import cut_lineage

LAYER_EXTS = ["jpg", "png", "tif"]  # fixed order of preference
PAGE_EXTS = ["jpg", "jpeg", "png", "gif", "bmp"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly in a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def training_images(files: DataFrame) -> DataFrame:
    """``.jpg`` names that are not themselves layers of another image."""
    name = F.lower(file_name(F.col("path")))
    return files.where(name.endswith(".jpg") & ~name.contains(".jpg.") & ~name.contains(".jpg_"))


def inference_images(files: DataFrame) -> DataFrame:
    """``.jpg`` files whose stem carries no ``.jpg_``, in order of their path."""
    name = file_name(F.col("path"))
    return files.where(name.endswith(".jpg") & ~stem_of(name).contains(".jpg_")).orderBy("path")


def batch_images(files: DataFrame, exts: list[str]) -> DataFrame:
    """Files of the given extensions, in order of their path."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.where(ext.isin([e.lower().lstrip(".") for e in exts])).orderBy("path")


def class_roots(files: DataFrame, exts: list[str] = LAYER_EXTS) -> DataFrame:
    """Each stem with the longest-named image it could be a layer of (NULL if none).

    With an underscore, the part before the last one has to be a stem; without,
    the longest proper prefix that is one.
    """
    name = file_name(F.col("path"))
    stems = files.where(F.lower(F.substring(name, -3, 3)).isin(exts)).select(stem_of(name).alias("name")).distinct()
    cut = F.col("name").contains("_")
    head = F.substring_index("name", "_", -1)
    before = F.expr("substring(name, 1, length(name) - length(substring_index(name, '_', -1)) - 1)")
    prefixes = F.when(cut, F.array(before)).when(F.length("name") > 1, F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda n: F.substring("name", 1, n)))
    candidates = stems.select("name", F.explode_outer(prefixes).alias("root"))
    known = stems.select(F.col("name").alias("root"), F.lit(True).alias("_known"))
    best = candidates.join(known, "root", "left").groupBy("name").agg(F.max(F.when(F.col("_known"), F.struct(F.length("root").alias("n"), F.col("root")))).alias("b"))
    suffix = F.when(cut, head).otherwise(F.expr("substring(name, b.n + 1)"))
    return best.select("name", F.col("b.root").alias("root"), F.when(F.col("b").isNotNull(), suffix).alias("suffix"))


def resolve_layers(roots: DataFrame) -> DataFrame:
    """Stems that count as layers or as unmatched, longest names deciding first.

    A stem that is the root of a deciding longer stem is an image and is passed
    over; then it makes no claim of its own. Names chain over a few underscores
    at most, and each round settles one link of every chain.
    """
    settled, open_ = None, cut_lineage(roots)
    while not open_.isEmpty():
        claimed = open_.where("root IS NOT NULL").select(F.col("root").alias("name")).distinct()
        free = open_.join(claimed, "name", "left_anti")
        images = free.where("root IS NOT NULL").select(F.col("root").alias("name")).distinct()
        settled = free if settled is None else settled.unionByName(free)
        open_ = cut_lineage(open_.join(free.select("name"), "name", "left_anti").join(images, "name", "left_anti"))
    return settled if settled is not None else roots.limit(0)


def discover_classes(files: DataFrame, exts: list[str] = LAYER_EXTS) -> DataFrame:
    """Class suffixes of a folder with alphabetical ids."""
    layers = resolve_layers(class_roots(files, exts)).where("root IS NOT NULL")
    names = layers.select(F.regexp_replace("suffix", "^_+|_+$", "").alias("suffix")).distinct()
    # one row per class of a folder
    return names.withColumn("class_id", F.row_number().over(W.orderBy("suffix")) - 1)


def unmatched_files(files: DataFrame, exts: list[str] = LAYER_EXTS) -> DataFrame:
    """Stems for which no image was found."""
    return resolve_layers(class_roots(files, exts)).where("root IS NULL").select("name")


def detect_label_format(files: DataFrame) -> DataFrame:
    """Per training image: ``bit_indexed``, ``numbered`` or ``suffix`` layers.

    Every file votes for the image it would belong to; one aggregation decides.
    """
    name = file_name(F.col("path"))
    stem, ext = stem_of(name), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    numbered = F.regexp_extract(stem, r"^(.*)_\d+$", 1)
    image = F.lower(name).endswith(".jpg") & ~F.lower(name).contains(".jpg.") & ~F.lower(name).contains(".jpg_")
    vote = lambda key, what, cond: F.when(cond, F.struct(key.alias("stem"), F.lit(what).alias("what")))
    votes = F.array_compact(F.array(
        vote(stem, "image", image), vote(stem, "bit", ext == "png"), vote(numbered, "numbered", ext.isin("jpg", "png") & (numbered != "")),
    ))
    flag = lambda what: F.max((F.col("v.what") == what).cast("int"))
    seen = files.select(F.explode(votes).alias("v")).groupBy(F.col("v.stem").alias("stem")).agg(flag("image").alias("i"), flag("bit").alias("b"), flag("numbered").alias("n"))
    return seen.where("i = 1").select("stem", F.when(F.col("b") == 1, "bit_indexed").when(F.col("n") == 1, "numbered").otherwise("suffix").alias("format"))
