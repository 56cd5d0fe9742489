"""Decoding image folders to label and intensity tables.

Spark's image source decodes files on the JVM; a small Arrow step turns each
decoded image into its non-zero pixels. Everything after that is columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.session import small_batches
from labelgrid.sources.listing import LAYER_EXTS, detect_label_format, file_name, stem_of, training_images

MAX_SUFFIXES = 1000
STRIP_BYTES = 1 << 15
OUTPUT_ROWS = 1 << 16


def decoded(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Images of a folder as ``path, height, width, nChannels, data``; undecodable files are left out.

    ``glob`` keeps files out of the scan, so they are never decoded.
    """
    im = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).load(folder)
    return im.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def strips(images: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Images cut into runs of pixel rows of at most ``STRIP_BYTES`` (one row if wider).

    The cut happens on the JVM, so the records that cross to Python are small
    whatever the page size, and a full Arrow batch of them is at most 32 MB.
    ``keep`` names further columns to carry along.
    """
    small_batches(images.sparkSession)
    line = F.col("width") * F.col("nChannels")
    rows = F.greatest(F.floor(F.lit(STRIP_BYTES) / line), F.lit(1)).cast("int")
    cut = lambda i: F.struct((i * F.col("_rows")).alias("y0"), F.substring("data", i * F.col("_rows") * line + 1, F.col("_rows") * line).alias("data"))
    sized = images.where((F.col("height") > 0) & (F.col("width") > 0)).withColumn("_rows", rows)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("height") / F.col("_rows")).cast("int") - 1), cut)
    return sized.select("path", *keep, "width", "nChannels", F.explode(parts).alias("s")).select("path", *keep, "width", "nChannels", "s.y0", "s.data")


def _per_strip(pixels: Callable[[np.ndarray], dict[str, np.ndarray]], keep: tuple[str, ...] = ("path",)):
    """Run ``pixels`` on the array of each strip, read where it lies in its Arrow batch, and hand rows on, with its ``keep`` columns, in pieces of bounded size."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, size = [], 0
            data, kept = batch.column("data"), [batch.column(c) for c in keep]
            for i, (width, channels, y0) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "nChannels", "y0")))):
                out = pixels(np.frombuffer(data[i].as_buffer(), np.uint8).reshape(-1, width, channels))
                out["y"] = out["y"] + y0
                n = len(out["y"])
                columns = [*(pa.repeat(c[i], n) for c in kept), *(pa.array(v if v.dtype.kind == "f" else v.astype(np.int32)) for v in out.values())]
                ready.append(pa.RecordBatch.from_arrays(columns, names=[*keep, *out]))
                size += n
                if size >= OUTPUT_ROWS:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, size = [], 0
            if size:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return convert


def _grey_pixels(px: np.ndarray) -> dict[str, np.ndarray]:
    if px.shape[2] == 1:
        grey = px[:, :, 0]
    else:
        b, g, r = (px[:, :, i].astype(np.float64) for i in range(3))
        grey = np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)
    y, x = np.nonzero(grey)
    return {"y": y, "x": x, "grey": grey[y, x]}


def _mask_pixels(px: np.ndarray) -> dict[str, np.ndarray]:
    mask = sum(px[:, :, c].astype(np.int32) << (8 * c) for c in range(min(px.shape[2], 3)))
    y, x = np.nonzero(mask)
    return {"y": y, "x": x, "mask": mask[y, x]}


def _channel_pixels(px: np.ndarray) -> dict[str, np.ndarray]:
    px = np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[:, :, :3]
    y, x, c = (a.ravel() for a in np.indices(px.shape))
    return {"y": y, "x": x, "c": c, "v": px.ravel() / 255.0}


def _image_id(path: str = "path"):
    return stem_of(file_name(F.col(path)))


def page_extents(spark: SparkSession, folder: str, n_classes: int) -> DataFrame:
    """``images`` table of the training images of a folder."""
    return training_images(decoded(spark, folder, "*.[jJ][pP][gG]")).select(_image_id().alias("image_id"), "height", "width", F.lit(n_classes).alias("n_classes"))


def layer_cells(images: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells (grey / 255) of decoded layer ``images`` by ``chosen (path_name, image_id, class_id)``; a layer may serve several images.

    Names meet whole images, so files nobody asked for are never taken apart and no pixel is joined.
    """
    keep = ("image_id", "class_id")
    named = images.withColumn("path_name", file_name(F.col("path"))).join(chosen.select("path_name", F.col("image_id").cast("string").alias("image_id"), F.col("class_id").cast("int").alias("class_id")), "path_name")
    pixels = strips(named, keep).mapInArrow(_per_strip(_grey_pixels, keep), "image_id string, class_id int, y int, x int, grey int")
    return pixels.select("image_id", "y", "x", "class_id", (F.col("grey") / F.lit(255e0)).alias("v"))


def mask_cells(images: DataFrame, n_classes: int, dont_care_bit: int | None = None) -> DataFrame:
    """Cells of decoded ``images`` whose bits are classes, low byte first; optional ambiguity flag."""
    masks = strips(images).mapInArrow(_per_strip(_mask_pixels), "path string, y int, x int, mask int").withColumn("image_id", _image_id())
    flag = F.lit(False) if dont_care_bit is None else F.getbit("mask", F.lit(dont_care_bit)) == 1
    return masks.select("image_id", "y", "x", flag.alias("dont_care"), "mask", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class_id")).where(
        F.getbit("mask", F.col("class_id")) == 1
    ).select("image_id", "y", "x", "class_id", F.lit(1e0).alias("v"), "dont_care")


def channel_values(images: DataFrame, rate: int = 1) -> DataFrame:
    """Dense channels of decoded ``images`` (blue, green, red; grey repeated), area-averaged if ``rate > 1``."""
    from labelgrid.operators.pixels import downsample

    rows = strips(images).mapInArrow(_per_strip(_channel_pixels), "path string, y int, x int, c int, v double")
    out = rows.select(_image_id().alias("image_id"), "y", "x", "c", "v")
    return downsample(out, rate) if rate > 1 else out


def _layer_cells(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Cells of the first existing file per (image, class); ``wanted (path_name, image_id, class_id, priority)``.

    Names are settled on the listing, which reads no file.
    """
    files = spark.read.format("binaryFile").load(folder).select(file_name(F.col("path")).alias("path_name"))
    chosen = files.join(wanted, "path_name").groupBy("image_id", "class_id").agg(F.min(F.struct("priority", "path_name")).alias("m")).select("image_id", "class_id", F.col("m.path_name").alias("path_name"))
    return layer_cells(decoded(spark, folder, "*_*"), chosen)


def _names(images: DataFrame, classes: DataFrame, exts: list[str], both_forms: bool) -> DataFrame:
    """Candidate layer names, extension order first, then stem before full image name.

    ``classes (suffix, class_id)`` is a short list per folder and becomes one
    array; candidates are spread from the image rows.
    """
    listed = [(r["suffix"], r["class_id"]) for r in classes.select("suffix", "class_id").limit(MAX_SUFFIXES + 1).collect()]
    if len(listed) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} layer suffixes")
    stem, name = stem_of(F.col("name")), F.col("name")
    options = []
    for suffix, class_id in listed:
        for i, ext in enumerate(exts):
            forms = [stem, name] if both_forms else [stem]
            for j, form in enumerate(forms):
                options.append(F.struct(
                    F.concat(form, F.lit(f"_{suffix}.{ext}")).alias("path_name"), F.lit(class_id).cast("int").alias("class_id"), F.lit(2 * i + j).alias("priority"),
                ))
    return images.select(stem.alias("image_id"), F.explode(F.array(*options)).alias("o")).select("image_id", "o.*")


def _training_names(spark: SparkSession, folder: str, only: DataFrame | None) -> DataFrame:
    """Names of the training images of a folder, or of those with an ``image_id`` in ``only``; no file is read."""
    names = training_images(spark.read.format("binaryFile").load(folder).select("path")).select(file_name(F.col("path")).alias("name"))
    return names if only is None else names.join(only, stem_of(F.col("name")) == only["image_id"], "left_semi")


def read_layers(spark: SparkSession, folder: str, classes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Suffix layers (grey / 255); a missing layer has no cells. ``only (image_id)`` narrows the images."""
    images = _training_names(spark, folder, only)
    return _layer_cells(spark, folder, _names(images, classes, LAYER_EXTS, both_forms=True))


def read_numbered_layers(spark: SparkSession, folder: str, n_classes: int, only: DataFrame | None = None) -> DataFrame:
    """``<stem>_<k>.png`` or ``.jpg`` layers. ``only (image_id)`` narrows the images."""
    classes = spark.range(n_classes).select(F.col("id").cast("string").alias("suffix"), F.col("id").cast("int").alias("class_id"))
    images = _training_names(spark, folder, only)
    return _layer_cells(spark, folder, _names(images, classes, ["png", "jpg"], both_forms=False))


def read_bit_indexed(spark: SparkSession, folder: str, n_classes: int, dont_care_bit: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """``<stem>.png`` whose bits are classes, low byte first; optional ambiguity flag. ``only (image_id)`` narrows the images."""
    stems = _training_names(spark, folder, only).select(stem_of(F.col("name")).alias("_stem"))
    images = decoded(spark, folder, "*.[pP][nN][gG]").join(stems, _image_id() == F.col("_stem"), "left_semi")
    return mask_cells(images, n_classes, dont_care_bit)


def read_intensity(spark: SparkSession, folder: str, rate: int = 1) -> DataFrame:
    """Dense channels of the training images (blue, green, red; grey repeated), area-averaged if ``rate > 1``."""
    return channel_values(training_images(decoded(spark, folder, "*.[jJ][pP][gG]")), rate)


READERS: dict[str, Callable[..., DataFrame]] = {
    "suffix": lambda spark, folder, classes, n, only=None: read_layers(spark, folder, classes, only),
    "numbered": lambda spark, folder, classes, n, only=None: read_numbered_layers(spark, folder, n, only),
    "bit_indexed": lambda spark, folder, classes, n, only=None: read_bit_indexed(spark, folder, n, only=only).drop("dont_care"),
}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a label format: ``reader(spark, folder, classes, n_classes) -> cells``."""
    READERS[name] = reader


def read_labels(spark: SparkSession, folder: str, classes: DataFrame, n_classes: int, reader: str | None = None) -> DataFrame:
    """Cells of a folder, by a named reader or by what each image's files look like: the listing settles the format, and each reader sees its own images only."""
    if reader is not None:
        return READERS[reader](spark, folder, classes, n_classes)
    formats = detect_label_format(spark.read.format("binaryFile").load(folder).select("path")).withColumnRenamed("stem", "image_id")
    out = None
    for name in ("suffix", "numbered", "bit_indexed"):
        own = formats.where(F.col("format") == name).select("image_id")
        part = READERS[name](spark, folder, classes, n_classes, own).select("image_id", "y", "x", "class_id", "v")
        out = part if out is None else out.unionByName(part)
    return out
