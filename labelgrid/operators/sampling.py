"""Repeatable sampling: every draw is a hash of the seed and its own number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelgrid.functions import geometry as G
from labelgrid.functions.arith import uniform
from labelgrid.operators.align import crop
from labelgrid.operators.banding import shuffled_index
from labelgrid.operators.boxes import char_boxes

SLOTS = 1024

# fixed values: smallest mean mask value a region must reach
CRITERIA = {"multichannel": 5e-5, "alternate": 1e-5, "paired": 0.01, "binary": 0.03, "binary_strict": 0.1, "text_box": 0.05}
MAX_TRIES = 50
STAMP_CLASS, STAMP_LEFT, STAMP_DEPTH = 4, 0.35, 0.25


def draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "sample_id")


def sample_images(images: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` uniform images with replacement: a numbered image list meets drawn numbers."""
    listed = shuffled_index(images.select("image_id", uniform(f"{seed}-order", F.col("image_id")).alias("_u")), [], "_u", ["image_id"])
    slots = listed.select("image_id", "idx", "n")
    # the image count rides on the list; a draw only needs its own fraction of it
    total = slots.select(F.col("n")).where("idx = 0")
    drawn = draws(images.sparkSession, n).withColumn("u", uniform(seed, F.col("sample_id")))
    sized = with_total(drawn, total)
    return sized.select("sample_id", F.floor(F.col("u") * F.col("n")).alias("idx")).join(slots.drop("n"), "idx").select("sample_id", "image_id")


def with_total(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table: its copies for the key slots are ``SLOTS`` rows, whatever the data."""
    spread = one_row.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return df.withColumn("_slot", F.pmod(F.xxhash64(*df.columns), F.lit(SLOTS)).cast("int")).join(F.broadcast(spread), "_slot").drop("_slot")


def class_probabilities(scores: DataFrame) -> DataFrame:
    """p_c = (1 - F_c) / sum(1 - F), uniform when all F or all 1 - F are 0; cumulative ``[lo, hi)``.

    One row per class. The sum is checked with a tolerance by construction: the
    last interval ends at 1.
    """
    whole, upto = W.partitionBy(), W.orderBy("class_id")
    miss = 1 - F.col("f1")
    p = F.when((F.sum("f1").over(whole) == 0) | (F.sum(miss).over(whole) <= 0), 1 / F.count(F.lit(1)).over(whole)).otherwise(miss / F.sum(miss).over(whole))
    out = scores.select("class_id", "f1", p.alias("p"))
    hi = F.when(F.row_number().over(W.orderBy(F.desc("class_id"))) == 1, 1e0).otherwise(F.sum("p").over(upto))
    return out.withColumns({"hi": hi}).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0e0)))


def draw_classes(probabilities: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` classes drawn by their intervals: draws and intervals meet on slots of [0, 1)."""
    slots = F.sequence(F.floor(F.col("lo") * SLOTS), F.least(F.floor(F.col("hi") * SLOTS), F.lit(SLOTS - 1)))
    intervals = probabilities.where("hi > lo").select("class_id", "lo", "hi", F.explode(slots).alias("_slot"))
    drawn = draws(probabilities.sparkSession, n).withColumn("u", uniform(seed, F.col("sample_id"))).withColumn("_slot", F.floor(F.col("u") * SLOTS))
    return drawn.join(intervals, "_slot").where("u >= lo AND u < hi").select("sample_id", "class_id")


def sample_by_performance(scores: DataFrame, index: DataFrame, n: int, seed: str) -> DataFrame:
    """Classes by how badly they score, then a uniform image of the class.

    Only classes with images take part.
    """
    listed = shuffled_index(
        index.select("class_id", "image_id", uniform(f"{seed}-order", F.col("class_id"), F.col("image_id")).alias("_u")), ["class_id"], "_u", ["image_id"]
    ).select("class_id", "image_id", "idx", "n")
    present = listed.where("idx = 0").select("class_id", "n")
    usable = scores.join(present.select("class_id"), "class_id", "left_semi")
    drawn = draw_classes(class_probabilities(usable), n, seed).withColumn("u", uniform(f"{seed}-image", F.col("sample_id")))
    # class sizes are repeated over slots: a favoured class may get most draws
    slot = F.pmod("sample_id", F.lit(SLOTS)).cast("int")
    sizes = present.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    picked = drawn.withColumn("_slot", slot).join(sizes, ["class_id", "_slot"]).withColumn("idx", F.floor(F.col("u") * F.col("n")))
    return picked.select("sample_id", "class_id", "idx").join(listed.drop("n"), ["class_id", "idx"]).select("sample_id", "class_id", "image_id")


def quota_rows(index: DataFrame, seed: str, quota: int | None = None) -> DataFrame:
    """The images that ``sample_quota`` takes, with their place ``idx`` in the class and the quota as ``_q``."""
    u = uniform(seed, F.col("class_id"), F.col("image_id"))
    ordered = shuffled_index(index.withColumn("_u", u), ["class_id"], "_u", ["image_id"], value="n_pixels")
    if quota is not None:
        return ordered.withColumn("_q", F.lit(quota)).where("before < _q")
    smallest = index.groupBy("class_id").agg(F.sum("n_pixels").alias("_t")).agg(F.min("_t").alias("_q"))
    return with_total(ordered, smallest).where("before < _q")


def sample_quota(index: DataFrame, seed: str, quota: int | None = None) -> DataFrame:
    """Images per class in random order until each class holds the same number of pixels.

    The quota defaults to the pixels of the smallest class. An image is taken
    while the pixels before it are below the quota.
    """
    return quota_rows(index, seed, quota).select("class_id", "image_id", "n_pixels", "before")


def greedy_draws(index: DataFrame, seed: str, quota: int | None = None) -> DataFrame:
    """The images of :func:`sample_quota` in the order of greedy draws, numbered from 0 by ``draw``.

    Each draw takes the next image of the class with the fewest pixels so far
    (ties: the smaller class). A class is next exactly when its running sum is
    the smallest, so the sequence is the merge of all classes by ``before``:
    ranges of it are counted, and rows numbered within their range.
    """
    rows = quota_rows(index, seed, quota).withColumnRenamed("idx", "_place").drop("n").withColumn("_u", F.col("before") / F.col("_q"))
    return shuffled_index(rows, [], "_u", ["before", "class_id", "_place"]).select(F.col("idx").cast("bigint").alias("draw"), "class_id", "image_id", "n_pixels", "before")


def _clamp(c: Column, extent: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(c - size // 2, extent - size)).cast("int")


def class_crops(cells: DataFrame, images: DataFrame, size: int, seed: str, per_layer: int = 1) -> DataFrame:
    """Windows around a uniform pixel of each (image, class), half of them around any pixel.

    The pixel is the one with the smallest hash: an aggregate with map-side
    combine, however many pixels a layer has.
    """
    draw = cells.where("v > 0").select("image_id", "class_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(per_layer - 1))).alias("draw"))
    keyed = draw.withColumn("u", uniform(f"{seed}-pixel", *[F.col(c) for c in ("image_id", "class_id", "draw", "y", "x")]))
    spot = keyed.groupBy("image_id", "class_id", "draw").agg(F.min(F.struct("u", "y", "x")).alias("s"))
    out = spot.join(images.select("image_id", "height", "width"), "image_id")
    u = lambda what: uniform(f"{seed}-{what}", F.col("image_id"), F.col("class_id"), F.col("draw"))
    anywhere = u("coin") > 0.5
    y = F.when(anywhere, F.floor(u("y") * F.col("height"))).otherwise(F.col("s.y"))
    x = F.when(anywhere, F.floor(u("x") * F.col("width"))).otherwise(F.col("s.x"))
    return out.select("image_id", "class_id", "draw", _clamp(x, F.col("width"), size).alias("left"), _clamp(y, F.col("height"), size).alias("top"), F.lit(size).alias("size"))


def uniform_crops(samples: DataFrame, images: DataFrame, size: int, seed: str) -> DataFrame:
    """A uniform window per sampled image."""
    out = samples.join(images.select("image_id", "height", "width"), "image_id")
    at = lambda what, extent: F.floor(uniform(f"{seed}-{what}", F.col("sample_id")) * F.greatest(F.col(extent) - size, F.lit(1))).cast("int")
    return out.select("sample_id", "image_id", at("x", "width").alias("left"), at("y", "height").alias("top"), F.lit(size).alias("size"))


def region_candidates(images: DataFrame, seed: str, low: int, high: int, tries: int = MAX_TRIES) -> DataFrame:
    """``tries`` windows per (image, class): centre and size hashed; class 4 only at the upper right."""
    layers = images.select("image_id", "height", "width", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)).alias("class_id"))
    out = layers.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    u = lambda what: uniform(f"{seed}-{what}", F.col("image_id"), F.col("class_id"), F.col("try"))
    stamp = F.col("class_id") == STAMP_CLASS
    x0 = F.when(stamp, F.floor(F.col("width") * STAMP_LEFT)).otherwise(0)
    y1 = F.when(stamp, F.greatest(F.floor(F.col("height") * STAMP_DEPTH), F.lit(1))).otherwise(F.col("height"))
    x = (x0 + F.floor(u("x") * (F.col("width") - x0))).cast("int")
    y = F.floor(u("y") * y1).cast("int")
    side = (low + F.floor(u("size") * (high - low + 1))).cast("int")
    out = out.withColumns({"cx": x, "cy": y, "side": side}).withColumn("half", F.floor(F.col("side") / 2).cast("int"))
    return out.select(
        "image_id", "class_id", "try", "side", F.greatest(F.lit(0), F.col("cx") - F.col("half")).alias("l"), F.greatest(F.lit(0), F.col("cy") - F.col("half")).alias("t"),
        F.least("width", F.col("cx") + F.col("half")).alias("r"), F.least("height", F.col("cy") + F.col("half")).alias("b"),
    )


def window_masses(windows: DataFrame, cells: DataFrame, keys: list[str], tile: int = 256) -> DataFrame:
    """``mass``: the sum of ``v`` inside each window ``(*keys, try, l, t, r, b)``; windows that meet no cell have no row.

    Windows and cells meet once per page tile: a row holds the tile's cells and all windows that touch it, so the join doesn't grow with the
    number of windows. Per tile a summed-area table is built, and each window is four lookups in it. A tile is bounded, so a page of any size is
    spread over as many keys as it has tiles.
    """
    lo = lambda c: F.floor(F.col(c) / tile).cast("int")
    hi = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    place = [*keys, "_ty", "_tx"]
    full = windows.where("r > l AND b > t")
    asked = (
        full.withColumn("_ty", F.explode(F.sequence(lo("t"), hi("b")))).withColumn("_tx", F.explode(F.sequence(lo("l"), hi("r"))))
        .groupBy(*place).agg(F.collect_list(F.struct("try", "l", "t", "r", "b")).alias("_windows"))
    )
    tiles = cells.withColumns({"_ty": lo("y"), "_tx": lo("x")}).groupBy(*place).agg(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))).alias("_cells"))

    def field(column: pa.ListArray, name: str) -> np.ndarray:
        return column.flatten().field(name).to_numpy(zero_copy_only=False)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                top, left = row.column("_ty")[0].as_py() * tile, row.column("_tx")[0].as_py() * tile
                area = np.zeros((tile + 1, tile + 1))
                own, asked = row.column("_cells"), row.column("_windows")
                np.add.at(area, (field(own, "y") - top + 1, field(own, "x") - left + 1), field(own, "v"))
                area = area.cumsum(0).cumsum(1)
                t, b = (np.clip(field(asked, c) - top, 0, tile) for c in "tb")
                le, r = (np.clip(field(asked, c) - left, 0, tile) for c in "lr")
                mass = area[b, r] - area[t, r] - area[b, le] + area[t, le]
                n = len(mass)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(row.column(c)[0], n) for c in keys), asked.flatten().field("try"), pa.array(mass)], names=[*keys, "try", "mass"])

    kinds = dict(windows.dtypes)
    found = tiles.join(asked, place).mapInArrow(sums, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "try")) + ", mass double")
    return found.groupBy(*keys, "try").agg(F.sum("mass").alias("mass"))


def accept_regions(candidates: DataFrame, cells: DataFrame, criterion: float = CRITERIA["multichannel"], tile: int = 256) -> DataFrame:
    """First candidate whose mean mask value reaches ``criterion``, else the last one.

    A class absent from the page takes its first candidate; a window without area is never good. Masses come from :func:`window_masses`.
    """
    layer = ["image_id", "class_id"]
    inked = cells.where("v > 0").select(*layer, "y", "x", "v")
    present = inked.select(*layer).distinct().withColumn("present", F.lit(True))
    box = F.struct("try", "l", "t", "r", "b", "side")
    rated = candidates.join(window_masses(candidates, inked, layer, tile), [*layer, "try"], "left").join(present, layer, "left")
    size = (F.col("b") - F.col("t")) * (F.col("r") - F.col("l"))
    good = F.col("present").isNull() | ((size > 0) & (F.coalesce("mass", F.lit(0e0)) >= F.lit(criterion) * size))
    pick = F.coalesce(F.min(F.when(good, box)), F.max(box)).alias("p")
    return rated.groupBy(*layer).agg(pick, F.max(good.cast("int")).alias("accepted")).select(*layer, "p.*", "accepted")


def sample_regions(images: DataFrame, cells: DataFrame, seed: str, low: int, high: int, criterion: float = CRITERIA["multichannel"], tries: int = MAX_TRIES) -> DataFrame:
    return accept_regions(region_candidates(images, seed, low, high, tries), cells, criterion)


def region_cells(regions: DataFrame, cells: DataFrame, target: int) -> DataFrame:
    """Cells of each region in a ``target x target`` frame (nearest pixel)."""
    windows = regions.select(F.concat_ws("-", "image_id", "class_id").alias("sample_id"), "image_id", F.col("l").alias("left"), F.col("t").alias("top"), F.col("side").alias("size"))
    cut = crop(windows, cells).join(windows.select("sample_id", "size"), "sample_id")
    scale = F.lit(float(target)) / F.col("size")
    rest = [c for c in cells.columns if c not in ("image_id", "y", "x", "v")]
    return cut.groupBy("sample_id", "image_id", *rest, F.floor(F.col("y") * scale).cast("int").alias("y"), F.floor(F.col("x") * scale).cast("int").alias("x")).agg(F.max("v").alias("v"))


def first_varied_crop(tries: DataFrame, intensity: DataFrame, limit: int = 3) -> DataFrame:
    """The first of ``limit`` windows per sample that is not flat, else the last.

    ``tries`` has ``sample_id, try, image_id, left, top, size``; intensity tables
    are dense, so the deviation is over the rows found.
    """
    windows = tries.where(F.col("try") <= limit).withColumn("_id", F.concat_ws("#", "sample_id", "try"))
    cut = crop(windows.select(F.col("_id").alias("sample_id"), "image_id", "left", "top", "size"), intensity)
    flat = cut.groupBy(F.col("sample_id").alias("_id")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rated = windows.join(flat, "_id", "left").withColumn("varied", F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)))
    row = F.struct("try", "left", "top", "size", "image_id", "varied")
    pick = F.coalesce(F.min(F.when(F.col("varied"), row)), F.max(row)).alias("p")
    return rated.groupBy("sample_id").agg(pick).select("sample_id", "p.*")


def char_regions(words: DataFrame, seed: str) -> DataFrame:
    """A square around every character: the shorter side grows by a hashed split."""
    chars = char_boxes(words)
    bx = G.box()
    split = uniform(seed, F.col("page_id"), F.col("box_id"), F.col("pos"))
    gap = (bx.b - bx.t) - (bx.r - bx.l)
    grow = F.floor(split * F.abs(gap) + 0.5).cast("int")
    b = F.when(gap < 0, bx.b + grow).otherwise(bx.b)
    r = F.when(gap > 0, bx.r + grow).otherwise(bx.r)
    t = F.when(gap < 0, bx.b + grow - (bx.r - bx.l)).otherwise(bx.t)
    le = F.when(gap > 0, bx.r + grow - (bx.b - bx.t)).otherwise(bx.l)
    return chars.select("page_id", "box_id", "pos", "ch", le.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))


def batch_mix(shares: DataFrame, batch_size: int) -> DataFrame:
    """Positions ``[first, last)`` of each class in a batch from cumulative shares."""
    upto = W.orderBy("class_id")  # one row per class
    cum = F.sum("share").over(upto)
    return shares.select("class_id", F.floor((cum - F.col("share")) * batch_size + 1e-9).cast("int").alias("first"), F.floor(cum * batch_size + 1e-9).cast("int").alias("last"))


def mix_samplers(first: DataFrame, second: DataFrame, probability: float, seed: str) -> DataFrame:
    """Each draw from ``first`` with the given probability, otherwise from ``second``."""
    u = uniform(seed, F.col("sample_id"))
    return first.where(u < probability).unionByName(second.where(u >= probability))


def subword_samples(words: DataFrame, seed: str) -> DataFrame:
    """A random part of each word with its strip of the page.

    Start and end are hashed character positions; the strip follows from the cut
    offsets, the text is the matching slice.
    """
    n = F.length("text")
    fit = words.where((F.size("charsegs") >= n - 1) & (n > 0))
    key = [F.col("page_id"), F.col("box_id")]
    fit = fit.withColumn("start", F.floor(uniform(f"{seed}-start", *key) * n).cast("int"))
    fit = fit.withColumn("end", (F.col("start") + 1 + F.floor(uniform(f"{seed}-end", *key) * (n - F.col("start")))).cast("int"))
    left = F.when(F.col("start") > 0, F.col("l") + F.get("charsegs", F.col("start") - 1)).otherwise(F.col("l"))
    right = F.when(F.col("end") < n, F.col("l") + F.get("charsegs", F.col("end") - 1)).otherwise(F.col("r"))
    return fit.select("page_id", "box_id", "start", "end", left.alias("l"), "t", right.alias("r"), "b", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
