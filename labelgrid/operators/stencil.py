"""Stencils on sparse layers: every cell goes to the tiles it touches.

Kernels and bounded distances work on dense tiles with a halo: one shuffle of
the cells, no row per pixel and offset, and no neighbour join. A task holds one
tile at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelgrid.operators.align import CELL, PIXEL
from labelgrid.operators.banding import attach_image

NARROW = 64  # pixel columns up to which all pairs of columns are compared
SIDE = 512  # pixels of a tile each way; work goes by the part of it that holds cells


def _dealt(cells: DataFrame, keys: list[str], reach: int, side: int) -> DataFrame:
    """Cells on every tile ``_ty, _tx`` of the page they reach, as far as its extent is known (columns ``height`` and ``width``)."""

    def touched(axis: str, extent: str):
        low, high = F.greatest(F.floor((F.col(axis) - reach) / side), F.lit(0)), F.floor((F.col(axis) + reach) / side)
        return F.sequence(low, F.least(high, F.floor((F.col(extent) - 1) / side)) if extent in cells.columns else high)

    placed = cells.where("y IS NOT NULL AND x IS NOT NULL")
    if "height" in cells.columns:
        # a cell beyond the page by more than the reach touches none of its tiles
        placed = placed.where((F.col("height") > 0) & (F.col("width") > 0) & (F.col("y") - reach < F.ceil(F.col("height") / side) * side) & (F.col("x") - reach < F.ceil(F.col("width") / side) * side) & (F.col("y") >= -reach) & (F.col("x") >= -reach))
    return placed.withColumn("_ty", F.explode(touched("y", "height"))).withColumn("_tx", F.explode(touched("x", "width")))


def tiled(cells: DataFrame, keys: list[str], reach: int, work: Callable[..., dict[str, np.ndarray]], schema: str, values: list[str] = ("v",), side: int = SIDE) -> DataFrame:
    """``work(y, x, values, y0, x0, height, width)`` on the cells of each tile of ``side`` pixels and a halo of ``reach`` around it: one shuffle, whatever the reach.

    A tile is bounded, so a page of any size is spread like many small ones. ``values`` come as doubles, null as NaN; ``work`` returns the
    columns of ``schema`` after ``keys``, masked arrays where they may be null.
    """
    keys = list(keys)
    dealt = _dealt(cells.select(*keys, "height", "width", "y", "x", *[F.col(c).cast("double").alias(c) for c in values]), keys, reach, side)
    kinds = dict(cells.dtypes)

    def run(rows: pa.Table) -> pa.Table:
        at = lambda c: rows.column(c)[0].as_py()
        number = lambda c: rows.column(c).to_numpy().astype(np.int64)
        own = [rows.column(v).to_numpy() for v in values]
        out = work(number("y"), number("x"), own, at("_ty") * side, at("_tx") * side, at("height"), at("width"))
        n = len(next(iter(out.values())))
        first = pa.array(np.zeros(n, np.int64))
        cols = {k: rows.column(k).combine_chunks().take(first) for k in keys}
        cols |= {k: pa.array(np.ma.getdata(v), mask=np.ma.getmaskarray(v)) for k, v in out.items()}
        return pa.Table.from_arrays([cols[k] if k in keys else cols[k].cast(made.field(k).type) for k in made.names], names=made.names)

    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema
    made = pa.schema([(c, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t]) for c, t in (part.split() for part in schema.split(", "))])
    made = pa.schema([*[pa.field(k, pa.null()) for k in keys], *made])
    return dealt.groupBy(*keys, "height", "width", "_ty", "_tx").applyInArrow(run, full)


def _tiled(cells: DataFrame, keys: list[str], reach: int, side: int, work, schema: str) -> DataFrame:
    """``work(tile rows, y0, x0)`` on dealt tiles like :func:`tiled`; rows of a tile carry all columns of ``cells``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        out = work(rows, int(first["_ty"]) * side, int(first["_tx"]) * side)
        return out.assign(**{k: first[k] for k in keys})

    return _dealt(cells, keys, reach, side).groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)


def _frame(y: np.ndarray, x: np.ndarray, y0: int, x0: int, height: int, width: int, reach: int, side: int = SIDE) -> tuple[slice, slice, int, int, tuple[int, int]]:
    """The part of the tile that cells reach: its rows and columns in an array that has ``reach`` more on each side, where that begins, and its shape."""
    top, left = max(y0, int(y.min()) - reach), max(x0, int(x.min()) - reach)
    low, right = min(y0 + side, height, int(y.max()) + reach + 1), min(x0 + side, width, int(x.max()) + reach + 1)
    low, right = max(low, top), max(right, left)
    return slice(reach, reach + low - top), slice(reach, reach + right - left), top - reach, left - reach, (low - top + 2 * reach, right - left + 2 * reach)


def _inside(y: np.ndarray, x: np.ndarray, top: int, left: int, shape: tuple[int, int]) -> np.ndarray:
    return (y >= top) & (x >= left) & (y < top + shape[0]) & (x < left + shape[1])


def _box(dense: np.ndarray, offsets: list[int], fold: Callable) -> np.ndarray:
    """``fold`` over what arrives when every place sends its value by all pairs of ``offsets``."""
    for axis in (0, 1):
        out = None
        for d in offsets:
            moved = np.roll(dense, d, axis)
            out = moved if out is None else fold(out, moved)
        dense = out
    return dense


def _largest(cells: DataFrame, images: DataFrame, offsets: list[int]) -> DataFrame:
    reach = max(abs(d) for d in offsets)
    keys = [c for c in CELL if c in cells.columns and c not in ("y", "x")]

    def work(y, x, values, y0, x0, height, width):
        rows, columns, top, left, shape = _frame(y, x, y0, x0, height, width, reach)
        near = _inside(y, x, top, left, shape)
        y, x, v = y[near] - top, x[near] - left, values[0][near]
        set_, best = np.zeros(shape, bool), np.full(shape, -np.inf)
        set_[y, x] = True
        known = ~np.isnan(v)
        np.maximum.at(best, (y[known], x[known]), v[known])
        some = np.zeros(shape, bool)
        some[y[known], x[known]] = True
        set_, best, some = (_box(a, offsets, f)[rows, columns] for a, f in ((set_, np.logical_or), (best, np.maximum), (some, np.logical_or)))
        y, x = np.nonzero(set_)
        return {"y": y + top + reach, "x": x + left + reach, "v": np.ma.array(best[y, x], mask=~some[y, x])}

    sized = attach_image(cells.select(*keys, "y", "x", "v"), images, ["height", "width"])
    return tiled(sized, keys, reach, work, f"{_places(cells)}, v double").select(*[c for c in CELL if c in cells.columns], "v")


def _places(cells: DataFrame) -> str:
    kinds = dict(cells.dtypes)
    return f"y {kinds['y']}, x {kinds['x']}"


def dilate(cells: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """``n`` passes of a 3x3 maximum: one maximum over (2n+1) x (2n+1)."""
    return _largest(cells, images, list(range(-n, n + 1)))


def dilate_window(cells: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """One pass of a k x k maximum anchored at ``k // 2``."""
    return _largest(cells, images, [k // 2 - j for j in range(k)])


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of the normalised 1-D kernel, side max(3, int(4 sigma + 1))."""
    side = max(3, int(4 * sigma + 1))
    mean, pad = side // 2, (side - 1) // 2
    w = [math.exp(-((i - mean) ** 2) / (2 * sigma**2)) for i in range(side)]
    return [(pad - i, w[i] / sum(w)) for i in range(side)]


def _blurred(cells: DataFrame, images: DataFrame, sigma: float, values: list[str], side: int = SIDE) -> DataFrame:
    """``values`` after a Gaussian blur; a row where any of them is not 0."""
    kernel = gaussian_kernel(sigma)
    reach = max(abs(d) for d, _ in kernel)
    keys = [c for c in CELL if c in cells.columns and c not in ("y", "x")]

    def work(y, x, own, y0, x0, height, width):
        rows, columns, top, left, shape = _frame(y, x, y0, x0, height, width, reach, side)
        near = _inside(y, x, top, left, shape)
        high, wide = rows.stop - rows.start, columns.stop - columns.start
        both = []
        for v in own:
            dense = np.zeros(shape)
            np.add.at(dense, (y[near] - top, x[near] - left), v[near])
            across = sum(w * dense[:, reach - d : reach - d + wide] for d, w in kernel)
            both.append(sum(w * across[reach - d : reach - d + high] for d, w in kernel))
        at_y, at_x = np.nonzero(np.any([b != 0 for b in both], axis=0))
        return {"y": at_y + top + reach, "x": at_x + left + reach, **{c: np.ma.masked_invalid(b[at_y, at_x]) for c, b in zip(values, both, strict=True)}}

    sized = attach_image(cells.select(*keys, "y", "x", *values), images, ["height", "width"])
    return tiled(sized, keys, reach, work, _places(cells) + "".join(f", {c} double" for c in values), values, side).select(*[c for c in CELL if c in cells.columns], *values)


def gaussian_smooth(cells: DataFrame, images: DataFrame, sigma: float = 5.0, side: int = SIDE) -> DataFrame:
    """Gaussian blur per class with zero padding; the 2-D kernel is the product of two 1-D ones."""
    return _blurred(cells, images, sigma, ["v"], side)


def gaussian_smooth_pairs(gt: DataFrame, pred: DataFrame, images: DataFrame, sigma: float = 5.0) -> DataFrame:
    """``g`` and ``p`` of two tables after the same blur, zero filled: both go to the same tiles, and no blurred pixel is shuffled."""
    left = gt.select(*CELL, F.col("v").alias("g"), F.lit(0e0).alias("p"))
    right = pred.select(*CELL, F.lit(0e0).alias("g"), F.col("v").alias("p"))
    return _blurred(left.unionByName(right), images, sigma, ["g", "p"])


def _nearest(marks: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance of every place of a dense mask to its nearest mark; beyond ``reach`` it may come out larger."""
    far = reach + 1
    at = np.arange(len(marks))[:, None]
    before = np.maximum.accumulate(np.where(marks, at, -far), axis=0)
    after = np.minimum.accumulate(np.where(marks, at, len(marks) - 1 + far)[::-1], axis=0)[::-1]
    column = np.minimum(np.minimum(at - before, after - at), far) ** 2
    best = column.copy()
    for d in range(1, min(reach, marks.shape[1] - 1) + 1):
        best[:, d:] = np.minimum(best[:, d:], column[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], column[:, d:] + d * d)
    return best


def border(cells: DataFrame, images: DataFrame) -> DataFrame:
    """Set cells that a 3x3 erosion removes: some neighbour inside the page is empty."""

    def work(y, x, values, y0, x0, height, width):
        rows, columns, top, left, shape = _frame(y, x, y0, x0, height, width, 1)
        near = _inside(y, x, top, left, shape)
        y, x, v = y[near] - top, x[near] - left, values[0][near]
        count, best = np.zeros(shape, np.int64), np.full(shape, -np.inf)
        np.add.at(count, (y, x), 1)
        np.maximum.at(best, (y, x), v)
        around = _box(count, [-1, 0, 1], np.add)
        y, x = (a + 1 for a in np.nonzero(count[rows, columns]))
        at_y, at_x = y + top, x + left
        side = lambda c, extent: np.minimum(c + 1, extent - 1) - np.maximum(c - 1, 0) + 1
        gone = around[y, x] < side(at_y, height) * side(at_x, width)
        return {"y": at_y[gone], "x": at_x[gone], "v": best[y, x][gone]}

    keys = ["image_id", "class_id"]
    sized = attach_image(cells.where("v > 0").select(*CELL, F.col("v").cast("double").alias("v")), images, ["height", "width"])
    placed = tiled(sized, keys, 1, work, f"{_places(cells)}, v double").select(*CELL, "v")
    # cells without a column stand in one of their own: each counts three times for the rows around it, against the width of the page
    sent = sized.where("x IS NULL").withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    got = sent.groupBy("image_id", (F.col("y") + F.col("_d")).alias("y"), "class_id", "height", "width").agg(
        (3 * F.count(F.lit(1))).alias("k"), F.max(F.when(F.col("_d") == 0, F.col("v"))).alias("v"))
    rows = F.least(F.col("y") + 1, F.col("height") - 1) - F.greatest(F.col("y") - 1, F.lit(0)) + 1
    loose = got.where(F.col("v").isNotNull() & (F.col("k") < rows * F.col("width"))).select("image_id", "y", F.lit(None).cast(dict(cells.dtypes)["x"]).alias("x"), "class_id", "v")
    return placed.unionByName(loose)


def erode(cells: DataFrame, images: DataFrame) -> DataFrame:
    """Set cells that keep all their neighbours."""
    return cells.where("v > 0").join(border(cells, images).select(*CELL), CELL, "left_anti")


def local_variance(cells: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Box mean of squares minus squared box mean in a k x k window, edges mirrored.

    A cell near an edge also stands at its mirror images. Pixels no cell reaches
    have variance 0 and no row.
    """
    offsets = [k // 2 - j for j in range(k)]

    def work(y, x, values, y0, x0, height, width):
        rows, columns, top, left, shape = _frame(y, x, y0, x0, height, width, k)
        some = np.zeros((2, *shape), np.int64)
        sums = np.zeros((2, *shape))
        v = values[0]
        known = ~np.isnan(v)
        for at_y in (y, -1 - y, 2 * height - 1 - y):
            for at_x in (x, -1 - x, 2 * width - 1 - x):
                near = _inside(at_y, at_x, top, left, shape)
                place = at_y[near] - top, at_x[near] - left
                full = near & known
                filled = at_y[full] - top, at_x[full] - left
                np.add.at(some[0], place, 1)
                np.add.at(some[1], filled, 1)
                np.add.at(sums[0], filled, v[full])
                np.add.at(sums[1], filled, v[full] * v[full])
        reached, filled, mean, square = (_box(a, offsets, np.add)[rows, columns] for a in (*some, *sums))
        y, x = np.nonzero(reached)
        mean, square = mean[y, x] / (k * k), square[y, x] / (k * k)
        return {"y": y + top + k, "x": x + left + k, "v": np.ma.array(square - mean * mean, mask=filled[y, x] == 0)}

    sized = attach_image(cells.select(*PIXEL, "v"), images, ["height", "width"])
    return tiled(sized, ["image_id"], k, work, f"{_places(cells)}, v double").select(*PIXEL, "v")


def profile(cells: DataFrame, images: DataFrame, axis: str = "y") -> DataFrame:
    """Mean and population variance of each row (``y``) or column (``x``), empty pixels included."""
    length, count = ("width", "height") if axis == "y" else ("height", "width")
    lines = images.select("image_id", F.col(length).alias("n"), F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(axis))
    sums = cells.groupBy("image_id", axis).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    full = lines.join(sums, ["image_id", axis], "left").fillna(0e0, ["s", "s2"])
    mean = F.col("s") / F.col("n")
    return full.select("image_id", axis, mean.alias("mean"), (F.col("s2") / F.col("n") - mean * mean).alias("variance"))


def profile_variance(cells: DataFrame, images: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Variance of the column means around x times that of the row means around y, per point.

    Windows reach from ``radius`` before to ``radius - 1`` after, cut at the page;
    the last sample of a profile is in none.
    """
    out = points
    for axis, name in (("x", "var_x"), ("y", "var_y")):
        extent = images.select("image_id", F.col("width" if axis == "x" else "height").alias("_n"))
        prof = profile(cells, images, axis).join(extent, "image_id").where(F.col(axis) < F.col("_n") - 1)
        near = F.array(*[F.lit(d) for d in range(1 - radius, radius + 1)])
        sent = prof.select("image_id", F.explode(F.transform(near, lambda d: F.col(axis) + d)).alias(axis), "mean")
        var = sent.groupBy("image_id", axis).agg(F.var_pop("mean").alias(name))
        out = out.join(var, ["image_id", axis], "left")
    return out.withColumn("v", F.coalesce("var_x", F.lit(0e0)) * F.coalesce("var_y", F.lit(0e0)))


def distance_to(layer: DataFrame, queries: DataFrame, max_r: int, keys: list[str] = ("image_id",), cap: bool = True, side: int = SIDE) -> DataFrame:
    """Exact Euclidean distance from each query pixel to the nearest set pixel of its layer.

    With ``cap`` a query without a set pixel inside ``max_r`` gets ``max_r``; else it has no row. Down the columns, then along the rows of
    dense tiles with a halo of ``max_r``.
    """
    keys = list(keys)
    marks = layer.select(*keys, "y", "x", F.lit(True).alias("mark"))
    asked = queries.select(*keys, "y", "x").distinct().withColumn("mark", F.lit(False))

    def reach(rows: pd.DataFrame, y0: int, x0: int) -> pd.DataFrame:
        y, x, mark = rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0, rows["mark"].to_numpy()
        own = ~mark & (y >= 0) & (y < side) & (x >= 0) & (x < side)
        d2 = np.full(int(own.sum()), (max_r + 1) ** 2)
        if own.any() and mark.any():
            top, left = y.min(), x.min()
            dense = np.zeros((y.max() - top + 1, x.max() - left + 1), bool)
            dense[y[mark] - top, x[mark] - left] = True
            d2 = _nearest(dense, max_r)[y[own] - top, x[own] - left]
        near = d2 <= max_r * max_r
        out = pd.DataFrame({"y": y[own] + y0, "x": x[own] + x0, "d": np.where(near, np.sqrt(d2), float(max_r))})
        return out if cap else out[near]

    kinds = dict(queries.dtypes)
    return _tiled(marks.unionByName(asked), keys, max_r, side, reach, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "y", "x")) + ", d double").select(*keys, "y", "x", "d")


def distance_to_empty(layer: DataFrame, images: DataFrame, max_r: int, keys: list[str] = ("image_id",), side: int = SIDE) -> DataFrame:
    """Exact distance from each set pixel to the nearest empty pixel of the page; pixels farther than ``max_r`` get ``max_r``."""
    keys = list(keys)
    sized = attach_image(layer.select(*keys, "y", "x").distinct(), images, ["height", "width"])

    def depth(y, x, values, y0, x0, height, width):
        y, x = y - y0, x - x0
        # the part of the page within reach of the tile
        top, left = max(-max_r, -y0), max(-max_r, -x0)
        low, right = min(side + max_r, height - y0), min(side + max_r, width - x0)
        empty = np.ones((low - top, right - left), bool)
        on_page = _inside(y, x, top, left, empty.shape)
        empty[y[on_page] - top, x[on_page] - left] = False
        own = on_page & _inside(y, x, 0, 0, (side, side))
        d2 = _nearest(empty, max_r)[y[own] - top, x[own] - left]
        return {"y": y[own] + y0, "x": x[own] + x0, "d": np.minimum(np.sqrt(d2), float(max_r))}

    return tiled(sized, keys, max_r, depth, f"{_places(layer)}, d double", (), side).select(*keys, "y", "x", "d")


def page_pixels(images: DataFrame) -> DataFrame:
    """All pixels of all pages (rows first, so a page spreads before it grows)."""
    rows = images.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def _per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows one by one, as they may be wide."""
    return (batch.slice(at, 1) for batch in batches for at in range(batch.num_rows))


def distance_lines(layer: DataFrame, images: DataFrame, block: int = 32) -> DataFrame:
    """Squared distances to the nearest set pixel as ``(image_id, y, d2)``, a list per pixel row of the page; pages without set pixels have none.

    A column's set rows give the distances down it; they go on as lists of
    ``block`` rows, meet the other columns of these rows, and the lower envelope
    of the columns' parabolas gives all distances along a row. No row per pixel
    is ever shuffled.
    """
    sizes = images.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    columns = layer.where("y IS NOT NULL").groupBy("image_id", "x").agg(F.sort_array(F.collect_set("y")).alias("ys")).join(sizes, "image_id")
    inside = columns.where("x >= 0 AND x < width")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _per_row(batches):
            ys, height = row.column("ys").values.to_numpy()[row.column("ys").offsets[0].as_py() : row.column("ys").offsets[1].as_py()].astype(np.int64), row.column("height")[0].as_py()
            y = np.arange(height)
            at = np.searchsorted(ys, y)
            gap = np.minimum(np.abs(ys[np.maximum(at - 1, 0)] - y), np.abs(ys[np.minimum(at, len(ys) - 1)] - y)).astype(np.int32)
            starts = range(0, height, block)
            same = lambda c: pa.array([row.column(c)[0].as_py()] * len(starts), row.column(c).type)
            yield pa.RecordBatch.from_arrays(
                [same("image_id"), same("x"), same("width"), pa.array(starts, pa.int32()), pa.array([gap[s : s + block] for s in starts], pa.list_(pa.int32()))],
                names=["image_id", "x", "width", "y0", "gap"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _per_row(batches):
            parts, width, y0 = row.column("parts")[0].as_py(), row.column("width")[0].as_py(), row.column("y0")[0].as_py()
            squares = np.full((len(parts[0]["gap"]), width), -1, np.int64)
            for part in parts:
                squares[:, part["x"]] = np.square(part["gap"], dtype=np.int64)
            if width <= NARROW:
                k = [part["x"] for part in parts]
                best = (squares[:, None, k] + (np.arange(width)[:, None] - np.array(k)) ** 2).min(axis=2)
            else:
                best = [nearest_in_row(line) for line in squares]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.column("image_id")[0].as_py()] * len(best), row.column("image_id").type), pa.array(range(y0, y0 + len(best)), pa.int32()), pa.array(list(best), pa.list_(pa.int64()))],
                names=["image_id", "y", "d2"])

    kinds = dict(layer.dtypes)
    gaps = inside.select("image_id", F.col("x").cast("int").alias("x"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "ys").mapInArrow(
        down, f"image_id {kinds['image_id']}, x int, width int, y0 int, gap array<int>")
    blocks = gaps.groupBy("image_id", "y0").agg(F.first("width").alias("width"), F.collect_list(F.struct("x", "gap")).alias("parts"))
    return blocks.mapInArrow(along, f"image_id {kinds['image_id']}, y int, d2 array<bigint>").withColumn("y", F.col("y").cast(kinds["y"]))


def distance_map(layer: DataFrame, images: DataFrame, block: int = 32) -> DataFrame:
    """Exact distance of every pixel of the page to the nearest set pixel, any radius, from :func:`distance_lines`."""
    rows = distance_lines(layer, images, block).select("image_id", "y", F.posexplode("d2").alias("x", "d2"))
    return rows.select("image_id", "y", "x", F.sqrt(F.col("d2").cast("double")).alias("d"))


def nearest_in_row(squares: np.ndarray) -> np.ndarray:
    """``min over k of (x - k)**2 + squares[k]`` for every x, in linear time; squares below 0 stand for no mark, and one must be there.

    Each column spans a parabola. The lowest ones, from left to right, are kept on a stack with the whole number from which each is lowest.
    """
    columns = np.flatnonzero(squares >= 0)
    value = (squares[columns] + columns * columns).tolist()
    place = columns.tolist()
    stack, since = [0], [0]
    for k in range(1, len(place)):
        while stack:
            j = stack[-1]
            # From here on parabola k is no higher than j.
            at = -((value[j] - value[k]) // (2 * (place[k] - place[j])))
            if at > since[-1]:
                break
            stack.pop()
            since.pop()
        at = at if stack else 0
        if at < len(squares):
            stack.append(k)
            since.append(at)
    ends = [*since[1:], len(squares)]
    lowest = columns[np.repeat(stack, [b - a for a, b in zip(since, ends)])]
    x = np.arange(len(squares))
    return (x - lowest) ** 2 + squares[lowest]
