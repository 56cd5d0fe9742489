"""Dense arrays to sparse tables and back, for cross-checks with numpy."""

import numpy as np


def cells(spark, layers, image_id="i"):
    """Non-zero cells of an H x W x C array."""
    a = np.asarray(layers, dtype=float)
    rows = [(image_id, int(y), int(x), int(c), float(a[y, x, c])) for y, x, c in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "image_id string, y int, x int, class_id int, v double")


def images(spark, layers, image_id="i"):
    h, w, c = np.asarray(layers).shape
    return spark.createDataFrame([(image_id, h, w, c)], "image_id string, height int, width int, n_classes int")


def layer(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def stack(*layers):
    """C layers of H x W to H x W x C."""
    return np.stack([np.asarray(x, dtype=float) for x in layers], axis=2)
