"""Embedding whitening by the covariance of distinct vectors, weighted by how often each occurs.

1. Entries become whole numbers x. Identical x vectors are grouped; a group's row count is its weight in the fit (or 1 if every distinct
   vector shall count once).
2. Weighted sums S and the weight n are exact whole numbers. In tasks, n * x - S is exact as well; divided by n it is the centred
   vector, and a weighted matrix product of centred vectors gives each task's part of the covariance. Parts are d x d numbers a task,
   added up by Spark.
3. The driver takes the eigenvectors of the d x d covariance. Each distinct vector is projected once, and joined back to its rows by a
   128-bit key of x. Vectors with more than a ``HOT``-th of all rows, at most ``HOT`` of them, are joined by broadcast, so no key holds more of a
   shuffle than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.shared import saved

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
HOT = 1000
#: Whole numbers stay within this bound, so that their products with small counts can't wrap; entries beyond are set to it.
LARGEST = 1 << 50


def usable(vector: Column) -> Column:
    """The vector is there and all of its entries are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Every entry c as floor(scale * c) + shift."""
    return F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(shift))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Parts (i, values) added up entry by entry, as rows i of a matrix. The result is one d x d matrix at most."""
    sums = parts.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, list] = {}
    for i, _, v in sums.orderBy("i", "j").collect():
        out.setdefault(i, []).append(v)
    return {i: np.array(v) for i, v in out.items()}


def moments(distinct: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """n and S over distinct vectors (x, weight), exactly."""

    def part(batches) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(size, np.int64), 0
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            sums += (matrix(batch.column("x"), size) * weight[:, None]).sum(0)
            n += int(weight.sum())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[n, *sums.tolist()]], pa.list_(pa.int64()))], names=["i", "values"])

    sums = added(distinct.select("x", "weight").mapInArrow(part, "i int, values array<bigint>"))[0]
    return int(sums[0]), sums[1:].astype(np.int64)


def covariance(distinct: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    size = len(sums)

    def part(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = (n * matrix(batch.column("x"), size) - sums) / n
            total += (centred * batch.column("weight").to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total / n), pa.list_(pa.float64()))], names=["i", "values"])

    rows = added(distinct.select("x", "weight").mapInArrow(part, "i int, values array<double>"))
    whole_matrix = np.stack([rows[i] for i in range(size)])
    return (whole_matrix + whole_matrix.T) / 2


def axes(spread: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit vectors (columns), ``most`` at the most, and which of them are above rounding errors."""
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    return values, vectors, values > max(0.0, values[0] if len(values) else 0.0) * len(spread) * 1e-14


def project(distinct: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, solid: np.ndarray) -> DataFrame:
    """key1, key2, weight, deviation and z (coordinates along the components, null where the eigenvalue is zero) of each distinct vector."""
    size = len(sums)
    along = vectors / np.sqrt(np.where(solid, values, 1.0))

    def part(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Whole numbers wrap at 2**64, which a sum that fits in 63 bits survives; one that doesn't is null.
            scaled = n * matrix(batch.column("x"), size) - sums
            deviation = (scaled * scaled).sum(1)
            large = (scaled.astype(np.float64) ** 2).sum(1) >= 2.0**63 * (1 - 1e-9)
            z = scaled / n @ along
            coordinates = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * len(values), pa.array(z.ravel(), mask=np.tile(~solid, len(z))))
            yield pa.RecordBatch.from_arrays([batch.column("key1"), batch.column("key2"), batch.column("weight"), pa.array(deviation, mask=large), coordinates], names=["key1", "key2", "weight", "deviation", "z"])

    return distinct.select("key1", "key2", "weight", "x").mapInArrow(part, "key1 long, key2 long, weight long, deviation long, z array<double>")


def identity_error(projected: DataFrame, n: int, solid: np.ndarray) -> float | None:
    """Largest entry, by size, of the covariance of the whitened vectors minus the identity."""
    use = np.flatnonzero(solid).tolist()
    if not use:
        return None
    z = {k: F.element_at("z", k + 1) for k in use}
    means = projected.agg(*(F.sum(z[k] * F.col("weight")).alias(f"m{k}") for k in use)).first()
    off = {k: z[k] - means[f"m{k}"] / n for k in use}
    sums = [F.abs(F.sum(off[a] * off[b] * F.col("weight")) / n - float(a == b)) for a in use for b in use if a <= b]
    return float(max(projected.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, once: bool = False) -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling eigenvalue, at most ``components``): key, component, n, deviation,
    whitened, explained, identity_error.

    Dropped are rows whose vector is null or holds null or non-finite entries, and rows whose vector isn't of the commonest length (ties: the
    longer). Entries of more than 2**50 by size count as 2**50. With ``once`` every distinct vector has weight 1 in the fit. Null and repeated keys keep their rows. Where an
    eigenvalue is zero, as with a single distinct vector or too few of them, ``whitened`` is null, and ``identity_error`` leaves that component out
    (null if none is left); ``explained`` is null if all are zero; ``deviation`` is null where it exceeds 63 bits. Without usable rows, or with
    empty vectors, the result is empty. Other columns are ignored.
    """
    spark, name = rows.sparkSession, rows.schema[key].dataType.simpleString()
    chosen = rows.select(F.col(key).alias("id"), F.col(vector).alias("c")).where(usable(F.col("c")))
    lengths = chosen.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = f"{key} {name}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None or lengths["size"] == 0:
        return spark.createDataFrame([], schema)
    size, total = lengths["size"], lengths["count"]
    x = chosen.where(F.size("c") == size).select("id", whole(F.col("c")).alias("x"))
    grouped = x.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.lit(1).cast("long") if once else F.col("copies")
    distinct = saved(grouped.select("x", "copies", weight.alias("weight"), *keys("x")), "vectors")
    n, sums = moments(distinct, size)
    spread = covariance(distinct, n, sums)
    values, vectors, solid = axes(spread, min(components, size))
    projected = saved(project(distinct, n, sums, values, vectors, solid), "whitened")
    error, trace = identity_error(projected, n, solid), float(np.trace(spread))
    explained = [float(v) / trace if trace > 0 else None for v in values]
    # Back to the rows. At most HOT vectors have more than a HOT-th of all rows each.
    hot = distinct.where(F.col("copies") > total // HOT).select("key1", "key2", F.lit(True).alias("hot"))
    named = x.select("id", *keys("x")).join(F.broadcast(hot), ["key1", "key2"], "left")
    points = projected.select("key1", "key2", "deviation", "z")
    few = points.join(F.broadcast(hot.select("key1", "key2")), ["key1", "key2"], "left_semi")
    back = named.where("hot").drop("hot").join(F.broadcast(few), ["key1", "key2"]).unionByName(named.where("hot IS NULL").drop("hot").join(points, ["key1", "key2"]))
    shares = F.array(*(F.lit(e).cast("double") for e in explained))
    return back.select("id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        F.col("id").alias(key),
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def keys(column: str) -> list[Column]:
    return [F.xxhash64(column).alias("key1"), F.xxhash64(F.lit(31), column).alias("key2")]
