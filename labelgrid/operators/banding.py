"""Splitting hot groups: page bands, dense row numbers, blocked windows.

A page, a run or a class may hold a large share of all rows. Nothing here
sorts such a group in one task: groups are cut into blocks of bounded size, the
blocks are summarised, and only the summaries are scanned in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAND = 256
BLOCK = 1 << 16
BUCKETS = 1024
SMALL = 10_000


def small_side(df: DataFrame, max_rows: int = SMALL) -> DataFrame:
    """Mark a lookup table for broadcast if it is counted to be small; otherwise leave the join to Spark.

    Counting stops at the limit. Meant for class, threshold and character tables.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def attach_image(cells: DataFrame, images: DataFrame, cols: list[str], how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Add per-image columns to cells, joining on ``(image_id, band of y)``.

    The image side is repeated once per band of its own height, so a page with
    most of the rows spreads over as many keys as it has bands.
    """
    keys = ["image_id", *(by or [])]
    need = images.select(*keys, F.col("height").alias("_h"), *[F.col(c).alias(f"_att_{c}") for c in cols])
    banded = need.withColumn(
        "_band", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("_h") - 1) / BAND), F.lit(0)).cast("int")))
    ).drop("_h")
    out = cells.withColumn("_band", F.floor(F.col("y") / BAND).cast("int")).join(banded, [*keys, "_band"], how).drop("_band")
    return out.drop(*cols).withColumnsRenamed({f"_att_{c}": c for c in cols})


def row_index(df: DataFrame, keys: list[str], order: str, ties: list[str] = (), block: int = BLOCK, firsts: dict[str, Column] | None = None) -> DataFrame:
    """Dense 0-based position ``idx`` of each row inside its key, by ``order``.

    ``order`` is an integer column whose values are spread (a step, an id), so a
    block of ``block`` consecutive values holds a bounded number of rows. Counts
    per block are scanned in order, rows are numbered inside their block.
    ``firsts`` adds whole-key minima, e.g. the start time of a run.
    """
    firsts = firsts or {}
    df = df.withColumn("_blk", F.floor(F.col(order) / block))
    counts = df.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_m_{k}") for k, c in firsts.items()])
    run = W.partitionBy(*keys).orderBy("_blk")
    offsets = counts.select(
        *keys, "_blk",
        F.coalesce(F.sum("_n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *[F.min(f"_m_{k}").over(W.partitionBy(*keys)).alias(k) for k in firsts],
    )
    inside = W.partitionBy(*keys, "_blk").orderBy(order, *ties)
    return (
        df.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_blk"])
        .withColumn("idx", (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_blk", "_rn", "_off")
    )


def lookback_window(df: DataFrame, keys: list[str], lookback: int, columns: Callable[[W], dict[str, Column]], block: int = BLOCK, idx: str = "idx") -> DataFrame:
    """Window expressions that look at most ``lookback`` rows back, exactly.

    Rows are cut into blocks by their dense position; the last ``lookback`` rows
    of a block are repeated at the head of the next one and dropped afterwards.
    """
    own = F.floor(F.col(idx) / block)
    homes = F.when(F.col(idx) % block >= block - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_home", F.explode(homes))
    win = W.partitionBy(*keys, "_home").orderBy(idx)
    out = spread.withColumns(columns(win))
    return out.where(F.col("_home") == own).drop("_home")


def running_before(df: DataFrame, keys: list[str], value: str, name: str, agg: Callable[[Column], Column], block: int = BLOCK, idx: str = "idx") -> DataFrame:
    """``agg`` of ``value`` over all earlier rows of the key (NULL for the first).

    ``agg`` must merge with itself (sum, max, min): block results are combined
    in order and carried into the next blocks.
    """
    df = df.withColumn("_blk", F.floor(F.col(idx) / block))
    run = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, "_blk").agg(agg(F.col(value)).alias("_b"))
        .select(*keys, "_blk", agg(F.col("_b")).over(run).alias("_carry"))
    )
    inside = W.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    merged = F.array_compact(F.array("_carry", "_here"))
    out = df.withColumn("_here", agg(F.col(value)).over(inside)).join(carry, [*keys, "_blk"])
    if agg is F.sum:
        both = F.when(F.size(merged) > 0, F.coalesce("_carry", F.lit(0)) + F.coalesce("_here", F.lit(0)))
    else:
        both = F.array_max(merged) if agg is F.max else F.array_min(merged)
    return out.withColumn(name, both).drop("_blk", "_carry", "_here")


def shuffled_index(df: DataFrame, keys: list[str], u: str, ties: list[str], value: str | None = None) -> DataFrame:
    """Position of each row in the order of its uniform ``u``, per key (or overall).

    Adds ``idx`` and ``n`` (rows of the key) and, with ``value``, the sum over
    earlier rows as ``before``. Hash buckets bound every sort.
    """
    df = df.withColumn("_bkt", F.floor(F.col(u) * BUCKETS).cast("int"))
    sums = [F.sum(value).alias("_v")] if value else []
    counts = df.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"), *sums)
    whole = W.partitionBy(*keys)
    past = whole.orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    offs = counts.select(
        *keys, "_bkt", F.sum("_n").over(whole).alias("n"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_off"),
        *([F.coalesce(F.sum("_v").over(past), F.lit(0)).alias("_voff")] if value else []),
    )
    inside = W.partitionBy(*keys, "_bkt").orderBy(u, *ties)
    out = df.withColumn("_rn", F.row_number().over(inside) - 1)
    if value:
        out = out.withColumn("_vin", F.coalesce(F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(offs, [*keys, "_bkt"]).withColumn("idx", F.col("_rn") + F.col("_off"))
    if value:
        out = out.withColumn("before", F.col("_vin") + F.col("_voff"))
    return out.drop("_bkt", "_rn", "_off", "_vin", "_voff")


def merge_rows(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side: stacked and folded, no join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
