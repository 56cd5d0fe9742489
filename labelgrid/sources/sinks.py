"""Writers. Tables are written clustered by page, so later scans prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.operators.align import lookup
from labelgrid.operators.pixels import cells_to_bitmask
from labelgrid.operators.vectors import argmax_cells


def layer_values(cells: DataFrame) -> DataFrame:
    """Scores as grey values 0..255."""
    return cells.select("image_id", "y", "x", "class_id", F.round(F.col("v") * 255).cast("int").alias("grey"))


def write_layers(cells: DataFrame, path: str) -> None:
    """One folder per class, files clustered by page range and sorted by row.

    A folder per page would mean millions of folders; page and row statistics of
    the sorted files prune the same way.
    """
    out = layer_values(cells).repartitionByRange("class_id", "image_id", "y").sortWithinPartitions("class_id", "image_id", "y", "x")
    out.write.mode("overwrite").partitionBy("class_id").parquet(path)


def write_indexed(cells: DataFrame, path: str, enum: bool = False) -> None:
    """One mask (or winning class) per pixel."""
    out = argmax_cells(cells) if enum else cells_to_bitmask(cells)
    out.repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(path)


def prediction_lines(coords: DataFrame, cells: DataFrame) -> DataFrame:
    """``x<TAB>y<TAB>class+1`` for each requested pixel; a ``pos`` column, the order of requests, is kept."""
    kept = ["image_id", "pos"] if "pos" in coords.columns else ["image_id"]
    return lookup(coords, argmax_cells(cells)).select(*kept, F.concat_ws("\t", "x", "y", F.col("class_id") + 1).alias("value"))


def write_predictions_txt(coords: DataFrame, cells: DataFrame, path: str) -> None:
    """Text lines ``image<TAB>x<TAB>y<TAB>class+1`` by image and order of request, in files of any number of images.

    Range partitions split a page with very many requests, and there is no folder per page.
    """
    lines = prediction_lines(coords, cells)
    order = ["image_id", "pos"] if "pos" in lines.columns else ["image_id", "value"]
    told = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws("\t", "image_id", "value").alias("value"))
    told.write.mode("overwrite").text(path)


def write_transcript(pages: DataFrame, path: str) -> None:
    """``page_id, text`` as JSON lines in page order: texts hold line breaks, and a folder per page would mean millions of folders."""
    pages.select("page_id", "text").repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").json(path)


PART_STEPS = 100_000


def history_json(history: DataFrame, metrics: list[str], part_steps: int = PART_STEPS) -> DataFrame:
    """Each metric of a run as one list in step order.

    A run longer than ``part_steps`` steps gives several documents, numbered by
    ``part``, so no task ever holds more than one part of it.
    """
    row = F.struct("step", *metrics)
    part = F.floor(F.col("step") / part_steps).alias("part")
    lists = history.groupBy("run_id", part).agg(F.sort_array(F.collect_list(row)).alias("h"))
    pick = lambda m: F.transform("h", lambda e: e[m]).alias(m)
    return lists.select("run_id", "part", F.to_json(F.struct(*[pick(m) for m in metrics])).alias("value"))


def write_run_history(history: DataFrame, metrics: list[str], path: str) -> None:
    history_json(history, metrics).write.mode("overwrite").partitionBy("run_id", "part").text(path)
