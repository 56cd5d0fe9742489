"""Tables written to the cluster's shared folder, so that lost executors cost no more than the tasks they ran."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Without that setting a single-machine session (tests) gets a temporary one; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="labelgrid-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks before it until no column of ``df`` is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


BATCHES, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

#: Shuffle files of a finished write serve nobody: with this setting Spark removes them at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries inside give the disk of their shuffle files back when they end."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the schema is passed on, so empty tables work too."""
    path = shared_folder(df.sparkSession, name)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def emptied(*tables: DataFrame) -> None:
    """Gives the disk of ``saved`` tables back once their last reader is written: each is overwritten with no rows. Other tables are left alone."""
    for df in tables:
        path = vars(df).get("saved_path")
        if path:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows can be whole texts: Arrow batches of Spark's default of 10,000 rows would hold tens of MB, several times over, in the JVM and in Python.
    A session that has this default is set to batches of ROWS rows."""
    if spark.conf.get(BATCHES) == "10000":
        spark.conf.set(BATCHES, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def about(df: DataFrame, most: int, *key: str) -> DataFrame:
    """A sample of at least ``most`` rows, some times as many on average, by a hash of ``key``; all rows of a small table.

    Put before ``orderBy().limit()`` of a sample, so that what tasks send for it does not grow with their number.
    """
    share = min(1.0, (4 * most + 1000) / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


MIN_BITS, MAX_BITS = 1 << 18, 1 << 27


def bit_filter(hashes: DataFrame, bits_each: int = 16) -> np.ndarray:
    """A bitmap of at most MAX_BITS bits in which every ``h`` of ``hashes`` is marked, for dropping early what a later join would drop.

    It errs to one side only: what is in ``hashes`` always passes, so more rows than the bitmap was made for cost time, not results.
    """
    bits = int(min(MAX_BITS, max(MIN_BITS, 1 << (bits_each * max(1, hashes.count()) - 1).bit_length())))
    slot = F.pmod(F.col("h"), F.lit(bits)) + 1
    parts = hashes.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, some in parts.collect():
        low = (part - 1) * 4096
        out[low : low + 4096] |= np.frombuffer(some, np.uint8)[: len(out) - low]
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64, copy=False) % (8 * len(bitmap))
    return bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
