"""Sums over pages that are delivered again: the newest version of a page replaces what earlier ones added.

A stream row is a whole page, ``(image_id, version, ...)``. A micro-batch keeps the newest row of each page, drops it if a newer version is
already counted, and writes three parts of its own, each overwritten if the batch is repeated:

* ``versions``: image_id and version of the pages it counts,
* ``sums``: their sums by page and key,
* ``deltas``: these sums less those of the versions they replace, added up by key.

Totals are the sum of deltas; sums of whole numbers are exact, others carry rounding errors of the order of one addition a delivery. Every
``compact`` batches the newest versions, their sums and the total are written as a base that stands for all parts up to it, so a
batch reads at most the base and ``compact`` small parts. Batches may hold pages in any order of versions; the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

PARTS = ("versions", "sums", "deltas")
COMPACT = 16


class PageSums:
    """``partial``: page rows to sums ``(image_id, *keys, *values)``; ``values`` add up, ``keys`` name the totals."""

    def __init__(self, spark: SparkSession, path: str, partial: Callable[[DataFrame], DataFrame], keys: list[str], pages: DataFrame, compact: int = COMPACT):
        self.spark, self.path, self.partial, self.keys, self.compact = spark, path, partial, keys, compact
        sums = partial(pages.limit(0)).schema
        self.values = [f.name for f in sums if f.name not in ("image_id", *keys)]
        batch = StructField("batch_id", LongType())
        version = StructField("version", pages.schema["version"].dataType)
        self.schemas = {
            "versions": StructType([sums["image_id"], version, batch]),
            "sums": StructType([*sums.fields, version, batch]),
            "deltas": StructType([f for f in sums if f.name != "image_id"] + [batch]),
        }
        for kind in PARTS:
            for place in ("part", "base"):
                nothing = spark.createDataFrame([], StructType(self.schemas[kind].fields[:-1]))
                nothing.write.mode("overwrite").parquet(f"{path}/{place}/{kind}/batch_id=-1")

    def read(self, kind: str, before: int, bases: int | None = None) -> DataFrame:
        """The newest base from batches before ``bases`` (by default ``before``) and the parts since, from batches before ``before``."""
        bases = before if bases is None else bases
        stored = lambda place, kind, limit: self.spark.read.schema(self.schemas[kind]).parquet(f"{self.path}/{place}/{kind}").where(F.col("batch_id") < limit)
        upto = stored("base", "versions", bases).agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
        return stored("base", kind, bases).where(F.col("batch_id") == upto).unionByName(stored("part", kind, before).where(F.col("batch_id") > upto))

    def newest(self, before: int, bases: int | None = None) -> DataFrame:
        return self.read("versions", before, bases).groupBy("image_id").agg(F.max("version").alias("version"))

    def added(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in self.values))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        out = lambda df, kind, place="part": df.select(self.schemas[kind].names[:-1]).write.mode("overwrite").parquet(f"{self.path}/{place}/{kind}/batch_id={batch_id}")
        own = lambda kind: self.spark.read.schema(StructType(self.schemas[kind].fields[:-1])).parquet(f"{self.path}/part/{kind}/batch_id={batch_id}")
        pages = batch.groupBy("image_id").agg(F.max_by(F.struct(*(c for c in batch.columns if c != "image_id")), "version").alias("p")).select("image_id", "p.*")
        counted = self.newest(batch_id).withColumnRenamed("version", "counted")
        fresh = pages.join(counted, "image_id", "left").where("counted IS NULL OR counted < version").drop("counted")
        out(fresh, "versions")
        fresh = fresh.join(own("versions"), ["image_id", "version"], "left_semi")
        out(self.partial(fresh.drop("version")).join(own("versions"), "image_id"), "sums")
        replaced = counted.join(own("versions").select("image_id"), "image_id", "left_semi").withColumnRenamed("counted", "version")
        old = self.read("sums", batch_id).join(replaced, ["image_id", "version"])
        negative = old.select(*self.keys, *((-F.col(v)).alias(v) for v in self.values))
        out(self.added(own("sums").select(*self.keys, *self.values).unionByName(negative), self.keys), "deltas")
        if (batch_id + 1) % self.compact == 0:
            # A repeated batch writes its base anew, so it doesn't read it.
            span = (batch_id + 1, batch_id)
            newest = self.newest(*span)
            out(self.added(self.read("deltas", *span), self.keys), "deltas", "base")
            out(self.read("sums", *span).join(newest, ["image_id", "version"]), "sums", "base")
            # Written last: a base counts from the moment its versions are there.
            out(newest, "versions", "base")

    def total(self) -> DataFrame:
        """Current totals by key; keys whose pages were all replaced by pages without them stay with zeros."""
        return self.added(self.read("deltas", 1 << 62), self.keys)

    def by_page(self) -> DataFrame:
        """Current sums by page and key."""
        return self.read("sums", 1 << 62).join(self.newest(1 << 62), ["image_id", "version"]).select("image_id", *self.keys, *self.values)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Count what the stream holds, until it is drained."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
