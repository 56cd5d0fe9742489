"""Token-id files with keyed access through a minimal perfect hash.

Files: one shard a file, in ascending doc_id order (nulls first). A shard is a header, the keys, the lengths, and the raw id payload:

    8 bytes magic, then little-endian 64-bit: partition, number in the partition, documents, ids, bytes an id (2 or 4)
    documents x 64-bit key, documents x 8-bit "key is null", documents x 64-bit length, ids x 2 or 4 bytes

Spark's own committer writes them (a text sink passes bytes through; each file ends in one line break), so any store that Spark knows
will do and a lost executor leaves nothing behind. Reading back uses the binaryFile source.

Index: keys are dealt into buckets by hash, each bucket holds a minimal perfect hash over its keys, built level by level: keys that meet at
no other key's position of a bit array stay there, the others go on to the next level, and the number of set bits before a key's bit is
its slot. Per slot stand a fingerprint, shard, payload offset, length and the number of rows with that key. A lookup reads one bucket, a
few bits and one slot, whatever the number of documents. ``fetch`` groups the places found by shard and cuts the ids out of its payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelgrid.llm.encode import encoder, forget_encoders, vocabulary
from labelgrid.llm.shared import saved, shared_folder, shuffles_cleaned
from labelgrid.llm.words import U64, mix, pieces

MAGIC = b"LGTOKEN1"
HEADER = "<8s5q"
END_ID = 2
SHARD_IDS = 1 << 22
BATCH_BYTES = 2 << 20
BUCKET_KEYS = 1 << 11
GAMMA = 2.0


def shard_bytes(part: int, number: int, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    head = struct.pack(HEADER, MAGIC, part, number, len(keys), len(ids), id_bytes)
    return b"".join([head, keys.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<i8").tobytes(), ids.astype(f"<u{id_bytes}").tobytes()])


def head_bytes(docs: int) -> int:
    """Bytes of a shard before its payload."""
    return struct.calcsize(HEADER) + 17 * docs


def read_head(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Partition, number, keys, null flags, lengths."""
    magic, part, number, docs, _, _ = struct.unpack_from(HEADER, raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, found = struct.calcsize(HEADER), []
    for kind in ("<i8", "u1", "<i8"):
        found.append(np.frombuffer(raw, kind, docs, at))
        at += found[-1].nbytes
    return part, number, *found


def write_token_files(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = END_ID, id_bytes: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every row's whole text (null: empty), append ``end_id`` and write shards of about ``shard_ids`` ids in ascending doc_id order.

    Rows of equal doc_id stand next to each other, ordered by text; a document is never split over shards.
    """

    def shards(encode, batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        number = 0

        def out() -> pa.RecordBatch:
            keys, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(part, number, keys, nulls, lengths, ids, id_bytes)], pa.binary())], names=["shard"])

        size = 0
        for batch in pieces(batches, "text", min(BATCH_BYTES, 2 * shard_ids)):
            ids, offsets = encode(batch.column("text"))
            keys = batch.column("doc_id")
            held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), ids))
            size += len(ids)
            if size >= shard_ids:
                yield out()
                held, size, number = [], 0, number + 1
        if held:
            yield out()

    def written(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from shards(encoder(vocabulary_file, end_id), batches)
        finally:
            forget_encoders()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    # Few rows in a batch, so that a shard's share of long texts in memory stays small.
    lines = ordered.mapInArrow(written, "shard binary").select(F.col("shard").cast("string").alias("value"))
    with shuffles_cleaned(docs.sparkSession):
        lines.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """part, number, docs and content of every shard; the numbers are read from the header on the JVM."""

    def number(k: int) -> Column:
        """The k-th number after the magic bytes, little-endian."""
        digits = F.hex(F.substring("content", 9 + 8 * k, 8))
        return F.conv(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))), 16, 10).cast("long")

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(number(0).alias("part"), number(1).alias("number"), number(2).alias("docs"), "content")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the heads of the shards, nothing shuffled: part, number, place (ids before it in the shard), doc_id, n_tokens."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("head"):
                part, number, keys, nulls, lengths = read_head(raw.as_py())
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(np.cumsum(lengths) - lengths), pa.array(keys, mask=nulls.astype(bool)), pa.array(lengths)], names=["part", "number", "place", "doc_id", "n_tokens"]
                )

    head = F.expr(f"substring(content, 1, CAST({head_bytes(0)} + 17 * docs AS INT))")
    return shard_files(spark, path).select(head.alias("head")).mapInArrow(rows, "part long, number long, place long, doc_id long, n_tokens long")


def fetch(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of documents at known ``places`` (doc_id, start, part, number, place, n_tokens).

    Places meet their shard, and only the ids asked for are cut out of its payload. ``doc_id`` and ``start`` are passed on.
    """
    asked = places.groupBy("part", "number").agg(F.collect_list(F.struct("doc_id", "start", "place", "n_tokens")).alias("asked"))
    kinds = "doc_id long, start long, ids binary"

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, wanted = batch.column("content")[k].as_buffer(), batch.column("asked").slice(k, 1).flatten()
                _, _, _, docs, ids, id_bytes = struct.unpack_from(HEADER, raw)
                payload = np.frombuffer(raw, f"<u{id_bytes}", ids, head_bytes(docs))
                ends = (wanted.field(c).to_numpy() for c in ("place", "n_tokens"))
                cuts = [payload[a : a + n].astype("<u4").tobytes() for a, n in zip(*(x.tolist() for x in ends), strict=True)]
                yield pa.RecordBatch.from_arrays([wanted.field("doc_id"), wanted.field("start"), pa.array(cuts, pa.binary())], names=["doc_id", "start", "ids"])

    return shard_files(spark, path).select("part", "number", "content").join(asked, ["part", "number"]).select("content", "asked").mapInArrow(cut, kinds)


def key_hashes(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (key_hashes(keys, 1 << 20) >> U64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels for distinct keys, and the slot of every key."""
    levels, left = [], np.arange(len(keys))
    place = np.zeros(len(keys), np.int64)
    before = 0
    while len(left):
        bits = max(8, int(GAMMA * len(left)))
        at = (key_hashes(keys[left], len(levels)) % U64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        own = alone[at]
        rank = np.cumsum(alone) - alone
        place[left[own]] = before + rank[at[own]]
        levels.append(alone)
        before += int(alone.sum())
        left = left[~own]
    return levels, place


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has its bit (such a key is not in the index)."""
    found, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        at = (key_hashes(keys[left], k) % U64(len(bits))).astype(np.int64)
        hit = bits[at]
        rank = np.cumsum(bits) - bits
        found[left[hit]] = before + rank[at[hit]]
        before += int(bits.sum())
        left = left[~hit]
    return found


def bucket_of(buckets: int, column: str = "doc_id"):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def build_index(rows: DataFrame, keys: int) -> DataFrame:
    """Index rows (bucket, buckets, blob) over the documents of ``read_token_files``; ``keys`` is about their number. Null keys are left out."""
    buckets = max(1, -(-keys // BUCKET_KEYS))
    first = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("part", "number", "place", "n_tokens")).alias("at"), F.count(F.lit(1)).alias("copies"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["doc_id"].to_numpy()
        levels, place = build_hash(keys)
        order = np.argsort(place)
        parts = [np.array([len(keys), len(levels), *map(len, levels)], "<i8").tobytes(), *(np.packbits(x).tobytes() for x in levels), fingerprints(keys)[order].astype("<u4").tobytes()]
        parts += [group[c].to_numpy()[order].astype("<i8").tobytes() for c in ("part", "number", "place", "n_tokens", "copies")]
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "buckets": [buckets], "blob": [b"".join(parts)]})

    entries = first.select(bucket_of(buckets).alias("bucket"), "doc_id", "at.*", "copies")
    return entries.groupBy("bucket").applyInPandas(build, "bucket int, buckets int, blob binary")


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, found, and where found part, number, place, n_tokens, copies, for every row of ``keys`` (doc_id). A null key is not found.

    The number of buckets is read from the index; rows that disagree about it are of several indexes, which is an error.
    """
    least, most = index.agg(F.min("buckets"), F.max("buckets")).first()
    if least != most:
        raise ValueError(f"index rows of several indexes: {least} and {most} buckets")
    buckets = most or 1

    def parse(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        n, count = np.frombuffer(blob, "<i8", 2)
        sizes, at, levels = np.frombuffer(blob, "<i8", count, 16), 16 + 8 * int(count), []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        marks = np.frombuffer(blob, "<u4", n, at)
        at += 4 * int(n)
        return levels, marks, [np.frombuffer(blob, "<i8", n, at + 8 * int(n) * k) for k in range(5)]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, parsed = None, None
        for batch in batches:
            for bucket, group in batch.groupby("bucket", sort=False):
                if bucket != last:
                    blob = next((b for b in group["blob"] if b is not None), None)
                    last, parsed = bucket, blob and parse(blob)
                wanted = group["doc_id"].to_numpy(np.int64)
                if parsed is None:
                    yield pd.DataFrame({"doc_id": wanted, "found": False} | dict.fromkeys(("part", "number", "place", "n_tokens", "copies")))
                    continue
                levels, marks, values = parsed
                slot = slots(levels, wanted)
                ok = slot >= 0
                ok[ok] = marks[slot[ok]] == fingerprints(wanted[ok])
                data = {"doc_id": wanted, "found": ok}
                for name, column in zip(("part", "number", "place", "n_tokens", "copies"), values, strict=True):
                    data[name] = pd.array(np.where(ok, column[np.maximum(slot, 0)], 0), dtype="Int64")
                    data[name][~ok] = pd.NA
                yield pd.DataFrame(data)

    asked = keys.where("doc_id IS NOT NULL").select("doc_id", bucket_of(buckets).alias("bucket"))
    # The blob stands once beside each bucket's keys: they are gathered into blocks first.
    blocks = asked.groupBy("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("block")).agg(F.collect_list("doc_id").alias("ids"))
    joined = blocks.join(index.select("bucket", "blob"), "bucket", "left")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, ids, blob in zip(batch["bucket"], batch["ids"], batch["blob"], strict=True):
                yield from find(iter([pd.DataFrame({"doc_id": np.asarray(ids, np.int64), "bucket": bucket, "blob": [blob] * len(ids)})]))

    return joined.mapInPandas(unfold, "doc_id long, found boolean, part long, number long, place long, n_tokens long, copies long")


def shard_starts(rows: DataFrame) -> DataFrame:
    """part, number and base: ids of all shards before, from sums over shards (never over documents) in two levels: within a partition, then over partitions."""
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    inside = sizes.withColumn("inside", F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids"))
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return inside.join(before, "part").select("part", "number", (F.col("inside") + F.col("before")).alias("base"))


def with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``start``: ids of all documents before. ``shards``: the result of ``shard_starts``, a row a shard."""
    return rows.join(shards, ["part", "number"]).withColumn("start", F.col("base") + F.col("place")).drop("base")


def token_digest(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Write ``docs`` as token files, index them, and read every document back through the index: doc_id, start, n_tokens, ids_crc32.

    Each key is looked up and its ids are cut out of the shard at the place that the index gives. Where the index says that a key has more
    rows, they are cut out likewise, at places from the heads of the files, and so are rows without a key, which no index can hold.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_token_files(docs, path, vocabulary_file)
    rows = saved(read_token_files(spark, path), "token-rows")
    shards = saved(shard_starts(rows), "token-shards")
    index = saved(build_index(rows, max(1, rows.count())), "token-index")
    places = saved(look_up(index, docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()), "token-places").where("found")
    at = ["part", "number", "place"]
    again = rows.join(places.where("copies > 1").select("doc_id", *(F.col(c).alias(f"first_{c}") for c in at)), "doc_id").where("struct(part, number, place) <> struct(first_part, first_number, first_place)")
    wanted = ["doc_id", *at, "n_tokens"]
    every = places.select(wanted).unionByName(again.select(wanted)).unionByName(rows.where("doc_id IS NULL").select(wanted))
    found = fetch(spark, path, with_starts(every, shards))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def byte_vocabulary() -> str:
    return vocabulary("byte_bpe_50k.json")
