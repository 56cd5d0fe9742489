"""Packing by powers of two: documents are cut into binary-length pieces, each a sequence of its own.

A document of L ids gives L // max_length pieces of full length and one piece for each further binary digit of L, longest first. No
sequence crosses documents and none needs padding. Pieces of one length form a bucket: the exponent leads the sequence id, so sorting by
it, or writing with ``write_buckets``, puts equal lengths together. Pieces leave in the task that encodes them; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.encode import encoder, forget_encoders, vocabulary
from labelgrid.llm.words import pieces

END_ID = 2
MAX_LENGTH = 4096
BATCH_BYTES = 1 << 19
#: Fewer pieces kept than elsewhere: other stages of a pipeline hold memory beside this one.
KEEP = 400_000


def binary_pieces(total: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids."""
    full, rest = divmod(total, max_length)
    return [max_length] * full + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary_file: str, end_id: int = END_ID, max_length: int = MAX_LENGTH) -> DataFrame:
    """Pieces of every row's whole text: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    A null or empty text is one piece that holds the end id. A null doc_id is passed on as null. Repeated rows are packed each on its own.
    An empty table gives an empty result. Other columns of the input are ignored. ``max_length`` is a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def packed(encode, batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, offsets = encode(batch.column("text"))
            sizes = np.diff(offsets)
            lengths = [binary_pieces(n, max_length) for n in sizes.tolist()]
            row = np.repeat(np.arange(batch.num_rows), list(map(len, lengths)))
            length = np.fromiter(chain.from_iterable(lengths), np.int64, len(row))
            upto = np.concatenate([[0], np.cumsum(length)])
            ids = ids.astype("<u4", copy=False)
            for a in range(0, len(row), 20_000):
                picked, own = row[a : a + 20_000], length[a : a + 20_000]
                edges = upto[a : a + len(own) + 1]
                # Pieces stand one after another in the ids: no copy of each is made.
                cuts = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((4 * (edges - edges[0])).astype(np.int32)), pa.py_buffer(ids[edges[0] : edges[-1]])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(picked)), pa.array(edges[:-1] - offsets[picked]), pa.array(own), cuts, pa.array(sizes[picked])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    def cut(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from packed(encoder(vocabulary_file, end_id, KEEP), batches)
        finally:
            forget_encoders()

    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")
    # The exponent takes the bits above partition (25 bits) and row (33 bits).
    bucket = F.shiftleft(F.log2("length").cast("long"), 58)
    return cut_up.withColumn("sequence_id", bucket + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("length").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_vocabulary() -> str:
    return vocabulary("word_bpe_49k.json")
