"""Repeated passages by relative Lempel-Ziv parsing against blocks of all earlier documents.

Reference blocks: the windows (``WINDOW`` consecutive words) of a document are cut into blocks where the words themselves say so, so equal
passages are cut alike. A block's key is a 128-bit hash of all words that its windows touch. The index holds every block of every
document, each under the smallest doc_id that has it.

Parsing: a document is factored greedily. Where a block is indexed under a smaller doc_id the whole block is a factor. At the boundaries of
factors, that is in blocks that are first seen in their own document, single windows are checked, against all windows of all such
blocks: every other block equals one of them, so no window is missed. Adjacent factors run together; a run of r windows is r + WINDOW - 1
words, never less than WINDOW, and those words are the duplicate span.

Single windows are only written out where they can meet another: two equal windows share their minimiser (the smallest hash of ``GRAM`` words
in them), so windows whose minimiser occurs in one document alone are left out, by a bitmap that errs to the side of checking more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.shared import bit_filter, emptied, passes, saved
from labelgrid.llm.words import BASES, U64, Runs, flat, mix, pieces, windows, word_hashes, word_spans

WINDOW = 13
GRAM = 5
#: A block ends, on average, after so many windows: the top bits of the hash of the next GRAM words are all zero.
BLOCK_BITS = 5
SLICE_BYTES = 4 << 20
HOT, SALTS = 1000, 32


class Parsed:
    """Windows and blocks of a batch of documents (columns doc_id, text_key, text)."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        data, offsets = flat(batch.column("text"))
        starts, ends, self.firsts = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        self.window, self.gram = window, gram
        self.runs = [Runs(words, b) for b in BASES]
        self.at = windows(self.firsts, window)
        self.rows = np.searchsorted(self.firsts, self.at, "right") - 1
        self.places = self.at - self.firsts[self.rows]
        self.grams = self.runs[0].of(np.arange(max(0, len(words) - gram + 1)), np.arange(gram, len(words) + 1)) if len(words) >= gram else np.zeros(0, U64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.rows[1:] != self.rows[:-1]) | (self.grams[self.at[1:]] >> U64(64 - BLOCK_BITS) == 0)
        self.block_of = np.cumsum(new) - 1
        self.block_first = np.flatnonzero(new)
        self.block_size = np.diff(np.append(self.block_first, len(self.at)))
        low = self.at[self.block_first]
        self.keys = [r.of(low, low + self.block_size + window - 1).view(np.int64) for r in self.runs] if len(low) else [np.zeros(0, np.int64)] * 2
        doc = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64).view(U64)
        key = np.asarray(batch.column("text_key").to_numpy(zero_copy_only=False), np.int64).view(U64)
        self.doc_hash = mix(doc * U64(BASES[0]) + mix(key))
        rows = self.rows[self.block_first]
        self.block_id = mix(self.doc_hash[rows] + self.places[self.block_first].astype(U64) * U64(BASES[1])).view(np.int64)

    def minimisers(self) -> np.ndarray:
        """Smallest gram hash of each window."""
        least = self.grams[self.at]
        for k in range(1, self.window - self.gram + 1):
            least = np.minimum(least, self.grams[self.at + k])
        return least.view(np.int64)


def scan(docs: DataFrame, rows, schema: str, window: int, gram: int) -> DataFrame:
    """``rows(batch, parsed)`` over all documents that have a doc_id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            yield from rows(batch, Parsed(batch, window, gram))

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, schema)


def take(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    index = pa.array(rows)
    return [batch.column("doc_id").take(index), batch.column("text_key").take(index)]


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, start (word), size (windows), source: the factors found in smaller doc_ids. ``docs``: doc_id, text_key, text."""
    spark = docs.sparkSession

    def blocks(batch: pa.RecordBatch, p: Parsed) -> Iterator[pa.RecordBatch]:
        first = p.block_first
        yield pa.RecordBatch.from_arrays([*take(batch, p.rows[first]), pa.array(p.places[first]), pa.array(p.block_size), *map(pa.array, p.keys), pa.array(p.block_id)], names=["doc_id", "text_key", "start", "size", "k1", "k2", "h"])

    every = saved(scan(docs, blocks, "doc_id long, text_key long, start long, size long, k1 long, k2 long, h long", window, gram), "blocks")
    index = every.groupBy("k1", "k2").agg(F.min("doc_id").alias("source"))
    judged = saved(every.join(index, ["k1", "k2"]).select("doc_id", "text_key", "start", "size", "source", "h"), "judged")
    own = spark.sparkContext.broadcast(bit_filter(judged.where("doc_id = source").select("h")))

    def openings(batch: pa.RecordBatch, p: Parsed) -> Iterator[pa.RecordBatch]:
        least = p.minimisers()
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (p.block_of[1:] != p.block_of[:-1])
        new &= passes(own.value, p.block_id)[p.block_of]
        yield pa.RecordBatch.from_arrays([pa.array(least[new]), batch.column("doc_id").take(pa.array(p.rows[new]))], names=["h", "doc_id"])

    met = scan(docs, openings, "h long, doc_id long", window, gram).groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = spark.sparkContext.broadcast(bit_filter(saved(met.where("low <> high").select("h"), "minimisers"), 64))

    def singles(batch: pa.RecordBatch, p: Parsed) -> Iterator[pa.RecordBatch]:
        some = passes(own.value, p.block_id)[p.block_of]
        some[some] = passes(shared.value, p.minimisers()[some])
        at = p.at[some]
        w1, w2 = (r.of(at, at + window).view(np.int64) for r in p.runs) if len(at) else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([*take(batch, p.rows[some]), pa.array(p.places[some]), pa.array(w1), pa.array(w2)], names=["doc_id", "text_key", "start", "w1", "w2"])

    # Read twice rather than kept: hashing is cheap, and single windows are the largest rows of all.
    single = scan(docs, singles, "doc_id long, text_key long, start long, w1 long, w2 long", window, gram)
    earliest = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    earliest = saved(earliest.where("source < last").drop("last"), "repeated-windows")
    # Windows with more than a HOT-th of all repeats, HOT of them at most, meet their source in SALTS places.
    total = earliest.agg(F.sum("n")).first()[0] or 0
    hot = earliest.where(F.col("n") > total // HOT).select("w1", "w2", F.lit(SALTS).alias("salts"))
    salt = lambda rows, of: rows.join(F.broadcast(hot), ["w1", "w2"], "left").withColumn("salt", of(F.coalesce("salts", F.lit(1)))).drop("salts")
    dealt = salt(single, lambda n: F.pmod(F.xxhash64("doc_id", "start"), n.cast("long")).cast("int"))
    sources = salt(earliest.drop("n"), lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    again = dealt.join(sources, ["w1", "w2", "salt"]).where("doc_id > source").select("doc_id", "text_key", "start", F.lit(1).cast("long").alias("size"), "source")
    again = saved(again, "repeats")
    emptied(earliest)
    whole = judged.where("doc_id > source").select("doc_id", "text_key", "start", "size", "source")
    return whole.unionByName(again)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) and spans (start, words) of every row of ``docs``.

    A word goes if a window of words that covers it also starts in a document of smaller doc_id; windows are those of the input. Null and
    empty texts have no words. Texts shorter than a window lose nothing. Rows without doc_id, which have no place in the order, neither lose
    words nor make others lose any. Repeated rows each get a row, and don't count as earlier than each other. Empty tables give an empty
    result; other columns are ignored.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = factors(chosen, window, gram).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("found"))
    found = found.withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, some in zip(batch.column("text"), batch.column("found"), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if not some.is_valid:
                    kept.append(b" ".join(words).decode())
                    n_removed.append(0)
                    spans.append([])
                    continue
                start, size = (some.values.field(c).to_numpy() for c in ("start", "size"))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept.append(b" ".join(compress(words, ~gone)).decode())
                n_removed.append(int(gone.sum()))
                spans.append([{"start": a, "words": b - a} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, spans_kind)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    both = chosen.join(found, (F.col("doc_id") == F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").select("doc_id", "text", "found")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,words:long>>")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
