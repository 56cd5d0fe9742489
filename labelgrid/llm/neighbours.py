"""Nearest neighbours by multi-index hashing of learned binary codes.

Fit, on a bounded sample of ``fit_rows`` vectors: principal axes, then the rotation that brings them closest to the corners of a cube
(iterative quantisation). A code is the sign of each rotated axis. ``radius`` is the Hamming distance within which ``reach`` of the true
neighbours lie, and it is measured as well: sample queries are compared with the whole sample.

Index, over all vectors, in blocks of about ``block_rows``: codes are split into bytes, and each byte position has its own table from the
256 values to the vectors that hold it. If two codes differ in at most ``radius = s * t + a`` of the bits of s substrings, then one of the
first a + 1 substrings differs in at most t bits, or one of the others in at most t - 1 (pigeonhole). Probing those values in every table
therefore retrieves every code within the radius; full codes are compared next, and original vectors last, in double precision.

A task reads the rows of its blocks sorted: the index block first, then the queries as they come, so it holds one block at a time. It
returns at most ``k`` rows per query and block, which a second small step merges.

The radius is one for all queries, so outliers and small clusters can have fewer than ``k`` codes within it. After the merge, queries whose
list is not full go through the blocks again with all bits, which compares them with every vector.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.shared import about, saved

FIT_ROWS = 20_000
SAMPLE_QUERIES = 256
REACH = 0.985
BLOCK_ROWS = 4096
K = 20
QUERY_ROWS = 256
BYTES = np.arange(256, dtype=np.uint8)
BITS_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and doubles of the vectors that take part: not null or zero, no null or non-finite component. Rows without vec_id take no part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("x", lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some)


class Codes:
    """The fitted rotation and radius."""

    def __init__(self, sample: np.ndarray, k: int = K, reach: float = REACH, rounds: int = 30):
        self.dim = sample.shape[1]
        self.bits = -(-self.dim // 8) * 8
        rng = np.random.default_rng(7)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(np.cov(centred.T).reshape(self.dim, self.dim) if len(sample) > 1 else np.eye(self.dim))
        flat = centred @ axes
        turn = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.axes = axes @ turn
        self.radius = self.bits
        codes, asked = self.encode(sample), sample[:SAMPLE_QUERIES]
        if len(sample) > 4 * k:
            scores = asked @ sample.T
            scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
            best = np.argpartition(-scores, k, axis=1)[:, :k]
            far = BITS_SET[codes[: len(asked), None, :] ^ codes[best]].sum(2)
            self.radius = int(np.quantile(far, reach, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the code of each row."""
        signs = np.zeros((len(x), self.bits), bool)
        signs[:, : self.dim] = (x - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1)


def probed(substrings: int, radius: int) -> np.ndarray:
    """Bits by which each substring may differ so that none within ``radius`` is missed; -1: that table needn't be probed."""
    t, a = divmod(radius, substrings)
    return np.array([t] * (a + 1) + [t - 1] * (substrings - a - 1))


def whole_words(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit numbers, filled up with zero bits."""
    out = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    out[:, : codes.shape[1]] = codes
    return out.view(np.uint64)


def search_block(model: Codes, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and the ids and scores of its k nearest in the block among the codes within the radius."""
    substrings = codes.shape[1]
    limits = probed(substrings, model.radius)
    all_bits = model.radius >= model.bits
    words = whole_words(codes)
    for at in range(0, len(queries), QUERY_ROWS):
        asked, own = queries[at : at + QUERY_ROWS], query_ids[at : at + QUERY_ROWS]
        query_codes = model.encode(asked)
        if all_bits:
            near_any = np.ones((len(asked), len(ids)), bool)
        else:
            # Each table gives, for a value, the vectors whose byte is within the limit of it, one bit a vector.
            seen = np.zeros((len(asked), -(-len(ids) // 8)), np.uint8)
            for j in np.flatnonzero(limits >= 0):
                values, of = np.unique(query_codes[:, j], return_inverse=True)
                seen |= np.packbits((BITS_SET[values[:, None] ^ BYTES] <= limits[j])[:, codes[:, j]], axis=1)[of]
            near_any = np.unpackbits(seen, axis=1, count=len(ids)).view(bool)
        far = np.zeros(near_any.shape, np.int64 if words.shape[1] > 1 else np.uint8)
        for own_words, query_words in zip(words.T, whole_words(query_codes).T, strict=True):
            far += np.bitwise_count(own_words ^ query_words[:, None])
        near_any &= (far <= model.radius) & (ids != own[:, None])
        for i in range(len(asked)):
            near = np.flatnonzero(near_any[i])
            scores = x[near] @ asked[i]
            if len(near) > k:  # ties at the last place are kept until ids decide
                near, scores = near[keep := scores >= np.partition(scores, -k)[-k]], scores[keep]
            best = np.lexsort((ids[near], -scores))[:k]
            yield own[i], ids[near[best]], scores[best]


def search(vectors: DataFrame, query_filter: str = "vec_id % 20 = 0", k: int = K, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row that fits ``query_filter`` its nearest other rows by inner product.

    Nearest first, ties to the smaller vec_id. Vectors of another dimension than most of the sample take no part. Fewer than ``k``
    candidates give fewer ranks; an empty table, or one without usable rows, gives an empty result. Rows that repeat a vec_id count as one
    candidate or query (one of them, of the largest vector in array order). Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors).groupBy("vec_id").agg(F.max("x").alias("x"))
    good = saved(good, "vectors")
    shape = "query_id long, rank int, vec_id long, score double"
    sample = about(good, fit_rows, "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()
    if sample.empty:
        return spark.createDataFrame([], shape)
    dim = int(sample["x"].map(len).mode()[0])
    model = Codes(np.stack([x for x in sample["x"] if len(x) == dim]), k)
    good = good.where(F.size("x") == dim)
    total = good.count()
    blocks = max(1, -(-total // block_rows))
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block."""
        held: dict[int, list] = {}
        for batch in batches:
            ids, of = batch.column("vec_id").to_numpy(), batch.column("block").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            for b in np.unique(of):
                held.setdefault(int(b), []).append((ids[of == b], x[of == b]))
        for b, parts in held.items():
            ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "rows"])

    # Rows are dealt by a hash of vec_id, so blocks are even whatever the data hold.
    dealt = good.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).repartition("block")
    index = dealt.mapInArrow(gather, "block int, ids binary, rows binary").withColumns({"kind": F.lit(0), "vec_id": F.lit(None).cast("long"), "x": F.lit(None).cast("array<double>")})
    queries = good.where(query_filter)
    spread = lambda some: some.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1), "ids": F.lit(None).cast("binary"), "rows": F.lit(None).cast("binary")})

    def find(model: Codes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = np.unique(np.concatenate([[0, len(kinds)], np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 0) + 1]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if kinds[a] == 0:
                    ids = np.frombuffer(batch.column("ids")[a].as_py(), np.int64)
                    x = np.frombuffer(batch.column("rows")[a].as_py()).reshape(-1, dim)
                    block = (ids, x, model.encode(x))
                    continue
                part = batch.slice(a, b - a)
                found = list(search_block(model, *block, part.column("vec_id").to_numpy(), part.column("x").flatten().to_numpy().reshape(-1, dim), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(asked: DataFrame, radius: int) -> DataFrame:
        own = copy.copy(model)
        own.radius = radius
        meeting = index.unionByName(spread(asked)).repartition("block").sortWithinPartitions("block", "kind")
        near = meeting.select("kind", "ids", "rows", "vec_id", "x").mapInArrow(lambda batches: find(own, batches), "query_id long, vec_id long, score double")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = nearest(queries, model.radius)
    if model.radius >= model.bits:
        return found
    found = saved(found, "near")
    full = found.where(F.col("rank") == min(k, total - 1)).select("query_id")
    short = saved(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(nearest(short, model.bits)).select("query_id", "rank", "vec_id", "score")
