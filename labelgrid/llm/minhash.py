"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Each text becomes its set of five-word shingles, a 128-bit hash of that set, and a signature of ``TREES * DEPTH`` minima. Texts of
   one set form a class (grouped by hash, pre-aggregated); only the smallest doc_id of a class goes on.
2. The signature is cut into ``TREES`` labels of ``DEPTH`` minima. For each tree all labels that share their first ``SHALLOW`` minima with
   another are sorted across the cluster (range partitions, so a hot region is spread like any other). Candidates are neighbours in this
   order whose longest common prefix is at least ``SHALLOW`` minima. In a region of at most ``NEAR + 1`` classes that is everyone; in a dense one it
   is the next in order, which shares the deepest prefix there is, in the first ``CHAINS`` trees. Rows at the seams of partitions are
   paired in a second small step. A byte of each minimum, kept once a class, gives every pair its estimate.
3. Candidates are confirmed on full sets, first the ``FIRST`` best of every class, then all that still lead from one component to another,
   so a family of n near copies costs some n confirmations rather than n * n.
4. The exact way for the rest: candidates are capped only in regions of more than ``NEAR + 1`` classes. Where such a region
   still holds more than one component, its classes are compared block by block: first by estimate, which only says which classes have a
   partner in another component, then those on their full sets, best estimates first. A block keeps a union-find of its own, skips what is
   connected already and passes on confirmed links, fewer than it has classes; lists of candidates are never made. Regions that
   became one component need nothing: further links in them change no component.

A pair at the threshold shares the shallow prefix of at least one tree with probability ``1 - (1 - 0.75**SHALLOW)**TREES``. Intermediate tables
are emptied as soon as their last reader is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.shared import bit_filter, emptied, passes, saved, unused
from labelgrid.llm.words import BASES, U64, Runs, flat, mix, pieces, windows, word_hashes, word_spans

SHINGLE = 5
SIMILAR = (75, 100)
TREES, DEPTH, SHALLOW, NEAR, CHAINS = 18, 7, 3, 4, 6
#: A block of a dense region has about so many classes and shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
FIRST = 3
SLICE_BYTES = 1 << 20
#: Estimates lower than the threshold by more than this many standard deviations of a signature of this length are not confirmed.
DEVIATIONS = 4.0


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and row offsets. A row of fewer words has its whole sequence as one."""
    data, offsets = flat(column)
    starts, ends, firsts = word_spans(data, offsets)
    runs = Runs(word_hashes(data, starts, ends, lower=True))
    n = np.diff(firsts)
    at, short = windows(firsts, size), np.flatnonzero((n > 0) & (n < size))
    low = np.concatenate([at, firsts[short]])
    high = np.concatenate([at + size, firsts[short + 1]])
    rows = np.concatenate([np.searchsorted(firsts, at, "right") - 1, short])
    hashes = runs.of(low, high) if len(low) else np.zeros(0, U64)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(n) + 1))


def signature_seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * count + 1, dtype=U64) * U64(BASES[1]))
    return base[:count] | U64(1), base[count:]


def signatures(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Minima of ``count`` random orders of each row's set, 32 bits each; rows without a set have zeros."""
    a, b = signature_seeds(count)
    out = np.zeros((len(bounds) - 1, count), np.uint32)
    for i in range(len(out)):
        x = hashes[bounds[i] : bounds[i + 1]]
        for at in range(0, len(x), 2048):  # in parts that stay in the processor's cache
            least = ((x[at : at + 2048, None] * a + b) >> U64(32)).min(0).astype(np.uint32)
            out[i] = np.minimum(out[i], least) if at else least
    return out


def estimate_floor(count: int) -> float:
    p = SIMILAR[0] / SIMILAR[1]
    return p - DEVIATIONS * (p * (1 - p) / count) ** 0.5


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's hash (low, high) and the signature of every row."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            hashes, bounds = shingle_sets(batch.column("text"))
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(salt)))]) for salt in BASES]
            low, high = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
            signs = signatures(hashes, bounds, TREES * DEPTH)
            raw = [s.tobytes() for s in signs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(low), pa.array(high), pa.array(raw, pa.binary())], names=["doc_id", "n_shingles", "low", "high", "signature"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, low long, high long, signature binary")


def forest_rows(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: tree, region (hash of tree and shallow prefix), label (big-endian, so bytes sort like numbers), node."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, TREES, DEPTH)
            at = np.arange(batch.num_rows) * (SHALLOW + 1)
            for t in range(TREES):
                shallow = Runs(np.concatenate([np.full((batch.num_rows, 1), t, np.uint32), signs[:, t, :SHALLOW]], axis=1).astype(U64).ravel())
                region = shallow.of(at, at + SHALLOW + 1).view(np.int64)
                labels = [s.tobytes() for s in signs[:, t, SHALLOW:].astype(">u4")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(region), pa.array(labels, pa.binary()), batch.column("node")], names=["tree", "region", "label", "node"])

    return classes.select("node", "signature").mapInArrow(rows, "tree int, region long, label binary, node long")


def class_codes(classes: DataFrame) -> DataFrame:
    """node, n_shingles and code: the lowest byte of each minimum."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), pa.array(codes, pa.binary())], names=["node", "n_shingles", "code"])

    return classes.select("node", "n_shingles", "signature").mapInArrow(rows, "node long, n_shingles long, code binary")


def alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, by their bytes; equal bytes by chance are taken off."""
    equal = (codes[a] == codes[b]).mean(1)
    return (equal - 1 / 256) / (1 - 1 / 256)


def opened(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), TREES * DEPTH)


def neighbour_pairs(forest: DataFrame) -> DataFrame:
    """Candidate pairs a < b from the sorted order of every tree, each once."""

    def pairs_of(region: np.ndarray, reach: np.ndarray, node: np.ndarray, split: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Pairs up to ``reach`` places apart; with ``split`` only those on both sides of that place."""
        left, right = [], []
        for k in range(1, NEAR + 1):
            i = np.flatnonzero((region[k:] == region[:-k]) & (reach[k:] >= k))
            if split >= 0:
                i = i[(i < split) & (i + k >= split)]
            left.append(node[i])
            right.append(node[i + k])
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]

    def along(batches) -> Iterator[pa.RecordBatch]:
        """Pairs inside a partition, and its first and last rows (kind 1) for the seams."""
        from pyspark import TaskContext

        part, seen, tail = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            some = tuple(batch.column(c).to_numpy() for c in ("region", "reach", "node"))
            yield framed(*pairs_of(*some))
            joined = some
            if tail is not None:
                joined = tuple(np.concatenate(x) for x in zip(tail, some, strict=True))
                yield framed(*pairs_of(*(x[: len(tail[0]) + NEAR] for x in joined), split=len(tail[0])))
            if seen < NEAR:
                yield seam(part, seen, tuple(x[: NEAR - seen] for x in some))
            seen += batch.num_rows
            tail = tuple(x[-NEAR:].copy() for x in joined)
        if tail is not None:
            yield seam(part, max(seen - len(tail[0]), 0) + (1 << 40), tail)

    names = ["kind", "part", "place", "region", "reach", "node", "a", "b"]

    def framed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n, none = len(a), pa.nulls
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int64()), pa.array(a), pa.array(b)], names=names)

    def seam(part: int, place: int, rows) -> pa.RecordBatch:
        region, reach, node = rows
        n, none = len(region), pa.nulls
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, part)), pa.array(place + np.arange(n)), *map(pa.array, (region, reach, node)), none(n, pa.int64()), none(n, pa.int64())], names=names)

    kinds = "kind int, part long, place long, region long, reach int, node long, a long, b long"
    reach = F.when(F.col("size") <= NEAR + 1, NEAR).when(F.col("tree") < CHAINS, 1).otherwise(0).alias("reach")
    found = saved(forest.repartitionByRange("region", "label", "node").sortWithinPartitions("region", "label", "node").select("region", reach, "node").mapInArrow(along, kinds), "forest")

    def across(batches) -> Iterator[pa.RecordBatch]:
        """A few rows of every partition, in order: pairs whose two sides lie in different partitions."""
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            table = table.combine_chunks()
            a, b = pairs_of(*(table.column(c).to_numpy() for c in ("region", "reach", "node")))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # At most 2 * NEAR rows of each partition. Pairs within a partition come up again and are merged with those found before.
    seams = found.where("kind = 1").groupBy("part", "region", "reach", "node").agg(F.min("place").alias("place"))
    joins = seams.repartition(1).sortWithinPartitions("part", "place").select("region", "reach", "node").mapInArrow(across, "a long, b long")
    pairs = saved(found.where("kind = 0").select("a", "b").unionByName(joins).distinct(), "neighbours")
    emptied(found)
    return pairs


def estimated(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """a, b and share of the pairs whose codes allow the threshold."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = np.concatenate([opened(batch.column(c).to_pylist()) for c in ("left", "right")])
                at = np.arange(batch.num_rows)
                share = alike(both, at, at + batch.num_rows)
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share.astype(np.float32))], names=["a", "b", "share"])
                yield out.filter(pa.array(share >= estimate_floor(TREES * DEPTH)))

    left, right = (codes.select(F.col("node").alias(n), F.col("code").alias(c)) for n, c in (("a", "left"), ("b", "right")))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(rows, "a long, b long, share float")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if SIMILAR[1] * min(len(x), len(y)) < SIMILAR[0] * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: node, hashes (sorted 64-bit values)."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(*(np.frombuffer(s.as_py(), U64) for s in pair)) for pair in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(rows, "a long, b long")


def components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, component; nodes that are not listed are their own component) after joining what ``links`` (a, b) connect; a component is
    named by its smallest node.

    Links are first moved onto components. Then, until nothing changes: every name takes the smallest name it or a neighbour points to, and
    follows pointers one step, so paths halve. Rounds are written to the shared folder.
    """
    moved = named(links, labels, "a", "b").where("x <> y")
    edges = saved(moved.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*").distinct(), "edges")
    names = saved(edges.select(F.col("x").alias("name")).distinct().withColumn("to", F.col("name")), "names")
    while True:
        asked = edges.join(names.withColumnsRenamed({"name": "y", "to": "offer"}), "y").groupBy("x").agg(F.min("offer").alias("offer"))
        nearer = names.join(asked, names["name"] == asked["x"]).select("name", F.col("to").alias("was"), F.least("to", "offer").alias("to"))
        # The root that a name pointed to learns of the smaller one too.
        told = nearer.where("to < was").groupBy(F.col("was").alias("name")).agg(F.min("to").alias("root"))
        lower = nearer.join(told, "name", "left").select("name", "was", F.least("to", F.coalesce("root", "to")).alias("to"))
        lower = saved(lower, "lower")
        jump = lower.join(lower.select(F.col("name").alias("to"), F.col("to").alias("further")), "to", "left")
        after = saved(jump.select("name", F.coalesce("further", "to").alias("to"), "was"), "names")
        emptied(lower, names)
        names = after
        if after.where("to <> was").isEmpty():
            break
        names = after.select("name", "to")
        names.saved_path = after.saved_path
    new = names.select("name", "to")
    if labels is None:
        every = new.select(F.col("name").alias("node"), F.col("to").alias("component"))
    else:
        # Members of old components, and names that had none.
        old = labels.join(new.withColumnRenamed("name", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        every = old.unionByName(new.join(labels.select(F.col("node").alias("name")), "name", "left_anti").select(F.col("name").alias("node"), F.col("to").alias("component")))
    every = saved(every, "labels")
    emptied(edges, after)
    return every


def named(rows: DataFrame, labels: DataFrame | None, *nodes: str) -> DataFrame:
    """``rows`` with the component of each of the given node columns, as x, y."""
    for node, name in zip(nodes, "xy", strict=False):
        if labels is None:
            rows = rows.withColumn(name, F.col(node))
        else:
            own = labels.select(F.col("node").alias(node), F.col("component").alias("__own"))
            rows = rows.join(own, node, "left").withColumn(name, F.coalesce("__own", node)).drop("__own")
    return rows


class Groups:
    """Union-find over places, for the classes of one block."""

    def __init__(self, components_: np.ndarray):
        _, first, place = np.unique(components_, return_index=True, return_inverse=True)
        self.up = first[place].tolist()

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k


def open_blocks(forest: DataFrame, codes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Classes of dense regions of more than one component, dealt into pairs of blocks i <= j: region, i, j, block, node, component, code."""
    big = named(forest.where(F.col("size") > NEAR + 1).select("region", "node"), labels, "node").withColumnRenamed("x", "component")
    spread = big.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("classes")).where("least <> most")
    open_ = saved(big.join(spread.select("region", "classes"), "region").join(codes.hint("merge"), "node"), "open-regions")
    blocks = open_.groupBy("region").agg(F.greatest(F.ceil(F.max("classes") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "code")


def candidates(component: np.ndarray, block: np.ndarray, codes: np.ndarray, inner: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after k whose class is of another component (and block, unless ``inner``) and whose estimate allows the threshold, and the estimates."""
    others = np.flatnonzero((component[k + 1 :] != component[k]) & (inner | (block[k + 1 :] != block[k]))) + k + 1
    share = alike(codes, np.full(len(others), k), others)
    good = share >= estimate_floor(TREES * DEPTH)
    return others[good], share[good]


def rest_links(forest: DataFrame, codes: DataFrame, labels: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Confirmed links between components within dense regions, fewer than each pair of blocks has classes."""
    same = "region long, i int, j int, block int, node long, component long, code binary"

    def partners(group: pa.Table) -> pa.Table:
        """The rows that have a candidate in another component."""
        component, block = (group.column(c).to_numpy() for c in ("component", "block"))
        signs, inner = opened(group.column("code").to_pylist()), group.column("i")[0] == group.column("j")[0]
        have = np.zeros(group.num_rows, bool)
        for k in range(group.num_rows - 1):
            others, _ = candidates(component, block, signs, inner, k)
            have[others] = True
            have[k] |= bool(len(others))
        return group.filter(pa.array(have))

    def check(group: pa.Table) -> pa.Table:
        """Candidates on full sets, best estimates first, but for those that are connected by then."""
        group = group.sort_by("node")
        component, block, node = (group.column(c).to_numpy() for c in ("component", "block", "node"))
        signs, inner = opened(group.column("code").to_pylist()), group.column("i")[0] == group.column("j")[0]
        sets = [np.frombuffer(s, U64) for s in group.column("hashes").to_pylist()]
        groups, found, a, b = Groups(component), [], [], []
        for k in range(group.num_rows - 1):
            others, share = candidates(component, block, signs, inner, k)
            found.append(np.stack([np.full(len(others), k), others, -share], axis=1))
        every = np.concatenate(found) if found else np.zeros((0, 3))
        for x, y in every[np.argsort(every[:, 2], kind="stable"), :2].astype(int).tolist():
            p, q = groups.root(x), groups.root(y)
            if p != q and linked(sets[x], sets[y]):
                groups.up[max(p, q)] = min(p, q)
                a.append(int(min(node[x], node[y])))
                b.append(int(max(node[x], node[y])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    key = ["region", "i", "j"]
    active = saved(open_blocks(forest, codes, labels).groupBy(*key).applyInArrow(partners, same), "rest")
    if active.isEmpty():
        return active.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = set_rows(docs, active.select("node").distinct())
    return active.join(sets.hint("merge"), "node").groupBy(*key).applyInArrow(check, "a long, b long").distinct()


def set_rows(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and hashes (sorted) of the given nodes, from their texts."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(F.xxhash64("node").alias("h"))))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        have = bitmap.value
        for batch in batches:
            some = batch.filter(pa.array(passes(have, batch.column("h").to_numpy())))
            for part in pieces([some], "text", SLICE_BYTES):
                hashes, bounds = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["node", "hashes"])

    slotted = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    found = slotted.mapInArrow(rows, "node long, hashes binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.max("hashes").alias("hashes"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Linked are rows whose shingle sets have a Jaccard similarity of at least 0.75; components are what links connect, named by their smallest
    doc_id, which alone is kept. Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows without
    doc_id name no component: component_id is null and they are kept. Repeated rows each get a row. Empty tables give an empty result; other
    columns are ignored. Rows that repeat a doc_id with another text go by their own text's component.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = saved(describe(chosen), "shingles")
    one_set = saved(every.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("low", "high").agg(F.min("doc_id").alias("node")), "sets")
    first = every.where("n_shingles > 0").join(one_set.select("low", "high", F.col("node").alias("doc_id")).hint("merge"), ["low", "high", "doc_id"], "left_semi")
    classes = saved(first.groupBy(F.col("doc_id").alias("node")).agg(F.max(F.struct("signature", "n_shingles")).alias("c")).select("node", "c.*"), "classes")
    slim = saved(every.drop("signature"), "rows")
    emptied(every)
    all_rows = saved(forest_rows(classes), "regions")
    sizes = all_rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    forest = saved(all_rows.join(sizes.hint("merge"), "region"), "shared-regions")
    codes = saved(class_codes(classes).join(forest.select("node").distinct().hint("merge"), "node", "left_semi"), "codes")
    emptied(all_rows, classes)
    neighbours = neighbour_pairs(forest)
    pairs = saved(estimated(neighbours, codes), "pairs")
    emptied(neighbours)
    labels = settle(pairs, chosen)
    links = saved(rest_links(forest, codes, labels, chosen), "rest-links")
    if not links.isEmpty():
        labels = components(labels, links)
    emptied(forest, codes, pairs, links)
    of_set = one_set if labels is None else one_set.join(labels, "node", "left")
    of_set = of_set.select("low", "high", (F.col("node") if labels is None else F.coalesce("component", "node")).alias("of_set"))
    # Each row goes by its own set; rows that share a doc_id can lie in different components.
    joined = slim.join(of_set.hint("merge"), ["low", "high"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_set"))
    result = joined.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def settle(pairs: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Components after confirming ``pairs`` (None: no links): the FIRST best of every class first, then all that still lead out of a component."""
    if pairs.isEmpty():
        return None
    sets = saved(set_rows(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "shingle-sets")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("share", "a", "b").alias("pair"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("pair")))
    asked = saved(ends.withColumn("place", place).where(F.col("place") <= FIRST).select("pair.a", "pair.b").distinct(), "asked")
    links = saved(confirm(asked, sets), "links")
    labels = None if links.isEmpty() else components(None, links)
    # What was refused is not asked again; what was confirmed lies within a component from now on.
    left = named(pairs.join(asked.hint("merge"), ["a", "b"], "left_anti").select("a", "b"), labels, "a", "b").where("x <> y")
    more = saved(confirm(left, sets), "links")
    if not more.isEmpty():
        labels = components(labels, more)
    emptied(sets, asked, links, more)
    return labels


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component, with all their columns. Rows without doc_id stay. Of rows that repeat a kept doc_id the
    one whose text (null last) has the smallest hash stays, of equal texts any one."""
    own_id, rows = unused(docs, "kept_id"), unused(docs, "kept_rows")
    kept = saved(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own_id)).agg(F.count(F.lit(1)).alias(rows)), "kept")
    own = lambda ids: docs.join(ids.select(own_id).hint("merge"), docs["doc_id"].cast("long") == F.col(own_id), "left_semi")
    once = own(kept.where(F.col(rows) == 1))
    again = kept.where(F.col(rows) > 1)
    if not again.isEmpty():  # only repeated ids are shuffled a second time
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), F.xxhash64("text"), "text"))
        once = once.unionByName(own(again).withColumn(rows, place).where(F.col(rows) == 1).drop(rows))
    return once.unionByName(docs.where("doc_id IS NULL"))
