"""Word boxes: spatial joins on a page grid, greedy matching, derived samples."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import geometry as G
from labelgrid.functions.arith import ratio, uniform
from labelgrid.functions.text import cer, drop_punctuation, squeeze
from labelgrid.operators.thresholds import on_level, sweep_values
from labelgrid.session import cut_lineage

GRID = 256
GENEROSITY = 100
COVERAGE = 0.75
PAGE_BOXES = 2000  # boxes of both sides that may meet on a page without a grid
PAGE_PAIRS = 1_000_000  # pairs of a page that a task may hold
CHUNK_PAIRS = 1 << 18  # pairs of small pages that are worked on side by side
ROUNDS = 8  # rounds over arrays before the pairs still left are put in order
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def box_join(left: DataFrame, right: DataFrame, grid: int = GRID, grow: int = 0) -> DataFrame:
    """All pairs of overlapping boxes of a page, each once.

    Both sides carry ``page_id, l, t, r, b`` and unique other columns; boxes are
    grown by ``grow``. Boxes meet on grid cells (an equi join, split by AQE where
    a cell is crowded) and a pair counts only in the cell that holds the corner
    of its intersection, so nothing has to be de-duplicated. Output columns are
    prefixed ``a_`` and ``b_``.
    """
    def spread(df: DataFrame, prefix: str) -> DataFrame:
        out = df.select("page_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "page_id"])
        bx = G.grow(G.box(prefix), grow)
        return out.withColumn("_gx", F.explode(G.cells_of(bx.l, bx.r, grid))).withColumn("_gy", F.explode(G.cells_of(bx.t, bx.b, grid)))

    a, b = G.grow(G.box("a_"), grow), G.grow(G.box("b_"), grow)
    home = (F.col("_gx") == F.floor(F.greatest(a.l, b.l) / grid)) & (F.col("_gy") == F.floor(F.greatest(a.t, b.t) / grid))
    return spread(left, "a_").join(spread(right, "b_"), ["page_id", "_gx", "_gy"]).where(G.boxes_overlap(a, b) & home).drop("_gx", "_gy")


def page_join(left: DataFrame, right: DataFrame, grow: int = 0) -> DataFrame:
    """:func:`box_join` without a grid, for pages of few boxes: each box is shuffled once, and the pairs of a page stay together."""
    side = lambda df, prefix: df.select("page_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "page_id"])
    a, b = G.grow(G.box("a_"), grow), G.grow(G.box("b_"), grow)
    return side(left, "a_").join(side(right, "b_"), "page_id").where(G.boxes_overlap(a, b))


def box_iou_pairs(gt: DataFrame, pred: DataFrame, generosity: int = GENEROSITY, page_boxes: int = PAGE_BOXES, packed: bool = False) -> DataFrame:
    """IoU of the grown boxes for every pair that overlaps.

    Boxes are counted by page first. Pages of at most ``page_boxes`` boxes are joined whole, so their pairs need no further shuffle to be
    matched by page; only crowded pages are spread over the grid.

    ``packed`` gives the same pairs as arrays for :func:`match_boxes`, one row a page (crowded pages: one a pair, ``whole`` unset): boxes are
    shuffled once and a page's pairs are found over arrays. Boxes without id, which match nothing, are left out. Both sides may carry
    ``levels``, bits of the levels a box lives on; a pair lives on those of both. Pairs come as rows where coordinates are no whole numbers.
    """
    levels = ["levels"] if "levels" in gt.columns and "levels" in pred.columns else []
    sides = ["page_id", "box_id", "l", "t", "r", "b", *levels]
    gt, pred = gt.select(*sides), pred.select(*sides)
    crowded = gt.select("page_id").unionByName(pred.select("page_id")).groupBy("page_id").count().where(F.col("count") > page_boxes).select("page_id")
    calm, full = (gt, pred), None
    if not crowded.isEmpty():
        calm, full = ([df.join(crowded, "page_id", how) for df in (gt, pred)] for how in ("left_anti", "left_semi"))
    iou = G.iou(G.grow(G.box("a_"), generosity), G.grow(G.box("b_"), generosity))
    named = ["page_id", F.col("a_box_id").alias("gt_id"), F.col("b_box_id").alias("pred_id"), iou.alias("iou")]
    if levels:
        named.append(F.col("a_levels").bitwiseAND(F.col("b_levels")).alias("levels"))
    rows = lambda met: met.select(*named).where("iou > 0" + " AND levels <> 0" * len(levels))
    if not (packed and gt.dtypes == pred.dtypes and all(kind in INTEGERS for c, kind in gt.dtypes if c in "ltrb")):
        met = page_join(*calm, generosity)
        return rows(met if full is None else met.unionByName(box_join(*full, grow=generosity)))
    # of crowded pages only: the IoU (and levels) of the row's pair
    out = _pack_pages(*calm, generosity).select("*", F.lit(None).cast("double").alias("iou"), *[F.lit(None).cast("bigint").alias(c) for c in levels], F.lit(True).alias("whole"))
    if full is None:
        return out
    apart = rows(box_join(*full, grow=generosity)).where("gt_id IS NOT NULL AND pred_id IS NOT NULL")
    ends = [F.array(one).alias(many) for one, many in (("gt_id", "gt_ids"), ("pred_id", "pred_ids"))]
    return out.unionByName(apart.select("page_id", *ends, "iou", *levels, F.lit(False).alias("whole")), allowMissingColumns=True)


def _pairs_of(l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, is_gt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the ground truth and of the prediction, and IoU, of all pairs of a page's (grown) boxes."""
    at_g, at_p = np.flatnonzero(is_gt), np.flatnonzero(~is_gt)
    up = lambda c: c[at_g][:, None]
    met = (up(l) <= r[at_p]) & (l[at_p] <= up(r)) & (up(t) <= b[at_p]) & (t[at_p] <= up(b))
    row, col = np.divmod(np.flatnonzero(met), max(len(at_p), 1))
    g, p = at_g[row], at_p[col]
    inter = (np.minimum(r[g], r[p]) - np.maximum(l[g], l[p])) * (np.minimum(b[g], b[p]) - np.maximum(t[g], t[p]))
    area = (r - l) * (b - t)
    union = area[g] + area[p] - inter
    on = np.flatnonzero((inter > 0) & (union > 0))
    return g[on], p[on], inter[on] / union[on]


def _pair_type(levels: bool) -> np.dtype:
    """A pair of a packed page: the places of its ends among the page's ids."""
    return np.dtype([("g", "<i4"), ("p", "<i4"), ("iou", "<f8"), *([("levels", "<i8")] if levels else [])])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))


def _pack_pages(gt: DataFrame, pred: DataFrame, generosity: int) -> DataFrame:
    """A row a page: the ids of both sides in order, and its pairs as the bytes of one array (:func:`_pair_type`), which no step takes apart on its way."""
    kinds = dict(gt.dtypes)
    levels = "levels" in kinds
    known = F.lit(True)
    for c in gt.columns:
        known &= F.col(c).isNotNull()
    sides = gt.withColumn("_gt", F.lit(True)).unionByName(pred.withColumn("_gt", F.lit(False))).where(known)

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole pages, page by page."""
        page, ids = table.column("page_id").combine_chunks(), table.column("box_id").combine_chunks()
        box = {c: table.column(c).to_numpy().astype(np.int64) + (-generosity if c in "lt" else generosity) for c in "ltrb"}
        names, is_gt = ids.to_numpy(zero_copy_only=False), table.column("_gt").to_numpy()
        on = table.column("levels").to_numpy() if levels else None
        first = [0, *(np.flatnonzero(pc.not_equal(page.slice(1), page.slice(0, len(page) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(page)]
        found, at, n = [], [], 0

        def batch() -> pa.RecordBatch:
            ends = [_lists([row[k] for row in found], ids.type) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([page.take(pa.array(at)), *ends, pa.array([row[2].tobytes() for row in found], pa.binary())], names=["page_id", "gt_ids", "pred_ids", "pairs"])

        for low, high in zip(first, first[1:]):
            g, p, iou = _pairs_of(*(box[c][low:high] for c in "ltrb"), mine := is_gt[low:high])
            if levels:
                both = on[low:high][g] & on[low:high][p]
                some = np.flatnonzero(both)
                g, p, iou, both = g[some], p[some], iou[some], both[some]
            if not len(iou):
                continue
            place, ends = np.empty(high - low, np.int32), []
            for side in (mine, ~mine):
                end, place[side] = np.unique(names[low:high][side], return_inverse=True)
                ends.append(end)
            pairs = np.empty(len(iou), _pair_type(levels))
            pairs["g"], pairs["p"], pairs["iou"] = place[g], place[p], iou
            if levels:
                pairs["levels"] = both
            found.append((*ends, pairs))
            at.append(low)
            n += len(iou)
            if n > CHUNK_PAIRS:
                yield batch()
                found, at, n = [], [], 0
        if found:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for new in batches:
            if not new.num_rows:
                continue
            page = new.column("page_id")
            last = pc.not_equal(page, page[new.num_rows - 1]).to_numpy(zero_copy_only=False)
            begun = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # where the last page begins, which may go on
            if begun or rest and rest[-1].column("page_id")[0] != page[0]:
                yield from pack(pa.Table.from_batches([*rest, new.slice(0, begun)]))
                rest = []
            rest.append(new.slice(begun))
        if rest:
            yield from pack(pa.Table.from_batches(rest))

    key, name = kinds["page_id"], kinds["box_id"]
    schema = f"page_id {key}, gt_ids array<{name}>, pred_ids array<{name}>, pairs binary"
    # dealt by a hash of its own: a plain repartition is left out where the rows come by page from a join, which may be planned anew while it runs
    return sides.repartition(F.xxhash64("page_id")).sortWithinPartitions("page_id").mapInArrow(run, schema)


_PAIR = ["page_id", "gt_id", "pred_id", "iou"]


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best left for both of their boxes."""
    order = F.max(F.struct("iou", "gt_id", "pred_id")).alias("m")
    best_gt = pairs.groupBy("page_id", "gt_id").agg(order).select("page_id", "m.*")
    best_pred = pairs.groupBy("page_id", "pred_id").agg(order).select("page_id", "m.gt_id", "m.pred_id")
    return best_gt.select(*_PAIR).join(best_pred, ["page_id", "gt_id", "pred_id"])


def _without(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs none of whose boxes is taken."""
    free = pairs.join(chosen.select("page_id", "gt_id"), ["page_id", "gt_id"], "left_anti")
    return free.join(chosen.select("page_id", "pred_id"), ["page_id", "pred_id"], "left_anti").select(*_PAIR)


def _greedy(pairs: pa.Table) -> pa.Table:
    """Greedy matching of one page's pairs, best first."""
    best = pairs.take(pc.sort_indices(pairs, sort_keys=[(c, "descending") for c in ("iou", "gt_id", "pred_id")])).combine_chunks()
    ends = [pc.dictionary_encode(best[c].combine_chunks()).indices.to_numpy().tolist() for c in ("gt_id", "pred_id")]
    used_gt, used_pred, rows = bytearray(len(best)), bytearray(len(best)), []
    for row, (g, p) in enumerate(zip(*ends)):
        if not used_gt[g] and not used_pred[p]:
            used_gt[g] = used_pred[p] = 1
            rows.append(row)
    return best.take(rows)


def _best_first(g: np.ndarray, p: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Places of the pairs that greedy matching takes: ``iou``, then ``g``, then ``p`` from the highest down.

    Pairs that are the best left for both of their ends are taken together (see :func:`match_boxes`), over arrays, for all pages at once; what
    is left after ``ROUNDS`` is put in order and taken one by one.
    """
    taken, at = [], np.arange(len(g))
    n_g, n_p = (int(x.max()) + 1 if len(x) else 0 for x in (g, p))
    for _ in range(ROUNDS):
        if not len(at):
            break
        gs, ps, v = g[at], p[at], iou[at]
        top_g, top_p = np.zeros(n_g), np.zeros(n_p)
        np.maximum.at(top_g, gs, v)
        np.maximum.at(top_p, ps, v)
        of_g, of_p = np.flatnonzero(v == top_g[gs]), np.flatnonzero(v == top_p[ps])
        last_p, last_g = np.full(n_g, -1), np.full(n_p, -1)
        np.maximum.at(last_p, gs[of_g], ps[of_g])
        np.maximum.at(last_g, ps[of_p], gs[of_p])
        both = of_g[v[of_g] == top_p[ps[of_g]]]
        both = both[(last_p[gs[both]] == ps[both]) & (last_g[ps[both]] == gs[both])]
        both = both[np.unique(gs[both], return_index=True)[1]]  # a pair that comes twice is taken once
        taken.append(at[both])
        free_g, free_p = np.ones(n_g, bool), np.ones(n_p, bool)
        free_g[gs[both]] = free_p[ps[both]] = False
        at = at[free_g[gs] & free_p[ps]]
    if len(at):
        at = at[np.lexsort((p[at], g[at], iou[at]))[::-1]]
        used_g, used_p, rest = bytearray(n_g), bytearray(n_p), []
        for row, a, b in zip(at.tolist(), g[at].tolist(), p[at].tolist()):
            if not used_g[a] and not used_p[b]:
                used_g[a] = used_p[b] = 1
                rest.append(row)
        taken.append(np.array(rest))
    return np.concatenate(taken) if taken else at


def _match_pages(batch: pa.RecordBatch, levels: bool) -> pa.RecordBatch:
    """Matches of packed pages, all of them side by side; with ``levels`` on each level by itself, and the bits of those a match is on."""
    kind = _pair_type(levels)
    pairs = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)
    n = pc.binary_length(batch.column("pairs")).to_numpy() // kind.itemsize
    ends = [(batch.column(c).flatten(), batch.column(c).value_lengths().to_numpy()) for c in ("gt_ids", "pred_ids")]
    g, p = (np.repeat(np.cumsum(k) - k, n) + pairs[c] for c, (_, k) in zip("gp", ends))
    iou = pairs["iou"].copy()
    if not levels:
        rows, more = np.sort(_best_first(g, p, iou)), {}
    else:
        on = pairs["levels"].copy()
        kept, before, best = np.zeros(len(on), np.int64), np.zeros(0, int), np.zeros(0, int)
        for k in range(int(np.bitwise_or.reduce(on)).bit_length() if len(on) else 0):
            some = np.flatnonzero(on >> k & 1)
            if not np.array_equal(some, before):
                before, best = some, some[_best_first(g[some], p[some], iou[some])]
            kept[best] |= 1 << k
        rows = np.flatnonzero(kept)
        more = {"levels": pa.array(kept[rows])}
    page = np.repeat(np.arange(len(n)), n)[rows]
    out = {"page_id": batch.column("page_id").take(pa.array(page)), "gt_id": ends[0][0].take(pa.array(g[rows])), "pred_id": ends[1][0].take(pa.array(p[rows])), "iou": pa.array(iou[rows])}
    return pa.RecordBatch.from_pydict(out | more)


def _match_packed(pairs: DataFrame) -> DataFrame:
    """Matches of whole pages; about ``CHUNK_PAIRS`` pairs, or one page, are worked on at a time."""

    kinds = dict(pairs.dtypes)
    levels = "levels" in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("pairs")).to_numpy().astype(np.int64)
            part = np.cumsum(size) // (CHUNK_PAIRS * _pair_type(levels).itemsize)
            first = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for low, high in zip(first, first[1:]):
                if low < high:
                    yield _match_pages(batch.slice(low, high - low), levels)

    name = lambda c: kinds[c].removeprefix("array<")[:-1]
    schema = f"page_id {kinds['page_id']}, gt_id {name('gt_ids')}, pred_id {name('pred_ids')}, iou double" + ", levels bigint" * levels
    return pairs.select("page_id", "gt_ids", "pred_ids", "pairs").mapInArrow(run, schema)


def _fold_pages(pairs: DataFrame, page_pairs: int) -> DataFrame:
    """Matches of pages of at most ``page_pairs`` pairs, and all pairs of the others with ``open`` set. Only so many pairs are held at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > page_pairs:
                break
        over = n > page_pairs
        done = chain(held, batches) if over else _greedy(pa.Table.from_batches(held)).to_batches()
        for batch in done:
            yield batch.append_column("open", pa.array([over] * batch.num_rows, pa.bool_()))

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in _PAIR) + ", open boolean"
    return pairs.select(*_PAIR).where("gt_id IS NOT NULL AND pred_id IS NOT NULL").groupBy("page_id").applyInArrow(fold, schema)


def match_boxes(pairs: DataFrame, page_pairs: int = PAGE_PAIRS) -> DataFrame:
    """Greedy one-to-one matching by IoU; ties go to the later gt, then the later prediction.

    Pages of at most ``page_pairs`` pairs are folded one by one in the tasks
    that join them; only matches are written, pairs are neither shuffled nor
    kept. The pairs of larger pages go on in rounds. A pair that is the best
    left for both of its boxes is what the greedy order takes for them, whatever
    happens elsewhere: every round takes all such pairs and drops their boxes,
    so no large page is ever held in one place. Lineage is cut in the checkpoint
    folder.

    Packed pages (see :func:`box_iou_pairs`) are matched over arrays, many at a
    time. Pairs with ``levels`` are matched on each level by itself, and a match
    carries the bits of the levels it is on.
    """
    if "whole" in pairs.columns:
        taken = cut_lineage(_match_packed(pairs.where("whole")))
        ends = [F.get(many, F.lit(0)).alias(one) for one, many in (("gt_id", "gt_ids"), ("pred_id", "pred_ids"))]
        apart = pairs.where("NOT whole").select("page_id", *ends, "iou", *["levels"] * ("levels" in pairs.columns))
        return taken if apart.isEmpty() else taken.unionByName(match_boxes(apart, page_pairs))
    if "levels" in pairs.columns:
        bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit("levels", k) == 1)
        swept = pairs.withColumn("_k", F.explode(bits)).withColumn("page_id", F.struct("page_id", "_k").cast(f"struct<page_id: {dict(pairs.dtypes)['page_id']}, _k: int>")).select(*_PAIR)
        bit = F.expr("bit_or(shiftleft(1L, page_id._k))").alias("levels")
        return match_boxes(swept, page_pairs).groupBy("page_id.page_id", "gt_id", "pred_id").agg(F.max("iou").alias("iou"), bit)
    folded = cut_lineage(_fold_pages(pairs, page_pairs))
    taken, left = folded.where(~F.col("open")).select(*_PAIR), folded.where("open").select(*_PAIR)
    while not left.isEmpty():
        chosen = cut_lineage(mutual_best(left))
        taken = taken.unionByName(chosen)
        left = cut_lineage(_without(left, chosen))
    return taken


def unmatched_boxes(boxes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Boxes of one side (``gt`` or ``pred``) no match uses."""
    used = matches.select("page_id", F.col(f"{side}_id").alias("box_id"))
    return boxes.join(used, ["page_id", "box_id"], "left_anti")


def prune_punctuation(boxes: DataFrame) -> DataFrame:
    """Texts without punctuation; boxes left empty are dropped."""
    return boxes.withColumn("text", drop_punctuation(F.col("text"))).where("length(text) > 0")


def _swept_rows(g: DataFrame, p: DataFrame, m: DataFrame) -> DataFrame:
    """Matched and left over texts as in :func:`ocr_score`, each with the bits of the ``levels`` it holds on.

    A box is left over on the levels where no match has it: those are a row beside its matches.
    """
    def free(key: str, **others: str) -> DataFrame:
        none = [F.lit(None).cast(kind).alias(c) for c, kind in others.items()]
        return m.groupBy("page_id", key).agg(F.bitwise_not(F.expr("bit_or(levels)")).alias("levels")).select("page_id", key, *none, "levels")

    kinds = dict(m.dtypes)
    both = lambda one: F.coalesce(one, F.lit(-1)).bitwiseAND(F.coalesce("levels", F.lit(-1)))
    of_pred = m.unionByName(free("pred_id", gt_id=kinds["gt_id"], _m="int"))
    x = p.withColumnRenamed("levels", "_on").join(of_pred, ["page_id", "pred_id"], "left").withColumn("levels", both("_on")).where("levels <> 0").select("page_id", "gt_id", "pred_text", "_m", "levels")
    of_gt = x.unionByName(free("gt_id", pred_text="string", _m="int"))
    return g.withColumnRenamed("levels", "_on").join(of_gt, ["page_id", "gt_id"], "full").withColumn("levels", both("_on")).where("levels <> 0")


def ocr_score(gt: DataFrame, pred: DataFrame, matches: DataFrame, case_sensitive: bool = True, levels: list[float] | None = None) -> DataFrame:
    """Word- and character-weighted error rates per page, matched and overall.

    Unmatched boxes count as error 1; the overall weighted rate leaves the
    characters of unmatched predictions out of its denominator. With ``levels``
    boxes and matches carry the bits of those they are on, and there is a row
    per page and ``threshold``; a pair of texts is compared once for all levels.
    """
    extra = ["levels"] if levels else []
    m = matches.select("page_id", "gt_id", "pred_id", F.lit(1).alias("_m"), *extra)
    g = gt.select("page_id", F.col("box_id").alias("gt_id"), F.col("text").alias("gt_text"), *extra)
    p = pred.select("page_id", F.col("box_id").alias("pred_id"), F.col("text").alias("pred_text"), *extra)
    both = _swept_rows(g, p, m) if levels else g.join(m, ["page_id", "gt_id"], "full").join(p, ["page_id", "pred_id"], "full")
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    matched = F.col("_m").isNotNull()
    glen, plen = F.length("gt_text").cast("double"), F.length("pred_text").cast("double")
    texts = both.select("page_id", *extra, matched.alias("matched"), glen.alias("gl"), plen.alias("pl"), *[F.when(matched, fold(c)).alias(c) for c in ("gt_text", "pred_text")])
    squeezed = texts.withColumns({"_ref": squeeze(F.col("gt_text")), "_hyp": squeeze(F.col("pred_text"))})
    rate = F.when(F.col("matched"), cer(F.col("gt_text"), F.col("pred_text"), (F.col("_ref"), F.col("_hyp"))))
    rows = squeezed.select("page_id", *extra, "matched", rate.alias("cer"), "gl", "pl")
    only_gt, only_pred = F.col("pl").isNull(), F.col("gl").isNull()
    sums = {
        "_c": F.sum("cer"), "_cn": F.count("cer"), "_cw": F.sum(F.col("cer") * F.col("gl")), "_w": F.sum(F.when(F.col("matched"), F.col("gl"))),
        "_all": F.sum(F.coalesce("cer", F.lit(1e0))), "_n": F.count(F.lit(1)),
        "unmatched_gt_chars": F.sum(F.when(only_gt, F.col("gl"))), "unmatched_pred_chars": F.sum(F.when(only_pred, F.col("pl"))),
        "gt_chars": F.sum("gl"), "pred_chars": F.sum("pl"),
        "n_matched": F.sum(F.col("matched").cast("bigint")), "n_unmatched_gt": F.sum(only_gt.cast("bigint")), "n_unmatched_pred": F.sum(only_pred.cast("bigint")),
    }
    s, by = rows.groupBy("page_id", *extra).agg(*[v.alias(c) for c, v in sums.items()]), ["page_id"]
    if levels:
        by = ["page_id", "threshold"]
        s = sweep_values(s, levels).where(on_level("levels", levels)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    known = lambda c: F.coalesce(c, F.lit(0e0))
    s = s.select(
        *by, ratio(F.col("_c"), F.col("_cn")).alias("word_cer"), "_cw", "_w", (F.col("_all") / F.col("_n")).alias("word_cer_all"),
        *[known(c).alias(c) for c in ("unmatched_gt_chars", "unmatched_pred_chars", "gt_chars", "pred_chars")], "n_matched", "n_unmatched_gt", "n_unmatched_pred",
    )
    errors = known("_cw") + F.col("unmatched_gt_chars") + F.col("unmatched_pred_chars")
    return s.withColumns({
        "document_cer": ratio(F.col("_cw"), F.col("_w")), "document_cer_all": ratio(errors, F.col("gt_chars")), "character_accuracy": 1 - F.col("word_cer"),
    }).drop("_cw", "_w")


def valid_words(words: DataFrame, min_segs: int = 0) -> DataFrame:
    """Words with enough cut offsets: at least one per gap, and ``min_segs`` of each."""
    segs = F.size("charsegs")
    ok = F.col("charsegs").isNotNull() & (segs + 1 >= F.length("text")) & (segs >= min_segs) & (F.length("text") >= min_segs)
    return words.where(ok)


def char_boxes(words: DataFrame, keep: list[str] = ()) -> DataFrame:
    """A box per character from the word box and its cut offsets.

    Words whose offsets do not fit their text (``len(segs) != len(text) - 1``)
    are skipped; ``_`` reads as a blank. ``keep`` names columns to carry along.
    """
    fit = words.where(F.size("charsegs") == F.length("text") - 1)
    chars = fit.select("page_id", "box_id", *keep, "l", "t", "r", "b", "charsegs", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    cut = lambda i: F.get("charsegs", i)
    return chars.select(
        "page_id", "box_id", *keep, "pos", F.translate("ch", "_", " ").alias("ch"),
        F.when(F.col("pos") > 0, F.col("l") + cut(F.col("pos") - 1)).otherwise(F.col("l")).alias("l"), "t",
        F.coalesce(F.col("l") + cut(F.col("pos")), F.col("r")).alias("r"), "b",
    )


def chars_in_region(regions: DataFrame, words: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Distinct characters covered by each region to at least ``threshold``.

    Regions meet whole words first; only words that overlap are taken apart.
    """
    met = box_join(regions.select("page_id", "region_id", "l", "t", "r", "b"), words.select("page_id", "box_id", "l", "t", "r", "b", "text", "charsegs"))
    sides = {f"a_{c}": f"region_{c}" for c in "ltrb"}
    inside = met.withColumnsRenamed({**sides, "a_region_id": "region_id", **{f"b_{c}": c for c in ("box_id", "l", "t", "r", "b", "text", "charsegs")}})
    chars = char_boxes(inside, ["region_id", *sides.values()])
    return chars.where(G.coverage(G.box("region_"), G.box()) >= threshold).select("page_id", "region_id", "ch").distinct()


def mean_heights(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_id").agg(F.avg(F.col("b") - F.col("t")).alias("mean_height"))


def candidate_squares(pages: DataFrame, seed: str, tries: int, low: Column, high: Column) -> DataFrame:
    """``tries`` hashed squares per page ``(page_id, height, width, ...)``, side in [low, high]."""
    out = pages.withColumns({"_lo": low, "_hi": high}).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    u = lambda what: uniform(f"{seed}-{what}", F.col("page_id"), F.col("try"))
    side = (F.col("_lo") + F.floor(u("side") * (F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)) + 1))).cast("int")
    out = out.withColumn("side", side)
    spot = lambda what, extent: F.floor(u(what) * F.greatest(F.col(extent) - F.col("side"), F.lit(1))).cast("int")
    out = out.withColumns({"l": spot("x", "width"), "t": spot("y", "height")})
    return out.withColumns({
        "r": F.least(F.col("l") + F.col("side"), F.col("width") - 1).cast("int"), "b": F.least(F.col("t") + F.col("side"), F.col("height") - 1).cast("int"),
    }).drop("_lo", "_hi", "side")


def blank_regions(boxes: DataFrame, pages: DataFrame, seed: str, tries: int = 10) -> DataFrame:
    """Squares (side 2 .. mean box height) that touch no word box."""
    sized = pages.join(mean_heights(boxes), "page_id")
    squares = candidate_squares(sized, seed, tries, F.lit(2), F.floor("mean_height")).select("page_id", "try", "l", "t", "r", "b")
    touched = box_join(squares, boxes.select("page_id", "l", "t", "r", "b")).select("page_id", F.col("a_try").alias("try"))
    return squares.join(touched, ["page_id", "try"], "left_anti")


def multiline_regions(boxes: DataFrame, pages: DataFrame, seed: str, tries: int = 10) -> DataFrame:
    """Squares of at least two mean heights whose boxes span more than one mean height of rows."""
    sized = pages.join(mean_heights(boxes), "page_id")
    squares = candidate_squares(sized, seed, tries, F.ceil(2 * F.col("mean_height")), F.least("height", "width") - 1)
    met = box_join(squares.select("page_id", "try", "mean_height", "l", "t", "r", "b"), boxes.select("page_id", "l", "t", "r", "b"))
    spans = met.groupBy("page_id", F.col("a_try").alias("try")).agg(
        (F.max("b_b") - F.min("b_b")).alias("span"), F.first("a_mean_height").alias("mh"), *[F.first(f"a_{c}").alias(c) for c in "ltrb"]
    )
    return spans.where(F.col("span") > F.col("mh")).drop("mh")


SAMPLE_KINDS = ["char", "interchar", "multichar", "interline", "subchar"]


def character_samples(words: DataFrame, kind: str, seed: str, size: int = 28) -> DataFrame:
    """Labelled boxes cut from words: each character, gap, whole word, the space
    between lines, or a fragment inside a word.

    Offsets that a sampler would draw are hashes of the word and position.
    """
    key = [F.col("page_id"), F.col("box_id")]
    if kind == "char":
        return char_boxes(words).select("page_id", "box_id", "pos", "l", "t", "r", "b", F.col("ch").alias("label"))
    if kind == "interchar":
        gaps = words.select("page_id", "box_id", "l", "t", "b", F.posexplode("charsegs").alias("pos", "cut"))
        return gaps.select(
            "page_id", "box_id", "pos", F.greatest(F.col("l") + F.col("cut") - size // 2, F.lit(0)).alias("l"), "t", (F.col("l") + F.col("cut") + size // 2).alias("r"), "b",
            F.lit("<interchar>").alias("label"),
        )
    if kind == "multichar":
        return words.where(F.size("charsegs") >= 1).select("page_id", "box_id", F.lit(0).alias("pos"), "l", "t", "r", "b", F.lit("<multichar>").alias("label"))
    if kind == "interline":
        off = (size // 4 + F.floor(uniform(f"{seed}-off", *key) * (size // 2 + 2 - size // 4))).cast("int")
        move = F.when(uniform(f"{seed}-dir", *key) < 0.5, -off).otherwise(off)
        return words.select(
            "page_id", "box_id", F.lit(0).alias("pos"), "l", F.greatest(F.lit(0), F.col("t") + move).alias("t"), "r", F.greatest(F.lit(1), F.col("b") + move).alias("b"),
            F.lit("<interline>").alias("label"),
        )
    if kind == "subchar":
        chars = char_boxes(words)
        u = lambda what: uniform(f"{seed}-{what}", *key, F.col("pos"))
        span = lambda what, extent: F.floor(u(what) * (F.greatest(F.lit(1), extent) + 1)).cast("int")
        w = (5 + F.floor(u("w") * (F.greatest(F.lit(6), F.col("r") - F.col("l")) - 4))).cast("int")
        sized = chars.withColumn("w", w)
        placed = sized.withColumns({"ox": span("x", F.col("r") - F.col("l") - F.col("w")), "oy": span("y", F.col("b") - F.col("t") - F.col("w"))})
        return placed.select(
            "page_id", "box_id", "pos", (F.col("l") + F.col("ox")).alias("l"), (F.col("t") + F.col("oy")).alias("t"),
            (F.col("l") + F.col("ox") + F.col("w")).alias("r"), (F.col("t") + F.col("oy") + F.col("w")).alias("b"), F.lit("<subchar>").alias("label"),
        )
    raise ValueError(f"unknown kind {kind!r}")
