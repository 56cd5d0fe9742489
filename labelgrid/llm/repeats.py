"""Periodic runs: stretches of words that repeat with a period, found by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends, here of at least
``MIN_WORDS`` words and ``MIN_TURNS`` periods. The words of a slice of documents form one sequence in which equal words of different
documents differ and every document ends in a mark of its own, so nothing reaches over a document's end.

1. Suffix array by doubling; only suffixes that still share a prefix are sorted again. Two neighbours that part between k and 2k words get
   their common prefix (LCP) by bisection on run hashes.
2. LCP intervals and their children come from the nearest smaller LCP to either side of every boundary; no tree is built.
3. For each interval of depth d every child but its largest is walked: suffix i starts a square of period d that branches to the right
   exactly if i + d lies in the same interval and another child, and i - d does so likewise; both are looked up in the inverse suffix
   array. Each suffix is walked O(log n) times.
4. A square is rotated to the left as long as its last word equals the word before it (one bisection for all rotations), which gives the
   run. Squares of q, 2q, 3q, ... words rotate into the same run and are merged under the smallest period.

A run that long repeats its first 16 words or more q words later, so documents without a repeated window of ``MARK`` words have none and
skip the suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.words import U64, Runs, flat, mix, pieces, ragged, windows, word_hashes, word_spans

MIN_WORDS, MIN_TURNS = 24, 3
SLICE_BYTES = 2 << 20


def mark_words(min_words: int, min_turns: int) -> int:
    """A run of period q and of L >= max(min_words, min_turns * q) words repeats its first L - q words; the least L - q over all q."""
    return max(1, min(max(min_words, min_turns * q) - q for q in range(1, min_words + 1)))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the LCP of each entry with the one before (0 for the first). Any equal symbols may meet; the last must be unique."""
    n = len(symbols)
    _, codes = np.unique(symbols, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    head = np.ones(n, bool)
    head[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    parted = np.zeros(n, np.int64)  # neighbours are equal over so many words at least, and over less than twice as many
    k = 1
    while True:
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        key = rank[at] * (n + 1) + rank[at + k]
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        first = new & ~head[open_]
        parted[open_[first]] = k
        head[open_[first]] = True
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        k *= 2
    lcp = parted.copy()
    runs = Runs(symbols)
    some = np.flatnonzero(parted > 1)
    low, high = parted[some], 2 * parted[some]  # equal over low words, not over high
    a, b = order[some - 1], order[some]
    while (high - low > 1).any():
        middle = (low + high) // 2
        fits = np.maximum(a, b) + middle <= n
        end = np.where(fits, middle, 0)
        same = fits & (runs.of(a, a + end) == runs.of(b, b + end))
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    lcp[some] = low
    return order, rank, lcp


def nearest_left(values: np.ndarray, equal: bool) -> np.ndarray:
    """Nearest place to the left with a smaller value (or with ``equal``, one that is no larger); values[0] must be the least of all.

    All places jump along each other's pointers at once; the few that remain after 2 log n rounds follow final pointers from left to right.
    """
    n = len(values)
    left = np.arange(n) - 1
    left[0] = 0
    open_ = np.arange(1, n)
    rounds = 2 * n.bit_length() + 8
    while len(open_) and rounds:
        there = values[left[open_]]
        far = there > values[open_] if equal else (there >= values[open_]) & (left[open_] > 0)
        open_ = open_[far]
        left[open_] = left[left[open_]]
        rounds -= 1
    for at in open_.tolist():
        place, value = int(left[at]), values[at]
        while place > 0 and (values[place] > value or (not equal and values[place] == value)):
            place = int(left[place])
        left[at] = place
    return left


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all children of LCP intervals but a largest one of each: first and last slot, then the interval's first and last slot and depth."""
    n = len(lcp)
    padded = np.concatenate([[-1], lcp[1:], [-1]])  # boundary k lies between slots k - 1 and k
    below, upto = nearest_left(padded, False), nearest_left(padded, True)
    back = padded[::-1].copy()
    above, next_ = n - nearest_left(back, False)[::-1], n - nearest_left(back, True)[::-1]
    cut = np.flatnonzero(padded > 0)
    low, high, depth = below[cut], above[cut] - 1, padded[cut]
    opens = padded[upto[cut]] < depth  # the first boundary of its interval: the child before it starts with the interval
    first = np.concatenate([cut, low[opens]])
    last = np.concatenate([next_[cut] - 1, cut[opens] - 1])
    of = np.concatenate([np.arange(len(cut)), np.flatnonzero(opens)])
    order = np.lexsort((first - last, depth[of], low[of]))  # the largest child of each interval comes first
    first, last, of = first[order], last[order], of[order]
    small = np.zeros(len(of), bool)
    small[1:] = (low[of[1:]] == low[of[:-1]]) & (depth[of[1:]] == depth[of[:-1]])
    of = of[small]
    return first[small], last[small], low[of], high[of], depth[of]


def squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose word after the end differs from the one a period before. origin: each document's first place, by place."""
    first, last, low, high, depth = intervals(lcp)
    size = last - first + 1
    slot, of = ragged(first, size), np.repeat(np.arange(len(first)), size)
    i, d = order[slot], depth[of]
    starts, periods = [], []
    for shift in (1, -1):
        j = i + shift * d
        ok = np.flatnonzero((j >= origin[i]) & (j < len(rank)))
        there, group = rank[j[ok]], of[ok]
        # In the interval, but not in the child that suffix i is in.
        hit = (there >= low[group]) & (there <= high[group]) & ((there < first[group]) | (there > last[group]))
        ok = ok[hit]
        starts.append(np.minimum(i[ok], j[ok]))
        periods.append(d[ok])
    return np.concatenate(starts), np.concatenate(periods)


def word_runs(hashes: np.ndarray, firsts: np.ndarray, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start (word number in the row), length and period of every run, by row, start and period. firsts: each row's first word."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    mark = mark_words(min_words, min_turns)
    at = windows(firsts, mark)
    if not len(at):
        return none
    rows = np.searchsorted(firsts, at, "right") - 1
    marks = np.sort(Runs(hashes).of(at, at + mark) ^ mix(rows.astype(U64)))
    again = np.unique(marks[1:][marks[1:] == marks[:-1]])
    if not len(again):
        return none
    found = Runs(hashes).of(at, at + mark) ^ mix(rows.astype(U64))
    rows = np.unique(rows[again[np.minimum(np.searchsorted(again, found), len(again) - 1)] == found])
    # The rows that are left, one after another, each with a mark at its end; a row's number is part of its words.
    sizes = np.diff(firsts)[rows]
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    own = np.repeat(np.arange(len(rows)), sizes + 1)
    symbols = mix(own.astype(U64) + U64(1))
    inner = ragged(begin, sizes)
    symbols[inner] = mix(hashes[ragged(firsts[rows], sizes)] ^ symbols[inner])
    order, rank, lcp = suffix_array(symbols)
    start, period = squares(order, rank, lcp, begin[own])
    # Rotate to the left: how far words q apart stay equal before the square.
    room, text = start - begin[own[start]], Runs(symbols)
    low, high = np.zeros(len(start), np.int64), room + 1
    while (high - low > 1).any():
        middle = (low + high) // 2
        same = text.of(start - middle, start) == text.of(start + period - middle, start + period)
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    end, start = start + 2 * period, start - low
    long = end - start >= np.maximum(min_words, min_turns * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    by = np.lexsort((period, start))
    start, end, period = start[by], end[by], period[by]
    return rows[own[start]], start - begin[own[start]], end - start, period


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties to the smaller start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start and period), strongest and collapsed for every row's whole text.

    Words are stretches of bytes other than ASCII white space. ``collapsed`` is the text, its words joined by one space, without the words that
    some run holds after its first period. A null or empty text has no words, no runs, and an empty ``collapsed``; ``strongest`` is null
    where there is no run. Null and repeated doc_ids are passed on row by row; an empty table gives an empty result; other columns are
    ignored. Nothing is shuffled; a text must fit in a task's memory some hundred bytes a word.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            data, offsets = flat(batch.column("text"))
            starts, ends, firsts = word_spans(data, offsets)
            row, start, length, period = word_runs(word_hashes(data, starts, ends), firsts, min_words, min_turns)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, firsts[row] + start + period, 1)
            np.add.at(gone, firsts[row] + start + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            runs: list[list] = [[] for _ in range(batch.num_rows)]
            for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
                runs[r].append(tuple(run))
            raw, texts = data.tobytes(), []
            for k, found in enumerate(runs):
                words = raw[offsets[k] : offsets[k + 1]].split()
                if found:
                    words = [words[i] for i in np.flatnonzero(kept[firsts[k] : firsts[k + 1]]).tolist()]
                texts.append(b" ".join(words))
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            as_dict = lambda run: run and dict(zip(("start", "length", "period"), run, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(firsts)), pa.array([[as_dict(x) for x in found] for found in runs], pa.list_(kind)), pa.array([as_dict(strongest(found)) for found in runs], kind), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(rows, f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten becomes periodic from some word on, as its doc_id's checksum says (fixed by the contract).

    With h = crc32 of the decimal doc_id, g = h // 10 and n words: if h % 10 = 0 and n > 0, word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + (n - a) // (3 + g % 8); such a text is its words joined by one space. Rows without doc_id stay as they are.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, h in enumerate(batch.column("h").to_pylist()):
                words = texts[k].split() if texts[k] and h is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).mapInArrow(rows, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``find_runs`` with hashes in place of lists and texts."""
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
