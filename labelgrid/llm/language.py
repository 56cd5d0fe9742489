"""Language identification with n-gram filters: one Bloom filter for each language, stored bit-sliced.

Row r of the filter is a bit mask over all languages, so reading the rows of an n-gram's ``HASHES`` positions and taking their AND gives the mask
of all languages that may contain it, whatever their number. A text's evidence for a language is the share of its n-grams whose mask
has that language's bit (a population count by language), corrected for false positives: of ``f`` expected by chance among the n-grams that a
language lacks, a measured share h stands for (h - f) / (1 - f).

An n-gram belongs to a language if it is among the ``KEPT`` ones of its order with the largest mean share of a training text. A second filter
of each language holds the first ``CORE``-th of them, and the evidence is the mean over both, so short words that several languages
contain go to the one in which they are common. n-grams have one to four lower-case letters and stay within words, whose ends count as a
letter of their own; all other characters are word ends.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.shared import crc32_of_id
from labelgrid.llm.words import U64, Runs, mix, pieces, ragged

#: At most so many training rows a language, and so many n-grams of each order in a language's filter.
TRAIN_ROWS = 5000
KEPT = {1: 200, 2: 1500, 3: 4000, 4: 6000}
CORE = 6
HASHES, BITS_EACH = 3, 12
UNKNOWN = "und"
SLICE_BYTES, CHUNK = 1 << 20, 1 << 18
UNIT = 1 << 40


@cache
def letters() -> np.ndarray:
    """Lower-case form of every code point that is a letter, 0 of all others. A letter whose lower case has several characters stays as it is."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, a 0 for each stretch of other characters and around each text, and each text's first place (rows + 1 entries)."""
    raw = "\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass")
    found = letters()[np.frombuffer(raw, np.uint32)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    kept = np.ones(len(found), bool)
    kept[1:] = (found[1:] > 0) | (found[:-1] > 0)
    # A text's first place is the 0 before it, which may stand before the last text's end.
    return found[kept], np.cumsum(kept)[firsts] - 1


def grams(stream: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the n-grams of one order: only letters inside, word ends at the first and last place at most."""
    n = len(stream) - order + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    letter = stream > 0
    ok = letter[:n].copy() if order == 1 else np.ones(n, bool)
    for k in range(1, order - 1):
        ok &= letter[k : n + k]
    if order == 2:
        ok &= letter[:n] | letter[1 : n + 1]
    at = np.flatnonzero(ok)
    hashes = np.full(len(at), order, U64)
    for k in range(order):
        hashes = hashes * U64(0x9E3779B97F4A7C15) + stream[at + k]
    return mix(hashes), at


class Words:
    """The words of some texts: which distinct word each one is, the first word of each text, and the distinct words' n-grams."""

    def __init__(self, texts: list[str]):
        stream, firsts = letter_stream(texts)
        letter = stream > 0
        starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        runs = Runs(mix(stream.astype(U64)))
        hashes, at, self.codes = np.unique(runs.of(starts, ends), return_index=True, return_inverse=True)
        self.count, self.firsts = len(hashes), np.searchsorted(starts, firsts)
        # Distinct words one after another with a 0 before and after each.
        sizes = ends[at] - starts[at]
        self.places = np.cumsum(sizes + 1) - (sizes + 1)
        self.stream = np.zeros(int((sizes + 1).sum()) + 1, np.uint32)
        self.stream[ragged(self.places + 1, sizes)] = stream[ragged(starts[at], sizes)]

    def grams(self, orders) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of n-grams, order by order and part by part, and the distinct word of each (ascending)."""
        longest = max(orders)
        for low in range(0, len(self.stream), CHUNK):
            part = self.stream[low : low + CHUNK + longest - 1]
            for order in orders:
                hashes, at = grams(part, order)
                at = at[at < CHUNK]
                yield hashes[: len(at)], np.searchsorted(self.places, low + at, "right") - 1

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's words of a row of values for each distinct word."""
        out = np.zeros((len(self.firsts) - 1, values.shape[1]), np.int64)
        full = np.flatnonzero(np.diff(self.firsts))
        if len(full):
            for k in range(values.shape[1]):
                out[full, k] = np.add.reduceat(values[self.codes, k], self.firsts[full])
        return out


class Filters:
    """``rows``: a mask a row, as 64-bit words, two bits a language. ``names``: the languages, sorted. sets: each one's n-grams by rank within their order, as hashes and ranks from 0 to 1."""

    def __init__(self, names: list[str], sets: list[tuple[np.ndarray, np.ndarray]], orders: tuple[int, ...] = tuple(KEPT)):
        self.names, self.orders = names, orders
        slices = [members for grams_, ranks in sets for members in (grams_, grams_[ranks < 1 / CORE])]
        most = max((len(s) for s in slices), default=0)
        self.rows = np.zeros((1 << max(8, (BITS_EACH * most - 1).bit_length()), max(1, -(-len(slices) // 64))), U64)
        for k, members in enumerate(slices):
            for at in self.places(members):
                self.rows[at, k // 64] |= U64(1 << (k % 64))
        # Of what a slice lacks, so much passes: the share of its set bits to the power of HASHES.
        self.chance = (self.counts(self.rows, np.zeros(len(self.rows), np.int64), 1)[0] / len(self.rows)) ** HASHES

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield (mix(hashes + U64(k)) & U64(len(self.rows) - 1)).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The slices that contain each n-gram, as bit masks (none is missed, some pass by chance): language k has bits 2k and 2k + 1."""
        first, *others = self.places(hashes)
        out = self.rows[first]
        for at in others:
            out &= self.rows[at]
        return out

    def counts(self, masks: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """For each text (sorted) and slice the number of masks with that bit."""
        out = np.zeros((n, 2 * len(self.names)), np.int64)
        if len(texts):
            new = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
            for k in range(out.shape[1]):
                out[texts[new], k] = np.add.reduceat((masks[:, k // 64] >> U64(k % 64) & U64(1)).astype(np.uint8), new, dtype=np.int64)
        return out

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams by language, and each text's number of n-grams. Each distinct word is looked up once."""
        words = Words(texts)
        hits, size = np.zeros((words.count, 2 * len(self.names)), np.int64), np.zeros(words.count, np.int64)
        for hashes, owner in words.grams(self.orders):
            hits += self.counts(self.masks(hashes), owner, words.count)
            size += np.bincount(owner, minlength=words.count)
        hits, size = words.by_text(hits), words.by_text(size[:, None])[:, 0]
        share = np.maximum(0, (hits / np.maximum(size, 1)[:, None] - self.chance) / np.maximum(1 - self.chance, 1e-9))
        return share.reshape(len(texts), len(self.names), 2).mean(2), size

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its corrected share, and how far it is ahead of the next. A tie goes to the first name."""
        share, size = self.evidence(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best, known = share.argmax(1), size > 0
        ordered = np.sort(share, axis=1)
        ahead = ordered[:, -1] - (ordered[:, -2] if len(self.names) > 1 else 0)
        at = np.arange(len(texts))
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share[at, best], 0.0).clip(0, 1), np.where(known, ahead, 0.0)


def training_rows(docs: DataFrame, most: int) -> DataFrame:
    """lang and text of at most ``most`` rows of each language, those of the smallest hash, never rows with crc32(doc_id) mod 3 = 1."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.where("lang IS NOT NULL AND text IS NOT NULL").where(F.coalesce(crc32_of_id() % 3 != 1, F.lit(False))).withColumn("order", F.xxhash64("doc_id", F.lit(13)))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # A hash decides about most rows before any are sorted, so that of a frequent language about four times as many rows as needed meet.
    share = F.least(F.lit(1.0), F.lit(4.0 * most + 1000) / F.col("rows"))
    near = usable.join(F.broadcast(sizes), "lang").where(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", F.xxhash64("text")))
    chosen = near.select("lang", "doc_id", "order", F.xxhash64("text").alias("mark"), "text").withColumn("place", place)
    return chosen.where(F.col("place") <= most).select("lang", "text")


def fit(docs: DataFrame, most: int = TRAIN_ROWS, kept: dict[int, int] | None = None) -> Filters:
    """Filters from at most ``most`` labelled rows of each language (whole texts). Each text counts alike, whatever its length."""
    kept = kept or KEPT

    def shares(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                texts = [t for t, own in zip(batch.column("text").to_pylist(), names, strict=True) if own == name]
                words = Words(texts)
                each = {order: np.zeros((words.count, 1), np.int64) for order in kept}
                parts = [(order, *found) for order in kept for found in words.grams([order])]
                for order, _, owner in parts:
                    each[order][:, 0] += np.bincount(owner, minlength=words.count)
                for order, hashes, owner in parts:
                    if not len(hashes):
                        continue
                    # A text's n-grams share UNIT among them. Whole numbers add up alike in any order.
                    own_share = UNIT // np.maximum(1, words.by_text(each[order])[:, 0])
                    weight = np.zeros(words.count, np.int64)
                    np.add.at(weight, words.codes, np.repeat(own_share, np.diff(words.firsts)))
                    found, where = np.unique(hashes, return_inverse=True)
                    total = np.zeros(len(found), np.int64)
                    np.add.at(total, where, weight[owner])
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, order, np.int32)), pa.array(found.view(np.int64)), pa.array(total)], names=["lang", "n", "gram", "share"])

    # Shares are summed in units of 2**-40; 2**23 rows a language fit in a long.
    by_gram = training_rows(docs, min(most, 1 << 22)).mapInArrow(shares, "lang string, n int, gram long, share long").groupBy("lang", "n", "gram").agg(F.sum("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("share"), "gram"))
    limit = F.create_map(*(F.lit(x) for pair in kept.items() for x in pair))
    top = by_gram.withColumn("place", place).where(F.col("place") <= max(kept.values())).withColumn("limit", F.element_at(limit, F.col("n"))).where("place <= limit")
    found = top.select("lang", "gram", ((F.col("place") - 1) / F.col("limit")).alias("rank")).toPandas()
    sets = {name: (part["gram"].to_numpy().view(U64), part["rank"].to_numpy()) for name, part in found.groupby("lang")}
    return Filters(sorted(sets), [sets[name] for name in sorted(sets)], tuple(kept))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score (corrected share of the text's n-grams, 0 to 1) and ahead (lead over the next language) for every row's whole text.

    Null texts and texts without a letter get ``und`` and 0, and so does everything where nothing was learned; all others get a learned
    language, ties the first by name. Null and repeated doc_ids are passed on row by row; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            names, score, ahead = shared.value.decide([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(ahead)], names=["doc_id", "lang_pred", "score", "ahead"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, lang_pred string, score double, ahead double")


def digest(found: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ahead")
