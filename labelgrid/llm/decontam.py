"""Benchmark decontamination by templates.

Words are canonicalised one by one: outer punctuation goes, numbers, names (words of one capital and small letters) and units become typed
placeholders, all else is compared in lower case. Windows of ``WINDOW`` canonical words are hash-joined between benchmark and documents;
windows with too few plain words say nothing and are left out. A window with names is joined a second time with the names spelt out in lower
case, so that case decides nothing. Matches of one item in one document are grouped by their offset, and the slots are checked: what stands
in the item's placeholders goes over to the document's by one mapping, and windows against the mapping of the majority don't count. So a
question asked again with other numbers or names is caught, and a chance mixture of windows is not.

Document windows that cannot occur in the benchmark are dropped where they are read, by a bitmap of the benchmark's window hashes whose size
is bounded: a larger benchmark only lets more windows through to the join, which decides. Each benchmark window is repeated
``SALTS`` times, so that a passage found in very many documents is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.shared import bit_filter, passes, saved, unused
from labelgrid.llm.words import U64, Runs, flat, pieces, windows, word_hashes, word_spans

WINDOW = 8
PLAIN_WORDS = 4
COVERAGE = 0.5
WORDS = 13
QUOTE = 24
SALTS = 16
SLICE_BYTES = 4 << 20

# Words that count as numbers, and as units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent mph kmh watt watts volt volts".split()

PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
NUMERIC = np.array([c < 128 and (chr(c).isdigit() or chr(c) in ".,:/-") for c in range(256)])
DIGIT = np.array([48 <= c < 58 for c in range(256)])
STOP = np.array([chr(c) in ".!?" for c in range(256)])
CAPITAL = np.array([65 <= c < 91 for c in range(256)])
#: By kind of window; a window taken word for word meets only its like.
VERBATIM = (U64(0), U64(0), U64(0x61C8864680B583EB))
NUMBER, NAME, UNIT = U64(0x9D8C2B7E11F3A501), U64(0x5B1F7C3D99E24A03), U64(0x2E6A90D4C7B81F05)


def list_hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words))
    return word_hashes(data, offsets[:-1], offsets[1:], lower=True)


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical value and filler (hash of the bare word in lower case) of every word of every row, each row's first word, and which words start a sentence."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, offsets = flat(column)
    starts, ends, firsts = word_spans(data, offsets)
    raw_ends = ends
    starts, ends = bare(data, starts, ends)
    low, low_offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))  # the same words: only ASCII space parts them
    low_starts, low_ends, _ = word_spans(low, low_offsets)
    filler = word_hashes(low, *bare(low, low_starts, low_ends))
    opens = np.zeros(len(filler), bool)
    if not len(filler):
        return filler, filler, firsts, opens
    count = lambda kind: np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
    numeric, capitals, stops, lead = count(NUMERIC), count(CAPITAL), count(STOP), data[starts]
    size = ends - starts
    accent = (lead == 0xC3) & (data[np.minimum(starts + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(starts + 1, len(data) - 1)] <= 0x9E)
    name = (CAPITAL[lead] & (capitals[ends] - capitals[starts] == 1) & (size > 1)) | (accent & (capitals[ends] - capitals[starts] == 0) & (size > 2))
    number = DIGIT[lead] & (numeric[ends] - numeric[starts] == size)
    number |= np.isin(filler, list_hashes(NUMBER_WORDS))
    unit = np.isin(filler, list_hashes(UNIT_WORDS))
    opens[1:] = stops[raw_ends[:-1]] > stops[ends[:-1]]
    opens[firsts[:-1][firsts[:-1] < len(opens)]] = True
    return np.select([number, unit, name], [NUMBER, UNIT, NAME], filler), filler, firsts, opens


def bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without outer punctuation."""
    while len(starts) and (more := (starts < ends - 1) & PUNCTUATION[data[starts]]).any():
        starts = starts + more
    while len(starts) and (more := (starts < ends - 1) & PUNCTUATION[data[ends - 1]]).any():
        ends = ends - more
    return starts, ends


def template_windows(column: pa.Array, size: int = WINDOW, plain: int = PLAIN_WORDS):
    """Start word, hash and row of every window, the slots of chosen ones, whether each is a template, and each row's first word.

    A window with names is there twice: as a template, and with its names as the plain words they are, in lower case. So a copy in
    another case, in which names can't be told, still meets one of the two. A window of fewer than ``plain`` plain words even so, as in a row of
    numbers, would say little as a template; it stands there word for word, without placeholders.
    """
    values, filler, firsts, opens = canonical(column)
    spelt = np.where(values == NAME, filler, values)
    at = windows(firsts, size)
    found, kinds = [], (values, spelt, filler)
    enough = []
    for own in (values, spelt):
        free = np.concatenate([[0], np.cumsum(own == filler)])
        enough.append(free[at + size] - free[at] >= plain)
    names = np.concatenate([[0], np.cumsum(values == NAME)])
    twice = names[at + size] > names[at]  # without names both are the same
    for kind, use in enumerate((enough[0], enough[1] & twice, ~enough[1])):
        own = at[use]
        found.append((own, Runs(kinds[kind]).of(own, own + size) ^ VERBATIM[kind] if len(own) else np.zeros(0, U64), np.full(len(own), kind)))
    at, hashes, kind = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.searchsorted(firsts, at, "right") - 1
    slots = lambda use: np.concatenate([slots_of(at[use & (kind == k)], own, filler, opens, size) for k, own in enumerate(kinds)])
    return at, hashes.view(np.int64), rows, slots, kind == 0, firsts


def slots_of(at: np.ndarray, values: np.ndarray, filler: np.ndarray, opens: np.ndarray, size: int) -> np.ndarray:
    """Fillers of the placeholders of each window; a plain word's place holds 0. The last bit tells names within a sentence."""
    span = at[:, None] + np.arange(size)
    strict = (values == NAME) & ~opens
    marked = np.where(strict, filler | U64(1), filler & ~U64(1))
    return np.where(values[span] == filler[span], U64(0), marked[span]).view(np.int64)


def lists(held: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, held.size + 1, held.shape[1], dtype=np.int32), pa.array(held.ravel()))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, item_pos, window, item_slots, counts, item_windows: every window of the benchmark, in positions without gaps.

    ``counts``: the position is one of the item's ``item_windows``, those of its templates, or of all windows where it has no template.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            at, hashes, of, slots, template, firsts = template_windows(batch.column("text"), size)
            templates = np.bincount(of[template], minlength=batch.num_rows)
            counted = np.isin(at, at[template]) | (templates[of] == 0)
            count = np.bincount(of[template | (templates[of] == 0)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(of)), pa.array(at - firsts[of]), pa.array(hashes), lists(slots(template | True)), pa.array(counted), pa.array(count[of])],
                names=["item_id", "item_pos", "window", "item_slots", "counts", "item_windows"],
            )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    return items.mapInArrow(rows, "item_id long, item_pos long, window long, item_slots array<long>, counts boolean, item_windows long")


def covered(starts, size: int) -> int:
    """Words in the union of windows."""
    total, end = 0, -1
    for at in sorted(starts):
        total += at + size - max(at, end)
        end = at + size
    return total


def longest(starts, size: int) -> int:
    """Words of the longest run of overlapping or touching windows."""
    best, low, end = 0, 0, -1
    for at in sorted(starts):
        low = low if at <= end else at
        end = at + size
        best = max(best, end - low)
    return best


def agreeing(found: list[tuple[int, list[int], list[int]]], size: int, quote: int = QUOTE) -> tuple[set[int], bool]:
    """Item positions of the windows of one shift that keep to one mapping of fillers, and whether every filler stayed the same.

    Each filler goes over to what most of its places hold (at a tie, to itself, then to the smaller hash); windows with another pair are left
    out. Where a name within a sentence becomes two, the names don't tell the same story: only what stands there word for word counts,
    and only in a run of ``quote`` words.
    """
    places: dict[tuple[int, int], set[int]] = {}
    names: dict[int, set[int]] = {}
    for at, a, b in found:
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x:
                places.setdefault((x | 1, y | 1), set()).add(at + k)
                if x & 1:
                    names.setdefault(x, set()).add(y | 1)
    same = {at for at, a, b in found if all(x | 1 == y | 1 for x, y in zip(a, b, strict=True) if x)}
    if any(len(v) > 1 for v in names.values()):
        return (same, True) if longest(same, size) >= quote else (set(), True)
    goes: dict[int, tuple] = {}
    for (x, y), where in places.items():
        goes[x] = max(goes.get(x, (0, False, 0, 0)), (len(where), x == y, -y, y))
    kept = {at for at, a, b in found if all(goes[x | 1][3] == y | 1 for x, y in zip(a, b, strict=True) if x)}
    return kept, kept <= same


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, words: int = WORDS) -> DataFrame:
    """doc_id, text_md5, item_id, matched and item_windows, coverage, words, same_words: each document that holds enough of a benchmark item.

    Enough is a share ``coverage`` of the item's windows; or ``words`` words in windows of one shift; or as many over several shifts, if
    they are the share ``coverage`` of the item's words in windows. A window or word of either side counts once, however often the other
    side repeats it.

    Rows without doc_id take part and are reported with null. Repeated rows are reported once for each doc_id and text. Null and empty texts,
    and texts or items of fewer than ``size`` words, match nothing. Items that repeat an item_id count with one text, the smallest. Empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = saved(benchmark_windows(benchmark, size), "items")
    filter_bits = spark.sparkContext.broadcast(bit_filter(items.select(F.col("window").alias("h"))))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        have = filter_bits.value
        for batch in pieces(batches, "text", SLICE_BYTES):
            at, hashes, of, slots, _, firsts = template_windows(batch.column("text"), size)
            hit = passes(have, hashes)
            at, hashes, of, slots = at[hit], hashes[hit], of[hit], slots(hit)
            texts = batch.column("text")
            keys = {int(i): hashlib.md5(texts[int(i)].as_py().encode()).hexdigest() for i in np.unique(of)}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), pa.array([keys[i] for i in of.tolist()], pa.string()), pa.array(at - firsts[of]), pa.array(hashes), lists(slots)],
                names=["doc_id", "text_md5", "pos", "window", "slots"],
            )

    def fitting(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, found in enumerate(batch.column("found").to_pylist()):
                kept, same = agreeing([(w["item_pos"], w["item_slots"], w["slots"]) for w in found], size)
                counts = {w["item_pos"]: w["counts"] for w in found}
                run = covered(kept, size)
                out += [(row, at, counts[at], run, same) for at in sorted(kept)]
            row, at, counts, run, same = zip(*out, strict=True) if out else ((),) * 5
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in one), pa.array(at, pa.int64()), pa.array(counts, pa.bool_()), pa.array(run, pa.int64()), pa.array(same, pa.bool_())], names=[*one, "item_pos", "counts", "run", "same"]
            )

    def summed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = ([covered(x, size) for x in batch.column(c).to_pylist()] for c in ("items", "places"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_names), pa.array(map(min, ours, theirs), pa.int64())], names=[*kept_names, "words"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = chosen.mapInArrow(rows, "doc_id long, text_md5 string, pos long, window long, slots array<long>")
    found = found.withColumn("salt", F.pmod(F.xxhash64("text_md5", "doc_id"), F.lit(SALTS)).cast("int"))
    spread = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = found.join(spread, ["window", "salt"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    # A shift pairs each window of the item with one of the document, so a group is no larger than the item.
    one = ["doc_id", "text_md5", "item_id", "item_windows", "shift"]
    runs = met.groupBy(*one).agg(F.collect_set(F.struct("item_pos", "counts", "item_slots", "slots")).alias("found"))
    fits = runs.mapInArrow(fitting, "doc_id long, text_md5 string, item_id long, item_windows long, shift long, item_pos long, counts boolean, run long, same boolean")
    counted = F.when(F.col("counts"), F.col("item_pos")), F.when(F.col("counts"), F.col("item_pos") + F.col("shift"))
    total = fits.groupBy(*one[:4]).agg(
        F.least(*(F.size(F.collect_set(c)) for c in counted)).cast("long").alias("matched"),
        F.collect_set("item_pos").alias("items"),
        F.collect_set(F.col("item_pos") + F.col("shift")).alias("places"),
        F.max("run").alias("run"),
        F.min("same").alias("same_words"),
    )
    kept_names = [*one[:4], "matched", "run", "same_words"]
    total = total.mapInArrow(summed, "doc_id long, text_md5 string, item_id long, item_windows long, matched long, run long, same_words boolean, words long")
    lengths = items.groupBy("item_id").agg((F.countDistinct("item_pos") + size - 1).alias("item_words"))
    share = F.col("matched") / F.col("item_windows")
    enough = (share >= coverage) | (F.col("run") >= words) | ((F.col("words") >= words) & (F.col("words") >= F.col("item_words") * coverage))
    return total.join(lengths, "item_id").where(enough).select("doc_id", "text_md5", "item_id", "matched", "item_windows", share.alias("coverage"), "words", "same_words")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns. Null texts stay."""
    md5 = unused(docs, "leak_md5")
    hit = saved(matches(docs, benchmark).select(F.col("text_md5").alias(md5)).distinct(), "leaks")
    return docs.join(hit, F.md5(docs["text"].cast("string").cast("binary")) == hit[md5], "left_anti")
