"""Text columns: error rates and character codes."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_CODE = 65536  # token codes start above the BMP: no surrogates, over a million tokens per pair
LONG_CELLS = 1 << 16
FREQUENT = 64
KEPT_BITS = 1 << 26
LANE_BITS = 1 << 16
BLEU_CHARS = 1 << 21


def squeeze(text: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref == 0, n_hyp.cast("double")).otherwise(distance / n_ref)


def _bytes_of(at: list[int], n: int) -> bytes:
    """The bits ``at`` of a lane of ``n`` and one more, in whole bytes."""
    out = bytearray((n >> 3) + 1)
    for i in at:
        out[i >> 3] |= 1 << (i & 7)
    return bytes(out)


def _places(left: Sequence[Hashable]) -> dict[Hashable, list[int]]:
    places: dict[Hashable, list[int]] = {}
    for i, item in enumerate(left):
        places.setdefault(item, []).append(i)
    return places


def _step(same: int, rise: int, fall: int, full: int, low: int) -> tuple[int, int]:
    """The next column's rises and falls; ``full`` and ``low`` have the bits of all lanes and the lowest ones."""
    level = (((same & rise) + rise) ^ rise) | same
    up, down = (fall | (full & ~(level | rise))) << 1 | low, (rise & level) << 1
    same |= fall
    return full & (down | ~(same | up)), full & up & same


def bit_distance(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """Edit distance with one column of the table as the bits of whole numbers: rises and falls from cell to cell, one step an item of ``right``.

    A step costs a few operations on numbers of ``len(left)`` bits. Bits of an item are kept if it is frequent and made anew if not, so
    memory stays small for texts of many different words.
    """
    n = len(left)
    if not n:
        return len(right)
    places = _places(left)
    kept = {item: int.from_bytes(_bytes_of(at, n), "little") for item, at in places.items() if len(at) > FREQUENT or n <= FREQUENT}
    full, rise, fall = (1 << n) - 1, (1 << n) - 1, 0
    for item in right:
        same = kept[item] if item in kept else int.from_bytes(_bytes_of(places.get(item, ()), n), "little")
        rise, fall = _step(same, rise, fall, full, 1)
    # the last column: from the number of steps on top down all rises and falls
    return len(right) + rise.bit_count() - fall.bit_count()


def bit_distances(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> list[int]:
    """:func:`bit_distance` of many pairs: about ``LANE_BITS`` bits of columns stand side by side in one number, each in a lane of whole bytes
    with a spare bit that stops its carry, so a step of all of them costs what one of a single pair does. Pairs with too many different items
    for their bits to be kept go alone."""
    out = [0] * len(pairs)
    lanes: list[tuple[int, int, list[bytes]]] = []

    def run() -> None:
        """Steps of all lanes; the first one is the shortest, and is taken off when it ends."""
        width = [8 * ((n >> 3) + 1) for _, n, _ in lanes]
        full = int.from_bytes(b"".join([((1 << n) - 1).to_bytes(w >> 3, "little") for (_, n, _), w in zip(lanes, width, strict=True)]), "little")
        low = int.from_bytes(b"".join([(1).to_bytes(w >> 3, "little") for w in width]), "little")
        rise, fall = full, 0
        rest = [iter(steps) for _, _, steps in lanes]
        for k, (row, n, steps) in enumerate(lanes):
            for same in zip(*rest[k:]):
                rise, fall = _step(int.from_bytes(b"".join(same), "little"), rise, fall, full, low)
            lane = (1 << n) - 1
            out[row] = len(steps) + (rise & lane).bit_count() - (fall & lane).bit_count()
            rise, fall, full, low = (x >> width[k] for x in (rise, fall, full, low))
        lanes.clear()

    bits = 0
    for row in sorted(range(len(pairs)), key=lambda row: len(pairs[row][1])):
        left, right = pairs[row]
        n, places = len(left), _places(left)
        if not n or len(places) * n > KEPT_BITS:
            out[row] = bit_distance(left, right)
            continue
        if bits + n > LANE_BITS and lanes:
            run()
            bits = 0
        kept, none = {item: _bytes_of(at, n) for item, at in places.items()}, bytes((n >> 3) + 1)
        lanes.append((row, n, [kept.get(item, none) for item in right]))
        bits += n
    run()
    return out


@F.pandas_udf(T.IntegerType())
def long_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    out = pd.Series(pd.arrays.IntegerArray(np.zeros(len(left), np.int32), np.ones(len(left), bool)))
    if not len(known):
        return out
    out.iloc[known] = bit_distances([(left.iloc[i], right.iloc[i]) for i in known.tolist()])
    return out


def edit_distance(left: Column, right: Column) -> Column:
    """Exact edit distance. Pairs of long texts go through :func:`bit_distance`, at a 64th of the steps; the others stay on the JVM and pass it as nulls."""
    is_long = F.length(left).cast("long") * F.length(right) > LONG_CELLS
    apart = long_distance(F.when(is_long, left), F.when(is_long, right))
    return F.when(is_long, apart).otherwise(F.levenshtein(F.when(is_long, F.lit("")).otherwise(left), F.when(is_long, F.lit("")).otherwise(right)))


def cer(ref: Column, hyp: Column, squeezed: tuple[Column, Column] | None = None) -> Column:
    """Character error rate; an empty reference with any text against it is 1. ``squeezed``: both texts after :func:`squeeze`, if they are at hand."""
    r, h = squeezed or (squeeze(ref), squeeze(hyp))
    rate = _rate(edit_distance(r, h), F.length(r), F.length(h))
    return F.when((F.length(ref) == 0) & (F.length(hyp) != 0), F.lit(1e0)).otherwise(rate)


@F.pandas_udf(T.StructType([T.StructField("r", T.StringType()), T.StructField("h", T.StringType())]))
def token_codes(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Both texts with each distinct token of the pair as one character."""
    def code(words, seen):
        return "".join(chr(FIRST_CODE + seen.setdefault(w, len(seen))) for w in words)

    out = []
    for r, h in zip(ref, hyp):
        seen: dict[str, int] = {}
        out.append((None, None) if r is None or h is None else (code(r.split(), seen), code(h.split(), seen)))
    return pd.DataFrame(out, columns=["r", "h"])


def wer_of_codes(codes: Column) -> Column:
    """Token error rate from :func:`token_codes`; an empty reference gives the hypothesis tokens.

    One character per token, so the built-in edit distance counts tokens.
    """
    r, h = codes["r"], codes["h"]
    return _rate(edit_distance(r, h), F.length(r), F.length(h))


def ngram_hits(refs: list[str], hyps: list[str], max_n: int) -> np.ndarray:
    """Matches of each order 1 .. ``max_n`` (columns), clipped to the rarer side, for each pair of texts (rows).

    All pairs go through one order at a time. A gram is the number of the gram
    one shorter at its place and the next character; first come pair numbers, so
    pairs never meet. Places whose gram occurs on one side only are dropped, as
    nothing longer can match there either.
    """
    texts = [t for pair in zip(refs, hyps, strict=True) for t in pair]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    side = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    pair, is_hyp = side // 2, side % 2 == 1
    at, gram = np.arange(len(chars)), pair
    hits = np.zeros((len(refs), max_n), np.int64)
    for n in range(1, max_n + 1):
        room = at + n <= end[at]
        at, gram = at[room], gram[room]
        if not len(at):
            break
        gram, distinct = pd.factorize(gram << 21 | chars[at + n - 1])
        of_hyp = np.bincount(gram[is_hyp[at]], minlength=len(distinct))
        clipped = np.minimum(of_hyp, np.bincount(gram, minlength=len(distinct)) - of_hyp)
        owner = np.empty(len(distinct), np.int64)
        owner[gram] = pair[at]
        hits[:, n - 1] = np.bincount(owner, clipped, len(refs))
        both = clipped[gram] > 0
        at, gram = at[both], gram[both]
    return hits


def bleu_scores(max_n: int):
    """Column function of two texts: cumulative BLEU of the orders 1 .. ``max_n`` as one array."""

    def block(refs: list[str], hyps: list[str]) -> np.ndarray:
        r, h = (np.array([[len(t)] for t in texts], float) for texts in (refs, hyps))
        n = np.arange(1, max_n + 1)
        share = ngram_hits(refs, hyps, max_n) / np.maximum(h - n + 1, 1)
        penalty = np.where(h > r, 1.0, np.exp(1 - r / np.maximum(h, 1)))
        score = penalty * np.exp(np.cumsum(np.log(np.maximum(share, 1e-300)), axis=1) / n)
        return np.where(np.minimum.accumulate(share, axis=1) <= 0, 0.0, score)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        refs, hyps = ref.fillna("").tolist(), hyp.fillna("").tolist()
        part = np.cumsum([len(r) + len(h) for r, h in zip(refs, hyps, strict=True)]) // BLEU_CHARS
        out: list[np.ndarray] = []
        for some in np.split(np.arange(len(refs)), np.flatnonzero(np.diff(part)) + 1):
            out += list(block([refs[i] for i in some], [hyps[i] for i in some])) if len(some) else []
        return pd.Series(out, dtype=object)

    return scores


def drop_punctuation(text: Column) -> Column:
    """Keep letters, digits and underscores."""
    return F.regexp_replace(text, r"(?U)\W+", "")


def labels_to_frames(labels: Column, n_inputs: int, gap: int) -> Column:
    """One-hot rows per label with ``gap`` blank rows before, between and after; blank is the last input."""
    hot = lambda k: F.transform(F.sequence(F.lit(0), F.lit(n_inputs)), lambda i: (i == k).cast("int"))
    blank = hot(F.lit(n_inputs))
    gaps = F.array_repeat(blank, gap)
    rows = F.flatten(F.transform(labels, lambda v: F.concat(F.array(hot(F.when(v == 0, n_inputs).otherwise(v - 1))), gaps)))
    return F.concat(gaps, rows)
