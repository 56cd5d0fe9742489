"""Text metrics and label codecs that need more than one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions.text import bleu_scores, cer, squeeze, token_codes, wer_of_codes
from labelgrid.operators.banding import lookback_window, row_index


def error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """CER of each ``(ref, hyp)`` row, where the row is: input splits spread the work, no text is shuffled."""
    both = pairs.withColumns({"_ref": squeeze(F.col("ref")), "_hyp": squeeze(F.col("hyp"))})
    return both.withColumn("cer", cer(F.col("ref"), F.col("hyp"), (F.col("_ref"), F.col("_hyp")))).drop("_ref", "_hyp")


def word_error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """WER of each ``(ref, hyp)`` row, like :func:`error_rates`."""
    coded = pairs.withColumn("_codes", token_codes("ref", "hyp"))
    return coded.withColumn("wer", wer_of_codes(F.col("_codes"))).drop("_codes")


def bleu(pairs: DataFrame, keys: list[str], max_n: int = 49) -> DataFrame:
    """Cumulative character BLEU of each ``(ref, hyp)`` row for n = 1 .. ``max_n``, uniform weights, brevity penalty.

    0 once any order has no match, for an empty text and for null. Every row is
    scored where it is: no gram leaves its task.
    """
    scores = pairs.select(*keys, F.posexplode(bleu_scores(max_n)("ref", "hyp")).alias("n", "bleu"))
    return scores.withColumn("n", F.col("n") + 1)


def _by_key(rows: DataFrame, keys: list[str], value: str, merge: Callable[[list], list | str], name: str, kind: str) -> DataFrame:
    """``merge`` of all values of a key, on each of its rows. One shuffle of the rows as they are, no row per character.

    Rows with a null among their keys stand alone and merge nothing.
    """
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    own = F.when(~whole, F.xxhash64(value))
    met = rows.groupBy(*keys, own.alias("_own")).agg(F.collect_list(F.when(whole, F.col(value))).alias("_all"), F.count(F.lit(1)).alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out = [merge(values) for values in batch.column("_all").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("_n"), pa.array(out, made)], names=[*keys, "_n", name])

    made = {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}[kind]
    kinds = dict(rows.dtypes)
    done = met.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", _n bigint, {name} {kind}")
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*keys, name)


def encode_labels(texts: DataFrame, charset: DataFrame, keys: list[str], unknown: str = "drop", pad_to: int | str | None = None) -> DataFrame:
    """Characters to indices in order; unknown ones dropped, or an error.

    Zeros pad to ``pad_to`` characters, or to the ``"longest"`` text. The
    alphabet goes to the tasks as a dictionary; texts that share a key are
    merged character by character.
    """
    if pad_to == "longest":
        pad_to = texts.agg(F.max(F.length("text"))).first()[0] or 0
    known: dict[str, list[int]] = {}
    for row in charset.where("ch IS NOT NULL AND idx IS NOT NULL").select("ch", "idx").collect():
        known[row.ch] = sorted([*known.get(row.ch, []), row.idx])
    only = {ch: idx[0] for ch, idx in known.items()} if all(len(idx) == 1 for idx in known.values()) else None

    def encode(found: list[str]) -> list[int]:
        if unknown == "error":
            for ch in set("".join(found)) - known.keys():
                raise ValueError(f"character not in charset: {ch}")
        if len(found) == 1 and only is not None:
            return [only[ch] for ch in found[0] if ch in only]
        placed = sorted((pos, idx) for text in found for pos, ch in enumerate(text) for idx in known.get(ch, ()))
        return [idx for _, idx in placed]

    out = _by_key(texts, keys, "text", encode, "labels", f"array<{dict(charset.dtypes)['idx']}>")
    if pad_to is None:
        return out
    fill = F.greatest(F.lit(pad_to) - F.size("labels"), F.lit(0))
    return out.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(0), fill)))


def decode_labels(labels: DataFrame, charset: DataFrame, keys: list[str], raw: bool = False) -> DataFrame:
    """Indices back to text; 0 ends the text, or shows as a dot when ``raw``."""
    known: dict[int, list[str]] = {}
    for row in charset.where("idx IS NOT NULL").select("ch", "idx").collect():
        known[row.idx] = sorted([*known.get(row.idx, []), "⋅" if row.idx == 0 else row.ch or ""])
    known.setdefault(0, ["⋅"])
    shown = {idx: "".join(chs) for idx, chs in known.items()}

    def decode(found: list[list[int]]) -> str:
        cut = [row if raw or 0 not in row else row[: row.index(0)] for row in found]
        if len(cut) == 1:
            return "".join([shown[idx] for idx in cut[0] if idx in shown])
        placed = sorted((pos, ch) for row in cut for pos, idx in enumerate(row) for ch in known.get(idx, ()))
        return "".join(ch for _, ch in placed)

    return _by_key(labels, keys, "labels", decode, "text", "string")


def frame_symbols(frames: DataFrame) -> DataFrame:
    """Winning symbol of each frame of ``frames (line_id, t, scores)``."""
    return frames.select("line_id", "t", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("sym"))


def ctc_collapse(symbols: DataFrame) -> DataFrame:
    """Greedy CTC on ``(line_id, t, sym)``: drop blanks (0) and repeats of the previous frame.

    Kept symbols stay rows ``(line_id, t, sym)``; a line of any length is cut
    into blocks with one frame of overlap.
    """
    indexed = row_index(symbols, ["line_id"], "t")
    prev = lookback_window(indexed, ["line_id"], 1, lambda w: {"_prev": F.lag("sym").over(w)})
    return prev.where("sym <> 0 AND (_prev IS NULL OR sym <> _prev)").select("line_id", "t", "sym")


def assemble_lines(symbols: DataFrame) -> DataFrame:
    """Kept symbols as one array per line (a line of text is short by nature)."""
    return symbols.groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "sym"))), lambda e: e["sym"]).alias("labels"))
