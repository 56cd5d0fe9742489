"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own vector (words of the training vocabulary; others get zeros) beside the mean of its character-trigram vectors,
so unseen forms of a known stem are recognised. Texts are read in all overlapping windows of ``WINDOW`` words, one at every word: attention
weighs the states of a window's words, and the score of a text is its highest window.

The recurrences are shared by all windows. A text is cut into segments of ``SEGMENT`` words; forwards each starts ``WARM`` words before its first
word (or at the text's start), backwards as many after its last, so every state knows at least ``WARM`` words of its text to its side. A window's
sums of exp(attention) and of exp(attention) times output are made by doubling: sums over 2, 4, 8, ... words, added, never subtracted.

Training is by multiple instances: in each round the windows that the present network scores highest stand for their document, so a few
words decide about a long text in training as they do later. Tasks score the training rows and send the chosen windows with their context;
the driver holds no whole text, only a round's windows and the network. The training rows are bounded (``TRAIN_TOXIC``, ``TRAIN_CLEAN``, and
``TRAIN_CHARS`` characters a text, of longer ones in excerpts from the whole of it); scoring covers every row's whole text and keeps nothing between rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.shared import crc32_of_id, saved
from labelgrid.llm.words import LOWER, U64, flat, mix, pieces, ragged, release, word_hashes, word_spans

WINDOW, SEGMENT, WARM = 32, 256, 32
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 16, 16, 12, 4096
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1200, 2400, 20_000
TRAIN_PARTS = 12
EXCERPTS = 20
EPOCHS, RANDOM_EPOCHS, BATCH, RATE = 7, 2, 192, 0.01
#: Windows a text in a round: at random, then the highest ones, of a toxic text and of a clean one (not overlapping).
AT_RANDOM, OF_TOXIC, OF_CLEAN = 3, 1, 2
LIMIT = 0.7
SLICE_BYTES = 1 << 20

#: ASCII letters, digits and all bytes of other characters belong to words.
SEPARATOR = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


class Words:
    """The words of a batch of texts: word hashes, rows, and which distinct word each one is, with the distinct words' trigrams."""

    def __init__(self, column: pa.Array):
        data, offsets = flat(column)
        starts, ends, self.firsts = word_spans(data, offsets, SEPARATOR)
        self.starts, self.ends, self.offsets = starts, ends, offsets
        hashes = word_hashes(data, starts, ends, lower=True)
        self.hashes, at, self.codes = np.unique(hashes, return_index=True, return_inverse=True)
        low, sizes = starts[at], ends[at] - starts[at]
        # Distinct words one after another, each between two marks, cut into overlapping trigrams.
        spread = np.zeros(int((sizes + 2).sum()), np.int64)
        place = np.cumsum(sizes + 2) - (sizes + 2)
        spread[ragged(place + 1, sizes)] = LOWER[data[ragged(low, sizes)]]
        self.tri_starts = np.cumsum(sizes) - sizes
        tri = ragged(place, sizes)
        code = (spread[tri] << 16) | (spread[tri + 1] << 8) | spread[tri + 2]
        self.tri = (mix(code.astype(U64)) % U64(CHAR_ROWS)).astype(np.int32)
        self.tri_sizes = sizes

    def window_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and row of every window; a row with words has at least one."""
        n = np.diff(self.firsts)
        count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
        return ragged(self.firsts[:-1], count), np.repeat(np.arange(len(n)), count)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in ``p``; ``vocabulary`` holds the sorted hashes of known words."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=1.0: (rng.normal(size=shape) * scale).astype(np.float32)
        size = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(CHAR_ROWS, CHAR_DIM, scale=0.5), "attend": draw(2 * HIDDEN, scale=0.1), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1.0, np.float32)}
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"x{d}": draw(size, 3 * HIDDEN, scale=size**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"h{d}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word's vector; 0 for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, known: np.ndarray, tri: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][tri], starts, axis=0) / sizes[:, None].astype(np.float32) if len(starts) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][known], chars], axis=1)

    def run(self, gates: dict[str, np.ndarray], codes: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Logits of windows with their context, for training. codes, inside: (windows, WARM + WINDOW + WARM) and whether a step holds a word of the text."""
        n = len(codes)
        states = np.zeros((n, WINDOW, 2 * HIDDEN), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for d, part, steps in (("f", slice(0, HIDDEN), range(WARM + WINDOW)), ("b", slice(HIDDEN, None), range(WARM + WINDOW + WARM - 1, WARM - 1, -1))):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"h{d}"]
            for t in steps:
                g, a = gates[d][codes[:, t]], h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = np.where(inside[:, t, None], c + z * (h - c), h)
                if keep:
                    tape[d].append((t, h, z, r, c, a[:, 2 * HIDDEN :]))
                h = new
                if WARM <= t < WARM + WINDOW:
                    states[:, t - WARM, part] = h
        weigh = np.where(inside[:, WARM : WARM + WINDOW], states @ self.p["attend"], -np.inf)
        weigh = np.exp(weigh - weigh.max(1, keepdims=True))
        weigh /= weigh.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weigh, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (states, weigh, pooled, tape)) if keep else logits

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def scores(self, words: Words) -> np.ndarray:
        """Highest window score of each row; 0 for rows without words."""
        out = np.zeros(len(words.firsts) - 1)
        logits, rows = self.window_logits(words)
        if len(rows):
            full = np.flatnonzero(np.diff(words.firsts))
            out[full] = 1 / (1 + np.exp(-np.maximum.reduceat(logits, np.searchsorted(rows, full))))
        return out

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and row of every window, in the order of their first words."""
        starts, rows = words.window_starts()
        if not len(starts):
            return np.zeros(0), rows
        attention, value = self.word_values(words).astype(np.float64)
        weight = np.exp(attention)
        ends = np.minimum(starts + WINDOW, words.firsts[rows + 1])
        value *= weight
        short = np.flatnonzero(ends - starts < WINDOW)  # windows of whole rows
        size = 1
        sums = [weight, value]
        while size < WINDOW:
            sums = [x[: max(0, len(x) - size)] + x[size:] for x in sums]
            size *= 2
        low, high = (np.append(x, np.zeros(len(words.codes) - len(x)))[starts] for x in sums)
        for k in short.tolist():
            low[k], high[k] = weight[starts[k] : ends[k]].sum(), value[starts[k] : ends[k]].sum()
        return high / low + float(self.p["bias"][0]), rows

    def word_values(self, words: Words) -> np.ndarray:
        """Of every word the attention logit and the output's part of its state."""
        gates = self.gates(self.inputs(self.known(words.hashes), words.tri, words.tri_starts, words.tri_sizes))
        n = np.diff(words.firsts)
        row = np.repeat(np.arange(len(n)), -(-n // SEGMENT))
        low = ragged(np.zeros(len(n), np.int64), -(-n // SEGMENT)) * SEGMENT + words.firsts[row]
        high = np.minimum(low + SEGMENT, words.firsts[row + 1])
        out = np.zeros((len(words.codes), 2), np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            begin = np.maximum(low - WARM, words.firsts[row]) if d == "f" else np.minimum(high + WARM, words.firsts[row + 1]) - 1
            size = high - begin if d == "f" else begin - low + 1
            # Longest first, so that the segments that still run stand at the front.
            order = np.argsort(-size, kind="stable")
            begin, size, first, last = begin[order], size[order], low[order], high[order]
            running = np.searchsorted(-size, -np.arange(int(size[0])), "left")
            # Update, reset and candidate gates apart and in buffers, as fresh arrays of this size would cost more than the sums. tanh of half
            # a gate gives 2 * sigmoid - 1.
            half = np.repeat(np.array([0.5, 1.0], np.float32), [2 * HIDDEN, HIDDEN])
            columns = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
            tables = [np.ascontiguousarray((gates[d] * half)[:, k]) for k in columns]
            mixers = [np.ascontiguousarray((self.p[f"h{d}"] * half)[:, k]) for k in columns]
            read = np.stack([self.p["attend"][part], self.p["out"][part]], axis=1)
            spaces = [np.empty((len(size), HIDDEN), np.float32) for _ in range(6)]
            held, found = np.zeros((len(size), HIDDEN), np.float32), np.empty((len(size), 2), np.float32)
            for t, k in enumerate(running.tolist()):
                at = begin[:k] + t if d == "f" else begin[:k] - t
                codes, h = words.codes[at], held[:k]
                z, r, c, az, ar, ac = (x[:k] for x in spaces)
                for gate, sums, table, mixer in zip((z, r, c), (az, ar, ac), tables, mixers, strict=True):
                    np.take(table, codes, axis=0, out=gate, mode="clip")
                    np.matmul(h, mixer, out=sums)
                for gate, sums in ((z, az), (r, ar)):
                    gate += sums
                    np.tanh(gate, out=gate)
                    gate *= 0.5
                    gate += 0.5
                ac *= r
                c += ac
                np.tanh(c, out=c)
                h -= c
                h *= z
                h += c
                np.matmul(h, read, out=found[:k])
                if t >= WARM:
                    out[at] += found[:k]
                else:
                    own = (at >= first[:k]) & (at < last[:k])
                    out[at[own]] += found[:k][own]
        return out.T

    def gradients(self, words: Words, known: np.ndarray, codes: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over windows, back through attention, both recurrences and the inputs."""
        used, codes = np.unique(codes, return_inverse=True)
        codes = codes.reshape(inside.shape)
        sizes, n, p = words.tri_sizes[used], len(labels), self.p
        tri = words.tri[ragged(words.tri_starts[used], sizes)]
        x = self.inputs(known[used], tri, np.cumsum(sizes) - sizes, sizes)
        logits, (states, weigh, pooled, tape) = self.run(self.gates(x), codes, inside, keep=True)
        d_logit = ((sigmoid(logits) - labels) / n).astype(np.float32)
        grad = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weigh = np.einsum("nth,nh->nt", states, d_pooled)
        d_score = weigh * (d_weigh - (weigh * d_weigh).sum(1, keepdims=True))
        grad["attend"] = np.einsum("nt,nth->h", d_score, states)
        d_states = np.zeros((n, WARM + WINDOW + WARM, 2 * HIDDEN), np.float32)
        d_states[:, WARM : WARM + WINDOW] = weigh[:, :, None] * d_pooled[:, None, :] + d_score[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, d_h = p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
            d_gates, d_u = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(u)
            for t, h, z, r, c, a in reversed(tape[d]):
                d_h = d_h + d_states[:, t, part]
                here = inside[:, t, None]
                d_new = np.where(here, d_h, 0)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * a * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_c], axis=1)
                d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
                np.add.at(d_gates, codes[:, t], d_g)
                d_u += h.T @ d_a
                d_h = np.where(here, d_new * z, d_h) + d_a @ u.T
            grad |= {f"h{d}": d_u, f"x{d}": x.T @ d_gates, f"b{d}": d_gates.sum(0)}
            d_x += d_gates @ p[f"x{d}"].T
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], known[used], d_x[:, :WORD_DIM])
        grad["word"][0] = 0
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], tri, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0).astype(np.float32))
        return grad


def window_codes(words: Words, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of windows and their context, step by step, and which steps lie in the text."""
    at = starts[:, None] + np.arange(-WARM, WINDOW + WARM)
    inside = (at >= words.firsts[rows][:, None]) & (at < words.firsts[rows + 1][:, None])
    return words.codes[np.clip(at, 0, len(words.codes) - 1)], inside


def choose(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of each row's windows (starts ascending) the places of the highest value, then of the highest that doesn't overlap it, and so on."""
    picked, left = [], values.astype(np.float64, copy=True)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    for turn in range(int(most.max(initial=0))):
        best = np.maximum.reduceat(left, first)
        at = np.flatnonzero((left == np.repeat(best, np.diff(np.append(first, len(rows))))) & np.isfinite(left))
        at = at[np.unique(rows[at], return_index=True)[1]]
        at = at[most[rows[at]] > turn]
        picked.append(at)
        low, high = np.searchsorted(starts, starts[at] - WINDOW, "right"), np.searchsorted(starts, starts[at] + WINDOW)
        size = high - low
        near = ragged(low, size)
        near = near[rows[near] == np.repeat(rows[at], size)]
        left[near] = -np.inf
    return np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)


EXAMPLES = "doc_id long, toxic int, start long, before int, inside int, context string"


def examples(rows: DataFrame, network: Network | None, turn: int) -> DataFrame:
    """Windows of the training rows (doc_id, toxic, text) with their context: at random where ``network`` is None, else the highest."""
    model = rows.sparkSession.sparkContext.broadcast(network)

    def part(batches) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in pieces(batches, "text", SLICE_BYTES // 2):
            words, texts = Words(batch.column("text")), batch.column("text").cast(pa.binary()).to_pylist()
            starts, of = words.window_starts()
            if not len(starts):
                continue
            ids, toxic = batch.column("doc_id").to_numpy(), batch.column("toxic").to_numpy()
            if net is None:
                values = mix(ids[of].view(U64) * U64(0x9E3779B97F4A7C15) + (starts - words.firsts[of]).astype(U64) + U64(turn << 40)).astype(np.float64)
                most = np.full(len(ids), AT_RANDOM)
            else:
                values, most = net.window_logits(words)[0], np.where(toxic == 1, OF_TOXIC, OF_CLEAN)
            at = choose(values, starts, of, most)
            starts, of = starts[at], of[at]
            low, end = np.maximum(starts - WARM, words.firsts[of]), words.firsts[of + 1]
            high = np.minimum(starts + WINDOW + WARM, end)
            base = words.offsets
            texts = [texts[r][words.starts[a] - base[r] : words.ends[b - 1] - base[r]] for r, a, b in zip(of.tolist(), low.tolist(), high.tolist(), strict=True)]
            columns = [ids[of], toxic[of], starts - words.firsts[of], (starts - low).astype(np.int32), (np.minimum(starts + WINDOW, end) - starts).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "toxic", "start", "before", "inside", "context"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(part, EXAMPLES)


def vocabulary_of(rows: DataFrame, least: int = 3) -> np.ndarray:
    """Sorted hashes of the words of at least ``least`` training rows."""

    def part(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES // 2):
            words = Words(batch.column("text"))
            seen = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(words.firsts)) * len(words.hashes) + words.codes) % max(1, len(words.hashes))
            found, count = np.unique(seen, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes[found].view(np.int64)), pa.array(count)], names=["word", "n"])

    found = rows.select("text").mapInArrow(part, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word").toPandas()
    return np.sort(found["word"].to_numpy(np.int64).view(U64))


def train(rows: DataFrame, seed: int = 5) -> Network | None:
    """A network for the training rows (doc_id, toxic, text), or None where one of the classes has no row with words. The same rows give the same network."""
    net, rng = None, np.random.default_rng(seed)
    step, moments = 0, {}
    for epoch in range(EPOCHS):
        found = examples(rows, net if epoch >= RANDOM_EPOCHS else None, epoch).toPandas().sort_values(["doc_id", "start"], kind="stable")
        labels = found["toxic"].to_numpy(np.float32)
        if len(set(labels.tolist())) < 2:
            return None
        if net is None:
            net = Network(vocabulary_of(rows), seed)
            moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        words = Words(pa.array(found["context"], pa.string()))
        known, before, inner = net.known(words.hashes), found["before"].to_numpy(), found["inside"].to_numpy()
        picked = rng.permutation(len(found))
        for at in range(0, len(picked), BATCH):
            part = picked[at : at + BATCH]
            codes, inside = window_codes(words, words.firsts[part] + before[part], part)
            # A window of a short text ends with it; what follows up to WINDOW words is no part of it.
            inside[:, WARM : WARM + WINDOW] &= np.arange(WINDOW) < inner[part][:, None]
            step += 1
            for k, g in net.gradients(words, known, codes, inside, labels[part]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        release()
    return net


def excerpts(text: str) -> Column:
    """The text, or of a text of more than TRAIN_CHARS characters EXCERPTS pieces spread evenly from its start to its end."""
    size, n = TRAIN_CHARS // EXCERPTS, F.length(text)
    parts = [F.substring(F.col(text), F.floor((n - size) * k / (EXCERPTS - 1)).cast("int") + 1, F.lit(size)) for k in range(EXCERPTS)]
    return F.when(n <= TRAIN_CHARS, F.col(text)).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Network | None:
    """Train on at most ``toxic`` + ``clean`` labelled rows, those of the smallest hash, never on rows with crc32(doc_id) mod 3 = 1.

    None where the labels don't hold both classes; an error where they do and a class has no text.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc32_of_id() % 3 != 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    texts = texts.withColumn("text", excerpts("text"))
    # Ids first: at most so many of each class, twice what is used as some have no text. Then only their texts are fetched.
    order = F.xxhash64("doc_id", F.lit(11))
    ids = [usable.where(F.col("toxic") == t).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(2 * most) for t, most in ((1, toxic), (0, clean))]
    found = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    parts = [found.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(most) for t, most in ((1, toxic), (0, clean))]
    rows = saved(parts[0].unionByName(parts[1]).repartition(TRAIN_PARTS, "doc_id"), "toxicity-training")
    network = train(rows)
    if network is None and usable.select("toxic").distinct().count() == 2:
        raise ValueError("toxicity labels hold both classes, but no labelled row of one of them has a text with words")
    return network


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text.

    A null or empty text, or one without words, scores 0; so does everything where there was nothing to learn from (``network`` is None).
    Null and repeated doc_ids are passed on row by row; an empty table gives an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in pieces(batches, "text", SLICE_BYTES):
            found = net.scores(Words(batch.column("text"))) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double")


def clean_rows(docs: DataFrame, network: Network | None, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    model, names = docs.sparkSession.sparkContext.broadcast(network), docs.columns
    if network is None:
        return docs

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            low = model.value.scores(Words(batch.column("text"))) < limit
            yield batch.filter(pa.array(low)).rename_columns(names)

    return docs.mapInArrow(rows, docs.schema)


def digest(scored: DataFrame, limit: float = LIMIT) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
