"""Quality by hierarchical empirical Bayes: what a document's text says, shrunk toward what is known of its path, host and the whole corpus.

1. A logistic classifier on figures of the text (shares of kinds of characters, lengths and repetition of words and lines), fitted on a
   bounded sample of labelled rows, gives each document a log-likelihood ratio: its logit less that of the sample's base rate.
2. Grouped sums over all documents give the mean probability of each host and of each path (a host's rows of one language). The spread of
   host means around the corpus mean, beyond what their sizes explain, gives the weight of the corpus prior (method of moments); the spread of
   path means around their hosts gives the weight of the host prior. Sparse sites are thereby drawn to the level above.
3. A document's posterior log odds are its ratio plus the log odds of its path's posterior mean taken without the document itself.

All sums are partial aggregations, so a host with a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.words import U64, flat, pieces, word_hashes, word_spans

TRAIN_ROWS = 4000
SLICE_BYTES = 4 << 20
LIMIT = 0.5
FLOOR = 1e-4

LINE_BREAK = np.array([c == 10 for c in range(256)])
CODE = np.arange(256)
#: Kinds of bytes whose shares are figures: lower and upper case, digits, white space, sentence marks, other ASCII marks, others.
KINDS = np.select([(CODE >= 97) & (CODE < 123), (CODE >= 65) & (CODE < 91), (CODE >= 48) & (CODE < 58), np.isin(CODE, [9, 10, 11, 12, 13, 32]), np.isin(CODE, [33, 39, 44, 46, 58, 59, 63]), CODE < 128], [0, 1, 2, 3, 4, 5], 6)


def distinct_share(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Distinct values among each row's values; 1 for a row without any."""
    n = np.diff(firsts)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    return np.where(n > 0, np.bincount(rows[order][new], minlength=len(n)) / np.maximum(n, 1), 1.0)


def repeated_share(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Share of a row's values that equal the one before."""
    n = np.diff(firsts)
    rows = np.repeat(np.arange(len(n)), n)
    same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][same], minlength=len(n)) / np.maximum(n, 1)


def figures(column: pa.Array) -> np.ndarray:
    """One row of figures for each whole text; a null counts as an empty text."""
    data, offsets = flat(column)
    rows, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(rows), size)
    kinds = np.bincount(of * 7 + KINDS[data], minlength=rows * 7).reshape(rows, 7) / np.maximum(size, 1)[:, None]
    starts, ends, firsts = word_spans(data, offsets)
    hashes, words = word_hashes(data, starts, ends), np.diff(firsts)
    low, high, line_firsts = word_spans(data, offsets, LINE_BREAK)
    lines = word_hashes(data, low, high) if len(low) else np.zeros(0, U64)
    # Means of word lengths from the byte counts: bytes outside white space by words.
    mean = size * (1 - kinds[:, 3]) / np.maximum(words, 1)
    marked = np.isin(KINDS[data[ends - 1]], [5]) if len(ends) else np.zeros(0, bool)
    marks = np.bincount(np.repeat(np.arange(rows), words)[marked], minlength=rows) / np.maximum(words, 1)
    figs = [kinds, np.log1p(words)[:, None], np.log1p(mean)[:, None], distinct_share(hashes, firsts)[:, None], repeated_share(hashes, firsts)[:, None], distinct_share(lines, line_firsts)[:, None], marks[:, None]]
    x = np.concatenate(figs, axis=1)
    return np.concatenate([x, x * x], axis=1)


class Logistic:
    """Logistic regression by Newton steps on standardised figures, with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        self.w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (p - y) + ridge * np.r_[0, self.w[1:]]
            bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(self.w))
            step = np.linalg.solve(bend, slope)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + ((x - self.mean) / self.spread) @ self.w[1:], -12, 12)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Logistic | None:
    """Fit on at most ``rows`` labelled documents, those of the smallest hash; None where the labels don't hold both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def measured(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in figures(batch.column("text"))], pa.binary())], names=["doc_id", "quality", "figures"])

    # Only the figures of whole texts travel to the driver, whatever the texts' lengths.
    found = found.mapInArrow(measured, "doc_id long, quality int, figures binary").orderBy("doc_id").toPandas()
    if found["quality"].nunique() < 2:
        if chosen.select("quality").distinct().count() == 2:
            raise ValueError("quality labels hold both classes, but no labelled row of one of them has a text")
        return None
    return Logistic(np.stack([np.frombuffer(x) for x in found["figures"]]), found["quality"].to_numpy(float))


def evidence(docs: DataFrame, model: Logistic | None, host: str, path: str) -> DataFrame:
    """doc_id, host, path, ratio (log-likelihood ratio for good quality) and p (the classifier's own probability) of every row."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            logits = model.logits(figures(batch.column("text"))) if model else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-logits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(logits - (model.base if model else 0.0)), pa.array(p)], names=["doc_id", "host", "path", "ratio", "p"])

    # A null site is a site of its own, told apart from the empty name.
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name(host).alias("host"), F.concat(name(host), F.lit("/"), name(path)).alias("path"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, host string, path string, ratio double, p double")


def prior_weight(sites: DataFrame, mean: Column, n: Column, above: Column) -> Column:
    """Rows that the prior counts for: from the excess of the spread of site means over what sampling explains. Aggregates over ``sites``."""
    within = F.sum(n * mean * (1 - mean))
    total = F.sum(n)
    between = F.sum(n * (mean - above) * (mean - above)) / total
    noise = F.sum(mean * (1 - mean)) / total
    excess = F.greatest(between - noise, F.lit(1e-9))
    return F.least(F.greatest(within / total / excess, F.lit(1.0)), F.lit(1e6))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """path, rows, mass (sum of p), and the prior of each path: its host's posterior mean and the weight of that prior."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("mass").alias("host_mass"))
    corpus = hosts.agg((F.sum("host_mass") / F.sum("host_n")).alias("corpus_mean"))
    hosts = hosts.join(F.broadcast(corpus))  # a single row, being an aggregate without keys
    weight = hosts.agg(prior_weight(hosts, F.col("host_mass") / F.col("host_n"), F.col("host_n"), F.col("corpus_mean")).alias("host_weight"))
    hosts = hosts.join(F.broadcast(weight)).withColumn("host_mean", (F.col("host_mass") + F.col("host_weight") * F.col("corpus_mean")) / (F.col("host_n") + F.col("host_weight")))
    paths = paths.join(hosts.select("host", "host_mean"), "host")
    weight = paths.agg(prior_weight(paths, F.col("mass") / F.col("n"), F.col("n"), F.col("host_mean")).alias("path_weight"))
    return paths.join(F.broadcast(weight)).select("path", "n", "mass", "host_mean", "path_weight")


def posterior(docs: DataFrame, model: Logistic | None, host: str = "source", path: str = "lang", limit: float = LIMIT) -> DataFrame:
    """doc_id, evidence, site_prior, score and kept of every row.

    Null or empty texts have the figures of an empty text. A null host or path is a site of its own. Null and repeated doc_ids are scored row by
    row. Without a model (no usable labels) evidence is 0 everywhere. An empty table gives an empty result; other columns are ignored.
    """
    from labelgrid.llm.shared import saved

    scored = saved(evidence(docs, model, host, path), "quality")
    both = scored.join(site_posteriors(scored), "path")
    prior = (F.col("mass") - F.col("p") + F.col("path_weight") * F.col("host_mean")) / (F.col("n") - 1 + F.col("path_weight"))
    bounded = F.least(F.greatest(prior, F.lit(FLOOR)), F.lit(1 - FLOOR))
    logit = F.col("ratio") + F.log(bounded / (1 - bounded))
    return both.select("doc_id", F.col("ratio").alias("evidence"), bounded.alias("site_prior"), (1 / (1 + F.exp(-logit))).alias("score")).withColumn("kept", F.col("score") >= limit)
