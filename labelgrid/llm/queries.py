"""One query for each operator over its whole table, and the SQL checks where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelgrid.llm import decontam, htmltext, language, minhash, neighbours, packing, pii, quality, repeats, substrings, tokenfiles, toxicity, whitening
from labelgrid.llm.shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), packing.word_vocabulary()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_windows", "coverage", "same_words")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.digest(htmltext.extract(pages, htmltext.fit(pages)))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digest(table(spark, sf_dir, "documents"), tokenfiles.byte_vocabulary())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.posterior(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.find_runs(repeats.with_planted(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.digest(language.identify(docs, language.fit(docs)))


ALL = (op1_toxicity, op2_packing, op3_decontamination, op4_personal_data, op5_substrings, op6_near_duplicates, op7_main_text, op8_neighbours, op9_token_files, op10_quality, op11_periodic_runs, op12_whitening, op13_language)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}
WORDS_SQL = r"""
words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
    FROM (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
)"""

OP5_SQL = (
    "WITH "
    + WORDS_SQL.format(text="coalesce(text, '')")
    + ", windows AS (SELECT doc_id, pos, word || ' ' || "
    + " || ' ' || ".join(f"lead(word, {k}) OVER w" for k in range(1, 13))
    + """ AS run FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT run, min(doc_id) AS least FROM windows WHERE run IS NOT NULL GROUP BY run),
gone AS (
    SELECT DISTINCT windows.doc_id, windows.pos + k.k AS pos FROM windows JOIN firsts USING (run), (SELECT unnest(range(0, 13)) AS k) k
    WHERE windows.doc_id > firsts.least
),
kept AS (SELECT words.doc_id, words.pos, words.word FROM words LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL),
total AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stays AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_words, coalesce(total.n, 0) - coalesce(stays.n, 0) AS n_removed, sha256(coalesce(stays.text, '')) AS kept_sha256
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN stays USING (doc_id)"""
)

OP6_SQL = (
    "WITH RECURSIVE "
    + WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """, total AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS whole FROM words GROUP BY doc_id),
runs AS (
    SELECT doc_id, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS s
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
shingles AS (SELECT DISTINCT doc_id, s FROM runs WHERE s IS NOT NULL UNION SELECT doc_id, whole FROM total WHERE n < 5),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.both >= 75 * (x.n + y.n - p.both)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.other, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""
)

#: The other operators learn, count token ids, find positions in texts or search by codes, which SQL can't express; tests use brute force.
ORACLES: dict[str, str] = {"op5_substrings": OP5_SQL, "op6_near_duplicates": OP6_SQL}
