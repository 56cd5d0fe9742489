import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from labelgrid.llm import language, queries, repeats, whitening
from labelgrid.llm.words import U64, mix

# --- periodic runs ---


def plain_runs(words, min_words=24, min_turns=3):
    """Every period is tried at every place; the smallest period names a stretch."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_words, min_turns * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("limits", [(24, 3), (4, 2), (6, 3), (2, 2), (10, 4)])
def test_runs_of_random_words(limits):
    rng = np.random.default_rng(sum(limits))
    for _ in range(120):
        docs = []
        for _ in range(rng.integers(1, 6)):
            words = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70))
            if rng.random() < 0.5 and len(words) > 3:
                a, i = rng.integers(0, len(words)), np.arange(len(words))
                i[a:] = a + (i[a:] - a) % rng.integers(1, max(2, (len(words) - a) // 3 + 1))
                words = words[i]
            docs.append(words)
        firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        row, *rest = repeats.word_runs(mix(np.concatenate(docs).astype(U64) + U64(7)), firsts, *limits)
        assert list(zip(row.tolist(), *(x.tolist() for x in rest))) == [(r, *x) for r, d in enumerate(docs) for x in plain_runs(d.tolist(), *limits)]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        symbols = mix(np.append(rng.integers(0, 3, size), 99).astype(U64))
        order, rank, lcp = repeats.suffix_array(symbols)
        codes = np.unique(symbols, return_inverse=True)[1].tolist()
        want = sorted(range(len(codes)), key=lambda i: codes[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(codes)))
        for k in range(1, len(want)):
            a, b = codes[want[k - 1] :], codes[want[k] :]
            assert lcp[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_nearest_smaller():
    rng = np.random.default_rng(4)
    for values in ([0, *rng.integers(1, 9, 200)], [0, *range(1, 300), 0, 1], [0, *range(300, 0, -1)], [0] + [5] * 50):
        values = np.array([-1, *values])
        for equal in (False, True):
            want = [0] + [next(j for j in range(i - 1, -1, -1) if values[j] < values[i] or (equal and values[j] == values[i])) for i in range(1, len(values))]
            assert repeats.nearest_left(values, equal).tolist() == want


def test_one_word_for_ever_and_fibonacci_words():
    hashes = mix(np.zeros(100_000, U64))
    assert [x.tolist() for x in repeats.word_runs(hashes, np.array([0, 100_000]))] == [[0], [0], [100_000], [1]]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    row, *rest = repeats.word_runs(mix(np.array(b, U64)), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in rest))) == plain_runs(b)


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


def test_periodic_runs_of_texts(spark, awkward, nothing):
    """Ids whose checksum plants a period stand beside ids that don't; the long text is 36,000 words of period twelve."""
    rng = np.random.default_rng(5)
    planted = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(rng.choice(["a", "b", "Ünd", "the"], rng.integers(1, 120)))) for i in [*planted, *range(40)]]
    rows += [(50, "x y z " * 12 + "x y q"), (51, "x " * 23), (52, "x y " * 24), (53, "a b " * 20 + "b a " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.digest(repeats.find_runs(repeats.with_planted(docs)))
    assert sorted(map(tuple, found.collect())) == sorted(plain_digest(*r) for r in rows)
    every = repeats.digest(repeats.find_runs(repeats.with_planted(awkward))).collect()
    short = [r for r in awkward.collect() if len(r.text or "") < 60_000]
    assert len(every) == awkward.count()
    assert Counter(r.collapsed_sha256 for r in every if r.doc_id != 5) == Counter(plain_digest(r.doc_id, r.text)[-1] for r in short)
    long = repeats.find_runs(awkward.where("doc_id = 5")).first()
    assert [tuple(r) for r in long.runs] == [(0, 36_000, 12)] and len(long.collapsed.split()) == 12 and tuple(long.strongest) == (0, 36_000, 12)
    assert repeats.digest(repeats.find_runs(repeats.with_planted(nothing))).count() == 0


# --- whitening ---


def plain_whitening(vectors, once=False, most=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    fit = np.unique(x, axis=0) if once else x
    n, sums = len(fit), fit.sum(0)
    centred = (fit - sums / n).astype(float)
    spread = centred.T @ centred / n
    values, axes = np.linalg.eigh(spread)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, ((x - sums / n) @ axes[:, order]) / np.sqrt(values[order]), values[order] / np.trace(spread)


@pytest.mark.parametrize("once", [False, True])
def test_whitening(spark, once):
    rng = np.random.default_rng(7)
    some = (rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    vectors = np.concatenate([some, some[:30], np.repeat(some[:1], 60, 0)]).astype(float)
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0, 2.0]), (905, [])]
    rows = spark.createDataFrame([(i, v.tolist(), i, "h") for i, v in enumerate(vectors)] + [(*r, 0, "h") for r in odd], "vec_id long, embedding array<float>, x long, hot string")
    got = whitening.whiten(rows, once=once).toPandas().sort_values(["vec_id", "component"])
    n, deviation, z, share = plain_whitening(vectors, once)
    assert len(got) == 8 * len(vectors) and set(got["vec_id"]) == set(range(len(vectors))) and set(got["n"]) == {n}
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation
    mine = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.allclose(mine * np.sign(mine[1]) * np.sign(z[1]), z, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8)[0], share, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_without_spread(spark):
    frame = lambda vectors: spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0] if vectors else None)], "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([]).limit(0)).count() == 0 and whitening.whiten(frame([[]])).count() == 0
    same = whitening.whiten(frame([[0.5, 0.25]] * 3)).collect()
    assert len(same) == 8 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None and r.n == 4 for r in same)
    line = whitening.whiten(frame([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).toPandas()
    assert line[line["component"] == 2]["whitened"].isna().all() and line[line["component"] == 1]["whitened"].notna().all() and line["identity_error"].max() < 1e-9
    huge = whitening.whiten(frame([[1e30, -1e30], [0.0, 1.0], [1.0, 5.0]])).toPandas()
    assert len(huge) == 8 and huge["deviation"].isna().any()


# --- language ---


def plain_grams(text):
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    out = []
    for word in letters.split(" "):
        marked = f" {word} " if word else ""
        for n in (1, 2, 3, 4):
            for i in range(len(marked) - n + 1):
                if n > 1 or marked[i] != " ":
                    out.append(marked[i : i + n])
    return out


def gram_hash(gram):
    codes = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
    value = np.array([len(gram)], U64)
    for c in codes:
        value = value * U64(0x9E3779B97F4A7C15) + U64(c)
    return int(mix(value)[0])


TEXTS = ["The cat sat; on the mat!", "", "123 ...", "Ünter den Linden", "a", "naïve ﬁ İstanbul 漢字 x1y", "  b  ", "the the the " * 40, "\0 z \0"]


def test_grams_of_words():
    words = language.Words(TEXTS)
    for order in (1, 2, 3, 4):
        found = [Counter() for _ in TEXTS]
        per_word = [[] for _ in range(words.count)]
        for hashes, owner in words.grams([order]):
            for h, w in zip(hashes.tolist(), owner.tolist()):
                per_word[w].append(h)
        for t in range(len(TEXTS)):
            for w in words.codes[words.firsts[t] : words.firsts[t + 1]]:
                found[t].update(per_word[w])
        assert found == [Counter(gram_hash(g) for g in plain_grams(t) if len(g) == order) for t in TEXTS]


@pytest.mark.parametrize("languages", [1, 3, 70])
def test_masks_and_counts(languages):
    """No member is missed, few others pass, and evidence is what plain loops over masks give, also beyond 64 bits."""
    rng = np.random.default_rng(languages)
    vocabulary = sorted({g for t in TEXTS for g in plain_grams(t)})
    sets = [(np.array([gram_hash(g) for g in rng.choice(vocabulary, 30, replace=False)], U64), np.arange(30) / 30) for _ in range(languages)]
    names = [f"l{k:02}" for k in range(languages)]
    filters = language.Filters(names, sets)
    bit = lambda mask, k: int(mask[k // 64]) >> (k % 64) & 1
    for k, (members, ranks) in enumerate(sets):
        masks = filters.masks(members)
        assert all(bit(m, 2 * k) for m in masks) and all(bit(m, 2 * k + 1) for m, r in zip(masks, ranks) if r < 1 / language.CORE)
    others = filters.masks(mix(np.arange(5000, dtype=U64)))
    assert np.mean([bit(m, 0) for m in others]) < 0.02
    share, size = filters.evidence(TEXTS)
    for t, text in enumerate(TEXTS):
        grams = plain_grams(text)
        assert size[t] == len(grams)
        masks = filters.masks(np.array([gram_hash(g) for g in grams], U64)) if grams else []
        for k in range(languages):
            raw = [sum(bit(m, 2 * k + s) for m in masks) / max(1, len(grams)) for s in (0, 1)]
            want = np.mean([max(0, (r - c) / (1 - c)) for r, c in zip(raw, filters.chance[2 * k : 2 * k + 2])])
            assert share[t, k] == pytest.approx(want, abs=1e-12)


def test_false_positives_are_corrected():
    """Of n-grams in no language a part passes by chance; the corrected share stays near zero even in a crowded filter."""
    rng = np.random.default_rng(8)
    sets = [(mix(rng.integers(0, 1 << 60, 4000).astype(U64)), np.arange(4000) / 4000) for _ in range(3)]
    filters = language.Filters(["a", "b", "c"], sets)
    filters.rows = filters.rows[: len(filters.rows) // 8] | filters.rows[len(filters.rows) // 8 : len(filters.rows) // 4]
    for members, k in ((s[0], k) for k, s in enumerate(sets)):
        for at in filters.places(members):
            filters.rows[at, 0] |= U64(1 << (2 * k))
    filters.chance = (filters.counts(filters.rows, np.zeros(len(filters.rows), np.int64), 1)[0] / len(filters.rows)) ** language.HASHES
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4000))
    words = language.Words([text])
    raw = np.mean([np.mean(filters.masks(h)[:, 0] & U64(1)) for h, _ in words.grams((4,))])
    share, _ = filters.evidence([text])
    assert raw > 0.3 and share.max() < 0.05


def test_language_of_held_out_rows(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = language.fit(docs)
    got = language.digest(language.identify(docs, filters)).toPandas().set_index("doc_id")
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert set(held.index) == {i for i in truth.index if zlib.crc32(str(i).encode()) % 3 == 1}
    assert (held["lang_pred"] == truth[held.index]).mean() >= 0.97 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "42 ... \n"), (4, "é"), (None, "the and of"), (5, "漢字"), (5, "漢字")], "doc_id long, text string")
    named = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, filters).collect()]
    assert [n for n in named if n[1] == "und"] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and len(named) == 7
    assert language.identify(awkward, filters).count() == awkward.count() and language.identify(nothing, filters).count() == 0
    assert language.fit(docs, most=5).names == filters.names
    untaught = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(awkward, untaught).collect()} == {"und"}


def test_labels_of_held_out_rows_are_never_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 'xx', lang) AS lang", "text", "'s' AS source")
    a, b = language.fit(docs), language.fit(changed)
    assert a.names == b.names and (a.rows == b.rows).all()


def test_a_text_counts_alike_however_long(spark):
    """One very long text of another language's words doesn't take over a language's filter."""
    rows = [(i, "xx", "aba abo abe") for i in range(0, 300)] + [(301, "xx", "zuz zoz " * 20_000)] + [(1000 + i, "yy", "zuz zoz zaz") for i in range(300)]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), kept={2: 4, 3: 4})
    assert filters.decide(["aba abe", "zuz zaz"])[0] == ["xx", "yy"]


def test_new_queries_run_on_the_smallest_tables(spark, sf):
    for name, table, rows_each in (("op11_periodic_runs", "documents", 1), ("op12_whitening", "embeddings", 8), ("op13_language", "documents", 1)):
        assert queries.QUERIES[name](spark, sf).count() == rows_each * spark.read.parquet(f"{sf}/{table}.parquet").count()
