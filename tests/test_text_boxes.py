import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelgrid.functions import text as text_functions
from labelgrid.functions.text import cer, labels_to_frames, token_codes, wer_of_codes
from labelgrid.operators import boxes as B
from labelgrid.operators import textscore as T
from labelgrid.plans.catalogue import QUERIES
from labelgrid.plans.jobs import score_ocr
from labelgrid.plans.views import text_lines

SF = "/root/testdata/sf0.001"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


PAIRS = [("the cat sat", "the  cat sat "), ("", "x"), ("", ""), ("abc", ""), ("a b c d", "a c x d d"), ("héé lo", "hee lo"), ("   ", "ab c")]


def test_error_rates_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    pairs = PAIRS + [(" ".join(rng.choices(words, k=30)), " ".join(rng.choices(words, k=25))) for _ in range(20)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "k int, r string, h string")
    codes = token_codes("r", "h")
    rows = df.select("k", cer(F.col("r"), F.col("h")).alias("c"), codes.alias("z")).select("k", "c", wer_of_codes(F.col("z")).alias("w")).orderBy("k").collect()
    for (r, h), got in zip(pairs, rows):
        rt, ht = r.split(), h.split()
        assert got["w"] == pytest.approx(edit(rt, ht) / len(rt) if rt else len(ht))
        rs, hs = " ".join(rt), " ".join(ht)
        want = 1.0 if not r and h else (edit(rs, hs) / len(rs) if rs else len(hs))
        assert got["c"] == pytest.approx(want)


def plain_bleu(r, h, max_n):
    ps, out = [], []
    for n in range(1, max_n + 1):
        a, b = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (r, h))
        ps.append(sum(min(v, a[g]) for g, v in b.items()) / max(1, len(h) - n + 1))
        bp = 1 if len(h) > len(r) else 0 if not h else math.exp(1 - len(r) / len(h))
        out.append(0 if min(ps) <= 0 else bp * math.exp(sum(map(math.log, ps)) / n))
    return out


def test_bleu_against_counts(spark):
    """All 49 orders; repeats, texts of other scripts, empty and null ones, a repeated row, few letters so that most grams meet."""
    rng = random.Random(4)
    texts = [("abcabcab" * 70, "abcabdab" * 69), ("aab", "b"), ("xy", ""), ("", "xy"), ("", ""), (None, "ab"), ("ab", None), ("ab" * 30, "ab" * 40), ("ab" * 30, "ab" * 40), ("𝄞é漢" * 30, "𝄞é漢" * 25 + "x")]
    texts += [tuple("".join(rng.choices("ab", [5, 1], k=rng.randrange(200))) for _ in "rh") for _ in range(40)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(texts)], "k int, ref string, hyp string")
    got = {(x["k"], x["n"]): x["bleu"] for x in T.bleu(df, ["k"]).collect()}
    assert len(got) == 49 * len(texts)
    for k, (r, h) in enumerate(texts):
        assert [got[k, n] for n in range(1, 50)] == pytest.approx(plain_bleu(r or "", h or "", 49)), k


def test_bleu_of_blocks(monkeypatch):
    """Blocks of texts score like single texts."""
    rng = random.Random(5)
    refs, hyps = (["".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(50)] for _ in "rh")
    scores = text_functions.bleu_scores(12).func
    want = [plain_bleu(r, h, 12) for r, h in zip(refs, hyps)]
    for size in (1 << 21, 100, 1):
        monkeypatch.setattr(text_functions, "BLEU_CHARS", size)
        assert np.allclose(np.array(scores(pd.Series(refs), pd.Series(hyps)).tolist()), want)


def fast_edit(a, b):
    """The full table, a row at a time."""
    a, b = np.asarray(a), np.asarray(b)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, x in enumerate(a, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


@pytest.mark.parametrize("seed", range(40))
def test_bits_against_the_full_table(seed):
    """Few and many kinds of items, empty and unequal lengths, lengths around the limit for kept bits."""
    rng = random.Random(seed)
    kinds = rng.choice([1, 2, 5, 400])
    a, b = ([rng.randrange(kinds) for _ in range(rng.choice([0, 1, 3, 63, 64, 65, 200]))] for _ in "ab")
    assert text_functions.bit_distance(a, b) == fast_edit(a, b)


def test_many_pairs_share_their_steps(monkeypatch):
    """Pairs of any length side by side, more than fit one number, and one of too many kinds; steps follow the longest of a number, not their sum."""
    rng, step, steps = random.Random(9), text_functions._step, []
    pairs = [tuple([rng.randrange(rng.choice([1, 3, 50])) for _ in range(rng.choice([0, 1, 7, 8, 9, 64, 150]))] for _ in "ab") for _ in range(120)]
    want = [fast_edit(a, b) for a, b in pairs]
    monkeypatch.setattr(text_functions, "_step", lambda *a: steps.append(1) or step(*a))
    assert text_functions.bit_distances(pairs) == want and len(steps) <= 151
    monkeypatch.setattr(text_functions, "LANE_BITS", 300)
    monkeypatch.setattr(text_functions, "KEPT_BITS", 3000)
    assert text_functions.bit_distances(pairs) == want and text_functions.bit_distances([]) == []


def test_edit_distance_of_all_lengths(spark):
    """Short pairs, long pairs and pairs of unequal length equal the full table, near and far."""
    rng = random.Random(6)
    pairs = [("", ""), ("", "a" * 70), (None, "a")]
    for n, changes in [(40, 7), (40, 8), (40, 9), (300, 63), (300, 64), (300, 66), (900, 511), (900, 513), (900, 890), (1500, 1400)]:
        word = rng.choices("abcdefghij", k=n)
        other = word.copy()
        for i in rng.sample(range(n), changes):
            other[i] = rng.choice(["", "Z", other[i] + "Y"])
        pairs.append(("".join(word), "".join(other)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, r string, h string")
    got = {x["k"]: x["d"] for x in df.select("k", text_functions.edit_distance(F.col("r"), F.col("h")).alias("d")).collect()}
    assert got.pop(2) is None
    assert got == {i: fast_edit(list(r), list(h)) for i, (r, h) in enumerate(pairs) if r is not None}
    assert max(got.values()) > 512


def test_word_error_rate_of_long_texts(spark):
    """Texts of 20,000 words with scattered changes."""
    rng = random.Random(7)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [w if rng.random() > 0.002 else "changed" for w in ref if rng.random() > 0.001]
    df = spark.createDataFrame([(" ".join(ref), " ".join(hyp))], "ref string, hyp string")
    codes = {w: i for i, w in enumerate({*ref, *hyp})}
    want = fast_edit([codes[w] for w in ref], [codes[w] for w in hyp]) / len(ref)
    assert T.word_error_rates(df, []).first()["wer"] == pytest.approx(want) and want > 0


def test_word_error_rates_of_the_whole_table(spark):
    """The registered query against the full table of distances, for every line of every document."""
    got = {(r.doc_id, r.line_no): r.wer for r in QUERIES["wer"](spark, SF).collect()}
    lines = text_lines(spark, SF).collect()
    assert len(got) == len(lines)
    for row in lines:
        r, h = row.ref.split(), row.hyp.split()
        codes = {w: i for i, w in enumerate({*r, *h})}
        want = fast_edit([codes[w] for w in r], [codes[w] for w in h]) / len(r) if r else len(h)
        assert got[row.doc_id, row.line_no] == pytest.approx(want, abs=1e-8)


def test_label_codecs(spark):
    chars = spark.createDataFrame([("a", 1), ("b", 2)], "ch string, idx int")
    texts = spark.createDataFrame([(0, "abxa"), (1, "")], "k int, text string")
    enc = T.encode_labels(texts, chars, ["k"], pad_to=5)
    assert {r["k"]: r["labels"] for r in enc.collect()} == {0: [1, 2, 1, 0, 0], 1: [0] * 5}
    assert {r["k"]: r["text"] for r in T.decode_labels(enc, chars, ["k"]).collect()} == {0: "aba", 1: ""}
    assert {r["k"]: r["text"] for r in T.decode_labels(enc, chars, ["k"], raw=True).collect()} == {0: "aba⋅⋅", 1: "⋅⋅⋅⋅⋅"}
    assert {len(r["labels"]) for r in T.encode_labels(texts, chars, ["k"], pad_to="longest").collect()} == {4}
    with pytest.raises(Exception, match="not in charset"):
        T.encode_labels(texts, chars, ["k"], unknown="error").collect()


def test_label_codecs_make_no_row_per_character(spark):
    """Coded where the text is; texts of one key merge by position, and rows with a null key stay, with nothing in them."""
    chars = spark.createDataFrame([("a", 1), ("b", 2), ("é", 3), ("𝄞", 9)], "ch string, idx int")
    texts = spark.createDataFrame([(0, "aé𝄞b"), (0, "ba"), (None, "a"), (None, "a"), (2, None), (3, "b")], "k int, text string")
    enc = T.encode_labels(texts, chars, ["k"])
    key = lambda df, c: sorted(((r["k"], r[c]) for r in df.collect()), key=str)
    assert key(enc, "labels") == sorted([(0, [1, 2, 1, 3, 9, 2]), (0, [1, 2, 1, 3, 9, 2]), (None, []), (None, []), (2, []), (3, [2])], key=str)
    dec = T.decode_labels(T.encode_labels(texts.where("text <> 'ba'"), chars, ["k"]), chars, ["k"])
    assert key(dec, "text") == sorted([(0, "aé𝄞b"), (None, ""), (None, ""), (3, "b")], key=str)
    assert "posexplode" not in dec._jdf.queryExecution().optimizedPlan().toString()


def test_labels_to_frames(spark):
    rows = spark.range(1).select(labels_to_frames(F.array(F.lit(2), F.lit(0)), 2, 1)).first()[0]
    assert rows == [[0, 0, 1], [0, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 1]]


def test_ctc(spark):
    seq = [0, 1, 1, 0, 1, 2, 2, 0, 0, 3]
    df = spark.createDataFrame([("l", t, s) for t, s in enumerate(seq)], "line_id string, t long, sym int")
    assert T.assemble_lines(T.ctc_collapse(df)).first()["labels"] == [1, 1, 2, 3]
    scores = spark.createDataFrame([("l", 0, [0.1, 0.9]), ("l", 1, [0.5, 0.5])], "line_id string, t long, scores array<double>")
    assert [r["sym"] for r in T.frame_symbols(scores).orderBy("t").collect()] == [1, 0]


def random_boxes(rng, n, page):
    return [(page, i, (x := rng.randrange(900)), (y := rng.randrange(900)), x + rng.randrange(5, 60), y + rng.randrange(5, 40), rng.choice(["ab", "cd", "x-y", "--"])) for i in range(n)]


SCHEMA = "page_id int, box_id long, l int, t int, r int, b int, text string"


def iou(a, b, g=100):
    w, h = min(a[4], b[4]) - max(a[2], b[2]) + 2 * g, min(a[5], b[5]) - max(a[3], b[3]) + 2 * g
    if w < 0 or h < 0:
        return 0.0
    area = lambda q: (q[4] - q[2] + 2 * g) * (q[5] - q[3] + 2 * g)
    return w * h / (area(a) + area(b) - w * h)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    gt = random_boxes(rng, 60, 1) + random_boxes(rng, 15, 2)
    pred = random_boxes(rng, 50, 1) + random_boxes(rng, 20, 2)
    return gt, pred, spark.createDataFrame(gt, SCHEMA), spark.createDataFrame(pred, SCHEMA)


def greedy(gt, pred):
    cand = sorted(((iou(a, b), a[0], a[1], b[1]) for a in gt for b in pred if a[0] == b[0]), key=lambda c: (c[0], c[2], c[3]), reverse=True)
    gs, ps, out = set(), set(), set()
    for s, page, g, p in cand:
        if s > 0 and (page, g) not in gs and (page, p) not in ps:
            gs.add((page, g))
            ps.add((page, p))
            out.add((page, g, p))
    return out


def test_pairs_and_matches(pages):
    gt, pred, g, p = pages
    pairs = B.box_iou_pairs(g, p)
    got = {(r["page_id"], r["gt_id"], r["pred_id"]): r["iou"] for r in pairs.collect()}
    want = {(a[0], a[1], b[1]): iou(a, b) for a in gt for b in pred if a[0] == b[0] and iou(a, b) > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    key = lambda df: {(r["page_id"], r["gt_id"], r["pred_id"]) for r in df.collect()}
    assert key(B.match_boxes(pairs)) == greedy(gt, pred)
    assert B.match_boxes(pairs.limit(0)).count() == 0


def test_pairs_meet_and_match_without_a_shuffle_of_pairs(spark, pages):
    """Calm pages: joined by page, matched where they are joined; crowded pages and large ones give the same by grid and rounds."""
    gt, pred, g, p = pages
    key = lambda df: sorted((r["page_id"], r["gt_id"], r["pred_id"], round(r["iou"], 9)) for r in df.collect())
    calm, mixed = B.box_iou_pairs(g, p), B.box_iou_pairs(g, p, page_boxes=50)
    assert key(calm) == key(mixed)
    assert key(B.match_boxes(calm)) == key(B.match_boxes(mixed, page_pairs=100)) == key(B.match_boxes(calm, page_pairs=0))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan(calm) and "explode" in plan(mixed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = B._fold_pages(calm, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert folded.count("Exchange hashpartitioning") == 2


def test_a_page_of_a_million_pairs(spark):
    """One crowded page with many ties beside small ones, against the plain greedy order."""
    crowded = spark.range(1_000_000).selectExpr("'a' AS page_id", "id % 1000 AS gt_id", "id DIV 1000 AS pred_id")
    small = spark.range(300).selectExpr("concat('p', id % 9) AS page_id", "id % 7 AS gt_id", "id % 5 AS pred_id").distinct()
    pairs = crowded.unionByName(small).withColumn("iou", ((F.pmod(F.xxhash64("page_id", "gt_id", "pred_id"), F.lit(5000)) + 1) / 5000))
    used, want = set(), set()
    for r in pairs.toPandas().sort_values(["iou", "gt_id", "pred_id"], ascending=False).itertuples():
        ends = {(r.page_id, "g", r.gt_id), (r.page_id, "p", r.pred_id)}
        if not ends & used:
            used |= ends
            want.add((r.page_id, r.gt_id, r.pred_id))
    assert {(r.page_id, r.gt_id, r.pred_id) for r in B.match_boxes(pairs).collect()} == want and len(want) > 1000


def test_ocr_score(pages):
    gt, pred, g, p = pages
    rows = {r["page_id"]: r for r in score_ocr(g, p).collect()}
    texts_g, texts_p = {(a[0], a[1]): a[6] for a in gt}, {(a[0], a[1]): a[6] for a in pred}
    for page in (1, 2):
        m = [(x[1], x[2]) for x in greedy(gt, pred) if x[0] == page]
        errs = [(edit(texts_g[page, a], texts_p[page, b]) / len(texts_g[page, a]), len(texts_g[page, a])) for a, b in m]
        un_g = [len(v) for k, v in texts_g.items() if k[0] == page and k[1] not in {a for a, _ in m}]
        un_p = [len(v) for k, v in texts_p.items() if k[0] == page and k[1] not in {b for _, b in m}]
        r = rows[page]
        assert r["word_cer"] == pytest.approx(sum(e for e, _ in errs) / len(errs))
        assert r["document_cer"] == pytest.approx(sum(e * w for e, w in errs) / sum(w for _, w in errs))
        assert r["word_cer_all"] == pytest.approx((sum(e for e, _ in errs) + len(un_g) + len(un_p)) / (len(errs) + len(un_g) + len(un_p)))
        assert r["document_cer_all"] == pytest.approx((sum(e * w for e, w in errs) + sum(un_g) + sum(un_p)) / (sum(w for _, w in errs) + sum(un_g)))
    assert "--" not in {r["text"] for r in B.prune_punctuation(g).collect()}
    assert score_ocr(g, p, punctuation=False).count() == 2


def test_char_boxes_and_regions(spark):
    words = spark.createDataFrame([(1, 0, 10, 0, 40, 10, "a_b", [10, 20]), (1, 1, 100, 0, 130, 10, "xyz", [5])], "page_id int, box_id int, l int, t int, r int, b int, text string, charsegs array<int>")
    got = [(r["ch"], r["l"], r["r"]) for r in B.char_boxes(words).orderBy("pos").collect()]
    assert got == [("a", 10, 20), (" ", 20, 30), ("b", 30, 40)]
    region = spark.createDataFrame([(1, 7, 0, 0, 28, 100)], "page_id int, region_id int, l int, t int, r int, b int")
    assert sorted(r["ch"] for r in B.chars_in_region(region, words).collect()) == [" ", "a"]
    assert [r["box_id"] for r in B.valid_words(words, 2).collect()] == [0]


def test_box_join_meets_each_pair_once(spark):
    big = spark.createDataFrame([(1, 0, 0, 0, 5000, 5000)], "page_id int, a_id int, l int, t int, r int, b int")
    small = spark.createDataFrame([(1, i, i * 40, i * 40, i * 40 + 300, i * 40 + 300) for i in range(100)], "page_id int, b_id int, l int, t int, r int, b int")
    assert B.box_join(big, small).count() == 100
