import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labelgrid.llm import decontam, minhash, pii, substrings
from labelgrid.llm.shared import emptied, saved

# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans_equal_plain_matching():
    rng = random.Random(4)
    parts = ["a@b.co", "x.y@", "@", ".", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", "-", " ", "_", "c", "7", "79927398713", "é", "\n", "10.0.0.1.5", "me@host.example.org"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "@" * 300_000, "a@" * 100_000):
        pii.find(text)


def test_checks_and_context():
    kinds = lambda text: [x[0] for x in pii.find(text)]
    assert kinds("account GB82 WEST 1234 5698 7654 32 closed") == ["iban"]
    assert kinds("account GB83 WEST 1234 5698 7654 32 closed") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("item 123-45-6789") == []
    assert kinds("call 555-010-9999") == ["local_phone"] and kinds("part 555-010-9999") == []
    assert pii.find("card 4111111111111111")[0][3] > pii.find("order 4111111111111111")[0][3]


def test_detect_and_redact(awkward, nothing):
    found = pii.digest(pii.detect(awkward)).collect()
    assert len(found) == awkward.count()
    nine = next(r for r in found if r.doc_id == 9)
    text = next(r.text for r in awkward.collect() if r.doc_id == 9)
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (0, 1, 0, 1)
    assert nine.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and nine.spans == want
    masked = pii.redact(awkward)
    assert masked.columns == awkward.columns
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[2].text is None and rows[3].text == "" and "[PHONE]" in rows[9].text and rows[9].n_chars == len(rows[9].text)
    assert "example.com" not in rows[1].text and rows[5].text == next(r.text for r in awkward.collect() if r.doc_id == 5)
    assert pii.detect(nothing).count() == 0 and pii.redact(nothing).count() == 0


# --- repeated passages ---


def plain_removal(docs, size):
    words = [((i, t), (t or "").encode().split()) for i, t in docs]
    first = {}
    for (i, _), w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [2, 6, 60])
def test_removal_equals_plain_removal(spark, vocabulary):
    rng = random.Random(vocabulary)
    passages = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(3, 60))] for _ in range(8)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 40))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    docs += docs[:2] + [(None, docs[3][1]), (60, None), (61, "")]
    got = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == plain_removal(docs, substrings.WINDOW)


def test_hot_windows_meet_in_many_places(spark, monkeypatch):
    """Windows that stand in every document are joined by salt; the result is the same."""
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(20))
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 25))) + " " + common + " " + " ".join(f"v{rng.randrange(9)}" for _ in range(8))) for i in range(60)]
    monkeypatch.setattr(substrings, "HOT", 20)
    got = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == plain_removal(docs, substrings.WINDOW)


def test_removal_awkward(awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = substrings.without_repeats(awkward).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == plain_removal(docs, substrings.WINDOW)
    assert substrings.digest(substrings.without_repeats(nothing)).count() == 0


# --- near-duplicates ---


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    name = {i: i for i in sets}
    for _ in range(len(sets)):
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and name[a] != name[b]:
                    low, high = sorted((name[a], name[b]))
                    name = {k: low if v == high else v for k, v in name.items()}
                    changed = True
        if not changed:
            return name, sets


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_equal_plain_components(spark):
    rng = random.Random(3)
    texts = []
    for n, edits in ((25, 3), (12, 5), (30, 8), (1, 0), (6, 1)):  # dense regions, pairs about the threshold, singles
        texts += family(rng, [f"w{rng.randrange(5000)}" for _ in range(120)], n, edits)
    texts += ["a b c", "A b C", "a b c d e", "", None, texts[0], texts[0]]
    docs = list(enumerate(rng.sample(texts, len(texts))))
    name, sets = plain_components(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (name[i], len(sets[i]), name[i] == i) for i in name}


def test_the_rest_is_compared(spark, monkeypatch):
    """With one neighbour only, and no pairs from it, all links come from the exact way for the rest."""
    rng = random.Random(8)
    docs = list(enumerate(family(rng, [f"w{i}" for i in range(100)], 20, 2)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    empty = spark.createDataFrame([], "a long, b long, share float")
    monkeypatch.setattr(minhash, "neighbour_pairs", lambda forest: empty)
    name, _ = plain_components(docs)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()} == name


def test_the_rest_in_many_blocks(spark, monkeypatch):
    """Families about the threshold, all links from blocks of eight classes: as plain comparison of all pairs says."""
    rng = random.Random(9)
    texts = []
    for n, edits in ((40, 9), (25, 4)):
        texts += family(rng, [f"w{rng.randrange(5000)}" for _ in range(90)], n, edits)
    docs = list(enumerate(rng.sample(texts, len(texts))))
    monkeypatch.setattr(minhash, "neighbour_pairs", lambda forest: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    name, _ = plain_components(docs)
    assert len(set(name.values())) > 3
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == name


def test_blocks_pass_on_fewer_links_than_classes(spark):
    rng = random.Random(10)
    docs = spark.createDataFrame(list(enumerate(family(rng, [f"w{i}" for i in range(100)], 60, 1))), "doc_id long, text string")
    every = minhash.describe(docs)
    classes = every.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.max("signature").alias("signature"), F.max("n_shingles").alias("n_shingles"))
    rows = minhash.forest_rows(classes)
    forest = rows.join(rows.groupBy("region").agg(F.count("node").alias("size")), "region")
    links = minhash.rest_links(forest, minhash.class_codes(classes), None, docs)
    blocks = minhash.open_blocks(forest, minhash.class_codes(classes), None).groupBy("region", "i", "j").count().collect()
    assert 0 < links.count() <= sum(r["count"] - 1 for r in blocks)


def test_emptied_tables_hold_nothing(spark):
    table = saved(spark.range(5), "five")
    assert table.count() == 5
    emptied(table, table.where("id > 2"))
    assert spark.read.parquet(table.saved_path).count() == 0


def test_keep_one_picks_the_same_text_of_a_repeated_id(spark):
    rows = [(1, "b text of its own", "x"), (1, "a text of its own", "y"), (1, None, "z"), (2, "else", "w")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, kept_id string").repartition(3)
        got = sorted(map(tuple, minhash.keep_one(frame).collect()))
        assert got == sorted(map(tuple, minhash.keep_one(spark.createDataFrame(rows, frame.schema)).collect())) and len(got) == 2


def test_near_duplicates_awkward(awkward, nothing):
    got = minhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].component_id == 1 and not by[4].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[7].n_shingles == 0 and by[2].kept and by[3].kept and by[8].n_shingles == 1
    lost = next(r for r in got if r.doc_id is None)
    assert lost.component_id is None and lost.kept
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 7, 8, 9, 10, None], key=str)


# --- benchmark leaks ---

QUESTION = "If Alice buys 12 apples for 3 dollars each and then sells 5 of them, how much money has Alice left after the market closes early?"


def leaks(spark, texts, items=((7, QUESTION),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.matches(docs, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_leaks(spark):
    changed = QUESTION.replace("Alice", "Bruno").replace("12", "40").replace("dollars", "euros")
    mixed = QUESTION.replace("Alice left", "Carla left")  # one name became two
    texts = ["Some words first. " + QUESTION + " And some after.", "before it " + changed, "x " + mixed, "How much money has anyone left after the market closes early?", None, "", QUESTION[:40]]
    got = leaks(spark, texts)
    assert set(got) == {(0, 7), (1, 7)}
    assert got[0, 7].same_words and not got[1, 7].same_words and got[0, 7].coverage == 1.0


def test_leaks_in_part_or_in_another_case(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randint(4, 8)))
    item = [w.capitalize() if rng.random() < 0.3 else w for w in (word() for _ in range(59))]
    tens = [word() if k % 10 == 9 else w for k, w in enumerate(item)]
    added = [w for k, w in enumerate(item) for w in ([word(), w] if k % 10 == 9 else [w])]
    texts = [item[20:50], tens, added, [w.lower() for w in item], [w.upper() for w in item], item[:9], item[:8] + [word()] * 30 + item[40:44]]
    assert {d for d, _ in leaks(spark, [" ".join(["before", *t, "after"]) for t in texts], [(7, " ".join(item))])} == {0, 1, 2, 3, 4}
    titles = "The Quick Brown Fox Jumps Over The Lazy Dog Near The Quiet River Bank"
    assert set(leaks(spark, [titles.lower(), titles], [(7, titles)])) == {(0, 7), (1, 7)}


def test_one_filler_that_becomes_two(spark):
    twins = "a box holds 3 red balls and also 3 green balls while the old shelf near the door holds some more of both colours"
    texts = [twins.replace("3 red", "4 red").replace("3 green", "7 green"), twins.replace("3 green", "5 green")]
    got = leaks(spark, texts, [(7, twins)])
    assert set(got) == {(0, 7), (1, 7)} and not got[0, 7].same_words
    starts = "Then a box holds some red balls for them. Then it was put on an old shelf near the door of both rooms"
    assert set(leaks(spark, [starts.replace("them. Then", "them. Later")], [(7, starts)])) == {(0, 7)}
    # A name that became two: a long quote counts nevertheless.
    more = QUESTION + " Tell how the sum was found and what is spent on the way home when the bus costs as much as one bag of them"
    assert set(leaks(spark, [more.replace("Alice left", "Carla left")], [(7, more)])) == {(0, 7)}
    # Windows against the mapping of the majority don't count, the others do.
    span = [(0, [0, 8], [0, 8]), (1, [8, 0], [8, 0]), (5, [8, 0], [6, 0]), (9, [0, 0], [0, 0])]
    assert decontam.agreeing(span, 2) == ({0, 1, 9}, True)


def test_repeats_count_once(spark):
    line = " ".join(QUESTION.split()[4:12])
    lines = f"{line} . " * 6
    assert set(leaks(spark, [lines * 7, "x " + line], [(7, QUESTION), (8, lines)])) == {(0, 8)}  # neither side's repeats add up
    got = leaks(spark, [(QUESTION + " and again ") * 3])
    assert got[0, 7].matched == got[0, 7].item_windows and got[0, 7].words == len(QUESTION.split())


def test_items_of_few_plain_words(spark):
    """Rows of numbers and units stand word for word: a copy is found, another row of numbers and a copy with changes all over are not."""
    numbers = "3 7 12 19 28 40 51 63 70 85 91 104 118 125 137 150"
    options = "Options: 5 km or 8 miles, 12 kg or 30 pounds, 7 hours or 90 minutes, 4 litres or 2 gallons."
    texts = ["before " + numbers + " after", "x " + options.upper() + " y", " ".join(str(int(n) + 1) for n in numbers.split()), numbers.replace("19", "18").replace("70", "71").replace("118", "9")]
    assert set(leaks(spark, texts, [(1, numbers), (2, options)])) == {(0, 1), (1, 2)}


def test_clean_rows_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, QUESTION, "a", "b"), (2, "fine", "c", "d"), (3, None, "e", "f")], "doc_id long, text string, __key string, leak_md5 string")
    clean = decontam.clean_rows(docs, spark.createDataFrame([(7, QUESTION)], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == [(2, "fine", "c", "d"), (3, None, "e", "f")]


def test_leaks_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, QUESTION), (4, "The quick brown fox jumps over the lazy dog near the quiet river bank"), (4, "The quick brown fox jumps over the lazy dog near the quiet river bank")], "item_id long, text string")
    got = decontam.matches(awkward, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 4), (4, 4)}
    clean = decontam.clean_rows(awkward, items)
    assert clean.columns == awkward.columns and {r.doc_id for r in clean.collect()} == {None, 2, 3, 5, 6, 7, 8, 9, 10}
    assert decontam.matches(nothing, items).count() == 0
    assert decontam.clean_rows(awkward, items.limit(0)).count() == awkward.count()
