import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from labelgrid.llm import htmltext, neighbours, quality, toxicity


def numeric_slope(net, loss, name, grad):
    """The steepest parameter's gradient against a difference quotient."""
    at, step = np.unravel_index(np.argmax(np.abs(grad)), grad.shape), 1e-3
    net.p[name][at] += step
    high = loss()
    net.p[name][at] -= 2 * step
    low = loss()
    net.p[name][at] += step
    return (high - low) / (2 * step), grad[at]


def test_toxicity_gradients():
    words = toxicity.Words(pa.array(["a b bad c", "good day to you all " * 10, "bad thing", "hello"]))
    net = toxicity.Network(words.hashes)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    starts, rows = words.window_starts()
    codes, inside = toxicity.window_codes(words, starts, rows)
    known, y = net.known(words.hashes), np.array([1, 0, 1, 0])[rows]

    def loss():
        logits = net.run(net.gates(net.inputs(known, words.tri, words.tri_starts, words.tri_sizes)), codes, inside)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, logits, -logits))))

    for name, grad in net.gradients(words, known, codes, inside, y.astype(float)).items():
        near, own = numeric_slope(net, loss, name, grad)
        assert near == pytest.approx(own, rel=1e-2, abs=1e-6), name


def test_labeller_gradients():
    rng = np.random.default_rng(1)
    examples = [htmltext.layout(rng, ["One two three.", "Four five."]) for _ in range(3)]
    read = htmltext.Read([e[0] for e in examples])
    at, inside = htmltext.padded(read.firsts[:-1], read.sizes)
    y = np.array([v for e in examples for v in e[1]], float)
    net = htmltext.Labeller()
    net.p = {k: v.astype(float) for k, v in net.p.items()}

    def loss():
        logits = net.run(net.inputs(read).astype(float), at, inside)[inside]
        return np.mean(np.log1p(np.exp(-np.where(y[at[inside]] == 1, logits, -logits))))

    for name, grad in net.gradients(read, at, inside, y, np.ones(len(y))).items():
        near, own = numeric_slope(net, loss, name, grad)
        assert near == pytest.approx(own, rel=2e-2, abs=1e-5), name


def test_windows_cover_every_word():
    words = toxicity.Words(pa.array(["w " * n for n in (0, 1, 31, 32, 33, 52, 53, 1000)]))
    starts, rows = words.window_starts()
    for r, (a, b) in enumerate(zip(words.firsts[:-1], words.firsts[1:])):
        own = starts[rows == r]
        assert own.tolist() == list(range(a, max(a + 1, b - toxicity.WINDOW + 1))) if b > a else not len(own)


def plain_states(net, words, low, high, first, last, backwards):
    """State of every word of the segment [low, high) of the row [first, last), step by step, after up to WARM words of warm-up."""
    d, span = ("b", range(min(last, high + toxicity.WARM) - 1, low - 1, -1)) if backwards else ("f", range(max(first, low - toxicity.WARM), high))
    x = net.inputs(net.known(words.hashes), words.tri, words.tri_starts, words.tri_sizes).astype(float)
    h, out, n = np.zeros(toxicity.HIDDEN), {}, toxicity.HIDDEN
    for at in span:
        g, a = x[words.codes[at]] @ net.p[f"x{d}"] + net.p[f"b{d}"], h @ net.p[f"h{d}"].astype(float)
        z, r = (1 / (1 + np.exp(-(g[k * n : k * n + n] + a[k * n : k * n + n]))) for k in (0, 1))
        c = np.tanh(g[2 * n :] + r * a[2 * n :])
        h = (1 - z) * c + z * h
        out[at] = h
    return out


def test_scores_equal_a_plain_recomputation_by_window():
    """Every window's attention, pooling and logit from states computed one at a time; texts of all lengths around windows and segments."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(60, size=n)) for n in (0, 1, 5, 31, 32, 33, 100, 255, 256, 257, 288, 600)]
    words = toxicity.Words(pa.array(texts))
    net = toxicity.Network(words.hashes[::2])
    net.p["attend"] *= 20
    logits, rows = net.window_logits(words)
    starts, _ = words.window_starts()
    best = np.zeros(len(texts))
    for r, (first, last) in enumerate(zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist())):
        states = {}
        for low in range(first, last, toxicity.SEGMENT):
            high = min(low + toxicity.SEGMENT, last)
            ahead, back = (plain_states(net, words, low, high, first, last, way) for way in (False, True))
            states |= {at: np.concatenate([ahead[at], back[at]]) for at in range(low, high)}
        for at in np.flatnonzero(rows == r):
            window = np.stack([states[k] for k in range(starts[at], min(starts[at] + toxicity.WINDOW, last))])
            weigh = np.exp(window @ net.p["attend"])
            logit = (weigh / weigh.sum()) @ window @ net.p["out"] + net.p["bias"][0]
            assert logits[at] == pytest.approx(logit, abs=2e-4)
            best[r] = max(best[r], 1 / (1 + np.exp(-logit)))
    assert net.scores(words) == pytest.approx(best, abs=1e-4)


def test_a_passage_scores_alike_wherever_it_stands():
    """Its states know words around it, so scores move a little with the place, but not with the segment that a place falls into."""
    rng = np.random.default_rng(6)
    net = toxicity.Network(np.zeros(0, np.uint64))
    score = lambda words: net.scores(toxicity.Words(pa.array([" ".join(words)])))[0]
    plain = [f"word{i}" for i in rng.integers(200, size=400)]
    passage = max(([f"bad{i}" for i in rng.integers(500, size=3 * toxicity.WINDOW)] for _ in range(200)), key=score)
    inner = [score(plain[:at] + passage + plain[at:]) for at in range(100, 300, 7)]
    assert min(inner) > score(plain) and max(inner) - min(inner) < 0.02 and abs(score(passage) - inner[0]) < 0.02


def test_chosen_windows_do_not_overlap():
    rng = np.random.default_rng(9)
    rows, starts = np.repeat([0, 2, 3], [100, 3, 70]), np.concatenate([np.arange(100), np.arange(200, 203), np.arange(300, 370)])
    values = rng.random(len(rows)) - 5
    most = np.array([3, 9, 1, 2])
    picked = toxicity.choose(values, starts, rows, most)
    for r in (0, 2, 3):
        own, left = [], np.where(rows == r, values, -np.inf)
        while len(own) < most[r] and np.isfinite(left).any():
            own.append(int(left.argmax()))
            left[np.abs(starts - starts[own[-1]]) < toxicity.WINDOW] = -np.inf
        assert sorted(own) == [p for p in picked if rows[p] == r]


def toxic_texts(rng, n):
    plain = [f"word{i}" for i in range(200)]
    out = []
    for k in range(n):
        words = list(rng.choice(plain, rng.integers(5, 120)))
        if k % 4 == 0:
            for _ in range(1 + len(words) // 30):
                words[rng.integers(len(words))] = rng.choice(["grumblefink", "grumbleost", "zorkness", "Zork,"])
        out.append((" ".join(words), int(k % 4 == 0)))
    return out


def test_toxicity_on_held_out_rows(spark, awkward, nothing):
    rows = toxic_texts(np.random.default_rng(2), 900)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = toxicity.digest(toxicity.score(docs, net)).toPandas().set_index("doc_id")
    truth = pd.Series({i: y for i, (_, y) in enumerate(rows)})
    held = got[got["held_out"]]
    assert set(held.index) == {i for i in range(900) if toxicity.is_held_out(i)}
    assert (held["predicted"] == truth[held.index]).mean() > 0.97
    unseen = net.scores(toxicity.Words(pa.array(["word1 word2 grumblewarp word3 word4", "word1 word2 word5 word3 word4"])))
    assert unseen[0] > unseen[1]
    # A single bad word in a very long text counts, wherever it stands.
    long = " ".join(f"word{i % 200}" for i in range(5000))
    assert net.scores(toxicity.Words(pa.array([long + " grumblefink zorkness", long])))[0] > 0.7
    scored = toxicity.score(awkward, net).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 for r in scored)
    assert next(r.score for r in scored if r.doc_id == 2) == 0
    assert toxicity.score(nothing, net).count() == 0
    assert toxicity.clean_rows(awkward, net).columns == awkward.columns
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.clean_rows(awkward, None).count() == awkward.count()


def test_long_texts_are_learned_from(spark):
    rows = [(t + " filler" * 20 + " ") * (25_000 // (len(t) + 141) + 1) if y else t for t, y in toxic_texts(np.random.default_rng(3), 120)]
    assert min(len(t) for t in rows[::4]) > toxicity.TRAIN_CHARS
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 > 0)) for i in range(120)], "doc_id long, toxic int, quality int")
    assert toxicity.fit(docs, labels) is not None and quality.fit(docs, labels) is not None
    for fit in (toxicity.fit, quality.fit):
        with pytest.raises(ValueError):
            fit(docs.where("doc_id % 4 > 0"), labels)
    cut = docs.limit(1).select(toxicity.excerpts("text").alias("t"), "text").first()
    assert len(cut.t) <= toxicity.TRAIN_CHARS + toxicity.EXCERPTS and cut.t[:900] == cut.text[:900] and cut.t[-900:] == cut.text[-900:]


# --- pages ---

PAGES = [
    (1, "u1", "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>First  paragraph &amp; more.<p>Second <b>bo</b>ld one.<script>var x='<p>no</p>';</script></article><footer>&copy; me</footer>"),
    (2, None, None),
    (3, "u3", ""),
    (4, "u4", "<p>unclosed <b>tags <div>everywhere"),
    (5, "u5", "no tags at all, 1 < 2 && 3 > 2 <"),
    (None, "u6", "<!-- <p>never</p> --><style>p{}</style>"),
    (1, "u1", "<title>t</title>" + "<div>" * 3000 + "deep" + "</div>" * 10),
]


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return htmltext.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_blocks():
    found = htmltext.blocks(PAGES[0][2])
    assert [b.text for b in found] == ["Home", "A title", "First paragraph & more.", "Second bold one.", "© me"]
    assert found[0].linked == 4 and found[2].path[-1] == "p" and "nav" not in found[2].path
    assert [b.text for b in htmltext.blocks("a&lt;b <p class='x y'>c<br>d</p><li>e<li>f")] == ["a<b", "c", "d", "e", "f"]
    assert htmltext.blocks("<div title='a>b' class=\"ad big\">x</div>")[0].path == ("div", ".ad", ".big")
    assert [b.text for b in htmltext.blocks(PAGES[4][2])] == ["no tags at all, 1 < 2 && 3 > 2 <"]


def test_embedded_elements_take_nothing_with_them():
    told = lambda page: [b.text for b in htmltext.blocks(page)]
    assert told('<p>one <svg viewBox="0 0 1 1"/> two</p><p>x <math/> three</p>') == ["one two", "x three"]
    assert told("<p>a <math><mi>m</mi><mspace/><mo>=</mo><mn>1</mn></math> b<p>c") == ["a m=1 b", "c"]
    assert told("<svg><title/><path d='M0'/><text>label</text></svg><p>after") == ["label", "after"]
    for tag in ("noscript", "object", "canvas", "video", "audio", "iframe", "template", "svg", "math"):
        assert told(f"<p>before</p><{tag}><p>inside</p></{tag}><p>after</p>") == ["before", "inside", "after"], tag
        assert told(f"<p>before</p><{tag}><p>the rest</p><p>of it</p>") == ["before", "the rest", "of it"], tag
    assert told("a<script>no<p>no</script>b<style>no</style>c<textarea>no</textarea>d<title>no") == ["abcd"]


def test_extract(spark, labeller, sf):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = htmltext.digest(htmltext.extract(pages, labeller)).collect()
    assert len(got) == len(PAGES)
    one = next(r for r in got if r.page_id == 1 and "title" in r.text)
    assert one.text == "A title First paragraph & more. Second bold one." and one.n_chars == len(one.text)
    assert next(r for r in got if r.page_id == 2).text == "" and next(r for r in got if r.page_id is None).text == ""
    assert htmltext.extract(pages.limit(0), labeller).count() == 0
    assert htmltext.fit(pages.limit(0)) is not None


def test_articles_of_the_tables(spark, labeller):
    """Pages of another table than those trained on; the article stands between its tags there."""
    rows = htmltext.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), labeller).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    article = {i: " ".join(b.text for b in htmltext.blocks(h) if "article" in b.path) for i, h in pages.items()}
    assert np.mean([article[r.page_id] == r.text for r in rows]) > 0.98


def test_layouts_never_seen(labeller):
    rng = np.random.default_rng(77)
    sentences = [" ".join(f"word{rng.integers(500)}" for _ in range(rng.integers(4, 25))) + "." for _ in range(300)]
    examples = [htmltext.layout(rng, sentences) for _ in range(150)]
    labels = labeller.label([e[0] for e in examples])
    assert np.mean([a == b for e, own in zip(examples, labels) for a, b in zip(e[1], own)]) > 0.95


# --- neighbours ---


def brute(x, q, k):
    scores = x @ x[q]
    scores[q] = -np.inf
    return set(np.argsort(-scores)[:k])


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = vectors.toPandas().sort_values("vec_id")
    x = np.stack(table["embedding"]).astype(float)
    got = neighbours.search(vectors, block_rows=100).toPandas()
    hits = [len(brute(x, q, 20) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == (table["vec_id"] % 20 == 0).sum() and np.mean(hits) >= 0.9
    assert np.allclose(got["score"], [x[a] @ x[b] for a, b in zip(got["query_id"], got["vec_id"])], rtol=1e-12)


def test_outliers_and_small_clusters_get_full_lists(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([centres[rng.integers(40, size=1980)] + 0.01 * rng.normal(size=(1980, 64)), 2 * rng.normal(size=(12, 64)), 0.01 * rng.normal(size=(8, 64)) + 3 * rng.normal(size=64)])
    x = x[rng.permutation(len(x))]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, "vec_id % 2 = 0", block_rows=500).toPandas()
    sizes = got.groupby("query_id").size()
    assert set(sizes.index) == set(range(0, len(x), 2)) and (sizes == 20).all() and not got.duplicated(["query_id", "vec_id"]).any()
    assert (got.groupby("query_id")["rank"].max() == 20).all() and min(len(brute(x, q, 20) & set(g["vec_id"])) for q, g in got.groupby("query_id")) >= 10


def test_probing_misses_nothing():
    rng = np.random.default_rng(5)
    model = neighbours.Codes(rng.normal(size=(300, 32)))
    x = rng.normal(size=(500, 32))
    codes, ids = model.encode(x), np.arange(500)
    for radius in (0, 3, 4, 7, 11, 32):
        model.radius = radius
        for q, found, _ in neighbours.search_block(model, ids, x, codes, ids[:20], x[:20], 500):
            far = neighbours.BITS_SET[codes ^ codes[q]].sum(1)
            assert set(found) == set(np.flatnonzero(far <= radius)) - {q}


@pytest.mark.parametrize("dim", [32, 70])
def test_queries_of_a_block_are_probed_together(dim):
    """As by brute force over codes of one and two words, in a few calls a query (each value of each table had one)."""
    import sys

    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, dim))
    model, ids = neighbours.Codes(x[:500]), np.arange(2000)
    model.radius = 5 * dim // 12
    codes, calls = model.encode(x), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = list(neighbours.search_block(model, ids, x, codes, ids[:600], x[:600], 20))
    finally:
        sys.setprofile(None)
    assert calls < 40 * 600 and [g[0] for g in got] == list(range(600))
    for q, found, scores in got[::50]:
        near = np.flatnonzero((neighbours.BITS_SET[codes ^ codes[q]].sum(1) <= model.radius) & (ids != q))
        want = near[np.argsort(-(x[near] @ x[q]))[:20]]
        assert found.tolist() == want.tolist() and np.allclose(scores, x[want] @ x[q])


def test_search_awkward(spark):
    rows = [(i, [float(i % 5 + 1), 1.0, 0.0]) for i in range(40)]
    rows += [(40, None), (41, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (61, [float("nan"), 1.0, 1.0]), (62, [float("inf"), 1.0, 1.0]), (63, [1.0]), (None, [1.0, 1.0, 1.0]), (80, []), (0, [1.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS rank", "3 AS block")
    got = neighbours.search(frame).toPandas()
    assert set(got["query_id"]) == {0, 20}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        want = sorted(((-(rows[q][1][0] * (i % 5 + 1) + 1.0), i) for i in range(40) if i != q))[:20]
        assert g["vec_id"].tolist() == [i for _, i in want] and g["score"].tolist() == [-s for s, _ in want]
    assert neighbours.search(frame.limit(0)).count() == 0
    few = neighbours.search(frame.where("vec_id < 3")).toPandas()
    assert len(few) == 2


# --- quality ---


def test_quality(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = labels.toPandas().set_index("doc_id")["quality"]
    train, test = labels.where("doc_id % 2 = 0"), truth[truth.index % 2 == 1]
    got = quality.posterior(docs, quality.fit(docs, train)).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and (got.loc[test.index, "kept"] == (test == 1)).mean() > 0.97
    assert len(quality.posterior(awkward, quality.fit(docs, labels)).collect()) == awkward.count()
    assert quality.posterior(nothing, None).count() == 0 and quality.fit(docs, labels.limit(0)) is None


def test_sparse_sites_are_drawn_to_the_level_above(spark):
    rng = np.random.default_rng(0)
    rows = [(f"={h}", f"={h}/={p}", 0.0, float(q)) for h, q0 in (("good", 0.95), ("bad", 0.1)) for p in range(4) for q in np.clip(rng.normal(q0, 0.05, 300), 0.01, 0.99)]
    rows += [("=bad", "=bad/=tiny", 0.0, 0.99), ("=new", "=new/=0", 0.0, 0.2)]
    scored = spark.createDataFrame(rows, "host string, path string, ratio double, p double")
    got = quality.site_posteriors(scored).toPandas().set_index("path")
    tiny = (got["mass"] + got["path_weight"] * got["host_mean"]) / (got["n"] + got["path_weight"])
    assert tiny["=bad/=tiny"] < 0.6 and tiny["=good/=1"] > 0.9 and tiny["=bad/=1"] < 0.15
    assert 0.2 < got["host_mean"]["=new/=0"] < 0.55


def test_figures_by_plain_counting():
    texts = ["Aa a.\nAa a.", "", "x9 é!! %%%", None]
    got = quality.figures(pa.array(texts))
    half = got.shape[1] // 2
    assert got[0][:half][[0, 1, 3]].tolist() == pytest.approx([4 / 11, 2 / 11, 3 / 11])
    assert got[0][half - 4 : half].tolist() == pytest.approx([0.5, 0.0, 0.5, 0.0])
    assert got[2][half - 1] == pytest.approx(1 / 3) and np.isfinite(got).all() and (got[1] == got[3]).all()
