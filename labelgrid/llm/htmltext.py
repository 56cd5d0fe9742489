"""Main text of web pages: a recurrent labeller decides block by block, seeing the whole page.

A page is cut into leaf blocks (text between block-level tags). Each block is read as the mean of its tag path's vectors (hashed tags, classes
and ids of its ancestors), the mean of its hashed words' vectors, and a few figures; a bidirectional LSTM in numpy runs over all blocks of the
page and labels each of them. Scripts, styles, comments, text areas and the head are no text at all and never become blocks; fallback text and formulas
are text like any other.

Training: a bounded sample of the pages themselves, labelled by what their tags say where they say it (article or main against navigation,
footers, adverts, ...), and layouts assembled from the same pages' sentences with such tags renamed, left out, or joined by further
furniture, so that context has to decide as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.shared import about
from labelgrid.llm.words import U64, flat, pieces, word_hashes, word_spans

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 600, 50_000, 1500
PATH_ROWS, PATH_DIM, WORD_ROWS, WORD_DIM, FIGURES, HIDDEN = 1024, 16, 2048, 6, 5, 16
EPOCHS, BATCH, RATE = 5, 48, 0.01
SLICE_BYTES = 2 << 20

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math".split())
BREAKS = frozenset(
    "address article aside audio blockquote body br button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul video".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
NO_CLOSE_OF_P = frozenset("a abbr audio b bdi bdo br button canvas cite code data del dfn em font i iframe img input ins kbd label link mark math meta noscript object q s samp select small span strong sub sup svg template time tt u var video wbr option".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select option label fieldset dialog menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo promotion banner menu nav navbar navigation sidebar side footer header masthead topbar cookie cookies consent notice alert comment comments reply replies discussion related recommended share sharing social newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager widget popup modal overlay copyright disclaimer toolbar tags meta".split()
)
CONTENT_WORDS = ("content", "post", "entry", "story", "article-body", "main-text", "post-content", "text", "body-copy")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Block:
    """Text of a leaf, its ancestors' names (tag, then tag with each class or id word), and how many of its characters are links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """All leaf blocks of a page in order; one pass over its tags."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    state = {"linked": 0, "links": 0, "foreign": 0}

    def flush() -> None:
        text = " ".join("".join(texts).split())
        if text and not any(tag == "head" for tag, _ in stack):
            out.append(Block(text, tuple(n for _, names in stack for n in names), min(state["linked"], len(text))))
        texts.clear()
        state["linked"] = 0

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            texts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    def pop(to: int) -> None:
        state["links"] -= sum(tag == "a" for tag, _ in stack[to:])
        state["foreign"] -= sum(tag in FOREIGN for tag, _ in stack[to:])
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            say(page[at:])
            break
        say(page[at:low])
        found = TOKEN.match(page, low) or LOOSE.match(page, low)
        if not found:
            say("<")
            at = low + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        closing, tag = bool(found[1]), found[2].lower()
        if closing:
            if tag in BREAKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if (tag in FOREIGN or state["foreign"]) and found[3].endswith("/"):  # only there a slash closes an element
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BREAKS:
            flush()
        if tag == "body":
            pop(next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        if not state["foreign"] and (tag in CLOSES or tag not in NO_CLOSE_OF_P):
            closes = CLOSES.get(tag, ()) + (("p",) if tag not in NO_CLOSE_OF_P else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop(k)
                    break
                if stack[k][0] in BREAKS and stack[k][0] not in ("p", "td", "th", "dt", "dd", "tbody"):
                    break
        if tag not in VOID:
            words = [w for a, b, c in NAMED.findall(found[3]) for w in re.split(r"[\s_-]+", (a or b or c).lower()) if w] if found[3] else []
            stack.append((tag, (tag, *(f".{w}" for w in words))))
            state["links"] += tag == "a"
            state["foreign"] += tag in FOREIGN
    flush()
    return out


def told(block: Block) -> int | None:
    """What the tags say: 0 for furniture, 1 for article text, None where they don't say."""
    if any(n in FURNITURE_TAGS or n[:1] == "." and n[1:] in FURNITURE_WORDS for n in block.path) or "header" in block.path and "article" not in block.path:
        return 0
    return 1 if "article" in block.path or "main" in block.path else None


def layout(rng: np.random.Generator, sentences: list[str]) -> tuple[list[Block], list[int]]:
    """A made-up page of the given sentences: an article among furniture, under names drawn at random."""
    some = lambda: sentences[rng.integers(len(sentences))]
    short = lambda: " ".join(some().split()[: rng.integers(1, 6)]) or "more"
    one = lambda *x: x[rng.integers(len(x))]
    found: list[Block] = []
    labels: list[int] = []

    def put(text: str, path: tuple[str, ...], label: int, linked: bool = False) -> None:
        if text:
            found.append(Block(text, ("html", "body", *path), len(text) if linked else 0))
            labels.append(label)

    def links(path: tuple[str, ...], n: int) -> None:
        for _ in range(n):
            put(short(), (*path, *one(("ul", "li"), ("div",), ("p",), ())), 0, True)

    def furniture(kind: str) -> None:
        if kind == "menu":
            links(one(("nav",), ("div", ".menu"), ("div", ".nav"), ("ul", ".navbar"), ("header", "nav"), ("div",)), rng.integers(3, 9))
        elif kind == "header":
            place = one(("header",), ("div", ".header"), ("div", ".masthead"))
            put(short(), (*place, one("h1", "div", "p")), 0, bool(rng.integers(2)))
            if rng.random() < 0.5:
                put(some(), (*place, "p"), 0)
        elif kind == "ad":
            place = one(("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("aside", ".promo"), ("section", ".sponsored"), ("div", ".banner"))
            for _ in range(rng.integers(1, 3)):
                put(one(some, short)(), (*place, *one((), ("p",))), 0, rng.random() < 0.3)
        elif kind == "notice":
            place = one(("div", ".cookie", ".banner"), ("div", ".notice"), ("div", ".alert"), ("section", ".consent"))
            put(some(), (*place, *one((), ("p",))), 0)
            put(short(), (*place, "button"), 0)
        elif kind == "form":
            place = one(("form",), ("form", ".search"), ("form", ".newsletter"), ("div", ".signup", "form"))
            for _ in range(rng.integers(1, 4)):
                put(one(some, short)(), (*place, *one(("label",), ("button",), ("p",), ("select", "option"))), 0)
        elif kind == "sidebar":
            place = one(("aside",), ("div", ".sidebar"), ("aside", ".related"), ("div", ".widget"))
            put(short(), (*place, one("h2", "h3")), 0)
            if rng.random() < 0.5:
                links(place, rng.integers(2, 6))
            else:
                for _ in range(rng.integers(1, 4)):
                    put(some(), (*place, "p"), 0)
        elif kind == "comments":
            place = one(("div", ".comments"), ("section", ".comments"), ("section", ".discussion"), ("ol", ".comment", ".list"))
            put(short(), (*place, "h3"), 0)
            for _ in range(rng.integers(1, 6)):
                put(some(), (*place, *one(("div", ".comment", "p"), ("li", ".comment"), ("article", ".comment", "p"), ("div", ".reply"))), 0)
        else:
            place = one(("footer",), ("div", ".footer"), ("footer", ".site", ".footer"))
            put("© " + short(), (*place, *one((), ("p",))), 0)
            if rng.random() < 0.5:
                put(some(), place, 0)
            if rng.random() < 0.5:
                links(place, rng.integers(1, 5))

    for kind in rng.permutation(["header", "menu", "ad", "notice", "form"])[: rng.integers(1, 5)]:
        furniture(kind)
    content = one(("article",), ("article",), ("main",), ("main", "article"), ("div", *(f".{w}" for w in one(*CONTENT_WORDS).split("-"))), ("div", ".content", "article"), ("div",), ())
    if rng.random() < 0.85:
        put(short() if rng.random() < 0.5 else some(), (*content, *(one((), ("header",)) if "article" in content else ()), "h1"), 1)
    for _ in range(rng.integers(1, 12)):
        if rng.random() < 0.12:
            put(short(), (*content, one("h2", "h3")), 1)
        elif rng.random() < 0.12:
            for _ in range(rng.integers(2, 5)):
                put(one(some, short)(), (*content, "ul", "li"), 1)
        put(some() if rng.random() < 0.9 else short(), (*content, *one(("p",), ("p",), ("p", "b"), ("div", "p"), ("blockquote",), ("section", "p"), ())), 1)
        if rng.random() < 0.06:
            furniture(one("ad", "form", "notice"))
    for kind in rng.permutation(["sidebar", "comments", "ad", "form", "menu"])[: rng.integers(0, 4)]:
        furniture(kind)
    if rng.random() < 0.9:
        furniture("footer")
    return found, labels


def name_rows(names: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(names, pa.string()))
    return (word_hashes(data, offsets[:-1], offsets[1:]) % U64(PATH_ROWS)).astype(np.int64)


class Read:
    """Blocks of many pages as index arrays: path rows, word rows, figures, and each page's first block."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        every = [b for p in pages for b in p]
        known: dict[str, int] = {}
        codes = [known.setdefault(n, len(known)) for b in every for n in b.path or ("",)]
        rows = name_rows(list(known))
        self.path, self.path_sizes = rows[np.array(codes, np.int64)] if codes else rows, np.array([len(b.path) or 1 for b in every], np.int64)
        data, offsets = flat(pa.array([b.text for b in every], pa.string()))
        starts, ends, firsts = word_spans(data, offsets)
        self.word = (word_hashes(data, starts, ends, lower=True) % U64(WORD_ROWS)).astype(np.int64)
        self.word_sizes = np.diff(firsts)
        chars = np.array([len(b.text) for b in every], float)
        place = np.concatenate([(np.arange(n) + 0.5) / n for n in self.sizes]) if every else np.zeros(0)
        linked = np.array([b.linked for b in every], float) / np.maximum(chars, 1)
        ended = np.array([b.text[-1] in ".!?…" for b in every], float) if every else np.zeros(0)
        self.figures = np.column_stack([np.log1p(chars) / 4, np.log1p(self.word_sizes) / 3, linked, ended, place]).astype(np.float32)


def mean_rows(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros((0, table.shape[1]), np.float32)
    sums = np.add.reduceat(np.concatenate([table[rows], np.zeros((1, table.shape[1]), table.dtype)]), np.minimum(np.cumsum(sizes) - sizes, len(rows)), axis=0)
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 0).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        size = PATH_DIM + WORD_DIM + FIGURES
        self.p = {"path": draw(PATH_ROWS, PATH_DIM, scale=0.7), "word": draw(WORD_ROWS, WORD_DIM, scale=0.1), "out": draw(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            self.p |= {f"x{d}": draw(size, 4 * HIDDEN, scale=size**-0.5), f"h{d}": draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), f"b{d}": bias}

    def inputs(self, read: Read) -> np.ndarray:
        return np.concatenate([mean_rows(self.p["path"], read.path, read.path_sizes), mean_rows(self.p["word"], read.word, read.word_sizes), read.figures], axis=1)

    def run(self, x: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Logits (pages, steps) of padded pages. at: row of x of each step."""
        n, steps = at.shape
        states, tape = np.zeros((n, steps, 2 * HIDDEN), np.float32), {"f": [], "b": []}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            gates, u = x @ self.p[f"x{d}"] + self.p[f"b{d}"], self.p[f"h{d}"]
            h = c = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = gates[at[:, t]] + h @ u
                i, f, o = (sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                new = np.tanh(g[:, 3 * HIDDEN :])
                here = inside[:, t, None]
                c2 = np.where(here, f * c + i * new, c)
                squashed = np.tanh(c2)
                h2 = np.where(here, o * squashed, h)
                if keep:
                    tape[d].append((t, h, c, i, f, o, new, squashed))
                h, c = h2, c2
                states[:, t, part] = h
        logits = states @ self.p["out"] + self.p["bias"][0]
        return (logits, states, tape) if keep else logits

    def gradients(self, read: Read, at: np.ndarray, inside: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over labelled blocks; ``at`` covers all blocks of ``read``."""
        p, x = self.p, self.inputs(read)
        logits, states, tape = self.run(x, at, inside, keep=True)
        share = weights[at] * inside
        d_logit = ((sigmoid(logits) - labels[at]) * share / max(1.0, share.sum())).astype(np.float32)
        grad = {"out": np.einsum("nt,nth->h", d_logit, states), "bias": np.array([d_logit.sum()])}
        d_states = d_logit[:, :, None] * p["out"]
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p[f"h{d}"]
            d_h = d_c = np.zeros((len(at), HIDDEN), np.float32)
            d_gates, d_u = np.zeros((len(x), 4 * HIDDEN), np.float32), np.zeros_like(u)
            for t, h, c, i, f, o, new, squashed in reversed(tape[d]):
                here = inside[:, t, None]
                d_h = d_h + d_states[:, t, part]
                d_own = np.where(here, d_h, 0)
                d_cell = np.where(here, d_c, 0) + d_own * o * (1 - squashed * squashed)
                d_g = np.concatenate([d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), d_own * squashed * o * (1 - o), d_cell * i * (1 - new * new)], axis=1)
                np.add.at(d_gates, at[:, t][here[:, 0]], d_g[here[:, 0]])
                d_u += h.T @ d_g
                d_h = np.where(here, 0, d_h) + d_g @ u.T
                d_c = np.where(here, d_cell * f, d_c)
            grad |= {f"h{d}": d_u, f"x{d}": x.T @ d_gates, f"b{d}": d_gates.sum(0)}
            d_x += d_gates @ p[f"x{d}"].T
        for name, rows, sizes, part in (("path", read.path, read.path_sizes, slice(0, PATH_DIM)), ("word", read.word, read.word_sizes, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
            grad[name] = np.zeros_like(p[name])
            np.add.at(grad[name], rows, np.repeat(d_x[:, part] / np.maximum(sizes, 1)[:, None], sizes, axis=0).astype(np.float32))
        return grad

    def label(self, pages: list[list[Block]], chunk: int = 256) -> list[np.ndarray]:
        """For each page which of its blocks are main text."""
        read = Read(pages)
        x, out = self.inputs(read), np.zeros(int(read.firsts[-1]), bool)
        order = np.argsort(read.sizes, kind="stable")
        for a in range(0, len(order), chunk):
            some = order[a : a + chunk]
            at, inside = padded(read.firsts[some], read.sizes[some])
            if at.size:
                out[at[inside]] = self.run(x, at, inside)[inside] > 0
        return [out[a:b] for a, b in zip(read.firsts[:-1], read.firsts[1:], strict=True)]


def padded(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(int(sizes.max()) if len(sizes) else 0)
    inside = steps < sizes[:, None]
    return np.where(inside, firsts[:, None] + steps, 0), inside


def train(pages: list[str], seed: int = 3) -> Labeller:
    """Train on the given pages and on layouts of their sentences. The same pages give the same labeller."""
    rng = np.random.default_rng(seed)
    real = [b for b in map(blocks, pages) if b]
    labelled = [(b, [told(x) for x in b]) for b in real]
    labelled = [(b, y) for b, y in labelled if 1 in y]
    sentences = [s for b in real for x in b for s in re.findall(r"[^.!?]+[.!?]", x.text)[:20]] or ["Some words make a sentence."]
    sentences = [" ".join(sentences[k : k + rng.integers(1, 5)]) for k in range(0, len(sentences), 3)]
    examples = labelled + [layout(rng, sentences) for _ in range(LAYOUTS)]
    net, step = Labeller(seed), 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        batches = [order[a : a + 8 * BATCH] for a in range(0, len(order), 8 * BATCH)]
        batches = [np.array(sorted(b, key=lambda k: len(examples[k][0])))[a : a + BATCH] for b in batches for a in range(0, len(b), BATCH)]
        for batch in batches:
            read = Read([examples[k][0] for k in batch])
            known = [y for k in batch for y in examples[k][1]]
            at, inside = padded(read.firsts[:-1], read.sizes)
            labels, weights = np.array([y or 0 for y in known], np.float32), np.array([y is not None for y in known], np.float32)
            step += 1
            for k, g in net.gradients(read, at, inside, labels, weights).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fit(pages: DataFrame, most: int = TRAIN_PAGES) -> Labeller:
    """Train on at most ``most`` pages of at most TRAIN_CHARS characters, those of the smallest hash."""
    usable = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= TRAIN_CHARS).withColumn("h", F.xxhash64("html"))
    # Hashes first, so that only the chosen pages travel.
    chosen = [r.h for r in about(usable.select("h"), most, "h").distinct().orderBy("h").limit(most).collect()]
    found = usable.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    return train([r.html for r in found.collect()])


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url and text of every page: the blocks labelled as main text, in page order, joined by one space.

    A null or empty page, or one without main text, gives an empty text. Null and repeated ids and urls are passed on row by row; an empty table
    gives an empty result; other columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(labeller)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", SLICE_BYTES):
            found = [blocks(h or "") for h in batch.column("html").to_pylist()]
            texts = [" ".join(b.text for b, own in zip(p, own_, strict=True) if own) for p, own_ in zip(found, model.value.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(rows, "page_id long, url string, text string")


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.length("text").cast("long"))
