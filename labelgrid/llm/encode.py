"""Token ids of whole texts with a vocabulary file of the tokenizers library.

Both vocabularies split texts before any white space that follows other text, and nothing to the left changes what follows. A text is
therefore cut there, each distinct piece is encoded once, and the ids are put together again: the same ids at a fraction of the work.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from labelgrid.llm.words import LOWER, SPACE, U64, flat, ragged, word_hashes

#: White space of more than one byte, before which a following space must not be cut off: pairs of bytes, and leading pairs of three.
LONG_SPACES_2 = ((0xC2, 0x85), (0xC2, 0xA0))
LONG_SPACES_3 = ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which a text may be cut: row starts and white space right after something else."""
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    back = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    bad = back[0] < 0x20  # control characters: left alone
    for a, b in LONG_SPACES_2:
        bad |= (back[1] == a) & (back[0] == b)
    for a, b in LONG_SPACES_3:
        bad |= (back[2] == a) & (back[1] == b)
    cut[at[bad]] = False
    cut[offsets] = True
    cut[-1] = False
    return np.flatnonzero(cut)


#: One plain word as it occurs in a piece: a space or line break at most, precomposed Latin letters, then ASCII punctuation but ' and <.
PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
PROBES = ["word", " word", " Word.", "\nÉtüde,", " ñandú", "\nI.", " aß,", "Über", " antidisestablishmentarianism.", " well%%%", "x_-;"]
JOINED = 128
CHAINED = 1024
WORDS = 8192
ASCII_LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[list(range(33, 127))] = True
MARK &= ~ASCII_LETTER
MARK[[*range(48, 58), 0x27, 0x3C]] = False


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pieces, given one after another, fit PLAIN as a whole, and how many bytes of leading space and of letters each has."""
    letter = ASCII_LETTER[data]
    two = np.zeros(len(data), bool)  # first byte of a letter from 192 on
    two[:-1] = (data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter |= two
    letter[1:] |= two[:-1]
    mark = MARK[data]
    back = np.zeros(len(data), bool)  # a letter after a mark
    back[1:] = mark[:-1] & letter[1:]
    back[offsets[:-1]] = False
    first = data[offsets[:-1]]
    space = ((first == 32) | (first == 10)).astype(np.int64)
    letters, marks, backs = (np.add.reduceat(x, offsets[:-1], dtype=np.int64) for x in (letter, mark, back))
    return (space + letters + marks == np.diff(offsets)) & (letters > 0) & (backs == 0), space, letters


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes of texts of ASCII and precomposed Latin letters in lower case."""
    out = LOWER[data]
    out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return out


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: itself where printable, else the next one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by one vocabulary file; ``keep`` distinct pieces are remembered between calls, by their 64-bit hashes. When there are more, those
    that came once go, as most pieces do.

    A new plain word goes straight to the library's model in the form that its own splitting gives it, many at a time, the parts of a form
    told apart by the bytes that each id stands for; which form that is (spaces dropped and lower case, or kept as they are) is settled by
    comparing both with the library's full encoding of a few probes. All else, and every piece if neither form agrees, goes through the full
    encoding; without a normaliser many at a time: those between two cuts one after another, as in a text, told apart likewise, the others
    with a special token between them.
    """

    def __init__(self, path: str, end_id: int, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end_id, self.keep = end_id, keep
        self.forget()
        self.letters = byte_letters()
        forms = [lambda space, word, mark: (word.lower(), mark), lambda space, word, mark: ("", space + word, mark) if space == " " else (space, word, mark)]
        self.form = next((f for f in forms if all(self.plain(f, PLAIN.fullmatch(x)) == self.full(x) for x in PROBES)), None)
        self.lower = self.form is forms[0]
        # A special token that takes no white space from its neighbours, as a mark between pieces: (text, id).
        marks = [(t.content, k) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[0] if marks and self.tokenizer.normalizer is None else None
        self.id_bytes = self.bytes_of_ids() if self.mark else None
        self.words = self.word_encoder() if self.form else None

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, form, match: re.Match) -> bytes:
        out = b""
        for part in form(*match.groups()):
            if part:
                ids = self.parts.get(part)
                if ids is None:
                    told = "".join(map(self.letters.__getitem__, part.encode()))
                    ids = self.parts[part] = np.array([x.id for x in self.tokenizer.model.tokenize(told)], "<u4").tobytes()
                out += ids
        return out

    def singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        self.parts = {}  # words of this call's pieces, which differ in marks or case only
        found = [self.plain(self.form, match) if self.form and (match := PLAIN.fullmatch(x)) else self.full(x) for x in texts]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def jointly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``singly``, from one text with the mark between its pieces; where a piece holds the mark itself, there are too many of them."""
        mark, mark_id = self.mark
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0].ids, "<u4")
        between = ids == mark_id
        if between.sum() != len(texts) - 1:
            return self.singly(texts)
        return ids[~between], np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1

    def bytes_of_ids(self) -> np.ndarray | None:
        """How many bytes of text each id stands for; None where that doesn't add up for the probes (not a byte-level vocabulary)."""
        out = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for told, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[k] = len(told)
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            out[k] = len(token.content.encode())
        return out if all(out[np.frombuffer(self.full(x), "<u4")].sum() == len(x.encode()) for x in PROBES) else None

    def word_encoder(self):
        """The library's model behind a split at blanks, for words written as the model's letters; None where it gives other ids for the probes.

        With it the code point of each byte and how many bytes each id stands for, an end-of-word mark not counted.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        words, end = Tokenizer(self.tokenizer.model), getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        id_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for told, k in words.get_vocab(with_added_tokens=False).items():
            id_bytes[k] = len(told) - (len(end) if end and told.endswith(end) else 0)
        self.words = words, np.array([ord(self.letters[b]) for b in range(256)], "<u4"), id_bytes
        parts = [part.encode() for x in PROBES for part in self.form(*PLAIN.fullmatch(x).groups()) if part]
        ends = np.cumsum([len(x) for x in parts])
        found = self.of_words(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        return self.words if found and found[0].tobytes() == b"".join(map(self.full, PROBES)) else None

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of parts of plain words one after another, and how many each has; None where the bytes of the ids don't add up."""
        words, points, id_bytes = self.words
        found = []
        for k in range(0, len(starts), WORDS):
            sizes = ends[k : k + WORDS] - starts[k : k + WORDS]
            upto = np.cumsum(sizes)
            letters = np.insert(points[data[ragged(starts[k : k + WORDS], sizes)]], upto[:-1], 32)
            ids = np.array(words.encode_batch_fast([letters.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
            told = np.cumsum(id_bytes[ids])
            last = np.searchsorted(told, upto)
            if not len(told) or told[-1] != upto[-1] or not np.array_equal(told[last], upto):
                return None
            found.append((ids, np.diff(last, prepend=-1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def wordwise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are plain words, and of those the ids one after another and how many each has. Each distinct part is encoded once."""
        none = np.zeros(len(offsets) - 1, bool), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.words is None:
            return none
        fits, space, letters = plain_words(data, offsets)
        start, end, space = offsets[:-1][fits], offsets[1:][fits], space[fits]
        word, mark = start + space, start + space + letters[fits]
        if self.lower:  # the form without spaces
            data, edges = lowered(data), [word, mark, end]
        else:  # a blank goes with its word, a line break stands by itself
            edges = [start, np.where(data[start] == 32, start, word), mark, end]
        edges = np.stack(edges, 1)
        some = edges[:, 1:] > edges[:, :-1]
        starts, ends, piece = edges[:, :-1][some], edges[:, 1:][some], np.nonzero(some)[0]
        codes, _ = pd.factorize(word_hashes(data, starts, ends))
        first = first_places(codes)
        found = self.of_words(data, starts[first], ends[first])
        if found is None:
            return none
        ids, sizes = found
        places, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        return fits, ids[ragged(places, sizes)], np.bincount(piece, sizes, len(start)).astype(np.int64)

    def chained(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``singly`` for pieces that a text may hold one after another: where the joined text would not be cut between them, or an id
        reaches from one into the next, they go the other way."""
        joined, ends = b"".join(texts), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = piece_starts(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        if np.array_equal(cuts[1:], ends[:-1]):
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum(self.id_bytes[ids])
            last = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
            if upto[-1] == len(joined) and np.array_equal(upto[last], ends):
                return ids, np.diff(last, prepend=-1)
        return self.jointly([x.decode() for x in texts])

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new pieces and add them to the sorted table of known ones."""
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        data = data[ragged(starts, ends - starts)]
        fits, *words = self.wordwise(data, offsets)
        raw, left = data.tobytes(), np.flatnonzero(~fits)
        texts = [raw[a:b] for a, b in zip(offsets[left].tolist(), offsets[left + 1].tolist(), strict=True)]
        inner, found = 0, [tuple(words)]
        if self.id_bytes is not None:
            # Pieces that begin with white space and don't end with it first: those can follow one another.
            inside = np.fromiter((SPACE[x[0]] and not SPACE[x[-1]] for x in texts), bool, len(texts))
            order = np.argsort(~inside, kind="stable")
            texts, left, inner = [texts[k] for k in order.tolist()], left[order], int(inside.sum())
            found += [self.chained(texts[k : min(k + CHAINED, inner)]) for k in range(0, inner, CHAINED)]
        rest = [x.decode() for x in texts[inner:]]
        if rest:
            found += [self.jointly(rest[k : k + JOINED]) for k in range(0, len(rest), JOINED)] if self.mark else [self.singly(rest)]
        hashes = hashes[np.concatenate([np.flatnonzero(fits), left])]
        new, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        places = len(self.values) + np.cumsum(sizes) - sizes
        self.values = np.concatenate([self.values, new])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, places[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.again = np.insert(self.again, at, False)

    def forget(self) -> None:
        self.hashes, self.places, self.sizes, self.values, self.parts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), {}
        self.again = np.zeros(0, bool)  # came in more than one call

    def forget_rare(self, room: int) -> None:
        """Only pieces that came again stay, if they leave room for ``room`` more and are at most half of what is kept."""
        stay = np.flatnonzero(self.again)
        if len(stay) > self.keep // 2 or len(stay) + room > self.keep:
            return self.forget()
        sizes = self.sizes[stay]
        self.values = self.values[ragged(self.places[stay], sizes)]
        self.hashes, self.places, self.sizes, self.again = self.hashes[stay], np.cumsum(sizes) - sizes, sizes, np.zeros(len(stay), bool)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, each row closed by the end id, and the row offsets."""
        data, offsets = flat(column)
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        codes, distinct = pd.factorize(word_hashes(data, starts, ends))
        if len(self.hashes) + len(distinct) > self.keep:
            self.forget_rare(len(distinct))
        order = np.argsort(distinct)  # rising, so that neighbours in the table are looked up one after another
        rising = distinct[order]
        at = np.searchsorted(self.hashes, rising)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != rising[inside]
        self.again[at[~new]] = True
        if new.any():
            first = first_places(codes)[order[new]]
            self.learn(data, starts[first], ends[first], rising[new])
            at = np.searchsorted(self.hashes, rising)
        place = np.empty(len(distinct), np.int64)
        place[order] = at
        at = place[codes]
        sizes = self.sizes[at] if len(codes) else np.zeros(0, np.int64)
        ids = self.values[ragged(self.places[at], sizes)] if len(codes) else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        rows = upto[np.searchsorted(starts, offsets)]
        rows[-1] = len(ids)
        return np.insert(ids, rows[1:], np.uint32(self.end_id)), rows + np.arange(len(rows))


def first_places(codes: np.ndarray) -> np.ndarray:
    """Where each code of ``pd.factorize`` stands first."""
    first = np.empty(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


KEEP = 1_000_000
_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int, keep: int = KEEP) -> Encoder:
    """One encoder for each file and task: this module travels to a task with its code."""
    if (path, end_id, keep) not in _encoders:
        _encoders[path, end_id, keep] = Encoder(path, end_id, keep)
    return _encoders[path, end_id, keep]


def forget_encoders() -> None:
    """For the end of a task, as its worker stays and the next task makes its own encoders."""
    _encoders.clear()


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
