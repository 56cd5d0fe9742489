"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has a pattern, an optional check (Luhn for cards, mod-97 for account numbers, ranges for addresses) and a score to start from.
A word that speaks for the kind within ``NEAR`` characters before the span adds to the score, one that speaks against it takes from it;
spans at or above ``threshold`` are reported. Base kinds (email, ip, card, phone) are certain once their check holds and start at a score
that no context takes below the threshold; the other kinds need their checksum or the right words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.llm.words import pieces

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
NEAR = 40
BATCH_BYTES = 16 << 20

# Starting scores, and words (lower case) that raise or lower the score of a kind.
START = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.7, "ssn": 0.3, "local_phone": 0.3}
UP, DOWN = 0.3, 0.2
FOR = {
    "email": ("mail", "e-mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = {"ip": ("version", "release"), "card": ("order", "invoice", "isbn"), "iban": ("serial", "part"), "ssn": ("part", "order"), "local_phone": ("order", "part", "isbn")}

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of international account numbers: the first four characters go last, letters count from 10."""
    plain = account.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, from one @ to the next, in time linear in the text."""
    domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind whose check holds, kind by kind; a match that fails its check is dropped and not tried again."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not re.search("[0-9]", text):
        return
    # A possessive digit run behind no digit gives the same leftmost matches without trying each digit of a long run.
    for m in re.finditer(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])++", text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        yield "ssn", *m.span()
    for m in re.finditer(r"(?<![0-9+])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", text):
        yield "local_phone", *m.span()


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, by start and then by kind as listed in ``START``."""
    order, found = list(START), []
    for kind, start, end in proposals(text):
        words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text[max(0, start - NEAR) : start].lower()))
        score = START[kind] + UP * bool(words.intersection(FOR[kind])) - DOWN * bool(words.intersection(AGAINST.get(kind, ())))
        if score >= threshold or kind in BASE:
            found.append((kind, start, end, round(min(score, 1.0), 3)))
    return sorted(found, key=lambda x: (x[1], order.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) of every row's whole text.

    A null or empty text has no spans. Null and repeated doc_ids are passed on row by row; an empty table gives an empty result; other
    columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def spans(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t or "", threshold)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(spans, f"doc_id long, spans {SPANS}")


def mask(text: str, threshold: float = THRESHOLD) -> str:
    """``text`` with each span, or each run of overlapping spans, replaced by its first kind in brackets."""
    out, upto = [], 0
    for kind, start, end, _ in find(text, threshold):
        if start >= upto:
            out += [text[upto:start], f"[{kind.upper()}]"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with masked texts and, where there is such a column, n_chars brought in line for changed texts. All columns and rows stay; null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def masked(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            texts = [None if t is None else mask(t, threshold) for t in batch.column("text").to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.schema["text"].dataType
    if not isinstance(plain, T.StringType):
        docs = docs.withColumn("text", F.col("text").cast("string"))
    if "n_chars" not in names:
        return docs.mapInArrow(masked, docs.schema)
    kind = docs.schema["n_chars"].dataType
    return docs.mapInArrow(masked, docs.schema).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
