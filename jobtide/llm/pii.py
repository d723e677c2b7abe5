"""Personal data: patterns propose spans, checksums confirm them, context words nearby adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, with_columns

# The kinds in their order, and what each is replaced with.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# The local part of an address is found from its @, so that a long word without one costs nothing.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always starts where a run of digits starts and ends where one ends; the look-behind saves the retries inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that make a kind more likely within CONTEXT characters before or after a span.
CONTEXT_WORDS = {
    "email": ("mail", "email", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT = 40
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
BONUS = 0.3
#: Kinds without a checksum of their own count only from this score on; the base kinds always count.
THRESHOLD = 0.5
_NEAR = {k: re.compile(rf"(?<![a-z])(?:{'|'.join(w)})(?![a-z])", re.ASCII | re.IGNORECASE) for k, w in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in rest)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield s, last
        at = text.find("@", max(at + 1, last))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposed span may reach over words behind a number: the longest one that ends with a word and passes the checksum counts."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        while b > a and 15 <= len(s := text[a:b].replace(" ", "")) and not (len(s) <= 34 and mod97(s)):
            b = text.rfind(" ", a, b)
        found = b > a and len(s) >= 15
        if found:
            yield a, b
        m = _IBAN.search(text, b if found else a + 1)


def _mentions(words: re.Pattern, text: str, lo: int, hi: int) -> bool:
    """Whether a context word stands within text[lo:hi]; one that the end cuts off does not count."""
    m = words.search(text, max(0, lo), hi)
    return m is not None and not (m.end() == hi and text[hi : hi + 1].isascii() and text[hi : hi + 1].isalpha())


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) by kind and then start; positions count code points, the end is exclusive."""
    spans: list[tuple[str, int, int]] = [("email", a, b) for a, b in _emails(text)]
    digit = _FIRST_DIGIT.search(text)
    if digit:
        at = digit.start()
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text, at) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        spans += [("iban", a, b) for a, b in _ibans(text)]
        spans += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text, at)]
    out = []
    for kind, a, b in spans:
        near = _NEAR[kind]
        score = BASE_SCORE[kind] + (BONUS if _mentions(near, text, a - CONTEXT, a) or _mentions(near, text, b, b + CONTEXT) else 0)
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, a, b, min(1.0, score)))
    return out


_FIRST_DIGIT = re.compile("[0-9]")


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each stretch covered by spans becomes the tag of its first span, ``<EMAIL>`` and so on."""
    out, last = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, *keep: str, redacted: bool = False) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score) in the order of KINDS and then start; then the columns ``keep`` as they are.

    With ``redacted`` also the redacted text. One row for each input row, repeated rows included; a null or empty text has no spans and
    becomes the empty text; a null id stays null; an empty table gives no rows. Columns of other names, also ``spans`` or ``redacted``, do not clash unless kept. Every pattern is linear in the text, however long. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [find(t.as_py() or "") for t in b.column(1)]
            columns = [b.column(0), pa.array([[dict(zip(SPAN.names, s, strict=True)) for s in f] for f in found], _ARROW_SPANS)]
            if redacted:
                columns.append(pa.array([redact(t.as_py() or "", f) for t, f in zip(b.column(1), found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *b.columns[2:]], names=schema.names)

    kept = docs.select(*keep)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), *[T.StructField("redacted", T.StringType())] * redacted]
    schema = T.StructType([*fields, *kept.schema.fields])
    return with_columns(docs, *keep).mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their list, the list of all spans, and the spans' scores in that order."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
