"""Personal data in texts: patterns propose spans, checksums confirm, context adjusts the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always kept once confirmed.
Further kinds (iban, ssn, local phone numbers, secrets) start from a score by pattern; a passed
checksum or a context word near the span raises it, and they are kept from ``KEEP`` on unless a base
span overlaps them. A code that fails its checksum is no iban, whatever stands near it.

The searches are linear in the text: digit patterns may only start where a run of digits starts, and
the local part of an address is found backwards from its ``@``. Neither changes which spans match.

Null or empty text: no spans. Repeated rows are reported once each; a null id stays null.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns

BASE = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE, "iban", "ssn", "local_phone", "secret"))}
KEEP = 0.6
#: Characters before and after a span in which context words count.
WINDOW = 48
CONTEXT_GAIN = 0.35

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: kind, pattern, score of a bare match, words that speak for it.
EXTRA = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0.3, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    ("ssn", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), 0.5, ("ssn", "social security", "tax id")),
    ("local_phone", re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}\b"), 0.4, ("phone", "tel", "call", "fax", "mobile", "telefon")),
    ("secret", re.compile(r"\b(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})\b"), 0.4, ("token", "secret", "password", "api_key", "apikey", "key =")),
)
CHECKSUM_GAIN = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    s = code.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping addresses, found from each ``@`` outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHAR:
            begin -= 1
        if m and begin < at:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


def ibans(pattern: re.Pattern, text: str):
    """Spans with a right checksum; of a match that runs into the next words, the longest such start."""
    m = pattern.search(text)
    while m:
        a, b = m.span()
        ends = (k for k in range(b, a, -1) if k == b or text[k] == " ")
        end = next((k for k in ends if mod97(text[a:k])), None)
        if end:
            yield a, end
        m = pattern.search(text, end or a + 1)


def extra_spans(text: str) -> list[tuple[int, str, int, float]]:
    found = []
    for kind, pattern, score, words in EXTRA:
        if kind == "iban":
            score += CHECKSUM_GAIN
            spans = ibans(pattern, text)
        else:
            spans = (m.span() for m in pattern.finditer(text))
        for a, b in spans:
            s = score
            near = text[max(0, a - WINDOW) : b + WINDOW].lower()
            if any(w in near for w in words):
                s += CONTEXT_GAIN
            if s >= KEEP:
                found.append((a, kind, b, s))
    return found


def spans_of(text: str):
    """(base spans, all spans), each as (start, kind, end) in order of start and kind."""
    if not text or not HINT.search(text):
        return [], []
    order = lambda x: (x[0], KINDS[x[1]])
    base = sorted(base_spans(text), key=order)
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max, initial=0))
    more = [
        (a, kind, b) for a, kind, b, _ in extra_spans(text) if reach[bisect_left(starts, b)] <= a
    ]
    return base, sorted([*base, *more], key=order)


#: Every span holds a digit or an ``@``.
HINT = re.compile(r"[0-9@]")


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string"
)


def _finder():
    def work(ids, texts):
        both = [spans_of(t) for t in texts]
        out = {"doc_id": ids}
        for kind in BASE:
            out[f"n_{kind}"] = [sum(k == kind for _, k, _ in base) for base, _ in both]
        out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both]
        out["spans"] = [joined(every) for _, every in both]
        return out

    return work


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of the base spans and all spans."""
    return map_columns(id_and_text(docs), _finder, SCHEMA)


def redacted(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    _, spans = spans_of(text)
    out, free = [], 0
    for a, kind, b in spans:
        if a >= free:
            out += [text[free:a], f"[{kind}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; null texts stay null, other columns stay."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
