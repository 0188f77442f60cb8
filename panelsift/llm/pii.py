"""Personal data: offset-preserving deobfuscation, detection, spans in the source text.

A text is rewritten by transducers that keep, for each character of their output, which
source characters it stands for: look-alike characters and invisible ones, then 'at' and
'dot' disguises, then spelled digits. The same detectors run on the source text (base
spans) and on the rewritten one; spans of the latter are mapped back and added unless
they lie inside a base span of their kind. A disguised span may so overlap a base span
that is a part of it; both are listed, and masking covers their union.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelsift.llm.common import map_texts, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PIECE = _LOCAL - {"."}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# greedy matches end where a run of digits ends, so none starts inside a run
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each '@' with what surrounds it: the same matches as a scan from the left, in linear time."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)
    return found


def _ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """Spans per kind in code points, leftmost and without overlap within a kind."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text) if digits and "." in text else [],
        "card": _cards(text) if digits else [],
        "phone": _phones(text) if digits and "+" in text else [],
    }


class Mapped:
    """A text and, per character, the source characters it stands for."""

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.begin = list(range(len(text))) if begin is None else begin
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replace the given stretches (in order, apart); replacements stand for the whole stretch."""
        parts, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        return Mapped("".join(parts), begin + self.begin[at:], end + self.end[at:])

    def source(self, span: Span) -> Span:
        return self.begin[span[0]], self.end[span[1] - 1]


# Letters of other scripts that look like a Latin one.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαοερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwABEKMHOPCTXYIJSaoepviktuABEZHIKMNOPTYX",
    )
)
INVISIBLE = "­​‌‍‎‏⁠﻿"


@lru_cache(maxsize=4096)
def plain(c: str) -> str:
    """The ASCII character another one stands for, '' for an invisible one, else itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else c


#: Anything outside ASCII and the accented Latin letters common in prose.
_STRANGE = re.compile(r"[^\x00-\x7fÀ-ɏ‐-‧€ ¿¡«»]|­")


def characters(text: Mapped) -> Mapped:
    edits = []
    for m in _STRANGE.finditer(text.text):
        new = plain(m[0])
        if new != m[0]:
            edits.append((*m.span(), new))
    return text.rewrite(edits) if edits else text


_AT_WORDS, _DOT_WORDS = "at|arobase|arroba", "dot|punkt|point|punto"
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:({_AT_WORDS}|@)|({_DOT_WORDS}|\.))\s*[\])}}>]\s*", re.I)
_AT_WORD = re.compile(rf"(?<=\s)(?:{_AT_WORDS})(?=\s)", re.I)
_DOT_WORD = re.compile(rf"(?<=\s)(?:{_DOT_WORDS})(?=\s)", re.I)
_SPOKEN_DOMAIN = re.compile(
    rf"[A-Za-z0-9-]++(?:(?:\s++(?:{_DOT_WORDS})\s++|\.)[A-Za-z0-9-]++)*?"
    rf"\s++(?:{_DOT_WORDS})\s++[A-Za-z0-9-]+(?:\s++(?:{_DOT_WORDS})\s++[A-Za-z0-9-]+)*(?!\w)",
    re.I,
)
_DOTS = frozenset(_DOT_WORDS.split("|"))
_DOT_LENGTHS = sorted({len(w) for w in _DOTS})


def _blanks_before(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1].isspace():
        at -= 1
    return at


def _dot_stretches(text: str, low: int, high: int) -> list[tuple[int, int, str]]:
    """Dot words between ``low`` and ``high`` with the blanks around them, apart from each other."""
    out = []
    for m in _DOT_WORD.finditer(text, low, high):
        begin, end = _blanks_before(text, m.start(), low), m.end()
        while end < high and text[end].isspace():
            end += 1
        if begin < m.start():  # else the blanks went with the word before
            out.append((begin, end, "."))
            low = end
    return out


def _spoken_local(text: str, end: int, low: int) -> int:
    """Where the local part that ends at ``end`` begins, -1 if there is none.

    Its pieces are joined by '.' or by dot words. It is walked backwards from the word
    'at', so that no character is looked at for more than one of those.
    """
    start = -1
    while True:
        begin = end
        while begin > low and text[begin - 1] in _PIECE:
            begin -= 1
        if begin == end:
            return start
        joined = begin > 0 and (text[begin - 1] in "._" or text[begin - 1].isalnum())
        if not joined:
            start = begin
        if begin > low and text[begin - 1] == ".":
            end = begin - 1
            continue
        stop = _blanks_before(text, begin, low)
        if stop == begin:
            return start
        for n in _DOT_LENGTHS:
            if stop - n > low and text[stop - n : stop].lower() in _DOTS:
                end = _blanks_before(text, stop - n, low)
                if end < stop - n:
                    break
        else:
            return start


def at_and_dot(text: Mapped) -> Mapped:
    edits, low = [], 0
    for m in _BRACKETED.finditer(text.text):
        edits.append((_blanks_before(text.text, m.start(), low), m.end(), "@" if m[1] else "."))
        low = m.end()
    if edits:
        text = text.rewrite(edits)
    if not _DOT_WORD.search(text.text):
        return text
    edits, low, source = [], 0, text.text
    for m in _AT_WORD.finditer(source):
        stop = _blanks_before(source, m.start(), low)
        if stop == m.start():
            continue
        start = _spoken_local(source, stop, low)
        begin = m.end()
        while begin < len(source) and source[begin].isspace():
            begin += 1
        domain = _SPOKEN_DOMAIN.match(source, begin) if start >= 0 else None
        if domain:
            low = domain.end()
            edits += [*_dot_stretches(source, start, stop), (stop, begin, "@"), *_dot_stretches(source, begin, low)]
    return text.rewrite(edits) if edits else text


# Digits as words, English, German, French, Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2",
    "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4",
    "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "plus": "+",
    "point": ".", "dot": ".", "punkt": ".", "punto": ".",
}
_ONE = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:(?:{_ONE})(?!\w)|\+?[0-9]+(?!\w))(?:[\s,.-]{{1,3}}(?:(?:{_ONE})(?!\w)|[0-9]+(?!\w))){{3,}}", re.I)
_WORD = re.compile(rf"(?<!\w)(?:{_ONE})(?!\w)", re.I)


def spelled_digits(text: Mapped) -> Mapped:
    """Runs of at least four digit words or numbers, some of them words, become digits."""
    edits = []
    if not _WORD.search(text.text):
        return text
    for run in _RUN.finditer(text.text):
        at = None
        for m in _WORD.finditer(text.text, run.start(), run.end()):
            # a separator next to a digit word goes with it
            if at is not None and not text.text[at : m.start()].strip(" \t\n,-"):
                edits.append((at, m.end(), DIGIT_WORDS[m[0].lower()])) if at < m.start() else None
            else:
                edits.append((*m.span(), DIGIT_WORDS[m[0].lower()]))
            at = m.end()
    return text.rewrite(edits) if edits else text


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of a whole text, per kind, in order of their start."""
    base = detect(text)
    rewritten = spelled_digits(at_and_dot(characters(Mapped(text)) if _needs_map(text) else Mapped("", [], [])))
    every = {k: list(v) for k, v in base.items()}
    if rewritten.text and rewritten.text != text:
        for kind, spans in detect(rewritten.text).items():
            starts = [a for a, _ in base[kind]]
            for span in map(rewritten.source, spans):
                i = bisect_right(starts, span[0]) - 1  # base spans are apart: only this one can hold it
                if i < 0 or base[kind][i][1] < span[1]:
                    every[kind].append(span)
            every[kind].sort()
    return base, every


_DISGUISE = re.compile(rf"[\[({{<]\s*(?:{_AT_WORDS}|{_DOT_WORDS}|@|\.)\s*[\])}}>]", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def _needs_map(text: str) -> bool:
    """Whether any transducer could change the text."""
    words = set(_LETTERS.findall(text.lower()))
    return bool(
        (not text.isascii() and _STRANGE.search(text))
        or (("[" in text or "(" in text or "{" in text or "<" in text) and _DISGUISE.search(text))
        or not _DOTS.isdisjoint(words)
        or (not words.isdisjoint(DIGIT_WORDS) and _RUN.search(text))
    )


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base counts per kind, base_sha256 and all spans as text.

    Null and empty texts have no spans. Repeated rows are searched each; other columns,
    whatever their names, are not read.
    """
    import hashlib

    def make():
        def work(batch: pa.RecordBatch):
            found = [find(t) for t in texts_of(batch, text)]
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
            sums = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *counts, pa.array(sums), pa.array([listed(s) for _, s in found], pa.string())],
                [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

        return work

    kind = dict(docs.dtypes)[key]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(docs.select(key, text), make, f"`{key}` {kind}, {counts}, base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    _, every = find(text)
    spans = sorted((a, b, k) for k in KINDS for a, b in every[k])
    out, at = [], 0
    for a, b, kind in spans:
        if a < at:  # overlaps the one before: nothing of it may stay
            at = max(at, b)
            continue
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in the text masked; null texts stay null, columns as they are."""

    def make():
        def work(batch: pa.RecordBatch):
            new = [None if t is None else mask(t) for t in batch.column(text).to_pylist()]
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

        return work

    return map_texts(docs, make, docs.schema)
