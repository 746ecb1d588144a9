"""Personal data in texts, disguised or not, with offsets into the source.

Four kinds of plain identifiers are found as their patterns say: e-mail addresses, IP
addresses, card numbers and telephone numbers.  Beyond them the text is deobfuscated by
transducers: homoglyphs and wide forms become ASCII, spelled digits become digits, and
"at" and "dot" disguises become signs.  Each output character remembers the source
characters it stands for, so a detection in the normalised text maps back to source spans.
Detections inside a failed plain match (a telephone number that runs into a card number)
are found by looking at its parts.

Plain spans always stay; a further span is added where it overlaps no plain span of its
kind.  The patterns take time in proportion to the text, and the spans found that of sorting
them.

Defined results: a null text counts as empty and has no spans; spans count code points
with exclusive ends, in order of start, then kind as listed in ``KINDS``; repeated rows are
answered one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A domain behind its @; the part before it is taken from the text, so that long runs without an @ cost nothing.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    if "@" not in text:
        return
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


PATTERNS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone),
)


def plain_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the plain patterns, and matches that failed their kind's test."""
    good: list[Span] = [(a, b, "email") for a, b in emails(text)]
    bad: list[Span] = []
    if DIGIT.search(text):
        for kind, pattern, test in PATTERNS:
            for m in pattern.finditer(text):
                (good if test(m[0]) else bad).append((m.start(), m.end(), kind))
    return good, bad


# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν" + "‐‑‒–—−․。",
    "ABESIJKMHOPCTYXaesijopcyxdqw" + "ABEZHIKMNOPTYXopv" + "------..",
)
# Characters without width.
INVISIBLE = frozenset("​‌‍⁠﻿­")
# Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS = frozenset({"plus"})
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
#: A run of spelled digits, perhaps among written ones; shorter runs are prose.
SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ ,-]+)?(?:(?:{_NUMBER}|[0-9])(?:[ ,.-]+|(?=[ ,.-]*$)|(?!\w))){{7,}}")
SPELLED_WORD = re.compile(rf"(?i)plus|{_NUMBER}|[0-9]")
BRACKETED = re.compile(r"(?i)[\[({<]\s*+(at|dot|punkt|punto|point|arobase|arroba)\s*+[\])}>]\s*+")
#: Bare words count only together: name at host dot top-level name.
BARE = re.compile(
    r"(?i)(?<![\w.])[a-z0-9._%+-]{1,64}( +(?:at|arobase|arroba) +)[a-z0-9-]{1,63}(?: +(?:dot|punkt|punto|point) +[a-z0-9-]{1,63}){1,4}(?!\w)"
)
BARE_DOT = re.compile(r"(?i) +(?:dot|punkt|punto|point) +")
#: Blanks around the @ before a host that is written as usual, or with blanks around its last dot and a common ending.
SPACED = re.compile(
    r"[A-Za-z0-9_%+-]( *@ +| +@ *)[A-Za-z0-9-]+(?:(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?: *\. *)(?:com|org|net|edu|info|io|de|fr|es))(?![\w-])"
)
ODD = re.compile("[Ͱ-ԯ​-‍‐-―․⁠−。﻿­！-～٠-٩۰-۹]")


def _glyph(c: str) -> str:
    if c in INVISIBLE:
        return ""
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E:
        return chr(code - 0xFEE0)
    for zero in (0x0660, 0x06F0):
        if zero <= code <= zero + 9:
            return chr(48 + code - zero)
    return c.translate(LOOKALIKES)


class Rewriting(NamedTuple):
    """Replaced spans of a text, in order: where they stand in the new text and in the old one."""

    new_starts: list[int]
    new_ends: list[int]
    old_starts: list[int]
    old_ends: list[int]

    def old(self, at: int) -> tuple[int, int]:
        """The old span of the new character at a place."""
        k = bisect_right(self.new_starts, at) - 1
        if k < 0:
            return at, at + 1
        if at < self.new_ends[k]:
            return self.old_starts[k], self.old_ends[k]
        at += self.old_ends[k] - self.new_ends[k]
        return at, at + 1


class Normalised:
    """A text after some rewritings, each of which knows where its characters come from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.rewritings: list[Rewriting] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the current text; each new character stands for the whole span."""
        if not edits:
            return
        done = Rewriting([], [], [], [])
        out, at, size = [], 0, 0
        for a, b, new in sorted(edits):
            if a < at:
                continue
            out += [self.text[at:a], new]
            size += a - at
            for where, value in zip(done, (size, size + len(new), a, b), strict=True):
                where.append(value)
            size += len(new)
            at = b
        out.append(self.text[at:])
        self.text = "".join(out)
        self.rewritings.append(done)

    def source(self, a: int, b: int) -> tuple[int, int]:
        for r in reversed(self.rewritings):
            a, b = r.old(a)[0], r.old(b - 1)[1]
        return a, b


class Taken:
    """Disjoint spans of one kind, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> bool:
        """Takes a span if it is free."""
        if not self.free(a, b):
            return False
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def normalise(text: str) -> Normalised | None:
    """The text after the transducers, or None if they leave it as it is."""
    n = Normalised(text)
    if ODD.search(text):
        n.rewrite([(m.start(), m.end(), _glyph(m[0])) for m in ODD.finditer(text) if _glyph(m[0]) != m[0]])
    edits = []
    for m in BRACKETED.finditer(n.text):
        start, last = m.start(), edits[-1][1] if edits else 0
        while start > last and n.text[start - 1].isspace():
            start -= 1
        edits.append((start, m.end(), "@" if m[1].lower() in ("at", "arobase", "arroba") else "."))
    for m in BARE.finditer(n.text):
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(m.end(1) + d.start(), m.end(1) + d.end(), ".") for d in BARE_DOT.finditer(n.text[m.end(1) : m.end()])]
    for m in SPACED.finditer(n.text):
        edits.append((m.start(1), m.end(1), "@"))
    n.rewrite(edits)
    edits = []
    for m in SPELLED_RUN.finditer(n.text):
        words = list(SPELLED_WORD.finditer(m[0]))
        if not any(w[0].lower() in SPELLED for w in words):
            continue
        for k, w in enumerate(words):
            new = "+" if w[0].lower() in PLUS else SPELLED.get(w[0].lower(), w[0])
            # The separators inside the run go with the word before them.
            end = words[k + 1].start() if k + 1 < len(words) else w.end()
            edits.append((m.start() + w.start(), m.start() + end, new))
    n.rewrite(edits)
    return None if n.text == text else n


def _parts(text: str, span: Span) -> list[Span]:
    """Identifiers among the parts of a number that failed as a whole.

    Usual lengths go first (16 digits of a card, 11 of a telephone number), then longer
    parts; a part begins and ends where the number has a separator.
    """
    a, b, kind = span
    if kind == "ip":
        return []
    piece = text[a:b]
    usual, least, most, test = (16, 12, 19, is_card) if kind == "card" else (11, 9, 15, is_phone)
    begins = [0, *[m.end() for m in re.finditer("[ -]+", piece)]]
    ends = [*begins[1:], len(piece)]
    digits = [len(_digits(piece[i:j])) for i, j in zip(begins, ends, strict=True)]
    found = []
    for i, begin in enumerate(begins):
        if kind == "phone" and piece[begin] != "+":
            continue
        n = 0
        for j in range(i, len(ends)):
            n += digits[j]
            if n > most:
                break
            # A further piece without a digit makes no other number.
            if digits[j] and n >= least:
                part = piece[begin : ends[j]].rstrip(" -.(")
                if test(part):
                    found.append((n != usual, -n, a + begin, a + begin + len(part)))
    taken = Taken()
    return [(x, y, kind) for _, _, x, y in sorted(found) if taken.add(x, y)]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans with those the method adds, in order."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base, bad = plain_spans(text)
    every = sorted(base, key=order)
    taken = {kind: Taken() for kind in KINDS}
    for a, b, kind in every:
        taken[kind].add(a, b)
    base = list(every)
    for a, b, kind in bad:
        for x, y, _ in _parts(text, (a, b, kind)):
            # A card number found in the same run of digits is no part of a telephone number.
            if (kind == "card" or taken["card"].free(x, y)) and taken[kind].add(x, y):
                every.append((x, y, kind))
    other = normalise(text)
    if other is not None:
        for a, b, kind in plain_spans(other.text)[0]:
            start, end = other.source(a, b)
            if taken[kind].add(start, end):
                every.append((start, end, kind))
    return base, sorted(every, key=order)


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def private_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the count of plain spans of each kind, base and spans as ``kind:start:end`` lists."""
    names = ["id", *[f"n_{k}" for k in KINDS], "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                found = [find(t or "") for t in piece.column(1).to_pylist()]
                yield pa.record_batch(
                    [
                        piece.column(0),
                        *[pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS],
                        pa.array([_shown(b) for b, _ in found]),
                        pa.array([_shown(s) for _, s in found]),
                    ],
                    names,
                )

    out = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    )
    return out.withColumnRenamed("id", id)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the spans of each text masked."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(text, mask(F.col(text)))

