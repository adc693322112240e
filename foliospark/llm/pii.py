"""Personal data, also where it is disguised, with spans in the source's own offsets.

Base detectors read the text as it is.  For disguises, a transducer rewrites homoglyphs, spelled
digits and at/dot disguises and notes for every character it writes which source characters it came
from; the same detectors read the rewritten text, and their spans are mapped back.  A mapped span
counts unless it lies within a base span of its kind; one that reaches beyond stands beside it.

Cases: null text counts as empty; empty tables give no rows; a row's result depends on its text
alone, so repeated rows repeat; columns besides doc_id and text are ignored, whatever their names.  All
scans are linear in the text for any content, spans are compared by binary search, and what is kept of
a rewritten text grows with its disguises, so very long texts are safe.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain identifiers, by start, then kind as listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return [(a, KINDS[k], b) for a, k, b in out]


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o",
    "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "ı": "i", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
#: The names of digits, and of the sign before a phone number.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
#: Characters without width, which disguises put between others.
_HIDDEN = "​‌‍⁠﻿­"
_CHARACTERS = (
    LOOKALIKES
    | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms of ASCII
    | {chr(first + d): str(d) for first in (0x660, 0x6F0, 0x966, 0x2080, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
    | dict.fromkeys(_HIDDEN, "")
)
_ODD = re.compile("[" + "".join(map(re.escape, _CHARACTERS)) + "]")
_NAMES = "|".join(SPELLED)
_UNIT = rf"(?:\b(?:{_NAMES})\b|[0-9])"
#: Five or more digits in a row of which some are spelled; separators stay.
_NUMBER = re.compile(rf"(?:\bplus[ -]?)?{_UNIT}(?:[ .-]{{0,2}}{_UNIT}){{4,}}", re.I)
_NAME = re.compile(rf"\b({_NAMES})\b", re.I)
_SOME_NAME = re.compile(rf"\b(?:{'|'.join(k for k in SPELLED if k not in ('oh', 'plus'))})\b", re.I)
_WRAPPED = re.compile(r" ?[\[({<] ?(at|dot) ?[\])}>] ?", re.I)
#: Bare words count only as a whole: name at host dot domain, with dots in the name as well.
_BARE = re.compile(r"( at |@)[A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)+", re.I)
_AT_OR_DOT = re.compile(r" (at|dot) ", re.I)
_SIGNS = {"at": "@", "dot": "."}


class Rewritten:
    """A text with, for each character, the source range it stands for.

    Every round of edits is kept as the places it changed, so memory grows with the disguises, not
    with the text; a place is mapped back through the rounds by binary search.
    """

    def __init__(self, text: str):
        self.text = text
        #: per round: starts and ends of edits in the new text, and in the text before
        self.rounds: list[tuple[array, array, array, array]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies (start, end, new text) edits, in order and apart; new characters stand for the whole edit."""
        if not edits:
            return
        text, at, size = [], 0, 0
        new_a, new_b, old_a, old_b = kept = tuple(array("q") for _ in range(4))
        for a, b, new in edits:
            text += [self.text[at:a], new]
            size += a - at
            new_a.append(size)
            size += len(new)
            new_b.append(size)
            old_a.append(a)
            old_b.append(b)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.rounds.append(kept)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source range of the characters [a, b)."""
        last = b - 1
        for new_a, new_b, old_a, old_b in reversed(self.rounds):
            i = bisect_right(new_a, a) - 1
            if i >= 0:
                a = old_a[i] if a < new_b[i] else old_b[i] + a - new_b[i]
            i = bisect_right(new_a, last) - 1
            if i >= 0:
                last = old_b[i] - 1 if last < new_b[i] else old_b[i] + last - new_b[i]
        return a, last + 1


def _local_start(text: str, end: int, least: int) -> int:
    """Where the local part before `end` starts, its dots plain or spelled; `end` if there is none."""
    start = end
    while True:
        at = start
        while at > least and text[at - 1] in _LOCAL:
            at -= 1
        if at == start:  # no name before this dot
            return min(end, start + len(" dot ")) if start < end else end
        if at - len(" dot ") < least or text[at - len(" dot ") : at].lower() != " dot ":
            return at
        start = at - len(" dot ")


def deobfuscate(text: str) -> Rewritten | None:
    """The rewritten text, or None if no disguise occurs."""
    out = Rewritten(text)
    if not text.isascii():
        out.replace([(m.start(), m.end(), _CHARACTERS[m[0]]) for m in _ODD.finditer(out.text)])
    low = out.text.lower()
    if "at" in low or "dot" in low:
        out.replace([(m.start(), m.end(), _SIGNS[m[1].lower()]) for m in _WRAPPED.finditer(out.text)])
        low = out.text.lower()
        if " at " in low or " dot " in low:
            edits, last = [], 0
            for m in _BARE.finditer(out.text):
                start = _local_start(out.text, m.start(), last)
                if start < m.start():
                    edits += [(x.start(), x.end(), _SIGNS[x[1].lower()]) for x in _AT_OR_DOT.finditer(out.text, start, m.end())]
                    last = m.end()
            out.replace(edits)
    if _SOME_NAME.search(out.text):
        edits = []
        for m in _NUMBER.finditer(out.text):
            for x in _NAME.finditer(out.text, m.start(), m.end()):
                stop = x.end()
                if x[1].lower() == "plus":  # the sign stands right before its number
                    stop += len(out.text[stop : stop + 1].strip()) == 0 and stop < m.end()
                edits.append((x.start(), stop, SPELLED[x[1].lower()]))
        out.replace(edits)
    return out if out.text != text else None


def find(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans with those behind disguises."""
    text = text or ""
    base = detect(text)
    plain = deobfuscate(text)
    if plain is None:
        return base, base
    starts: dict[str, list[int]] = {k: [] for k in KINDS}
    ends: dict[str, list[int]] = {k: [] for k in KINDS}
    for a, kind, b in base:
        starts[kind].append(a)
        ends[kind].append(b)
    more = []
    for a, kind, b in detect(plain.text):
        a, b = plain.source(a, b)
        # base spans of a kind lie apart, so only the last that starts no later can hold this one
        i = bisect_right(starts[kind], a) - 1
        if i < 0 or ends[kind][i] < b:
            more.append((a, kind, b))
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256, spans."""
    counts = [f"n_{k}" for k in KINDS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {c: [] for c in [*counts, "base_sha256", "spans"]}
        for text in batch.column(1).to_pylist():
            base, spans = find(text)
            for k in KINDS:
                cols[f"n_{k}"].append(sum(x[1] == k for x in base))
            cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols["spans"].append(_joined(spans))
        kinds = [pa.int64()] * len(counts) + [pa.string()] * 2
        return pa.record_batch([batch.column(0), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))], ["doc_id", *cols])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
