"""Personal data, also disguised: transducers with an offset for every character, detectors, spans in the source.

The detectors find e-mail addresses, IPv4 addresses, card numbers and phone numbers in the text as it stands; these
base spans always stay. The text then passes through transducers that undo disguises: look-alike characters, foreign
and wide digits, hidden characters and character references; spelled digits in English, German, French and Spanish
("plus four nine ..."); ``at`` and ``dot`` in words or brackets. Every character of the normalised text knows the source
characters it came from, so what the same detectors find there is reported at its place in the source. Such a span is
added when the normalised text differs from the source and it overlaps no base span.

Words are undone only where they can be part of an identifier: plain ``at`` needs a plain ``dot`` after it, spelled
digits need four in a row. All steps are linear in the text. Odd input: a null text is empty; ids are passed through,
null or repeated.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobtally.llm.tables import apart, inner

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ZONE = re.compile(r"[+0-9][0-9 .()\-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Span]:
    """Leftmost spans of each kind that pass its test, by start and kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        if b - a < 9:
            continue
        for m in _CARD.finditer(text, a, b):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ѵ": "v", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "п": "n", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "﹫": "@", "。": ".", "․": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ",
    "\u2007": " ", "\u202f": " ",
}
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e"
# Digits as words.
_SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_DIGIT = {word: digit for digit, words in _SPELLED.items() for word in words.split()}
# Words for the two signs, by language.
_SIGNS = (("at|klammeraffe", "dot|punkt"), ("arobase", "point"), ("arroba", "punto"))
_AT, _DOT = ("|".join(pair[i] for pair in _SIGNS) for i in (0, 1))
_DOTS = frozenset(_DOT.split("|"))


def _char(c: str) -> str:
    """What one character of another script or width stands for; the character itself if nothing."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c in _HIDDEN:
        return ""
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isalnum() else c


def _odd() -> dict[str, str]:
    """Every character that ``_char`` changes; letters with accents are none of them."""
    ranges = [(0x660, 0x3300), (0xA000, 0xABFF), (0xFE00, 0xFFF0), (0x10400, 0x12000), (0x16A00, 0x17000), (0x1D400, 0x1D800), (0x1E100, 0x1FBFA)]
    places = [*map(ord, [*_LOOKALIKES, *_HIDDEN]), *(c for a, b in ranges for c in range(a, b))]
    return {chr(c): new for c in places if (new := _char(chr(c))) != chr(c)}


_ODD = _odd()
_REFERENCE = re.compile(r"&(?:#(?:64|x40)|commat|#(?:46|x2e)|period);", re.I)
_ITEM = re.compile(r"[^\W_]+|\+")
_JOIN = re.compile(r"[ \t,\-]{1,3}")
_BRACKETED = re.compile(rf"[\[({{<_*|][ \t]*({_AT}|{_DOT})[ \t]*[\])}}>_*|]", re.I)
_PLAIN = [
    (re.compile(rf"[ \t]+(?:{dot})[ \t]+", re.I), re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?P<at>[ \t]+(?:{at})[ \t]+|@)[A-Za-z0-9-]{{1,63}}(?:(?:[ \t]+(?:{dot})[ \t]+|\.)[A-Za-z0-9-]{{1,63}})+(?![^\W_])", re.I))
    for at, dot in _SIGNS
]
LEAST_SPELLED = 4


class Tape:
    """A text on its way through transducers; each character keeps the source span it stands for."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order and apart, by texts whose characters stand for the whole span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += self.text[at:a], new
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]


def _characters(tape: Tape) -> None:
    tape.rewrite([(i, i + 1, _ODD[c]) for i, c in enumerate(tape.text) if c in _ODD])
    tape.rewrite([(m.start(), m.end(), "@" if re.search("64|40|commat", m.group()) else ".") for m in _REFERENCE.finditer(tape.text)])


def _digits(tape: Tape) -> None:
    """Runs of spelled digits, also with single digits and words for a dot among them, and a plus before."""
    edits, run, spelled = [], [], 0

    def close() -> None:
        nonlocal spelled
        while run and run[-1][2] == ".":
            run.pop()
        if spelled >= LEAST_SPELLED:
            at = run[0][0]
            for a, b, new in run:
                if a > at:
                    edits.append((at, a, ""))
                edits.append((a, b, new))
                at = b
        run.clear()
        spelled = 0

    for item in _ITEM.finditer(tape.text):
        word = item.group().lower()
        new = _DIGIT.get(word) or ("+" if word in ("plus", "+") else "." if word in _DOTS else word if len(word) == 1 and word in "0123456789" else None)
        if new is None or new == "+" or run and not _JOIN.fullmatch(tape.text, run[-1][1], item.start()):
            close()
        if new is None or new == "." and not run:
            continue
        run.append((item.start(), item.end(), new))
        spelled += word in _DIGIT
    close()
    tape.rewrite(edits)


def _signs(tape: Tape) -> None:
    edits = []
    for m in _BRACKETED.finditer(tape.text):
        a, b = m.span()
        while a and tape.text[a - 1] in " \t" and (not edits or a > edits[-1][1]):
            a -= 1
        while b < len(tape.text) and tape.text[b] in " \t":
            b += 1
        edits.append((a, b, "." if m.group(1).lower() in _DOTS else "@"))
    tape.rewrite(edits)
    for dot, plain in _PLAIN:
        edits = []
        for m in plain.finditer(tape.text) if dot.search(tape.text) else ():
            edits += [(m.start("at"), m.end("at"), "@")] if m.group("at") != "@" else []
            edits += [(d.start(), d.end(), ".") for d in dot.finditer(tape.text, m.end("at"), m.end())]
        tape.rewrite(edits)


def _disguised(text: str) -> bool:
    """Whether any transducer may have something to undo; cheap, as most texts have nothing."""
    if not text.isascii() and not _ODD.keys().isdisjoint(set(text)) or _BRACKETED.search(text) or "&" in text and _REFERENCE.search(text):
        return True
    found = text.lower().replace(",", " ").replace("-", " ").split()
    different = set(found)
    if not _DOTS.isdisjoint(different):
        return True
    return len(_DIGIT.keys() & different) > 1 and sum(map(_DIGIT.__contains__, found)) >= LEAST_SPELLED


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the normalised text shows."""
    base = detect(text)
    if not _disguised(text):
        return base, []
    tape = Tape(text)
    for step in (_characters, _digits, _signs):
        step(tape)
    if tape.text == text:
        return base, []
    taken = sorted((s, e) for s, _, e in base)
    added = []
    for a, kind, b in detect(tape.text):
        start, end = tape.start[a], tape.end[b - 1]
        if text[start:end] == tape.text[a:b]:
            continue
        if not any(s < end and start < e for s, e in taken) and not any(k == kind and s < end and start < e for s, k, e in added[-4:]):
            added.append((start, kind, end))
    return base, sorted(added)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hashes, spans, added_in = [[], [], [], []], [], [], []
        for text in batch.column("text"):
            base, added = find(text.as_py() or "")
            for k, column in enumerate(counts):
                column.append(sum(s[1] == k for s in base))
            hashes.append(hashlib.sha256(render(base).encode()).hexdigest())
            spans.append(render(sorted(base + added)))
            added_in.append(len(added))
        columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added_in, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])


def find_private(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, counts of base spans, their hash, all spans, number of added ones) for each row."""
    picked = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of the first."""
    if not text:
        return text
    base, added = find(text)
    out, at = [], 0
    for start, kind, end in sorted(base + added):
        if start >= at:
            out += text[at:start], f"[{KINDS[kind].upper()}]"
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([masked(t.as_py()) for t in batch.columns[-1]], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)


@apart
def mask(docs: DataFrame, text_col="text") -> DataFrame:
    """The documents with personal data masked in their texts."""
    schema = StructType([*docs.schema.fields, StructField("__text", StringType())])
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text_col}`").alias("__text")).mapInArrow(_mask, schema)
    return out.select(*[(F.col("__text") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
