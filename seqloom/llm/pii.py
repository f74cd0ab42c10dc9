"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Transducers then rewrite disguises (look-alike
letters, spelled digits, "at" and "dot" in words or brackets) and keep, for every character written,
the span of source characters it came from; identifiers found in the rewritten text that touch a
rewritten character are mapped back to source spans and added.

Offsets are code points, ends exclusive. Null and empty texts have no spans; an empty table gives no rows. Every
search is linear in the text, so very long texts are safe. Rows are independent, so repeated ones are treated
alike; spans of one start come in the order of their kinds. detect() reads id and text only, redact() passes
all other columns unchanged, whatever their names. Words are those of English, German, French and Spanish.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can't succeed where the run's own start fails, hence the lookbehind.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each @ with the run of local characters before it that is still free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", m.end() if m else at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def find(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, kind's index, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# Letters of other scripts that look like Latin ones, with the Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
}
# Digit words of English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for @ and for the point of a domain, in these languages.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
# Last labels that make "name at host dot label" without brackets an address.
LABELS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "co")
#: White space around a word or a bracket, letters of a label, and labels between the host and the last one, at most.
GAP, LABEL_LETTERS, MORE_LABELS = 3, 63, 4

_WORDS = f"(?a:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})"
_SPELLED = re.compile(rf"(?<![^\W_]){_WORDS}(?:[\s,.-]{{1,{GAP}}}{_WORDS})*(?![^\W_])", re.I)
# A single digit word is a disguise only next to a digit or a plus.
_DIGIT_BEFORE = re.compile(rf"[0-9+][\s,.-]{{1,{GAP}}}\Z|\+\Z").search
_DIGIT_AFTER = re.compile(rf"[\s,.-]{{1,{GAP}}}[0-9]").match
_ONE_WORD = re.compile(_WORDS, re.I)
_AT_WORD, _DOT_WORD = f"(?:{'|'.join(AT_WORDS)})", f"(?:{'|'.join(DOT_WORDS)})"
_OPEN, _CLOSE = rf"[\[({{<]\s{{0,{GAP}}}", rf"\s{{0,{GAP}}}[\])}}>]"
_AT = re.compile(rf"\s{{0,{GAP}}}{_OPEN}{_AT_WORD}{_CLOSE}\s{{0,{GAP}}}", re.I)
_DOT = re.compile(rf"\s{{0,{GAP}}}{_OPEN}{_DOT_WORD}{_CLOSE}\s{{0,{GAP}}}", re.I)
_LABEL, _SPACED_DOT = f"[a-z0-9-]{{1,{LABEL_LETTERS}}}", rf"\s{{1,{GAP}}}{_DOT_WORD}\s{{1,{GAP}}}"
_PLAIN = re.compile(
    rf"(?<=[a-z0-9])\s{{1,{GAP}}}{_AT_WORD}\s{{1,{GAP}}}(?!(?:the|an?|this|that|my|our|your|its)\s)"
    rf"(?=({_LABEL}(?:{_SPACED_DOT}{_LABEL}){{0,{MORE_LABELS}}}?{_SPACED_DOT}(?:{'|'.join(LABELS)}))(?![a-z0-9-]))",
    re.I,
)
_AT_CORE = re.compile(_OPEN + _AT_WORD + _CLOSE, re.I).search
_PLAIN_DOT = re.compile(_SPACED_DOT, re.I)


def plain_character(c: str) -> str:
    """The ASCII character that a look-alike, full-width or styled character stands for; itself where none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.digit(c, None) if c > "\x7f" else None
    return c if digit is None else str(digit)


#: Every character that plain_character changes (digits of all scripts among them), with what it stands for.
PLAIN = {c: plain_character(chr(c)) for c in range(0x80, 0x20000) if plain_character(chr(c)) != chr(c)}
_STRANGE = re.compile(f"[{''.join(map(chr, PLAIN))}]")


class Rewritten:
    """A text with, for each character, its source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def characters(self) -> None:
        for m in _STRANGE.finditer(self.text):
            self.changed[m.start()] = 1
        self.text = self.text.translate(PLAIN)

    def replace(self, edits: list[tuple[int, int, str, list[tuple[int, int]]]]) -> None:
        """Edits in order, as (start, end, written text, span in this text of each written character)."""
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, new, spans in edits:
            if a < at:
                continue
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[p] for p, _ in spans]
            end += self.end[at:a] + [self.end[q - 1] for _, q in spans]
            changed += self.changed[at:a] + b"\1" * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def spelled_digits(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """Edits that write runs of digit words, and single ones next to a digit or a plus, as digits."""
    edits = []
    for m in _SPELLED.finditer(text):
        words = list(_ONE_WORD.finditer(text, m.start(), m.end()))
        if len(words) > 1 or _DIGIT_BEFORE(text[max(0, m.start() - 1 - GAP) : m.start()]) or _DIGIT_AFTER(text, m.end()):
            edits.append((m.start(), m.end(), "".join(DIGIT_WORDS[w.group().lower()] for w in words), [w.span() for w in words]))
    return edits


def disguised(text: str, gates: bool = True) -> list[tuple[int, int, int]]:
    """Spans of identifiers that show only after rewriting, as (start, kind's index, end) in the source.

    Each gate is a necessary condition of its transducer on the text that it reads, so that results don't
    depend on `gates`. Digits written for words make no new "at" or "dot".
    """
    strange = not gates or (not text.isascii() and _STRANGE.search(text) is not None)
    plain = text.translate(PLAIN) if strange else text
    lower = plain.lower()
    edits = spelled_digits(plain) if not gates or any(w in lower for w in DIGIT_WORDS) else []
    dots = not gates or any(w in lower for w in DOT_WORDS)
    ats = not gates or any(w in lower for w in AT_WORDS)
    brackets = not gates or (ats and _AT_CORE(plain) is not None)
    if not (strange or dots or brackets or edits):
        return []
    out = Rewritten(text)
    if strange:
        out.characters()
    if edits:
        out.replace(edits)
    edits = [(m.start(), m.end(), "@", [m.span()]) for m in _AT.finditer(out.text)] if brackets else []
    if dots:
        edits += [(m.start(), m.end(), ".", [m.span()]) for m in _DOT.finditer(out.text)]
        if ats:
            for m in _PLAIN.finditer(out.text):
                edits.append((m.start(), m.end(), "@", [m.span()]))
                edits += [(d.start(), d.end(), ".", [d.span()]) for d in _PLAIN_DOT.finditer(out.text, m.start(1), m.end(1))]
    if edits:
        out.replace(sorted(edits))
    if not any(out.changed):
        return []
    return [(out.start[a], k, out.end[b - 1]) for a, k, b in find(out.text) if any(out.changed[a:b])]


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans as (start, kind's index, end, by the method), in order; a base span isn't given twice."""
    base = find(text)
    have = set(base)
    return sorted([(*x, False) for x in base] + [(*x, True) for x in set(disguised(text)) - have])


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of id and spans (kind, start, end, added), ordered by start, then kind, for every document."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": KINDS[k], "start": a, "end": b, "added": new} for a, k, b, new in spans_of(t)] for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN)], names=["id", "spans"])

    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kernel, f"id {kind}, spans {SPANS}", "text").withColumnRenamed("id", id_col)


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at, upto = [], 0, 0
    for a, k, b, _ in spans_of(text):
        if a >= upto:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = upto = max(upto, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; null texts stay null."""
    cols = docs.columns
    at = cols.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([None if t is None else redacted(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_arrow(plain, kernel, plain.schema, f"c{at}").toDF(*cols)
