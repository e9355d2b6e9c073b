"""Personal data behind disguises, found by transducers that keep offsets.

Three transducers rewrite a text one after the other: lookalike and invisible characters to plain ones, spelled digits to
digits, and disguises of @ and . to these. Each is a set of arcs (what it reads, what it writes, where), runs from left to
right, and copies what no arc reads; what it rewrote is kept as edits, so a span of what it wrote is a span of what it read.
Identifiers are detected in the last text, and their spans go back through all edits to the source's characters.

The plain detectors also run on the source itself: what they find stays as it is, and the transducers only add."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_batches, texts_only

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]


# Detectors

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# Within a run of digits all starts end alike, so only a run's first is tried.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """A local part, @, and labels with a dot between; each @ is looked at once, so long runs of letters cost no more."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if got := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = got.end()
                yield start, done
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for got in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in got[0].split(".")):
            yield got.span()


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for got in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", got[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield got.span()


def phones(text: str) -> Iterator[Span]:
    for got in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", got[0])) <= 15:
            yield got.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones)))


# Transducers


@dataclass
class Tape:
    """What a transducer wrote, and its edits: parallel lists of where each is written and where it was read. Without edits
    in between, characters are copied."""

    text: str
    wrote: list[Span] = field(default_factory=list)
    read: list[Span] = field(default_factory=list)

    def back(self, span: Span) -> Span:
        """The characters read for a written span: an edit that it touches counts whole."""
        return self._place(span[0], True), self._place(span[1], False)

    def _place(self, at: int, opens: bool) -> int:
        # A start belongs to the last edit that begins at it or before, an end to the first that ends at it or later.
        if opens:
            i = bisect_right(self.wrote, at, key=lambda s: s[0]) - 1
            while i >= 0 and self.wrote[i][0] == self.wrote[i][1] == at:  # deleted characters before it aren't part of it
                return self.read[i][1]
            if i >= 0 and at < self.wrote[i][1]:
                return self.read[i][0]
            return self.read[i][1] + at - self.wrote[i][1] if i >= 0 else at
        i = bisect_left(self.wrote, at, key=lambda s: s[1])
        if i < len(self.wrote) and self.wrote[i][0] < at:
            return self.read[i][1]
        return self.read[i - 1][1] + at - self.wrote[i - 1][1] if i else at


@dataclass(frozen=True)
class Transducer:
    """Arcs: (what is read, what is written for it). Reading is by pattern, the first arc that fits is taken at each place from
    left to right, and everything else is copied. An arc that writes None declines after all."""

    arcs: tuple[tuple[re.Pattern, Callable[[re.Match], str | None]], ...]
    maybe: Callable[[str], object] = bool  # true of every text that an arc reads from

    def run(self, text: str) -> Tape:
        if not self.maybe(text):
            return Tape(text)
        edits: list[tuple[int, int, str]] = []
        for pattern, write in self.arcs:
            for got in pattern.finditer(text):
                if (made := write(got)) is not None and made != got[0]:
                    edits.append((*got.span(), made))
        return _edited(text, edits)


def _edited(text: str, edits: list[tuple[int, int, str]]) -> Tape:
    """``text`` with these replacements (start, end, new); of overlapping ones the first."""
    if not edits:
        return Tape(text)
    tape, parts, at, size = Tape(""), [], 0, 0
    for start, end, new in sorted(edits):
        if start < at:
            continue
        parts += (text[at:start], new)
        size += start - at
        tape.wrote.append((size, size + len(new)))
        tape.read.append((start, end))
        size += len(new)
        at = end
    tape.text = "".join([*parts, text[at:]])
    return tape


# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "ɑ": "a", "ı": "i", "ɡ": "g", "ⅼ": "l", "∂": "d",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".",
}
_PLAIN = frozenset(map(chr, range(0x21, 0x7F)))
# All but ASCII and Latin-1, and of that the no-break space, soft hyphen, raised digits and middle dot.
_OTHER = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xb1\xb4-\xb6\xb8\xba-\xff]")


@lru_cache(maxsize=1 << 16)
def plain(character: str) -> str | None:
    """The plain character that one looks like or stands for (by compatibility, digit value, or the list above), the empty
    text for an invisible one, else None. Letters with accents are themselves."""
    if character in LOOKALIKES:
        return LOOKALIKES[character]
    if unicodedata.category(character) == "Cf" or "︀" <= character <= "️":
        return ""
    if (digit := unicodedata.digit(character, None)) is not None:
        return str(digit)
    if unicodedata.category(character) == "Zs":
        return " "
    simple = unicodedata.normalize("NFKC", character)
    return simple if len(simple) == 1 and simple in _PLAIN else None


LOOKS = Transducer(((_OTHER, lambda got: plain(got[0])),))

# The digits' names in English, German, French and Spanish.
DIGIT_NAMES = (
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_DIGITS = {w: str(d) for d, names in enumerate(DIGIT_NAMES) for w in names.split()}
# Names of the signs.
_AT, _DOT, _PLUS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt", "plus|más"
_NAMED = "|".join(sorted(_DIGITS, key=len, reverse=True))
_GAP = rf"(?:[ \t]*[-,][ \t]*|[ \t]+(?:(?:{_DOT})[ \t]+)?)"
SPELLED = 3  # digits' names in a row that are read as digits
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_PLUS})[ \t]+)?(?:{_NAMED})(?!\w)(?:{_GAP}(?:(?:{_NAMED})|[0-9]+)(?!\w))+", re.IGNORECASE)
_TOKEN = re.compile(r"\w+")
_CLASS = dict.fromkeys([*_DIGITS, *_DOT.split("|")], "d")


def _maybe_spelled(text: str) -> bool:
    """Whether two such words stand side by side."""
    return "dd" in "".join([_CLASS.get(w, " ") for w in _TOKEN.findall(text.lower())])


_ITEM = re.compile(rf"(?P<name>{_NAMED})|(?P<plus>{_PLUS})|(?P<dot>{_DOT})|(?P<digits>[0-9]+)|[ \t]*[-,]?[ \t]*", re.IGNORECASE)


def _digits(got: re.Match) -> str | None:
    """A row of digits' names and digits, gaps dropped and dots named in it written; two names at least are neighbours, or it isn't read."""
    out, names, before, pair = [], 0, False, False
    for item in _ITEM.finditer(got[0]):
        word = item[0].lower()
        if item["name"]:
            names += 1
            pair |= before
            out.append(_DIGITS[word])
        elif item["plus"]:
            out.append("+")
        elif item["dot"]:
            out.append(".")
        elif item["digits"]:
            out.append(word)
        if item.lastgroup:
            before = item.lastgroup in ("name", "dot") and names > 0
    return "".join(out) if names >= SPELLED and pair else None


SPELLS = Transducer(((_SPELLED, _digits),), _maybe_spelled)

_OPEN, _CLOSE = r"\s{0,4}[\[({<]\s{0,4}", r"\s{0,4}[\])}>]\s{0,4}"
# A name's parts, "at" and "dot" as words: taken only where a dot is named after the @ as well.
_PART = r"[A-Za-z0-9_%+-]{1,64}"
_WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?:{_PART}(?:\.|[ ]{{1,4}}(?:{_DOT})[ ]{{1,4}})){{0,8}}{_PART}"
    rf"(?:@|[ ]{{1,4}}(?:{_AT}|@)[ ]{{1,4}})(?:[A-Za-z0-9-]{{1,63}}\.){{0,8}}[A-Za-z0-9-]{{1,63}}"
    rf"(?:[ ]{{1,4}}(?:{_DOT})[ ]{{1,4}}[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,8}})+",
    re.IGNORECASE,
)
_WORD = re.compile(rf"[ ]{{1,4}}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}))[ ]{{1,4}}", re.IGNORECASE)
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,4}}(?i:{_AT}|{_DOT}|@|\.)\s{{0,4}}[\])}}>]")
_DOT_WORD = re.compile(r"[DdPp](?<!\w.)(?i:ot|unto|oint|unkt)(?!\w)")
BRACKETS = Transducer((
    (re.compile(rf"{_OPEN}(?:{_AT}|@){_CLOSE}", re.IGNORECASE), lambda got: "@"),
    (re.compile(rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}", re.IGNORECASE), lambda got: "."),
    (re.compile(rf"(?<=[0-9])[ ]{{1,4}}(?:{_DOT})[ ]{{1,4}}(?=[0-9])", re.IGNORECASE), lambda got: "."),
), lambda text: _BRACKETED.search(text) or _DOT_WORD.search(text))


def _worded(text: str) -> Tape:
    """Addresses in words: their signs are written, one edit each. Looked for only around a named dot."""
    if not _DOT_WORD.search(text):
        return Tape(text)
    edits = []
    for address in _WORDED.finditer(text):
        for sign in _WORD.finditer(text, *address.span()):
            edits.append((*sign.span(), "@" if sign["at"] else "."))
    return _edited(text, edits)


def disguises(text: str) -> list[Tape]:
    """The composed transducers: their tapes in order, those without edits left out."""
    out = []
    for step in (LOOKS.run, SPELLS.run, BRACKETS.run, _worded):
        tape = step(out[-1].text if out else text)
        if tape.wrote:
            out.append(tape)
    return out


Found = tuple[str, int, int, bool]  # kind, start, end, whether the source shows it plainly


def find(text: str) -> list[Found]:
    """All spans by kind, then start. Behind a disguise, a span is added unless plain spans of its kind hold it whole."""
    out: list[Found] = []
    tapes = disguises(text)
    for kind, detect in DETECTORS.items():
        spans = list(detect(text))
        found = {s: True for s in spans}
        if tapes:
            for span in detect(tapes[-1].text):
                for tape in reversed(tapes):
                    span = tape.back(span)
                # The source's spans are in order and apart: only the last one that begins at it or before can hold it.
                i = bisect_right(spans, span[0], key=lambda s: s[0]) - 1
                if i < 0 or spans[i][1] < span[1]:
                    found.setdefault(span, False)
        out += [(kind, *span, found[span]) for span in sorted(found)]
    return out


def _listed(found: list[Found]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in found)


def _mapped(docs: DataFrame, schema: str, row: Callable[[str], tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if len(batch):
                rows = [row(t.as_py()) for t in batch.column("text")]
                yield {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, zip(*rows))))

    return map_batches(texts_only(docs), f"doc_id long, {schema}", run)


def spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end, plain) in code points, ends exclusive. See ``report``."""
    keys = ("kind", "start", "end", "plain")
    schema = "spans array<struct<kind: string, start: long, end: long, plain: boolean>>"
    named = schema.replace(", ", ",")  # one column
    return _mapped(docs, named, lambda text: ([dict(zip(keys, f)) for f in find(text)],))


def redact(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and text with each span, or each group of overlapping ones, replaced by its kind in angle brackets (of
    overlapping ones, the kind that begins first)."""

    def cleaned(text: str) -> tuple:
        parts, at = [], 0
        for kind, start, end, _ in sorted(find(text), key=lambda f: (f[1], -f[2])):
            if start >= at:
                parts += (text[at:start], f"<{kind.upper()}>")
            at = max(at, end)
        return ("".join([*parts, text[at:]]),)

    return _mapped(docs, "text string", cleaned)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (all spans, disguised ones included), base_sha256 (of the plain spans
    as kind:start:end, by kind and start, joined by commas), spans (all, joined likewise), n_disguised.

    Null and empty texts have no spans; repeated rows are looked at each; null ids are kept; other columns are ignored; an empty
    table gives an empty result. Work grows with the length of a text, whatever it holds. Nothing is shuffled."""
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"

    def row(text: str) -> tuple:
        found = find(text)
        base = _listed([f for f in found if f[3]])
        counts = [sum(f[0] == kind for f in found) for kind in KINDS]
        return *counts, hashlib.sha256(base.encode()).hexdigest(), _listed(found), sum(not f[3] for f in found)

    return _mapped(docs, schema, row)
