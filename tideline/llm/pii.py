"""Personal data in texts, disguised or not, with spans in the characters of the source.

Plain finds are the leftmost non-overlapping matches of each kind; a match that fails its check is dropped and the
search goes on behind it. Disguised finds come from a transducer that rewrites homoglyphs, full-width forms and other
scripts' digits, invisible characters, spelled digits, and at/dot disguises, and remembers for every piece of
its output where it came from. The same detectors then read the rewritten text, and matches that touch a rewritten
place are mapped back to source characters; those that lie inside a plain find of their kind add nothing.

A null text counts as empty and has no spans. Texts of any length are read whole; every detector is linear in the
length, save that a single match is checked once more for each of its digits. Repeated rows get repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before "@" is the run of its characters that ends there; looking back from each "@" keeps this linear."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# Letters that look like Latin ones: Cyrillic, Greek, then those that match s, i and k where case is ignored
# but aren't turned into them by lower().
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһгАВЕКМНОРСТУХІЈЅοαρνικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧſıİ\u212a",
        "aeopcyxijsdhrABEKMHOPCTYXIJSoapviKuABEZHIKMNOPTYXsiIK",
        strict=True,
    )
)
# Digits as words: English, German, French, Spanish.
_DIGIT_WORDS = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
_SPELLED = {word: str(i) for line in _DIGIT_WORDS for i, word in enumerate(line.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_AT, _DOT = "(?:at|arroba|arobase)", "(?:dot|punkt|point|punto)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOTTED = rf"(?:[ ]*{_OPEN}[ ]*(?:{_DOT}|\.)[ ]*{_CLOSE}[ ]*|[ ]+{_DOT}[ ]+)"

_BEHIND_DOT = "(?:" + "|".join(f"(?<=[ ]{w}[ ])" for w in ("dot", "punkt", "point", "punto")) + ")"

#: Rules over words. Digits as words count in runs of three or more, or beside a spelled dot; a bare "at" only ahead
#: of a disguised dot.
_RULES = re.compile(
    rf"(?P<digits>(?<!\w){_WORD}(?:(?:[ -]{_WORD}){{2,}}(?!\w)|(?:[ -]{_WORD})?(?=[ ]{_DOT}[ ]{_WORD}(?!\w)))"
    rf"|{_BEHIND_DOT}{_WORD}(?:[ -]{_WORD})?(?!\w))"
    rf"|(?P<plus>(?<!\w)plus[ ]+(?={_WORD}(?!\w)|[0-9]))"
    rf"|(?P<at>[ ]*{_OPEN}[ ]*(?:{_AT}|@)[ ]*{_CLOSE}[ ]*|(?<=\w)[ ]+{_AT}[ ]+(?=[A-Za-z0-9-]+{_DOTTED}))"
    rf"|(?P<dot>(?<=\w){_DOTTED}(?=\w))",
    re.IGNORECASE,
)
#: What a text must have for a word rule to apply; cheap enough to look for in every text.
_HINT = re.compile(
    rf"{_OPEN}[ ]*(?:{_AT}|{_DOT}|@|\.)[ ]*{_CLOSE}|[ ]{_DOT}[ ]|(?<!\w){_WORD}[ -]{_WORD}[ -]{_WORD}(?!\w)"
    rf"|(?<!\w)plus[ ]+(?:{_WORD}(?!\w)|[0-9])",
    re.IGNORECASE,
)
_INVISIBLE = "­​‌‍⁠﻿"
_OTHER = re.compile(f"[{''.join(_LOOKALIKES)}{_INVISIBLE}！-～٠-٩۰-۹०-९⁰⁴-⁹₀-₉²³¹]")


def _plain_char(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c))


class Rewritten:
    """A text after some of its pieces were replaced, with the way back to source positions."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.edits = edits
        parts, self._at, self._from, done, length = [], [], [], 0, 0
        for start, end, new in edits:
            parts += [source[done:start], new]
            for size, begins in ((start - done, done), (len(new), start)):
                self._at.append(length)
                self._from.append(begins)
                length += size
            done = end
        self._at.append(length)
        self._from.append(done)
        self.text = "".join([*parts, source[done:]])

    def char(self, i: int) -> tuple[int, int, bool]:
        """The source span of the i-th character, and whether a rewrite made it."""
        k = bisect_right(self._at, i) - 1
        if k % 2:
            start, end, _ = self.edits[k // 2]
            return start, end, True
        at = self._from[k] + i - self._at[k]
        return at, at + 1, False

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of text[start:end], and whether a rewrite touches it."""
        first, last = self.char(start), self.char(end - 1)
        a, b = bisect_right(self._at, start), bisect_right(self._at, end - 1)
        return first[0], last[1], first[2] or last[2] or b > a


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _RULES.finditer(text):
        if m["digits"]:
            for w in re.finditer(_WORD, m["digits"], re.IGNORECASE):
                # the separator ahead of a digit goes with it, so the digits of a run stand together
                out.append((m.start() + w.start() - (w.start() > 0), m.start() + w.end(), _SPELLED[w[0].lower()]))
        else:
            out.append((*m.span(), "+" if m["plus"] else "@" if m["at"] else "."))
    return out


def disguised(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that appear only after rewriting: characters first, then words over the result."""
    chars = [(m.start(), m.end(), _plain_char(m[0])) for m in _OTHER.finditer(text)] if not text.isascii() else []
    first = Rewritten(text, chars)
    words = _word_edits(first.text) if _HINT.search(first.text) else []
    if not chars and not words:
        return
    second = Rewritten(first.text, words)
    for kind, detect in DETECTORS.items():
        for start, end in detect(second.text):
            a, b, by_words = second.span(start, end)
            a, b, by_chars = first.span(a, b)
            if by_words or by_chars:
                yield kind, a, b


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) by start, then kind; positions count code points and end is exclusive."""
    if not text:
        return []
    plain = {kind: list(detect(text)) for kind, detect in DETECTORS.items()}
    out = [(kind, a, b, True) for kind, spans in plain.items() for a, b in spans]
    for kind, a, b in disguised(text):
        k = bisect_right(plain[kind], (a, 1 << 62)) - 1
        if k < 0 or plain[kind][k][1] < b:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), not s[3], s[2]))


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, base>> of each whole text, in order; base marks plain finds."""

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [find(t.as_py()) for t in batch]
            flat = [s for row in rows for s in row]
            offsets = [0]
            for row in rows:
                offsets.append(offsets[-1] + len(row))
            columns = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(_SPAN)]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))

    return found(text)
