"""PII: offset-preserving deobfuscation.

Base rules find e-mail, IPv4, card and phone spans in the text as it is. Transducers then rewrite disguises while
keeping, for each character they emit, the source range it stands for: homoglyphs and invisible characters, spelled
digits, at/dot disguises. The same rules run over the rewritten text, and each span found is mapped back to source
characters. A mapped span that touches a base span of its kind is dropped, so base spans always stay.

The transducers run only on texts in which one of their triggers occurs. The triggers are whatever the transducers'
own tables and patterns can begin with, so an unrelated character elsewhere never decides whether a disguise is found.

Defined results: null and empty texts have no spans; a very long text or very many spans cost linear time (no rule
backtracks over a run it has read, spans are compared by position); spans of equal start are ordered by kind; repeated
rows get equal results; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .support import decode, per_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

# Look-alike characters and what they stand for.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTYXIJS", strict=True))
GREEK = dict(zip("οαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaeiknptuxABEZHIKMNOPTYX", strict=True))
MARKS = {"∙": ".", "。": ".", "․": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " "}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits 0 to 9.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)


def _look_alikes() -> dict[str, str]:
    """Single characters whose compatibility form is one printable ASCII character (full-width, styled, super- and
    subscript forms), digits of other scripts, and the fixed tables above."""
    table = {}
    for code in (*range(0xAA, 0x250), *range(0x660, 0x6FA), *range(0x966, 0x970), *range(0x2070, 0x24FF), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        ch = chr(code)
        plain = unicodedata.normalize("NFKC", ch)
        if unicodedata.category(ch) == "Nd":
            table[ch] = str(unicodedata.decimal(ch))
        elif plain != ch and len(plain) == 1 and "!" <= plain <= "~":
            table[ch] = plain
    return table | CYRILLIC | GREEK | MARKS | dict.fromkeys(INVISIBLE, "")


LOOK_ALIKE = _look_alikes()
TRIGGER_CHARS = re.compile("[" + re.escape("".join(LOOK_ALIKE)) + "]")
DIGIT_OF = {w: str(i) for line in SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}
WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
DIGIT_RUN = re.compile(rf"(?i)(?:\bplus[\x20-]+)?\b{WORD}(?:[\x20,-]{{1,3}}(?:{WORD}|[0-9]+)|\x20?(?:\.|\bdot\b)\x20?(?:{WORD}|[0-9]+))*(?![A-Za-z])")
# Whatever DIGIT_RUN joins: a spelled digit beside another, or beside figures.
RUN_GAP = r"(?:[\x20,-]{1,3}|\x20?(?:\.|dot)\x20?)"
RUN_TRIGGER = re.compile(rf"\b{WORD}{RUN_GAP}(?:{WORD}|[0-9])")
RUN_TOKEN = re.compile(rf"(?i){WORD}|[0-9]+|plus|dot|\.")
# Words for the two marks, and top-level names that an address in plain words must end with unless its
# shape tells.
AT, DOT = "at|@", r"dot|punkt|punto|point|\."
TOP = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|dev|app|ai|de|fr|es|it|nl|be|uk|eu|us|ca|cn|jp|ru|ch|at|se|no|dk|fi|pl|pt|br|mx|in|au|nz"
BRACKET_AT = re.compile(rf"(?i)\x20?(?:[\[({{<]\x20?(?:{AT})\x20?[\])}}>]|_at_)\x20?")
BRACKETED_DOT = rf"\x20?(?:[\[({{<]\x20?(?:{DOT})\x20?[\])}}>]|_dot_)\x20?"
BRACKET_DOT = re.compile(rf"(?i){BRACKETED_DOT}")
NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])\x20dot\x20(?=[0-9])")
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\x20@\x20(?=[A-Za-z0-9])")
# A bare " at " joins an address if a disguised dot follows: a bracketed one, two bare ones, or one bare one with a known
# top-level name or after a local part that holds a figure, dot or underscore, as plain words don't.
LABEL = r"[A-Za-z0-9-]++"
BARE_AT = re.compile(
    rf"(?i)(?<![A-Z0-9._%+-])(?:(?=[A-Z%+-]*+[0-9._])(?P<shaped>)|)[A-Z0-9._%+-]*+(?<=[A-Z0-9])(?P<at>\x20at\x20)"
    rf"(?={LABEL}(?:\.{LABEL})*+(?:{BRACKETED_DOT}{LABEL}|(?:\x20dot\x20{LABEL}){{2}}|\x20dot\x20(?:{TOP})\b|(?P<bare>\x20dot\x20[A-Z]{{2}})))"
)
# Bare dots count within an address only: a chain of address words that holds an "@".
DOTTED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])(?<!\x20dot\x20)(?:[A-Za-z0-9._%+-]++(?:\x20dot\x20[A-Za-z0-9._%+-]++)*+)@[A-Za-z0-9.-]++(?:\x20dot\x20[A-Za-z0-9.-]++)*+")
BARE_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9])")
MARK_TRIGGER = re.compile(rf"[\[({{<]\x20?(?:{AT}|{DOT})\x20?[\])}}>]|_at_|_dot_|\x20dot\x20|\x20@\x20")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping; each ``@`` is tried once, from the start of the run of local characters before it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            found.append((start, last))
        at = text.find("@", last)
    return found


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def find_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start."""
    spans = [("email", a, b) for a, b in find_emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if _luhn(NOT_DIGIT.sub("", m[0]))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


class Rewritten:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + np.int32(1)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending, disjoint, non-empty ranges; emitted characters stand for the whole range replaced."""
        if not edits:
            return
        out, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            out += self.text[last:a], new
            starts += self.starts[last:a], np.full(len(new), self.starts[a], np.int32)
            ends += self.ends[last:a], np.full(len(new), self.ends[b - 1], np.int32)
            last = b
        self.text = "".join([*out, self.text[last:]])
        self.starts, self.ends = np.concatenate([*starts, self.starts[last:]]), np.concatenate([*ends, self.ends[last:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a]), int(self.ends[b - 1])


def _digits(m: re.Match) -> str | None:
    """A run of spelled digits as digits; None if it has fewer than three of them."""
    tokens = RUN_TOKEN.findall(m[0])
    out = "".join("+" if t.lower() == "plus" else "." if t.lower() in ("dot", ".") else DIGIT_OF.get(t.lower(), t) for t in tokens)
    return out if sum(t.lower() in DIGIT_OF for t in tokens) >= 3 else None


def rewrite(text: str) -> Rewritten | None:
    """The text with its disguises undone, or None if it holds no trigger."""
    low = text.lower()
    odd = not text.isascii() and not LOOK_ALIKE.keys().isdisjoint(text)
    if not (odd or MARK_TRIGGER.search(low) or RUN_TRIGGER.search(low)):
        return None
    out = Rewritten(text)
    if odd:
        out.apply([(m.start(), m.end(), LOOK_ALIKE[m[0]]) for m in TRIGGER_CHARS.finditer(text)])
    out.apply([(m.start(), m.end(), d) for m in DIGIT_RUN.finditer(out.text) if (d := _digits(m)) is not None])
    out.apply([(*m.span("at"), "@") for m in BARE_AT.finditer(out.text) if m["bare"] is None or m["shaped"] is not None])
    for pattern, new in ((BRACKET_AT, "@"), (BRACKET_DOT, "."), (NUMBER_DOT, "."), (SPACED_AT, "@")):
        out.apply([(m.start(), m.end(), new) for m in pattern.finditer(out.text)])
    if "@" in out.text:
        out.apply([(d.start(), d.end(), ".") for m in DOTTED.finditer(out.text) for d in BARE_DOT.finditer(out.text, *m.span())])
    return out


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the method's own; both by kind as listed, then start."""
    base = find_spans(text)
    changed = rewrite(text)
    if changed is None or changed.text == text:
        return base, base
    extra = {(kind, *changed.source(a, b)) for kind, a, b in find_spans(changed.text)}
    spans: list[Span] = []
    for kind in KINDS:
        own = [s for s in base if s[0] == kind]  # disjoint, by start
        ends = [b for _, _, b in own]
        new = []
        for s in extra:
            at = bisect_right(ends, s[1]) if s[0] == kind else -1  # the first base span that ends after this one starts
            if at >= 0 and (at == len(own) or own[at][1] >= s[2]):
                new.append(s)
        spans += sorted([*own, *new], key=lambda s: s[1:])
    return base, spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str) -> str:
    """The text with each span, disguised ones included, replaced by its kind; a span inside an earlier one goes with it."""
    out, last = [], 0
    for kind, a, b in sorted(detect(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += text[last:a], f"[{kind.upper()}]"
            last = b
    return "".join([*out, text[last:]])


FIELDS = [("n_email", T.LongType()), ("n_ip", T.LongType()), ("n_card", T.LongType()), ("n_phone", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("redacted_chars", T.LongType())]


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every whole text."""

    def one(raw: bytes) -> tuple:
        base, spans = detect(decode(raw))
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), _covered(spans)

    return per_text(docs, "doc_id", "text", FIELDS, lambda: lambda texts: list(map(list, zip(*map(one, texts), strict=True))), scan=True)


def _covered(spans: list[Span]) -> int:
    """Characters inside any span."""
    edges = sorted([(a, 1) for _, a, _ in spans] + [(b, -1) for _, _, b in spans])
    total = depth = 0
    for (x, step), (y, _) in pairwise([*edges, (0, 0)]):
        depth += step
        total += (y - x) * (depth > 0)
    return total
