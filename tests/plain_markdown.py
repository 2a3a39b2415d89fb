"""Markdown structure of one text: blocks, protected spans, line rewriting. A documented subset of CommonMark and tables.

Blocks: fence, html_block, heading (ATX and setext), thematic_break, blockquote, list_item, table, definition,
indented_code, paragraph. Block quotes and list items are containers; ``nested`` lists what they hold. Line ends are CRLF, CR and LF only. All offsets are
code points, half open.
"""

from __future__ import annotations

import difflib
import re
from typing import NamedTuple

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
QUOTE = re.compile(r" {0,3}>")
ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
DEFINITION = re.compile(r" {0,3}\[(?!\^)([^\]\n]+)\]:[ \t]*(<[^<>\n]*>|\S+)")
DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HTML_START = re.compile(r" {0,3}<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9-]*)(?=[\s/>]|$))")
# Element names that open an HTML block.
HTML_TAGS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
)
RAW_TAGS = frozenset("script pre style textarea".split())
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
INLINE_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", re.S)
LINK_OPEN = re.compile(r"\]\(")
IMAGE_TAG = re.compile(r"(?is)<img\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ALT = re.compile(r"(?is)\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Block(NamedTuple):
    type: str
    line_start: int
    line_end: int
    start: int
    end: int
    top_level: bool


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def split_lines(text: str) -> list[tuple[int, str]]:
    """``(offset, line without its end)``."""
    out = [(m.start(), m[0].rstrip("\r\n")) for m in LINE.finditer(text) if m.start() < len(text)]
    return out


def fence_open(line: str) -> str | None:
    m = FENCE.fullmatch(line)
    return m[1] if m and not (m[1][0] == "`" and "`" in m[2]) else None


def fence_closes(line: str, opener: str) -> bool:
    body = line.strip(" ").rstrip(" \t")
    return len(line) - len(line.lstrip(" ")) <= 3 and len(body) >= len(opener) and not body.strip(opener[0])


def has_unclosed_fence(text: str) -> bool:
    opener = None
    for _, line in split_lines(text):
        if opener is None:
            opener = fence_open(line)
        elif fence_closes(line, opener):
            opener = None
    return opener is not None


def _html_end(line: str) -> str | None:
    """What ends the HTML block that this line opens: a pattern, or "" for a blank line; None if it opens none."""
    m = HTML_START.match(line)
    if not m:
        return None
    tag = (m[2] or "").lower()
    if not tag:
        return "-->" if "<!--" in line else ">"
    if tag in RAW_TAGS and not m[1]:
        return f"</{tag}>"
    return "" if tag in HTML_TAGS else None


def segment(text: str) -> list[Block]:
    """Blocks in order of (start, end)."""
    lines = split_lines(text)
    n = len(lines)
    out: list[Block] = []

    def add(kind: str, a: int, b: int, top: bool = True) -> None:
        last = lines[b - 1]
        out.append(Block(kind, a, b, lines[a][0], last[0] + len(last[1]), top))

    def blank(i: int) -> bool:
        return not lines[i][1].strip()

    def is_table(i: int) -> bool:
        return i + 1 < n and "|" in lines[i][1] and ("|" in lines[i + 1][1] or "-" in lines[i + 1][1]) and bool(DELIMITER_ROW.match(lines[i + 1][1])) and "|" in lines[i][1] + lines[i + 1][1]

    def interrupts(i: int) -> bool:
        line = lines[i][1]
        return bool(fence_open(line) or HEADING.match(line) or BREAK.match(line) or QUOTE.match(line) or ITEM.match(line) or _html_end(line) is not None or is_table(i))

    def line_tab(i: int) -> bool:
        return lines[i][1].startswith("\t")

    i = 0
    while i < n:
        line = lines[i][1]
        if blank(i):
            i += 1
            continue
        j = i + 1
        if opener := fence_open(line):
            while j < n and not fence_closes(lines[j][1], opener):
                j += 1
            j = min(n, j + 1)
            add("fence", i, j)
        elif (stop := _html_end(line)) is not None:
            if stop:
                j = i
                while j < n and stop not in lines[j][1].lower():
                    j += 1
                j = min(n, j + 1)
            else:
                while j < n and not blank(j):
                    j += 1
            add("html_block", i, j)
        elif HEADING.match(line):
            add("heading", i, j)
        elif BREAK.match(line):
            add("thematic_break", i, j)
        elif QUOTE.match(line):
            while j < n and not blank(j) and (QUOTE.match(lines[j][1]) or not interrupts(j)):
                j += 1
            add("blockquote", i, j)
        elif m := ITEM.match(line):
            width = len(line) - len(line.lstrip(" ")) + (2 if line.lstrip(" ")[0] in "-*+" else 3)
            while j < n:
                indent = len(lines[j][1]) - len(lines[j][1].lstrip(" "))
                if blank(j):
                    k = j
                    while k < n and blank(k):
                        k += 1
                    if k == n or len(lines[k][1]) - len(lines[k][1].lstrip(" ")) < width and not lines[k][1].startswith("\t"):
                        break
                    j = k
                elif indent >= width or line_tab(j) or not interrupts(j) and not blank(j - 1):
                    j += 1
                else:
                    break
            add("list_item", i, j)
        elif is_table(i):
            j = i + 2
            while j < n and not blank(j) and not (HEADING.match(lines[j][1]) or fence_open(lines[j][1]) or QUOTE.match(lines[j][1])):
                j += 1
            add("table", i, j)
        elif DEFINITION.match(line):
            add("definition", i, j)
        elif line.startswith(("    ", "\t")):
            while j < n and (blank(j) or lines[j][1].startswith(("    ", "\t"))):
                j += 1
            while blank(j - 1):
                j -= 1
            add("indented_code", i, j)
        else:
            kind = "paragraph"
            while j < n and not blank(j):
                if SETEXT.match(lines[j][1]):
                    kind, j = "heading", j + 1
                    break
                if interrupts(j):
                    break
                j += 1
            add(kind, i, j)
        i = j
    return sorted(out, key=lambda b: (b.start, b.end))


QUOTE_MARK, ITEM_MARK = re.compile(r" {0,3}>[ \t]?"), re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]{1,4}(?=[^ \t\r\n])|[ \t]?)")


def nested(text: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """``type, start, end, first line, line after, depth, parent's start`` of all blocks inside containers."""
    out = []

    def enter(block: Block, lines: list[tuple[int, str]], depth: int, line0: int) -> None:
        """``lines``: source offset and content of each line of the container."""
        inner = []
        width = None
        for at, content in lines:
            if block.type == "blockquote":
                m = QUOTE_MARK.match(content)
                cut = m.end() if m else 0
            elif width is None:
                cut = width = ITEM_MARK.match(content).end()
            else:
                cut = min(width, 1 if content.startswith("\t") else len(content) - len(content.lstrip(" ")))
            inner.append((at + cut, content[cut:]))
        for b in segment("\n".join(c for _, c in inner) + "\n"):
            last = inner[b.line_end - 1]
            out.append((b.type, inner[b.line_start][0], last[0] + len(last[1]), line0 + b.line_start, line0 + b.line_end, depth, lines[0][0]))
            if b.type in ("blockquote", "list_item"):
                enter(b, inner[b.line_start : b.line_end], depth + 1, line0 + b.line_start)

    lines = split_lines(text)
    for b in segment(text):
        if b.type in ("blockquote", "list_item"):
            enter(b, lines[b.line_start : b.line_end], 1, b.line_start)
    return sorted(out, key=lambda x: (x[1], x[5]))


def _destination(text: str, at: int, end: int) -> tuple[int, int] | None:
    """Of the link whose ``(`` is just before ``at``: its destination, parentheses balanced."""
    while at < end and text[at] in " \t\n":
        at += 1
    if at < end and text[at] == "<":
        close = text.find(">", at, end)
        return (at, close + 1) if close >= 0 else None
    depth, i = 0, at
    while i < end and text[i] not in " \t\n":
        if text[i] == "\\":
            i += 1
        elif text[i] == "(":
            depth += 1
        elif text[i] == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return (at, min(i, end)) if i > at and text.find(")", i, end) >= 0 else None


def protected(text: str, blocks: list[Block] | None = None) -> list[Span]:
    """Spans that no rewriting may touch, left to right, without overlaps: fences, HTML blocks, code spans, inline
    HTML, autolinks, link and image destinations, destinations of reference definitions."""
    blocks = segment(text) if blocks is None else blocks
    spans = [Span(b.type, b.start, b.end) for b in blocks if b.type in ("fence", "html_block")]
    code = [Span(*n[:3]) for n in nested(text) if n[0] in ("fence", "html_block")]
    spans += code
    for c in code:
        text = text[: c.start] + " " * (c.end - c.start) + text[c.end :]
    for b in blocks:
        if not b.top_level or b.type in ("fence", "html_block", "thematic_break"):
            continue
        if b.type == "definition" and (m := DEFINITION.match(text, b.start, b.end)):
            spans.append(Span("definition", m.start(2), m.end(2)))
            continue
        at = b.start
        while at < b.end:
            options = [(m.start(), k, m) for k, p in (("code", CODE_SPAN), ("autolink", AUTOLINK), ("html_inline", INLINE_HTML), ("destination", LINK_OPEN)) if (m := p.search(text, at, b.end))]
            if not options:
                break
            _, kind, m = min(options, key=lambda o: o[0])
            if kind == "destination":
                where = _destination(text, m.end(), b.end)
                if where:
                    spans.append(Span(kind, *where))
                at = where[1] if where else m.end()
            else:
                spans.append(Span(kind, m.start(), m.end()))
                at = m.end()
    return sorted(spans, key=lambda s: (s.start, s.end))


def paragraph_key(text: str) -> str:
    return re.sub(r"[ \t]+", " ", re.sub(r"\r\n|\r|\n", " ", text)).strip()


def dedup_paragraphs(text: str) -> tuple[str, int]:
    """The first of equal top-level paragraphs stays; later ones go with the blank lines after them."""
    lines = split_lines(text)
    seen: set[str] = set()
    cuts = []
    for b in segment(text):
        if b.type != "paragraph" or not b.top_level:
            continue
        key = paragraph_key(text[b.start : b.end])
        if key in seen:
            j = b.line_end
            while j < len(lines) and not lines[j][1].strip():
                j += 1
            cuts.append((b.start, lines[j][0] if j < len(lines) else len(text)))
        seen.add(key)
    out, last = [], 0
    for a, b in cuts:
        out.append(text[last:a])
        last = b
    return "".join([*out, text[last:]]), len(cuts)


def _single(line: str) -> str:
    return re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", line)


def _table(lines: list[str]) -> list[str]:
    rows = [[c.strip(" ") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", line.strip(" ")))] for line in lines]
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    out = [[] for _ in rows]
    for c in range(width):
        column = [r[c] for r in rows]
        rule = column[1]
        size = max(3, *(len(x) for i, x in enumerate(column) if i != 1))
        left, right = rule.startswith(":") and len(rule) > 0, rule.endswith(":") and len(rule) > 0
        left = left and not (right and len(rule) == 1)
        for i, x in enumerate(column):
            if i == 1:
                out[i].append((":" if left else "-") + "-" * (size - 2) + (":" if right else "-"))
            else:
                ahead = (size - len(x)) // 2 if left and right else size - len(x) if right else 0
                out[i].append(" " * ahead + x + " " * (size - len(x) - ahead))
    return ["| " + " | ".join(r) + " |" for r in out]


def _item(lines: list[str], code: bool) -> list[str]:
    whole = "\n".join(lines)
    m = re.match(r"( {0,3}(?:[-*+]|\d{1,9}[.)]))([ \t]{1,4}(?=[^ \t\n])|[ \t]?)", whole)
    mark, out = re.sub(r"[*+]", "-", m[1].strip()), []
    for i, line in enumerate(lines):
        rest = line[m.end() :] if i == 0 else line[min(m.end(), 1 if line.startswith("\t") else len(line) - len(line.lstrip(" "))) :]
        if not code:
            rest = _single(re.sub(r"^( *)[*+](?=[ \t])", r"\1-", rest))
        out.append(f"{mark} {rest}" if i == 0 and rest else mark if i == 0 else " " * (len(mark) + 1) + rest if rest else "")
    return out


def _quote(lines: list[str], code: bool) -> list[str]:
    if code:
        return [re.sub(r"^ {0,3}>[ \t]?", "> ", line).rstrip(" ") if QUOTE.match(line) else line.rstrip(" ") for line in lines]
    return [("> " + _single(re.sub(r"^ {0,3}>? {0,4}(?! )|^ {0,3}>?[ \t]*$", "", line, count=1))).rstrip(" ") for line in lines]


def normalize(text: str) -> str:
    """Text-level formatting: LF ends, no trailing blanks, one empty line between blocks but those of a list, tables, items
    and quotes in one form, single inner blanks, one LF at the end. Fences, HTML blocks and indented code keep their lines."""
    text = re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
    blocks = segment(text)
    lines = text.split("\n")
    out: list[str] = []
    last, before = 0, None
    for b in blocks:
        code = b.type in ("blockquote", "list_item") and any(x in text[b.start : b.end] for x in ("```", "~~~", "<"))
        if out and (b.line_start > last or (before, b.type) not in {("list_item", "list_item"), ("definition", "definition")}):
            out.append("")
        own = lines[b.line_start : b.line_end]
        if b.type not in ("fence", "html_block", "indented_code"):
            own = [line.rstrip(" \t") for line in own]
        if b.type == "paragraph":
            own = [_single(line.lstrip(" \t")) for line in own]
        elif b.type in ("heading", "thematic_break"):
            own[0] = re.sub(r"^ {1,3}", "", own[0])
        elif b.type in ("table", "list_item", "blockquote"):
            own = _table(own) if b.type == "table" else _item(own, code) if b.type == "list_item" else _quote(own, code)
        out += own
        last, before = b.line_end, b.type
    return "\n".join(out).strip("\n") + "\n" if out else ""


def count_changes(before: str, after: str) -> int:
    """Differing stretches of lines, neighbouring ones as one."""
    if before == after:
        return 0
    codes = difflib.SequenceMatcher(None, before.splitlines(True), after.splitlines(True), autojunk=False).get_opcodes()
    return sum(c[0] != "equal" and (i == 0 or codes[i - 1][0] == "equal") for i, c in enumerate(codes))


def table_form(text: str) -> str:
    """Tables in a form to compare: cells joined by blanks, delimiter rows as their alignments."""
    lines = text.split("\n")
    for b in segment(text):
        if b.type != "table":
            continue
        for k in range(b.line_start, b.line_end):
            cells = [c.strip() for c in lines[k].strip().strip("|").split("|")]
            if k == b.line_start + 1:
                align = [("center" if c[:1] == ":" == c[-1:] and len(c) > 1 else "left" if c[:1] == ":" else "right" if c[-1:] == ":" else "none") for c in cells]
                lines[k] = "TABLE_DELIMITER:" + ",".join(align)
            else:
                lines[k] = " ".join(c for c in cells if c)
    return "\n".join(lines)


def type_signature(text: str) -> list[str]:
    return [b.type for b in segment(text)]


def link_targets(text: str) -> list[str]:
    return [text[s.start : s.end].strip("<>") for s in protected(text) if s.kind in ("destination", "definition", "autolink")]


def visible_text(text: str) -> str:
    """What a reader sees: marks, destinations and tags gone, white space single."""
    text = table_form(text)
    kept, last = [], 0
    for s in protected(text):
        if s.kind in ("html_inline", "html_block", "destination", "definition"):
            kept.append(text[last : s.start])
            last = s.end
    text = "".join([*kept, text[last:]])
    text = re.sub(r"(?m)^ {0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+|`{3,}.*$|~{3,}.*$|(?:=+|-+|[-*_ ]{3,})$|\[[^\]]*\]:[ \t]*$)", "", text)
    text = re.sub(r"!?\[([^\]]*)\](?:\(\s*(?:\"[^\"]*\")?\s*\)|\[[^\]]*\])?", r"\1", text)
    for pair in (r"\*\*([^*\r\n]+)\*\*", r"__([^_\r\n]+)__", r"\*([^*\r\n]+)\*", r"_([^_\r\n]+)_", r"~~([^~\r\n]+)~~"):
        text = re.sub(rf"((?<!`)(?P<c>`+)(?!`)(?s:.+?)(?<!`)(?P=c)(?!`))|{pair}", lambda m: m[1] or m[3], text)
    return " ".join(text.split())


def _alt(attributes: str) -> str:
    m = ALT.search(attributes)
    return next((g for g in m.groups() if g is not None), "") if m else ""


def strip_images(text: str) -> str:
    """Images become their alternative texts, ``<img>`` its alt; definitions that only images use go. Code stays."""
    code = [s for s in protected(text) if s.kind in ("fence", "code")]
    free: list[tuple[int, int]] = []
    last = 0
    for s in code:
        free.append((last, s.start))
        last = s.end
    free.append((last, len(text)))
    used = {m[1].strip().lower() for a, b in free for m in re.finditer(r"(?<!!)\[[^\]\n]*\]\[([^\]\n]+)\]", text[a:b])}
    used |= {m[1].strip().lower() for a, b in free for m in re.finditer(r"(?<!!)(?<!\])\[([^\]\n]+)\](?![:(\[])", text[a:b])}
    images = {m[1].strip().lower() for a, b in free for m in re.finditer(r"!\[[^\]\n]*\]\[([^\]\n]+)\]", text[a:b])}
    images |= {m[1].strip().lower() for a, b in free for m in re.finditer(r"!\[([^\]\n]+)\](?:\[\])?(?![(\[])", text[a:b])}

    def clean(piece: str) -> str:
        out, at = [], 0
        for m in re.finditer(r"!\[((?:[^\[\]\\]|\\.)*)\](\(|\[[^\]\n]*\])?", piece):
            if m.start() < at:
                continue
            end = m.end()
            if m[2] == "(":
                where = _destination(piece, m.end(), len(piece))
                close = piece.find(")", where[1] if where else m.end())
                title = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')?\s*\)").match(piece, where[1] if where else m.end())
                end = title.end() if title else close + 1 if close >= 0 else m.end()
            out += piece[at : m.start()], m[1]
            at = end
        piece = "".join([*out, piece[at:]])
        return IMAGE_TAG.sub(lambda m: _alt(m[1]), piece)

    def keep_line(line: str) -> bool:
        m = DEFINITION.match(line)
        return not (m and m[1].strip().lower() in images and m[1].strip().lower() not in used)

    out = []
    for i, (a, b) in enumerate(free):
        piece = "".join(x for x in text[a:b].splitlines(True) if keep_line(x))
        out.append(clean(piece))
        if i < len(code):
            out.append(text[code[i].start : code[i].end])
    return "".join(out)


def has_forbidden_image(text: str) -> bool:
    """An image, an ``<img>``, or a link to a ``data:image`` outside code."""
    code = [s for s in protected(text) if s.kind in ("fence", "code")]
    last, free = 0, []
    for s in code:
        free.append(text[last : s.start])
        last = s.end
    rest = "\0".join([*free, text[last:]])
    return bool(re.search(r"!\[[^\]\n]*\](?:\(|\[)", rest) or IMAGE_TAG.search(rest) or re.search(r"(?i)\]\(\s*<?data:image|^ {0,3}\[[^\]]+\]:\s*<?data:image", rest))
