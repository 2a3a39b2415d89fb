"""Markdown structure as expressions: a text is cut into blocks by one regular expression, and every rule is a map over
the blocks. A documented subset of CommonMark and tables.

Blocks: fence, html_block, heading (ATX and setext), thematic_break, blockquote, list_item, table, definition,
indented_code, paragraph, and blank for the white space between. They cover the text: joined, they give it back. Block
quotes and list items are containers, peeled level by level for what they hold; a list item goes on over lines indented
by two blanks (three in numbered lists) more than its mark, or a tab. Parentheses in link destinations nest three deep. Line ends are CRLF, CR and LF only. All offsets
are code points, half open. Loops in the patterns are possessive, so they neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import first_flags, higher, let, running_totals
from .regex_spans import positioned
from .text import paragraph_key

NL, EOL, LINE = r"(?:\r\n|\r|\n)", r"(?:\r\n|\r|\n|\z)", r"[^\r\n]*+"
INDENT = r"[ ]{0,3}+"
SPACE = r"[\s\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f&&[^\r\n]]"
BLANK = rf"{SPACE}*+{EOL}"
# Element names that open an HTML block.
HTML_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
RAW_TAGS = "script|pre|style|textarea"
MARKER = r"(?:[-*+]|[0-9]{1,9}[.)])"

OPENS = {
    "fence": rf"{INDENT}(?:`{{3,}}+[^`\r\n]*+{EOL}|~{{3,}})",
    "html_block": rf"{INDENT}<(?:!--|[!?]|(?i:/?(?:{HTML_TAGS})|(?:{RAW_TAGS}))(?:[\s/>]|\z))",
    "heading": rf"{INDENT}#{{1,6}}(?:[ \t]|{EOL})",
    "thematic_break": rf"{INDENT}(?:(?:\*[ \t]*+){{3,}}+|(?:-[ \t]*+){{3,}}+|(?:_[ \t]*+){{3,}}+){EOL}",
    "blockquote": rf"{INDENT}>",
    "list_item": rf"{INDENT}{MARKER}(?:[ \t]|{EOL})",
    "table": rf"[^\r\n|]*+\|{LINE}{NL}{INDENT}\|?[ \t]*+:?-++:?[ \t]*+(?:\|[ \t]*+:?-++:?[ \t]*+)*+\|?[ \t]*+{EOL}",
    "definition": rf"{INDENT}\[(?!\^)[^\]\r\n]++\]:[ \t]*+(?:<[^<>\r\n]*+>|\S)",
    "indented_code": r"(?:[ ]{4}|\t)",
}
INTERRUPTS = "|".join(OPENS[k] for k in ("fence", "heading", "thematic_break", "blockquote", "list_item", "html_block", "table"))
SETEXT = rf"{INDENT}(?:=++|-++)[ \t]*+{EOL}"


def _fence(mark: str, name: str, info: str) -> str:
    close = rf"{INDENT}\k<{name}>{mark}*+[ \t]*+{EOL}"
    return rf"{INDENT}(?<{name}>{mark}{{3,}}+){info}{EOL}(?:(?!{close})(?!\z){LINE}{EOL})*+(?:{close})?+"


def _item(marker: str, width: int, name: str) -> str:
    deeper = rf"(?:\k<{name}>[ ]{{{width}}}|\t)"
    return rf"(?<{name}>{INDENT}){marker}(?:[ \t]{LINE})?+{EOL}(?:(?!{BLANK})(?:(?={deeper})|(?!{INTERRUPTS})){LINE}{EOL}|(?:{SPACE}*+{NL})++(?={deeper}{SPACE}*+\S))*+"


FENCE = rf"{_fence('`', 'tick', '[^`' + chr(92) + 'r' + chr(92) + 'n]*+')}|{_fence('~', 'tilde', LINE)}"
BLOCKS = "|".join(
    [
        rf"(?:{SPACE}*+{NL})++(?:{SPACE}++\z)?+|{SPACE}++\z",
        FENCE,
        rf"{INDENT}<!--(?s:.*?)(?:-->{LINE}{EOL}|\z)",
        rf"{INDENT}<[!?](?s:.*?)(?:>{LINE}{EOL}|\z)",
        rf"{INDENT}<(?<raw>(?i:{RAW_TAGS}))(?=[\s/>]|\z)(?s:.*?)(?:(?i:</\k<raw>>){LINE}{EOL}|\z)",
        rf"{INDENT}</?(?i:{HTML_TAGS})(?=[\s/>]|\z){LINE}{EOL}(?:(?!{BLANK}){LINE}{EOL})*+",
        rf"{INDENT}#{{1,6}}(?:[ \t]{LINE})?+{EOL}",
        OPENS["thematic_break"],
        rf"{OPENS['blockquote']}{LINE}{EOL}(?:(?!{BLANK})(?:(?={OPENS['blockquote']})|(?!{INTERRUPTS})){LINE}{EOL})*+",
        _item("[-*+]", 2, "bullet"),
        _item("[0-9]{1,9}[.)]", 3, "number"),
        rf"{OPENS['table']}(?:(?!{BLANK}|{OPENS['heading']}|{OPENS['fence']}|{OPENS['blockquote']}){LINE}{EOL})*+",
        rf"{OPENS['definition']}{LINE}{EOL}",
        rf"{OPENS['indented_code']}{LINE}{EOL}(?:(?!{BLANK}){OPENS['indented_code']}{LINE}{EOL}|(?:{SPACE}*+{NL})++(?=(?:[ ]{{4}}|\t){SPACE}*+\S))*+",
        rf"[^\r\n]++{EOL}(?:(?!{BLANK}|{INTERRUPTS}|{SETEXT}){LINE}{EOL})*+(?:{SETEXT})?+",
    ]
)
CLOSED = rf"\A{INDENT}(?<f>`{{3,}}+|~{{3,}}+)(?s:.*)[\r\n]{INDENT}\k<f>[`~]*+[ \t]*+{NL}?+\z"
SPECIAL = rf"\A(?:{SPACE}|[\r\n]|{INDENT}[`~<#>*+_\[0-9-])|\|"

CODE = r"(?<!`)(?<c>`++)(?s:.+?)(?<!`)\k<c>(?!`)"
#: Code of a block, fences in containers among it: those open with marks of their containers before them, and in a quote
#: end with its marks.
_BOXED = rf"(?:(?<=[\r\n])|(?<![^\r\n]))[ \t]*+(?:{MARKER}[ \t]++)*+(?<q>>)?+[ \t>]*+(?:{MARKER}[ \t]++|>[ \t]*+)*+(?<w>`{{3,}}+(?=[^`\r\n]*+{EOL})|~{{3,}}+){LINE}{EOL}(?:(?![ \t>]*+\k<w>[`~]*+[ \t]*+{EOL})(?!\z){LINE}{EOL})*+(?:[ \t>]*+\k<w>[`~]*+[ \t]*+)?+"
KEPT_CODE = rf"{_BOXED}|{CODE}"
AUTOLINK = r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*+|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]++@[A-Za-z0-9.-]++)>"
INLINE_HTML = r"<!--(?s:.*?)-->|</?[A-Za-z][A-Za-z0-9-]*+(?:\s[^<>]*+)?+/?>"
_PLAIN = r"[^\s()\\]|\\[^\r\n]"
_NESTED = rf"\((?:{_PLAIN}|\((?:{_PLAIN}|\((?:{_PLAIN})*+\))*+\))*+\)"
DESTINATION = rf"(?:<[^<>\r\n]*+>|(?:{_PLAIN}|{_NESTED})++)"
OPEN_LINK = r"\]\([ \t\r\n]*+"
INLINE = rf"{CODE}|{AUTOLINK}|{INLINE_HTML}|{OPEN_LINK}(?<d>{DESTINATION})(?=[^)]*+\))"
IMAGE_TAG = r"(?i:<img)\b(?:(?!\b(?i:alt)\s*+=)(?:[^>\"']|\"[^\"]*+\"|'[^']*+'))*+(?:(?i:alt)\s*+=\s*+(?:\"(?<x>[^\"]*+)\"|'(?<y>[^']*+)'|(?<z>[^\s\"'>]++)))?+(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>"
IMAGE = rf"!\[(?<alt>(?:[^\[\]\\]|\\[^\r\n])*+)\](?:\([ \t\r\n]*+{DESTINATION}?+\s*+(?:\"[^\"]*+\"|'[^']*+')?+\s*+\)|\[[^\]\r\n]*+\])?+"
LABEL = r"\[([^\]\r\n]++)\]"

BLOCK = "struct<type:string,value:string>"
SPAN = "struct<kind:string,start:int,end:int>"
NESTED = "struct<type:string,start:int,end:int,line_start:int,line_end:int,depth:int,parent:int>"
BOX = "struct<type:string,value:string,start:int,line:int,at:array<int>>"
CONTAINERS = ("blockquote", "list_item")
#: Containers within containers are peeled so many levels deep; what lies deeper is text of the last one.
MAX_DEPTH = 64
UNTOUCHED = ("fence", "html_block", "indented_code")


def block_type(value: str) -> str:
    """SQL for the type of one piece of a text; pieces that begin as no special block does are told apart by their last
    line alone."""
    cases = {rf"\A(?:{BLANK})++\z": "blank"} | {rf"\A(?:{p})": name for name, p in OPENS.items()} | {rf"[\r\n]{SETEXT}\z": "heading"}
    listed = " ".join(f"WHEN {value} RLIKE r'{p}' THEN '{name}'" for p, name in cases.items())
    return rf"CASE WHEN {value} RLIKE r'{SPECIAL}' THEN CASE {listed} ELSE 'paragraph' END WHEN {value} RLIKE r'[\r\n]{SETEXT}\z' THEN 'heading' ELSE 'paragraph' END"


def breaks(value: str) -> str:
    """SQL for the number of line ends in a text; a pattern is needed only where CR stands."""
    return f"if(contains({value}, '\\r'), size(split({value}, r'{NL}', -1)) - 1, octet_length({value}) - octet_length(replace({value}, '\\n', '')))"


def blocks(text: Column) -> Column:
    """All blocks, blank ones included, in order; their values joined are the text."""
    return higher("transform", F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)), f"v -> cast(named_struct('type', {block_type('v')}, 'value', v) AS {BLOCK})")


def joined(values: Column) -> Column:
    return F.array_join(values, "")


def _trimmed(value: Column) -> Column:
    """Without its line end."""
    return F.regexp_replace(value, rf"{NL}\z", "")


def located(found: Column) -> Column:
    """The blocks with ``line_start, line_end, start, end``; the line end of a block is not part of it."""
    ends = running_totals(higher("transform", found, "b -> char_length(b.value)"))
    lines = running_totals(higher("transform", found, f"b -> {breaks('b.value')}"))
    start = "p.e - char_length(b.value)"
    fields = {
        "type": "b.type", "value": "b.value", "line_start": f"p.l - ({breaks('b.value')})", "line_end": r"if(b.value RLIKE r'[\r\n]\z', p.l, p.l + 1)",
        "start": start, "end": rf"{start} + char_length(regexp_replace(b.value, r'{NL}\z', ''))",
    }
    place = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return higher("zip_with", found, F.arrays_zip(ends.alias("e"), lines.alias("l")), f"(b, p) -> named_struct({place})")


def _bound(**values: str) -> tuple[str, str]:
    """SQL around an expression in which the names of ``values`` are computed once, as fields of ``v``."""
    return "transform(array(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")), v -> ", ")[0]"


def _peeled() -> str:
    """SQL for what ``box``, a container of level ``acc.depth``, holds: ``array<struct<block,box>>``. Its lines lose the
    container's mark or indent; the text left is cut into blocks; ``at`` says where each line's rest stands in the source."""
    line = rf"[^\r\n]++{EOL}|{NL}"
    mark = rf"\A({INDENT}{MARKER}(?:[ \t]{{1,4}}(?=[^ \t\r\n])|[ \t]?))"
    lead = rf"if(box.type = 'blockquote', regexp_extract(x, r'\A({INDENT}>[ \t]?)', 1), if(i = 0, regexp_extract(x, r'{mark}', 1), regexp_extract(x, r'\A(\t|[ ]*)', 1)))"
    width = rf"char_length(if(box.type = 'blockquote', '    ', regexp_extract(box.value, r'{mark}', 1)))"
    o1, c1 = _bound(lines=f"regexp_extract_all(box.value, r'{line}', 0)", width=width)
    o2, c2 = _bound(lines="v.lines", cut=f"transform(v.lines, (x, i) -> least(v.width, char_length({lead})))")
    o3, c3 = _bound(inner="array_join(zip_with(v.lines, v.cut, (x, n) -> substring(x, n + 1)), '')", at="zip_with(box.at, v.cut, (a, n) -> a + n)")
    cut = f"transform(regexp_extract_all(v.inner, r'{BLOCKS}', 0), p -> named_struct('type', {block_type('p')}, 'value', p, 'breaks', {breaks('p')}))"
    o4, c4 = _bound(at="v.at", found=cut)
    o5, c5 = _bound(at="v.at", found="v.found", ends=running_totals("transform(v.found, f -> f.breaks)"))
    first = "(e - f.breaks)"
    last = rf"if(f.value RLIKE r'[\r\n]\z', e, e + 1)"
    tail = rf"char_length(element_at(split(regexp_replace(f.value, r'{NL}\z', ''), r'{NL}', -1), -1))"
    block = f"named_struct('type', f.type, 'start', v.at[{first}], 'end', v.at[{last} - 1] + {tail}, 'line_start', box.line + {first}, 'line_end', box.line + {last}, 'depth', acc.depth, 'parent', box.start)"
    inner = f"named_struct('type', f.type, 'value', f.value, 'start', v.at[{first}], 'line', box.line + {first}, 'at', slice(v.at, {first} + 1, {last} - {first}))"
    rows = f"zip_with(v.found, v.ends, (f, e) -> if(f.type = 'blank', NULL, named_struct('block', {block}, 'box', {inner})))"
    return f"{o1}{o2}{o3}{o4}{o5}filter({rows}, r -> r IS NOT NULL){c5}{c4}{c3}{c2}{c1}"


def nested_blocks(block: Column) -> Column:
    """What a located container holds, at all depths: ``array<struct<type,start,end,line_start,line_end,depth,parent>>``,
    level by level; offsets and lines are those of the source, ``parent`` is the start of the container around. One pass
    per depth: the containers that a level holds are the work of the next."""
    lengths = F.transform(F.regexp_extract_all(block["value"], F.lit(rf"[^\r\n]++{EOL}|{NL}"), F.lit(0)), F.char_length)
    at = let(lengths, lambda n: F.zip_with(running_totals(n), n, lambda e, x: block["start"] + e - x))
    box = F.struct(block["type"].alias("type"), block["value"].alias("value"), block["start"].alias("start"), block["line_start"].alias("line"), at.alias("at")).cast(BOX)
    listed = ", ".join(f"'{c}'" for c in CONTAINERS)
    found = f"flatten(transform(acc.boxes, box -> {_peeled()}))"
    grown = f"cast(concat(acc.done, transform(found, f -> f.block)) AS array<{NESTED}>)"
    boxes = f"cast(transform(filter(found, f -> f.block.type IN ({listed})), f -> f.box) AS array<{BOX}>)"
    step = f"if(size(acc.boxes) = 0, acc, transform(array({found}), found -> named_struct('depth', acc.depth + 1, 'done', {grown}, 'boxes', {boxes}))[0])"
    start = f"named_struct('depth', 1, 'done', cast(array() AS array<{NESTED}>), 'boxes', cast(b AS array<{BOX}>))"
    return let(F.array(box), f"b -> aggregate(sequence(1, {MAX_DEPTH}), {start}, (acc, k) -> {step}, acc -> acc.done)")


def masked(value: Column, spans: Column) -> Column:
    """The text with blanks for the spans, given left to right and disjoint, relative to it."""
    gap = "(s, i) -> concat(substring(t, if(i = 0, 0, ss[i - 1].end) + 1, s.start - if(i = 0, 0, ss[i - 1].end)), repeat(' ', s.end - s.start))"
    return let(F.struct(value.alias("t"), spans.alias("ss")), f"x -> transform(array(x.t), t -> transform(array(x.ss), ss -> concat(array_join(transform(ss, {gap}), ''), substring(t, if(size(ss) = 0, 0, ss[size(ss) - 1].end) + 1)))[0])[0]")


#: A destination's match without what opens the link, and the kind of a match.
_TARGET = r"regexp_replace(m, r'\A\]\([ \t\r\n]*+', '')"
_AUTO = AUTOLINK.replace("'", chr(92) + "x27")
_KIND = rf"CASE left(m, 1) WHEN '`' THEN 'code' WHEN ']' THEN 'destination' ELSE if(m RLIKE r'\A{_AUTO}\z', 'autolink', 'html_inline') END"


def _may_hold_spans(value: Column) -> Column:
    return value.rlike(r"[`<]|\]\(")


def inline_spans(value: Column) -> Column:
    """Spans inside one block, left to right: code, autolinks, tags, link and image destinations."""
    nothing = F.array().cast(f"array<{SPAN}>")
    one = f"p -> transform(array(p.value), m -> cast(named_struct('kind', {_KIND}, 'start', if(left(m, 1) = ']', p.end - char_length({_TARGET}), p.start), 'end', p.end) AS {SPAN}))[0]"
    return F.when(_may_hold_spans(value), higher("transform", positioned(F.regexp_extract_all(value, F.lit(INLINE), F.lit(0)), value, INLINE), one)).otherwise(nothing)


def inline_units(value: Column, block_type: Column) -> Column:
    """``kind:block type:content`` of those spans; no offsets are looked up."""
    kinds = f"b -> transform(b.hits, m -> concat_ws(':', {_KIND}, b.type, if(left(m, 1) = ']', {_TARGET}, m)))"
    found = lambda: let(F.struct(F.regexp_extract_all(value, F.lit(INLINE), F.lit(0)).alias("hits"), block_type.alias("type")), kinds)
    return F.when(_may_hold_spans(value), found()).otherwise(F.array().cast("array<string>"))


def holds_code(block: Column) -> Column:
    """Whether a container may hold a fence or an HTML block; most need no peeling."""
    return block["type"].isin(*CONTAINERS) & block["value"].rlike(r"```|~~~|<")


def protected_inside(block: Column) -> Column:
    """The fences and HTML blocks of a located container, at all depths, left to right."""
    found = F.filter(nested_blocks(block), lambda n: n["type"].isin("fence", "html_block"))
    return F.array_sort(F.transform(found, lambda n: F.struct(n["type"].alias("kind"), n["start"], n["end"]).cast(SPAN)), lambda x, y: x["start"] - y["start"])


def protected(places: Column) -> Column:
    """Of located blocks the spans that no rewriting may touch, left to right and disjoint: fences and HTML blocks, also
    those in containers, code, tags, autolinks, link and image destinations, destinations of definitions."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def of(b):
        whole = F.array(F.struct(b["type"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")).cast(SPAN))
        head = F.char_length(F.regexp_extract(b["value"], rf"\A({INDENT}\[[^\]\r\n]++\]:[ \t]*+)", 1))
        target = F.char_length(F.regexp_extract(b["value"], rf"\A{INDENT}\[[^\]\r\n]++\]:[ \t]*+(<[^<>\r\n]*+>|\S++)", 1))
        definition = F.array(F.struct(F.lit("definition").alias("kind"), (b["start"] + head).alias("start"), (b["start"] + head + target).alias("end")).cast(SPAN))
        shift = lambda spans, by: higher("transform", F.array(F.struct(spans.alias("ss"), by.alias("by"))), f"v -> transform(v.ss, s -> cast(named_struct('kind', s.kind, 'start', s.start + v.by, 'end', s.end + v.by) AS {SPAN}))")[0]
        rest = lambda spans: inline_spans(F.when(F.size(spans) > 0, masked(b["value"], shift(spans, -b["start"]))).otherwise(b["value"]))
        moved = let(F.when(holds_code(b), protected_inside(b)).otherwise(nothing), lambda spans: let(F.concat(spans, shift(rest(spans), b["start"])), "a -> if(size(a) < 2, a, array_sort(a, (x, y) -> x.start - y.start))"))
        return F.when(b["type"].isin("fence", "html_block"), whole).when(b["type"] == "definition", definition).when(b["type"].isin("blank", "thematic_break"), nothing).otherwise(moved)

    return F.flatten(F.transform(places, of))


def code_inside(block: Column) -> Column:
    """The fences and HTML blocks inside a block of any type, relative to its value."""
    box = F.struct(block["type"].alias("type"), block["value"].alias("value"), F.lit(0).alias("start"), F.lit(0).alias("line_start"))
    return F.when(holds_code(block), protected_inside(box)).otherwise(F.array().cast(f"array<{SPAN}>"))


def protected_units(found: Column) -> Column:
    """``kind:block type:content`` of the protected spans, in order; content inside containers without their marks."""

    def of(b):
        value = b["value"]
        inline = lambda text, spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], b["type"], F.substring(text, s["start"] + 1, s["end"] - s["start"])))
        unmarked = lambda text: F.regexp_replace(text, rf"([\r\n])[ \t]*+(?:>[ \t]?+)*+[ \t]*+", "$1")
        inside = let(code_inside(b), lambda spans: F.concat(F.transform(inline(value, spans), unmarked), let(masked(value, spans), lambda rest: inline_units(rest, b["type"]))))
        target = F.array(F.concat(F.lit("definition:definition:"), F.regexp_extract(value, rf"\]:[ \t]*+(<[^<>\r\n]*+>|\S++)", 1)))
        whole = F.array(F.concat_ws(":", b["type"], b["type"], _trimmed(value)))
        none = F.array().cast("array<string>")
        return F.when(b["type"].isin("fence", "html_block"), whole).when(b["type"] == "definition", target).when(b["type"].isin("blank", "thematic_break"), none).when(holds_code(b), inside).otherwise(inline_units(value, b["type"]))

    return F.flatten(F.transform(found, of))


def unclosed_fence(text: Column) -> Column:
    """True if a fence stays open; only texts that hold a fence mark are searched."""
    anchored = rf"(?:\A|(?<=[\r\n]))(?:{FENCE})"
    marked = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
    return F.coalesce(F.when(marked, F.exists(F.regexp_extract_all(text, F.lit(anchored), F.lit(0)), lambda f: ~f.rlike(CLOSED))).otherwise(False), F.lit(False))


def without_repeated_paragraphs(found: Column) -> Column:
    """``struct<text,removed>``: the first of equal paragraphs stays, later ones go with the blank lines after them."""
    keys = F.transform(found, lambda b, i: F.when(b["type"] == "paragraph", F.concat(F.lit("p"), paragraph_key(b["value"]))).otherwise(F.concat(F.lit("-"), i.cast("string"))))

    def rebuild(first):
        stays = lambda b, i: F.get(first, i) & ((b["type"] != "blank") | (i == 0) | F.get(first, i - 1))
        text = joined(F.transform(F.filter(found, lambda b, i: F.coalesce(stays(b, i), F.lit(True))), lambda b: b["value"]))
        return F.struct(text.alias("text"), F.size(F.filter(first, lambda f: ~f)).alias("removed"))

    return let(first_flags(keys), rebuild)


def separated(found: Column) -> Column:
    """For each block whether formatting puts an empty line before it: blocks that touch are set apart, but for the items
    of a list and for definitions."""
    kinds = "list_item", "definition"
    together = " OR ".join(f"(b.type = '{k}' AND p.type = '{k}')" for k in kinds)
    return let(found, f"bs -> transform(bs, (b, i) -> transform(array(get(bs, i - 1)), p -> coalesce(i > 0 AND b.type <> 'blank' AND p.type <> 'blank' AND NOT ({together}), false))[0])")


def formatted_table(value: Column) -> Column:
    """The rows with cells as wide as the widest of their column, three at least, set to the column's side."""
    cells = r"transform(split(regexp_replace(trim(line), r'\A\||(?<!\\)\|\z', ''), r'(?<!\\)\|', -1), c -> trim(c))"
    rows = rf"transform(split(regexp_replace(t, r'{NL}\z', ''), r'{NL}', -1), line -> {cells})"
    wide = "aggregate(filter(rs, (r, i) -> i <> 1), array_repeat(3, array_max(transform(rs, r -> size(r)))), (ws, r) -> concat(zip_with(slice(ws, 1, size(r)), r, (w, c) -> greatest(w, char_length(c))), slice(ws, size(r) + 1, size(ws))))"
    side = "CASE WHEN c LIKE ':%:' THEN 'center' WHEN c LIKE '%:' THEN 'right' WHEN c LIKE ':%' THEN 'left' ELSE 'none' END"
    columns = f"zip_with(ws, rs[1], (w, c) -> named_struct('w', w, 's', {side}))"
    rule = "array_join(transform(xs, x -> concat(if(x.s IN ('center', 'left'), ':', '-'), repeat('-', x.w - 2), if(x.s IN ('center', 'right'), ':', '-'))), ' | ')"
    cell = "CASE x.s WHEN 'right' THEN lpad(c, x.w, ' ') WHEN 'center' THEN rpad(concat(repeat(' ', (x.w - char_length(c)) DIV 2), c), x.w, ' ') ELSE rpad(c, x.w, ' ') END"
    # cells that a row lacks are blank: the end of a row of blanks
    lack = "if(size(r) < size(xs), substring(e.blank, e.ends[size(r) - 1] + 1), '')"
    line = f"concat('| ', if(i = 1, e.rule, concat(array_join(zip_with(slice(xs, 1, size(r)), r, (x, c) -> {cell}), ' | '), if(size(r) < size(xs), ' | ', ''), {lack})), ' |')"
    ends = running_totals("transform(xs, x -> x.w + 3)")
    edges = f"named_struct('rule', {rule}, 'blank', array_join(transform(xs, x -> repeat(' ', x.w)), ' | '), 'ends', {ends})"
    body = f"array_join(transform(rs, (r, i) -> {line}), '\\n')"
    return let(value, f"t -> transform(array({rows}), rs -> transform(array({wide}), ws -> transform(array({columns}), xs -> transform(array({edges}), e -> {body})[0])[0])[0])[0]")


def formatted_item(value: Column, code: Column) -> Column:
    """A list item with one blank behind its mark and its lines at the indent of that; bullets are ``-``, nested ones too."""
    mark = rf"\A({INDENT}{MARKER})([ \t]{{1,4}}(?=[^ \t\n])|[ \t]?)"
    head = f"regexp_replace(trim(regexp_extract(t, r'{mark}', 1)), r'[*+]', '-')"
    width = f"char_length(regexp_extract(t, r'{mark}', 0))"
    rest = "if(i = 0, substring(line, x.w + 1), substring(line, least(x.w, char_length(regexp_extract(line, r'\\A(\\t|[ ]*)', 1))) + 1))".replace("\\\\", "\\")
    shown = "if(i = 0, concat_ws(' ', x.h, nullif(y, '')), if(y = '', '', concat(repeat(' ', char_length(x.h) + 1), y)))"
    tidy = r"regexp_replace(regexp_replace(z, r'\A( *)[*+](?=[ \t])', '$1-'), r'(?<=\S)[ \t]{2,}(?=\S)', ' ')"
    done = f"transform(array({rest}), z -> transform(array(if(x.code, z, {tidy})), y -> {shown})[0])[0]"
    lines = f"array_join(transform(split(regexp_replace(t, r'\\n\\z', ''), '\\n', -1), (line, i) -> {done}), '\\n')".replace("\\\\", "\\")
    return let(F.struct(value.alias("t"), code.alias("code")), f"b -> transform(array(b.t), t -> transform(array(named_struct('h', {head}, 'w', {width}, 'code', b.code)), x -> {lines})[0])[0]")


def formatted_quote(value: Column, code: Column) -> Column:
    """Every line with the quote's mark and one blank; text that goes on without a mark gets it."""
    plain = r"regexp_replace(regexp_replace(line, r'\A {0,3}>? {0,4}(?! )|\A {0,3}>?[ \t]*\z', ''), r'(?<=\S)[ \t]{2,}(?=\S)', ' ')"
    kept = r"if(line RLIKE r'\A {0,3}>', regexp_replace(line, r'\A {0,3}>[ \t]?', '> '), line)"
    each = f"if(b.code, rtrim({kept}), rtrim(concat('> ', {plain})))"
    return let(F.struct(value.alias("t"), code.alias("code")), rf"b -> array_join(transform(split(regexp_replace(b.t, r'\n\z', ''), '\n', -1), line -> {each}), '\n')")


def formatted_values(found: Column) -> Column:
    """The blocks' new values, blank runs as one empty line: LF line ends, no trailing blanks, no indent and single inner
    blanks in paragraphs, items, quotes and tables in one form; fences, HTML blocks and indented code keep their lines, and so does
    text in containers that hold code."""

    def one(b):
        lines = F.regexp_replace(b["value"], r"\r\n?", "\n")
        value = F.regexp_replace(lines, r"[ \t]+(?=\n|\z)", "")
        end = lambda text: F.when(value.endswith("\n"), F.concat(text, F.lit("\n"))).otherwise(text)
        return (
            F.when(b["type"] == "blank", "\n").when(b["type"].isin(*UNTOUCHED), lines)
            .when(b["type"] == "list_item", end(formatted_item(value, holds_code(b))))
            .when(b["type"] == "blockquote", end(formatted_quote(value, holds_code(b))))
            .when(b["type"] == "table", end(formatted_table(value)))
            .when(b["type"] == "paragraph", F.regexp_replace(F.regexp_replace(value, r"(?m)^[ \t]+", ""), r"(?<=\S)[ \t]{2,}(?=\S)", " "))
            .when(b["type"].isin("heading", "thematic_break"), F.regexp_replace(value, r"\A {1,3}", ""))
            .otherwise(value)
        )

    return F.transform(found, one)


def formatted(found: Column, values: Column) -> Column:
    """The formatted text of blocks and their new values."""
    spaced = F.zip_with(values, separated(found), lambda v, s: F.when(s, F.concat(F.lit("\n"), v)).otherwise(v))
    return ended(joined(spaced))


def changed_stretches(found: Column, values: Column) -> Column:
    """How many stretches of lines formatting changes: each block's lines beside those of its new value, line ends
    included; empty lines put between blocks, and blank lines beyond the first of a run, or at either end of the text, are
    lines that change."""
    lines = lambda text: F.regexp_extract_all(text, F.lit(rf"[^\r\n]++{EOL}|{NL}"), F.lit(0))

    def of(p, i, last):
        b, new = p["b"], p["v"]
        outer = (b["type"] == "blank") & ((i == 0) | (i == last))
        missing_end = (i == last) & ~new.endswith("\n")
        after = F.when(outer, F.array().cast("array<string>")).otherwise(lines(F.when(missing_end, F.concat(new, F.lit("\n"))).otherwise(new)))
        own = let(after, lambda a: F.transform(lines(b["value"]), lambda x, k: ~x.eqNullSafe(F.get(a, k))))
        return F.when(p["s"], F.concat(F.array(F.lit(True)), own)).otherwise(own)

    def count(pairs):
        flags = F.flatten(F.transform(pairs, lambda p, i: of(p, i, F.size(pairs) - 1)))
        return let(flags, lambda f: F.size(F.filter(f, lambda x, i: x & ~F.coalesce(F.get(f, i - 1), F.lit(False)))))

    return let(F.arrays_zip(found.alias("b"), values.alias("v"), separated(found).alias("s")), count)


def ended(text: Column) -> Column:
    """Without empty lines at either end, and with one LF at the end; empty if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\A\n+", ""), r"\n+\z", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def table_form(found: Column) -> Column:
    """The blocks' values, tables in a form to compare: cells joined by blanks, delimiter rows as their alignments."""

    def row(line, i):
        cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"\A\|+|\|+\z", ""), r"\|", -1), lambda c: F.trim(c))
        sides = F.transform(cells, lambda c: F.when(c.rlike(r"\A:.*:\z"), "center").when(c.startswith(":"), "left").when(c.endswith(":"), "right").otherwise("none"))
        return F.when(i == 1, F.concat(F.lit("TABLE_DELIMITER:"), F.array_join(sides, ","))).otherwise(F.array_join(F.filter(cells, lambda c: c != ""), " "))

    def one(b):
        tail = F.regexp_extract(b["value"], rf"({NL}?)\z", 1)
        return F.when(b["type"] == "table", F.concat(F.array_join(F.transform(F.split(_trimmed(b["value"]), NL, -1), row), "\n"), tail)).otherwise(b["value"])

    return F.transform(found, one)


def link_targets(found: Column) -> Column:
    """Destinations, autolinks and definitions in order, without angle brackets."""
    return unit_targets(protected_units(found))


def unit_targets(units: Column) -> Column:
    """The same of the protected units."""
    targets = F.filter(units, lambda u: u.rlike(r"\A(?:destination|autolink|definition):"))
    return F.transform(targets, lambda u: F.regexp_replace(F.regexp_extract(u, r"(?s)\A[^:]*:[^:]*:(.*)\z", 1), r"\A<|>\z", ""))


#: Emphasis is what two equal marks of a line enclose, strongest first; marks without a partner are text.
EMPHASIS = (r"\*\*(?<x>[^*\r\n]++)\*\*", r"__(?<x>[^_\r\n]++)__", r"\*(?<x>[^*\r\n]++)\*", r"_(?<x>[^_\r\n]++)_", r"~~(?<x>[^~\r\n]++)~~")


def without_emphasis(text: Column) -> Column:
    """Pairs of emphasis marks go, what they enclose stays; code and lone marks, as in ``snake_case``, stay as they are."""
    for pair in EMPHASIS:
        text = F.regexp_replace(text, rf"(?<keep>{CODE})|{pair}", "${keep}${x}")
    return text


def visible_text(found: Column) -> Column:
    """What a reader sees, code with its marks: structure and pairs of emphasis marks, destinations and tags gone, white
    space single."""
    other = rf"{AUTOLINK})|{INLINE_HTML}|(?<open>{OPEN_LINK}){DESTINATION}(?=[^)]*+\))"
    dropped = "(?<keep>{code}|" + other.replace("{", "{{").replace("}", "}}")

    def one(b, shown):
        inline = F.when(shown.rlike(r"[`<~]|\]\("), _by_code(b, shown, dropped, "${keep}${open}")).otherwise(shown)
        return F.when(b["type"].isin("html_block", "definition"), "").when(b["type"] == "fence", shown).otherwise(inline)

    text = joined(F.zip_with(found, table_form(found), one))
    marks = r"(?m)^ {0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|[0-9]{1,9}[.)][ \t]+|`{3,}.*$|~{3,}.*$|(?:=+|-+|[-*_ ]{3,})$)"
    plain = F.regexp_replace(F.regexp_replace(text, marks, ""), r"!?\[([^\]]*)\](?:\(\s*(?:\"[^\"]*\")?\s*\)|\[[^\]]*\])?", "$1")
    return F.trim(F.regexp_replace(F.when(plain.rlike("[*_~]"), without_emphasis(plain)).otherwise(plain), r"\s+", " "))


def leaf_sequence(found: Column) -> Column:
    """``kind:block type`` of the protected spans, in order."""
    return unit_leaves(protected_units(found))


def unit_leaves(units: Column) -> Column:
    """The same of the protected units."""
    return F.transform(units, lambda u: F.regexp_extract(u, r"\A([^:]*:[^:]*):", 1))


def _by_code(block: Column, text: Column, pattern: str, new: str) -> Column:
    """``regexp_replace`` of a block's text; ``{code}`` in the pattern stands for code, in containers with their fences."""
    replaced = lambda code: F.regexp_replace(text, pattern.format(code=code), new)
    return F.when(block["type"].isin(*CONTAINERS), replaced(KEPT_CODE)).otherwise(replaced(CODE))


def _outside_code(b: Column) -> Column:
    return F.when(b["type"] == "fence", "").when(b["type"] == "html_block", b["value"]).otherwise(_by_code(b, b["value"], "{code}", "`"))


def strip_images(found: Column) -> Column:
    """Images become their alternative texts, ``<img>`` its alt; definitions that only images use go. Code stays."""
    free = joined(F.transform(found, _outside_code))
    labels = lambda t, pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.lower(F.trim(x)))
    image = lambda t: F.concat(labels(t, rf"!\[[^\]\r\n]*+\]{LABEL}"), labels(t, rf"!{LABEL}(?:\[\])?+(?![(\[])"))
    link = lambda t: F.concat(labels(t, rf"(?<!!)\[[^\]\r\n]++\]{LABEL}"), labels(t, rf"(?<![!\]]){LABEL}(?![:(\[])"))
    orphans = let(free, lambda t: F.array_except(image(t), link(t)))
    images = rf"{IMAGE}|{IMAGE_TAG}"

    def rebuild(unused):
        def one(b):
            lines = F.regexp_extract_all(b["value"], F.lit(rf"[^\r\n]++{EOL}|{NL}"), F.lit(0))
            kept = F.filter(lines, lambda x: ~x.rlike(rf"\A(?:{OPENS['definition']})") | ~F.array_contains(unused, F.lower(F.trim(F.regexp_extract(x, LABEL, 1)))))
            value = F.when(F.contains(b["value"], F.lit("]:")) & (F.size(unused) > 0), joined(kept)).otherwise(b["value"])
            shown = F.when(b["type"] == "html_block", F.regexp_replace(value, images, "${alt}${x}${y}${z}")).otherwise(_by_code(b, value, rf"(?<keep>{{code}})|{images.replace('{', '{{').replace('}', '}}')}", "${keep}${alt}${x}${y}${z}"))
            return F.when(b["type"] == "fence", b["value"]).otherwise(shown)

        return joined(F.transform(found, one))

    return let(orphans, rebuild)


def has_forbidden_image(found: Column) -> Column:
    """An image, an ``<img>``, or a link to a ``data:image`` outside code."""
    pattern = rf"!\[[^\]\r\n]*+\][(\[]|(?i:<img)\b[^>]*+>|(?i:\]\(\s*+<?data:image)|(?im:^ {{0,3}}\[[^\]\r\n]++\]:[ \t]*+<?data:image)"
    return F.exists(found, lambda b: _outside_code(b).rlike(pattern))
