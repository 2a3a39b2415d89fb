"""Markdown structure, personal data and cleaning: vectors, protection, idempotence, guards."""

import difflib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from corpusmill.functions import alignment, markdown
from corpusmill.functions.regex_spans import find_matches
from corpusmill.operators import cleaning, extract, pii, structure

from . import plain_markdown as plain

# One valid value of each entity.
VALUES = {"EMAIL_ADDRESS": "a@sample.org", "CN_ID_CARD": "11010519491231002X", "CN_MOBILE_PHONE": "13800138000", "CREDIT_CARD": "4111111111111111", "IPV4_ADDRESS": "10.0.0.1"}
#: Every kind of protected place, with a gap for a value.
PLACES = ["`{}`", "see [the page](https://files.example/{}/x) there", "![shot](img/{}.png)", "<https://files.example/{}>", 'a <i title="{}">word</i>', "~~~\n{}\n~~~", "<section>\n{}\n</section>", "[r1]: https://files.example/{}"]


def columns(spark, text, *exprs):
    return spark.createDataFrame([(text,)], "t string").select(*exprs).head()


@pytest.mark.parametrize("entity", VALUES)
def test_values_go_from_text_and_stay_in_protected_places(spark, entity):
    value, token = VALUES[entity], pii.TOKENS[entity]
    kept = [p.format(value) for p in PLACES]
    text = "\n\n".join([f"# about {value}", f"It says {value} here, and {value}.", *kept, f"- point {value}", f"> quoted {value}", f"| a | {value} |\n| --- | --- |\n| b | c |"]) + "\n"
    frame = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id long, text string, lang string, blocks string, row string")
    row = cleaning.clean_documents(frame).head()
    assert row.status == "succeeded" and (row.lang, row.blocks, row.row) == ("x", "y", "z")
    assert {c: row[c] for c in pii.COUNTERS.values()} == {c: 6 * (e == entity) for e, c in pii.COUNTERS.items()}
    assert row.text.count(token) == 6 and all(k in row.text for k in kept)
    again = cleaning.clean_documents(spark.createDataFrame([(1, row.text)], "doc_id long, text string")).head()
    assert again.text == row.text and sum(again[c] for c in cleaning.COUNTERS) == 0


@pytest.mark.parametrize(
    ("before", "after", "removed"),
    [("same\n\nsame\n\nsame\n", "same\n\n", 2), ("a\n\nb\n", "a\n\nb\n", 0), ("a  b\n\na b\n\nc", "a  b\n\nc", 1), ("- x\n\nx\n", "- x\n\nx\n", 0), ("", "", 0), ("p\n\n# h\n\np\n# h\n", "p\n\n# h\n\n# h\n", 1), ("x\r\n\r\nx", "x\r\n\r\n", 1), ("> q\n\nq\n\nQ\n\nq", "> q\n\nq\n\nQ\n\n", 1)],
)
def test_paragraph_vectors(spark, before, after, removed):
    assert tuple(columns(spark, before, cleaning.dedup_paragraphs(F.col("t")).alias("d")).d) == (after, removed)


def test_pii_vector(spark):
    text = "a@sample.org 11010519491231002X 13800138000 4111111111111111 10.0.0.1 256.1.1.1 bad-email@ 4111111111111112"
    row = columns(spark, text, pii.find_pii(F.col("t")).alias("m"), pii.redact(F.col("t"), pii.find_pii(F.col("t"))).alias("r"))
    assert [m.entity for m in row.m] == ["EMAIL_ADDRESS", "CN_ID_CARD", "CN_MOBILE_PHONE", "CREDIT_CARD", "IPV4_ADDRESS"]
    assert row.r == "[EMAIL] [ID_CARD] [PHONE] [BANK_CARD] [IPV4] 256.1.1.1 bad-email@ 4111111111111112"


def test_full_width_digits_and_bad_ids(spark):
    row = columns(spark, "１３８００１３８０００ 11010520230230002X 99010519491231002X", pii.redact(F.col("t"), pii.find_pii(F.col("t"))).alias("r"))
    assert row.r == "[PHONE] 11010520230230002X 99010519491231002X"


def test_offsets_agree_with_python(spark):
    texts = ["ab1c22", "漢1字22😀333", "", "1", "no digits", "7a" * 5_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_matches(F.col("t"), r"\d+").alias("m")).collect()
    for r in rows:
        assert [(m.start, m.end, m.value) for m in r.m] == [(*m.span(), m[0]) for m in re.finditer(r"\d+", r.t)]


CONTAINED = ["- a\n  ~~~\n  {}\n  ~~~\n", "> ~~~\n> {}\n> ~~~\n", "> 1. x\n>    ```\n>    {}\n>    ```\n", "- > - y\n  >   ~~~ text\n  >   {}\n  >   ~~~\n", "- <div>\n  {}\n  </div>\n", "> ~~~\n> {}\n"]


@pytest.mark.parametrize("form", CONTAINED)
def test_code_in_containers_survives(spark, form):
    text = form.format("me@sample.org 10.0.0.1") + "\n- tell me@sample.org\n\n> and 10.0.0.1\n"
    row = cleaning.clean_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    want = text.replace("tell me@sample.org", "tell [EMAIL]").replace("and 10.0.0.1", "and [IPV4]")
    assert (row.status, row.text.count("me@sample.org"), row.email_redactions, row.ipv4_redactions) == ("succeeded", 1, 1, 1) and "10.0.0.1" in row.text
    assert [x.split() for x in row.text.splitlines() if x.strip()] == [x.split() for x in want.splitlines() if x.strip()]


PIECES = "a b|- ~~~|> ~~~|> - x|> > y|  ~~~|>  z|   1. w|- > v|a  c|# h|- x|1. y|  more|   deep|> q|```|~~~|`c`|<div>|</div>|<b>t</b>|<!-- z|-->|[r]: u/x|    code|---|===|[l](u(1))|![i](p.png)|<http://e.org/>|text `x|***|||| |\t|a\\b".split("|") + ["| a | b |", "|---|:-:|"]


def test_structure_matches_a_plain_reading(spark):
    """Texts of random lines, against a reader that goes line by line."""
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n"]) for _ in range(1500)]
    read = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markdown.blocks(F.col("t")).alias("b")).select("t", "b", markdown.located(F.col("b")).alias("places"))
    rows = read.select(
        "t", "b", structure.blocks_of(F.col("t")).alias("blocks"), markdown.protected(F.col("places")).alias("spans"), structure.unclosed_fence(F.col("t")).alias("open"),
        markdown.without_repeated_paragraphs(F.col("b")).alias("unique"), cleaning.normalize_markdown(F.col("t")).alias("formatted"), markdown.link_targets(F.col("b")).alias("targets"),
        markdown.visible_text(F.col("b")).alias("visible"), markdown.strip_images(F.col("b")).alias("bare"), markdown.has_forbidden_image(F.col("b")).alias("image"), structure.line_offsets(F.col("t")).alias("lines"),
    ).collect()
    for r in rows:
        t = r.t
        assert "".join(b.value for b in r.b) == t
        assert [tuple(b)[:6] for b in r.blocks if b.top_level] == [tuple(b) for b in plain.segment(t)]
        assert [(b.type, b.start, b.end, b.line_start, b.line_end, b.depth, b.parent) for b in r.blocks if not b.top_level] == plain.nested(t)
        assert [tuple(s) for s in r.spans] == [tuple(s) for s in plain.protected(t)]
        assert r.open == plain.has_unclosed_fence(t) and tuple(r.unique) == plain.dedup_paragraphs(t)
        assert r.formatted == plain.normalize(t) and list(r.targets) == plain.link_targets(t)
        assert r.bare == plain.strip_images(t) and r.image == plain.has_forbidden_image(t)
        assert r.lines == [m.end() for m in re.finditer(r"\A|\n", t)]
        if "|" not in t:
            assert r.visible == plain.visible_text(t)


@pytest.mark.parametrize("text", ["```\n" + "line\n" * 100_000, "word word\n" * 100_000, "- item\n" * 50_000, "p one\n\n" * 50_000, "`a " * 20_000, "[a](" + "(" * 20_000, "<a " * 30_000], ids=lambda t: t[:8].strip())
def test_very_long_texts(spark, text):
    done = columns(spark, text, cleaning.normalize_markdown(F.col("t")).alias("f"), F.size(structure.protected_spans(F.col("t"))).alias("n"))
    assert done.f == plain.normalize(text) and done.n >= 0


@pytest.mark.parametrize(("text", "unclosed"), [("```\na", True), ("```\na\n```", False), ("~~~\na\n```", True), ("````\n```\n````", False), ("``` a`b\nx", False), ("plain", False)])
def test_fences(spark, text, unclosed):
    assert columns(spark, text, structure.unclosed_fence(F.col("t")).alias("u")).u == unclosed


@pytest.mark.parametrize(
    ("text", "n"),
    [("x\n", 0), ("x", 1), ("a  \nb\nc\n", 1), ("a  \nb  \nc\n", 1), ("a  \nb\nc  \n", 2), ("a\n\n\n\nb\n", 1), ("\n\na\n", 1), ("a\n\n\n", 1), ("a\r\nb\r\n", 1), ("* x\n\nb\n\n* y\n", 2), ("```\nx  \n```\n", 0), ("", 0)],
)
def test_change_counts(spark, text, n):
    frame = spark.createDataFrame([(text,)], "t string")
    versions = frame.select(F.lit("x").alias("doc_id"), F.col("t").alias("before"), cleaning.normalize_markdown(F.col("t")).alias("after"))
    assert (frame.select(cleaning.formatting_changes(F.col("t")).alias("n")).head().n, cleaning.count_format_changes(versions).head().changes) == (n, n)


# Fixed vectors.
@pytest.mark.parametrize(("before", "after", "n"), [("a  \r\nb  \r\n", "a\nb\n", 1), ("a\n\nb\n", "\na\n\nb\n", 1), ("a   \n\nb   \n", "a\n\nb\n", 2), ("a\n\n\n\n", "a\n", 1), ("hello\n", "hello\n", 0), ("", "x", 1), (None, "", 0), ("a\x0bb\u2028c", "a\x0bB\u2028c", 1)])
def test_changes_between_texts(spark, before, after, n):
    assert [r.changes for r in cleaning.count_format_changes(spark.createDataFrame([(1, before, after)], "doc_id long, before string, after string")).collect()] == [n]


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_alignment_agrees_with_the_standard_library(before, edits):
    after = list(before)
    for at, line in edits:
        if line == 5:
            del after[at : at + 1]
        else:
            after.insert(at, line)
    blocks = [tuple(m) for m in difflib.SequenceMatcher(None, before, after, autojunk=False).get_matching_blocks()[:-1]]
    one, two = np.array(before, np.uint64), np.array(after, np.uint64)
    assert alignment.matching_stretches(one, two) == blocks
    assert alignment.changes(one, two) == sum(c[0] != "equal" for c in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes())


def test_short_texts_need_no_hashes_of_windows(monkeypatch):
    monkeypatch.setattr(alignment, "_Windows", None)
    one, two = np.arange(64, dtype=np.uint64), np.arange(64, dtype=np.uint64)
    two[::3] += np.uint64(100)
    assert alignment.changes(one, two) == 22


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
@settings(max_examples=300, deadline=None)
def test_long_texts_are_aligned_like_short_ones(before, after):
    one, two = np.array(before, np.uint64), np.array(after, np.uint64)
    few = alignment.FEW_LINES
    try:
        alignment.FEW_LINES = 0
        long = alignment.matching_stretches(one, two)
    finally:
        alignment.FEW_LINES = few
    assert long == alignment.matching_stretches(one, two)


def test_line_digests_cut_at_every_line_end(spark):
    text = "a\r\nb\r\r\n\n\x0b\U0001f600c\x0c\x1c\x1d\x1e\x85d\u2028\u2029e"
    rows = spark.createDataFrame([(t,) for t in (text, text + "\n", "", "\r\n")], "t string").select(F.size(alignment.line_digests(F.col("t"))).alias("n"), "t").collect()
    assert [r.n for r in rows] == [len(r.t.splitlines()) for r in rows]


def test_alignment_of_long_texts_is_fast():
    lines = np.arange(60_000, dtype=np.uint64)
    other = lines.copy()
    other[::2] += np.uint64(10**9)
    began = time.time()
    assert alignment.changes(lines, other) == 30_000 and alignment.changes(np.zeros(60_000, np.uint64), np.zeros(30_000, np.uint64)) == 1
    assert time.time() - began < 20


# Fixed vectors: texts, what cleaning makes of them, and its counters.
GOLDEN = [
    (
        "# 清洗基准1\n\n同一段落\n\n同一段落\n\n邮箱: a@sample.org\n电话: 13800138000\n银行卡: 4111111111110006\n身份证: 11010519491231002X\n内网: 10.0.0.1\n\n| h1 | h2 |\n| --- | --- |\n| A | B |\n\n- item one\n- item one\n\n[safe-ref]: https://a@b.com/foo(1)\n",
        "# 清洗基准1\n\n同一段落\n\n邮箱: [EMAIL]\n电话: [PHONE]\n银行卡: [BANK_CARD]\n身份证: [ID_CARD]\n内网: [IPV4]\n\n| h1  | h2  |\n| --- | --- |\n| A   | B   |\n\n- item one\n- item one\n\n[safe-ref]: https://a@b.com/foo(1)\n",
        (1, 1, 1, 1, 1, 1, 2),
    ),
    (
        "# 清洗基准2\n-   item  one\n\n-   item  one\n\n|a|b|\n|---|---|\n|x|y|\n\n  >  quote\nbefore   [x](https://example.com/?a=1)   after\n",
        "# 清洗基准2\n\n- item one\n\n- item one\n\n| a   | b   |\n| --- | --- |\n| x   | y   |\n\n> quote\n> before [x](https://example.com/?a=1) after\n",
        (0, 0, 0, 0, 0, 0, 4),
    ),
]


@pytest.mark.parametrize(("text", "want", "counts"), GOLDEN)
def test_golden_texts(spark, text, want, counts):
    names = ("duplicate_paragraphs_removed", "phone_redactions", "id_card_redactions", "bank_card_redactions", "email_redactions", "ipv4_redactions", "formatting_changes")
    first, again = cleaning.clean_documents(spark.createDataFrame([(1, text), (2, want)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (first.status, first.text, tuple(first[c] for c in names)) == ("succeeded", want, counts)
    assert (again.text, tuple(again[c] for c in names)) == (want, (0,) * 7)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("|a|bb|c|\n|:-:|--:|:--|\n|xxxxx|1|y|\n|z|\n", "|   a   |  bb | c   |\n| :---: | --: | :-- |\n| xxxxx |   1 | y   |\n|   z   |     |     |\n"),
        ("|a\\|b|c|\n|-|-|\n", "| a\\|b | c   |\n| ---- | --- |\n"), ("*   a\n    more\n    *  b\n", "- a\n  more\n  - b\n"), ("12)   x\n      y\n", "12) x\n    y\n"),
        ("# h\ntext\n***\n> q\n", "# h\n\ntext\n\n***\n\n> q\n"), (">  a   b\n>\n>c\nlazy\n", "> a b\n>\n> c\n> lazy\n"), ("-   x\n\n    ~~~\n    a  b\n    ~~~\n", "- x\n\n  ~~~\n  a  b\n  ~~~\n"), ("-\n", "-\n"),
    ],
)
def test_forms_of_tables_items_and_quotes(spark, text, want):
    row = columns(spark, text, cleaning.normalize_markdown(F.col("t")).alias("f"))
    assert row.f == want and plain.normalize(text) == want and plain.normalize(want) == want


def test_spans_are_cleared_in_linear_time_and_as_by_comparison(spark):
    rng = random.Random(2)
    pick = lambda n: sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(400) for _ in range(n)))
    cases = [(i, [("E", *s) for s in pick(rng.randrange(30))], [("k", *s) for s in pick(rng.randrange(20))]) for i in range(60)]
    schema = "i int, m array<struct<entity:string,start:int,end:int>>, f array<struct<kind:string,start:int,end:int>>"
    for r in spark.createDataFrame(cases, schema).select("m", "f", pii.clear_of(F.col("m"), F.col("f")).alias("kept")).collect():
        want = [tuple(m) for m in r.m if not any(f.start < m.end and f.end > m.start for f in r.f)]
        assert sorted(map(tuple, r.kept)) == sorted(want)


def test_images(spark):
    """Reference definitions that only images use go, and code is left alone."""
    text = "# Report\n\nSee ![the chart](plots/q(2).svg 'second') or ![][map].\n\n[map]: plots/map.svg\n[doc]: files/doc.md\n\nRead [this][doc] and <IMG alt='a logo' src=l.svg>; type `![x](y)`.\n\n~~~\n![kept](z)\n~~~\n"
    want = "# Report\n\nSee the chart or .\n\n[doc]: files/doc.md\n\nRead [this][doc] and a logo; type `![x](y)`.\n\n~~~\n![kept](z)\n~~~\n"
    row = columns(spark, text, extract.strip_images(F.col("t")).alias("s"), extract.has_forbidden_image_content(F.col("t")).alias("before"), extract.has_forbidden_image_content(extract.strip_images(F.col("t"))).alias("after"))
    assert row.s == want and row.before and not row.after
    assert columns(spark, "[n](data:image/gif;base64,R0)", extract.has_forbidden_image_content(F.col("t")).alias("f")).f


def test_rejections_leave_others_alone(spark):
    rows = [(1, None), (2, ""), (3, "```\nopen"), (4, "fine"), (5, " a@b.org" * 20)]
    limits = cleaning.CleaningLimits(max_pii_candidates=10)
    got = {r.doc_id: (r.status, r.error_code) for r in cleaning.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), limits).collect()}
    assert got == {1: ("rejected", "EMPTY_INPUT"), 2: ("rejected", "EMPTY_INPUT"), 3: ("rejected", "INVALID_MARKDOWN"), 4: ("succeeded", None), 5: ("rejected", "TOO_MANY_PII_CANDIDATES")}


@pytest.mark.parametrize(
    ("before", "after", "found"),
    [
        ("call snake_case now", "call snakecase now", {"VISIBLE_TEXT"}), ("a * b", "a  b", {"VISIBLE_TEXT"}), ("so **strong** and _soft_ and ~~gone~~", "so strong and soft and gone", set()),
        ("*open only", "open only", {"VISIBLE_TEXT"}), ("use `x_y`", "use `xy`", {"VISIBLE_TEXT", "PROTECTED_UNITS"}), ("use `x`", "use x", {"VISIBLE_TEXT", "INLINE_LEAVES", "PROTECTED_UNITS"}),
        ("`a` <http://x.org/>", "<http://x.org/> `a`", {"VISIBLE_TEXT", "INLINE_LEAVES", "PROTECTED_UNITS"}), ("> ~~~\n> a\n> ~~~\n", "> ~~~\n> b\n> ~~~\n", {"VISIBLE_TEXT", "PROTECTED_UNITS"}), ("- a_b_c\n", "* abc\n", set()),
    ],
)
def test_emphasis_by_pairs(spark, before, after, found):
    versions = spark.createDataFrame([(1, before, after)], "doc_id long, before string, after string")
    assert {r.violation for r in cleaning.content_preserved(versions).collect()} == found


def test_merge_spans_keeps_touching_apart(spark):
    rows = [(1, 0, 5), (1, 3, 8), (1, 8, 9), (2, 1, 2), (1, 4, 6)]
    got = structure.merge_spans(spark.createDataFrame(rows, "doc_id long, start int, end int")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(1, 0, 8), (1, 8, 9), (2, 1, 2)]


def test_texts_are_parsed_once(spark, sf):
    """How often a plan names the patterns of inline spans and of blocks, and whether it joins: checks share what they read."""
    found = __spark_entry__.queries()
    for name, inline, blocks in (("f4_content_preserved", 4, 4), ("g4_protected_regions_preserved", 4, 4), ("c7_signature_and_targets", 2, 3), ("g2_resource_guard", 4, 3), ("d2_top_level_paragraphs", 0, 2)):
        plan = found[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(markdown.INLINE) <= inline and plan.count(f", {markdown.BLOCKS}, 0)") <= blocks and "Join" not in plan, name


def test_ragged_tables(spark):
    """Sides, rows shorter and longer than the head, and cells wider than it."""
    text = "|a|b|c|\n|:-:|--:|:--|\n|one word|x|\n||1|2|wider|\n"
    row = spark.createDataFrame([(text,)], "t string").select(cleaning.normalize_markdown(F.col("t")).alias("f")).head()
    assert row.f == "|    a     |   b | c   |       |\n| :------: | --: | :-- | ----- |\n| one word |   x |     |       |\n|          |   1 | 2   | wider |\n"


def test_documents_without_paragraphs_are_counted(spark, docs, tmp_path):
    docs([(1, ""), (2, "# only a heading"), (3, "one\ntwo")]).write.parquet(f"{tmp_path}/documents.parquet")
    counted = __spark_entry__.queries()["d2_top_level_paragraphs"](spark, str(tmp_path))
    blocks = structure.segment_blocks(docs([(1, ""), (3, "one\n\n- two")]).select("doc_id", "text"))
    assert sorted(map(tuple, counted.collect())) == [(1, 0), (2, 0), (3, 2)]
    assert [r.doc_id for r in structure.top_level_paragraphs(blocks).collect()] == [3]
