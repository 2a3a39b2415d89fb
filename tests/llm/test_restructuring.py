"""Suffix removal, conversation tries and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import fill_in_middle, prefix_trie, registry, suffix_dedup
from corpusmill.llm.fill_in_middle import FillConfig
from corpusmill.llm.suffix_dedup import SuffixConfig

# --- fill in the middle


def brute_fill(doc_id, text, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i : i + 8], 16) for i in range(0, 32, 8)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(0, 10**12), st.text(st.sampled_from("ab\n\n\r é漢😀<PSM>"), max_size=300), st.sampled_from([1, 3, 64]))
@settings(max_examples=400, deadline=None)
def test_fill_property(doc_id, text, block):
    n, form, ahead, middle, out = fill_in_middle.transform(doc_id, text.encode(), FillConfig(block_bytes=block))
    assert (n, form, ahead, middle, out.decode()) == brute_fill(doc_id, text)
    assert fill_in_middle.restore(out, form) == text.encode()


@given(st.lists(st.integers(0, 3), max_size=70))
def test_fenwick(counts):
    tree = fill_in_middle.Fenwick(counts)
    assert [tree.ahead(i) for i in range(len(counts) + 1)] == [sum(counts[:i]) for i in range(len(counts) + 1)]
    items = [i for i, c in enumerate(counts) for _ in range(c)]
    assert [tree.descend(k + 1) for k in range(len(items))] == [(b, sum(counts[:b])) for b in items]


LONG = "ligne é\n" * 200_000 + "end"
FILL_EDGE = [(1, None), (2, ""), (3, "\n"), (4, "a"), (5, "a\nb"), (5, "a\nb"), (6, LONG), (None, "x\ny\n"), (7, "has <M> inside\n")]


def test_fill_operator_on_edge_rows(spark, docs):
    table = docs(FILL_EDGE)
    for name in ("n", "form", "output", "prefix_chars"):
        table = table.withColumn(name, F.lit("x"))
    rows = fill_in_middle.fill_in_middle(table).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in rows)
    assert got == sorted((str(i), *brute_fill(i, t or "")) for i, t in FILL_EDGE)
    for row in fill_in_middle.digest_columns(fill_in_middle.fill_in_middle(table)).collect():
        assert row.doc_id is None or row.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in FILL_EDGE if i == row.doc_id}
    assert fill_in_middle.fill_in_middle(docs([])).count() == 0


# --- conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = [t[2:] for t in own.get(c - c % 20, [])[:h] + turns[h:]]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found_trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("block", F.lit(1))
    return [tuple(r) for r in prefix_trie.prefix_trie(table).collect()]


TREES = {
    "edges": [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 1, "x", "y"), (3, 0, "user", ""), (41, 5, "u", "only")],
    "shared": [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % (t + 1)} words") for c in range(0, 70) for t in range(c % 6)],
    "copies": [(c, t, "user", f"w{t} " * (t + 1)) for c in range(100, 160) for t in range(4)],
    "nested": [(c, t, "user", f"step {t}") for c in range(200, 240) for t in range(c - 199)],
    "deep": [(c, t, "user", f"step {t // (1 + (c == 302))}") for c in (300, 301, 302) for t in range(40)] + [(5, 0, "a", "b")],
}


@pytest.mark.parametrize("name", TREES)
def test_trie_matches_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 8)
    rows = TREES[name]
    assert sorted(map(str, found_trie(spark, rows))) == sorted(map(str, brute_trie(rows)))


def test_trie_of_nothing(spark):
    assert found_trie(spark, []) == []
    assert found_trie(spark, [(None, 1, "user", "x")]) == []


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.sampled_from([1, 2, 3, 8]))
@settings(max_examples=300, deadline=None)
def test_findclose(closes, block):
    opens, depth = [], 0
    for k in closes:
        opens.append(True)
        opens += [False] * min(k, depth)
        depth += 1 - min(k, depth)
    opens += [False] * depth
    stack, expected = [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            expected[stack.pop()] = i
    tree = prefix_trie.Parentheses(np.array(opens), block)
    assert {i: tree.findclose(i) for i in expected} == expected


# --- suffix removal


def brute_removal(texts, length):
    """``n_bytes, n_removed, n_spans, kept digest`` per text."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


SMALL = SuffixConfig(length=12, gram=2, window=8, run_bytes=600, sample_rate=1, strings_per_part=7, piece_bytes=20)


@given(st.lists(st.text(st.sampled_from("ab"), max_size=60), max_size=8), st.integers(2, 11))
@settings(max_examples=200, deadline=None)
def test_every_start_has_one_anchor_that_its_bytes_decide(texts, window):
    cfg = SuffixConfig(length=12, gram=2 if window < 12 else 1, window=min(window, 11), piece_bytes=7)
    seen = {}
    for text in texts:
        rows = suffix_dedup.anchors_of(text.encode(), cfg).tolist()
        assert [p for _, a, b in rows for p in range(a, b + 1)] == list(range(max(len(text) - 11, 0)))
        assert len({r[0] for r in rows}) == len(rows)
        for anchor, first, last in rows:
            for p in range(first, last + 1):
                assert 0 <= anchor - p < cfg.window
                assert seen.setdefault(text[p : p + 12], anchor - p) == anchor - p


@given(st.lists(st.lists(st.text(st.sampled_from("ab"), max_size=9), min_size=1, max_size=12), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges_with_common_prefixes(runs):
    pieces = [sorted(s.encode() for s in run) for run in runs]
    coded = [suffix_dedup.front_code(p, np.zeros((len(p), 5), np.int64)) for p in pieces]
    merged = list(suffix_dedup.LoserTree([suffix_dedup.front_decode(c) for c in coded]))
    expected = sorted(s for p in pieces for s in p)
    assert [bytes(m[1]) for m in merged] == expected
    assert [m[0] for m in merged] == [0, *(suffix_dedup.common(x, y) for x, y in zip(expected, expected[1:], strict=False))]


def passages(seed):
    rng = random.Random(seed)
    words = lambda n: "".join(rng.choice(["ab", "ba", "c", "é", "dd "]) for _ in range(n))
    shared = [words(12) for _ in range(4)]
    texts = [words(rng.randrange(20)) + "".join(rng.choice(shared)[rng.randrange(3) :] + words(rng.randrange(3)) for _ in range(rng.randrange(4))) for _ in range(40)]
    return [*texts, None, "", "short", "a" * 50, "ab" * 30, shared[0], *[shared[1] * 2] * 12, *["x" + shared[2] + w for w in "pqrstuvw" * 3]]


@pytest.mark.parametrize("seed", range(4))
def test_removal_matches_brute_force(spark, docs, seed):
    texts = passages(seed)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    table = docs(rows)
    for name in ("file", "row", "text_crc", "n_bytes", "anchor", "_metadata"):
        table = table.withColumn(name, F.lit("x"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table, SMALL).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute_removal(texts, 12), strict=True))


def test_removal_of_nothing(spark, docs):
    assert suffix_dedup.remove_repeats(docs([]), SMALL).count() == 0


def test_removal_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in registry.op11_suffixes(spark, sf).collect())
    expected = sorted((r.doc_id, *b) for r, b in zip(rows, brute_removal([r.text for r in rows], 400), strict=True))
    assert got == expected and any(0 < e[2] < e[1] for e in expected)
