"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, and put in another order.

A unit is a line with its line feed. The UTF-8 bytes of a text are cut into fixed blocks; two Fenwick trees over the
blocks hold how many units end, and how many code points begin, in each. A cut after ``u`` units is found by a
binary-lifting descent of the first tree to the block in which the u-th unit ends, and then among that block's line
feeds alone; the second tree gives the code points ahead of the block, to which those of the block up to the cut are
added. Building the trees reads a text once; a cut costs the logarithm of the blocks and one block.

Which texts are transformed, where and in which order is drawn from the SHA-256 of the seed and the id, so that a row's
result depends on nothing else.

Defined results: null and empty texts are plain with 0 units; texts that hold a mark are plain; a null id draws as an
empty one; a text's last line need not end in a line feed; very long texts are cut like any other; rows of equal id and
text get equal results, repeated rows as often as they stand there; malformed bytes count as they stand, a code point
for each byte that continues none; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.ordering import spread

MARKS = (b"<P>", b"<S>", b"<M>")


@dataclass(frozen=True)
class FillConfig:
    seed: int = 7
    #: Of a hundred texts so many are transformed, and of a hundred of these so many in the order suffix, prefix, middle.
    rate: int = 100
    spm_rate: int = 50
    block_bytes: int = 4096


class Fenwick:
    """Prefix sums over block counts: built in linear time, asked in logarithmic time."""

    def __init__(self, counts: list[int]) -> None:
        self.size = len(counts)
        self.tree = tree = [0, *counts]
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                tree[above] += tree[i]
        self.top = 1 << self.size.bit_length() >> 1

    def ahead(self, block: int) -> int:
        """Sum of the counts before ``block``."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def descend(self, rank: int) -> tuple[int, int]:
        """The block that holds the ``rank``-th (1-based) counted item, and the number of items in the blocks before it."""
        block, passed, step = 0, 0, self.top
        while step:
            if block + step <= self.size and passed + self.tree[block + step] < rank:
                block += step
                passed += self.tree[block]
            step >>= 1
        return block, passed


class CutIndex:
    """Unit boundaries of one text."""

    def __init__(self, text: bytes, block_bytes: int) -> None:
        self.data, self.width = np.frombuffer(text, np.uint8), block_bytes
        starts = np.arange(0, len(text), block_bytes)
        self.feeds, points = self.data == 10, (self.data & 0xC0) != 0x80
        per_block = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64).tolist() if len(text) else []
        self.units_tree, self.points_tree, self.begins = Fenwick(per_block(self.feeds)), Fenwick(per_block(points)), points
        self.closed = self.units_tree.ahead(len(starts))
        self.units = self.closed + (len(text) > 0 and text[-1:] != b"\n")

    def cut(self, units: int) -> int:
        """Byte offset after the first ``units`` units."""
        if units == 0:
            return 0
        if units > self.closed:
            return len(self.data)
        block, passed = self.units_tree.descend(units)
        at = block * self.width
        return at + int(np.flatnonzero(self.feeds[at : at + self.width])[units - passed - 1]) + 1

    def code_points(self, offset: int) -> int:
        """Code points that begin before ``offset``."""
        block = offset // self.width
        return self.points_tree.ahead(block) + int(np.count_nonzero(self.begins[block * self.width : offset]))


def arrange(text: bytes, first: int, second: int, form: str) -> bytes:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    return b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if form == "spm" else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from; exact, as a transformed text holds no mark of its own."""
    if form == "plain":
        return output
    p, s, m = (output.index(mark) for mark in MARKS)
    prefix, suffix, middle = (output[p + 3 : s], output[s + 3 : m], output[m + 3 :]) if form == "psm" else (output[p + 3 : m], output[s + 3 : p], output[m + 3 :])
    return prefix + middle + suffix


def transform(doc_id: int | None, text: bytes, cfg: FillConfig) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output."""
    index = CutIndex(text, cfg.block_bytes)
    drawn = hashlib.sha256(b"%d:%b" % (cfg.seed, b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= cfg.rate:
        return index.units, "plain", None, None, text
    a, b = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    form = "spm" if h4 % 100 < cfg.spm_rate else "psm"
    first, second = index.cut(a), index.cut(b)
    ahead = index.code_points(first)
    return index.units, form, ahead, index.code_points(second) - ahead, arrange(text, first, second, form)


def fill_in_middle(docs: DataFrame, cfg: FillConfig = FillConfig()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` (binary), one row per row; no shuffle but that of a small scan."""
    source = spread(docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [transform(i.as_py(), t.as_py(), cfg) for i, t in zip(part.column(0), part.column(1), strict=True)]
                n, form, ahead, middle, output = zip(*made, strict=True)
                arrays = [pa.array(n, pa.int64()), pa.array(form), pa.array(ahead, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(run, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output binary")


def digest_columns(filled: DataFrame) -> DataFrame:
    """The outputs as digests, and those of the texts rebuilt from output and form."""

    @F.pandas_udf(T.BinaryType())
    def restored(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([restore(bytes(o), f) for o, f in zip(output, form, strict=True)], dtype=object)

    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 100 AS plain,
         CAST('0x' || d[25:32] AS BIGINT) % 100 < 50 AS spm FROM units
), cut AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
