"""SimHash near-dedup: pivot distance tables.

A document's fingerprint is the 64-bit majority of the XXH64 hashes of its 3-word shingles. Reference fingerprints
(pivots) come in families: the pivots of family ``s`` are zero outside segment ``s`` of the 64 bits. The pivot table of
a fingerprint holds its Hamming distance to each pivot and to the zero pivot; the difference of the two depends on
segment ``s`` alone.

Two fingerprints that differ in at most ``radius`` bits leave all but ``radius`` of the families untouched, so their
table entries for some set of ``families - radius`` families are the same: such an equal set of coordinates is a cell.
Within a cell, pairs whose greatest coordinate difference over the whole table exceeds ``radius`` are discarded (the
triangle inequality), and the survivors are verified bit by bit. Cells hold different fingerprints only; one with more
than ``cell_limit`` of them never forms its pairs: each member names the balls of radius one it lies in (by flipping
the bits outside the cell's families), and members of one ball, at most 2 bits apart, are linked in a star. That is as
exact, and linear. Components come from distributed star contraction over different fingerprints.

Defined results: texts without words, null included, have fingerprint zero and link like any other; very long texts are
hashed whole, in slices; a bit set in just half of the hashes is 0; repeated rows and equal texts share a component; rows
with a null id join components but never name one (null if no member has an id); an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from corpusmill.operators.components import connected_components

from .support import materialize, per_text

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    seed: int = 42
    families: int = 4
    #: As many as a segment has bits, so that equal coordinates mean equal segments and cells stay small.
    pivots_per_family: int = 16
    cell_limit: int = 64
    pivot_seed: int = 1

    @property
    def radius(self) -> int:
        return 2

    @property
    def segment_bits(self) -> int:
        return 64 // self.families

    def pivots(self) -> list[list[int]]:
        """Per family, patterns with about half of its segment's bits set, as signed 64-bit integers."""
        rng, out = random.Random(self.pivot_seed), []
        for s in range(self.families):
            out.append([_signed(rng.getrandbits(self.segment_bits) << (s * self.segment_bits)) for _ in range(self.pivots_per_family)])
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, cfg: SimHashConfig = SimHashConfig()) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < cfg.shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(cfg.shingle)), strict=False)))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(cfg.seed)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every whole text."""
    return per_text(docs, "doc_id", "text", [("fp", T.LongType())], lambda: lambda texts: [[_signed(fingerprint(t, cfg)) for t in texts]], scan=True)


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def pivot_table(fp: Column, cfg: SimHashConfig) -> list[list[Column]]:
    """Hamming distances to the pivots, by family."""
    return [[distance(fp, F.lit(p)) for p in family] for family in cfg.pivots()]


def greatest_difference(x: Column, y: Column, cfg: SimHashConfig) -> Column:
    return F.greatest(*(F.abs(a - b) for fa, fb in zip(pivot_table(x, cfg), pivot_table(y, cfg), strict=True) for a, b in zip(fa, fb, strict=True)))


def cells(distinct: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``subset, cell, fp``: one row per fingerprint and set of families that a link may leave untouched."""
    zero = F.bit_count(F.col("fp"))
    table = pivot_table(F.col("fp"), cfg)
    keys = []
    for i, subset in enumerate(combinations(range(cfg.families), cfg.families - cfg.radius)):
        coordinates = [d - zero for s in subset for d in table[s]]
        keys.append(F.struct(F.lit(i).alias("subset"), F.xxhash64(*coordinates).alias("cell")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.subset", "k.cell", "fp")


def _outside_bits(cfg: SimHashConfig) -> Column:
    """Per subset, the single-bit masks of the segments that it leaves open, and zero."""
    masks = []
    for subset in combinations(range(cfg.families), cfg.families - cfg.radius):
        bits = [b for s in range(cfg.families) if s not in subset for b in range(s * cfg.segment_bits, (s + 1) * cfg.segment_bits)]
        masks.append(F.array(*(F.lit(_signed(1 << b)) for b in bits), F.lit(0).cast("long")))
    return F.array(*masks)


def fingerprint_links(distinct: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``src, dst`` over different fingerprints: connects just those that chains of links connect."""
    members = cells(distinct, cfg)
    sizes = members.groupBy("subset", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(members.join(sizes, ["subset", "cell"]), "pivot-cells")
    small, hot = shared.where(F.col("n") <= cfg.cell_limit), shared.where(F.col("n") > cfg.cell_limit)
    x, y = small.select("subset", "cell", F.col("fp").alias("src")), small.select("subset", "cell", F.col("fp").alias("dst"))
    pairs = x.join(y, ["subset", "cell"]).where("src < dst").select("src", "dst")
    kept = pairs.where(greatest_difference(F.col("src"), F.col("dst"), cfg) <= cfg.radius).where(distance(F.col("src"), F.col("dst")) <= cfg.radius)
    flips = F.transform(F.get(_outside_bits(cfg), F.col("subset")), lambda m: m.bitwiseXOR(F.col("fp")))
    balls = hot.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("inside")).where(F.size("inside") > 1)
    stars = balls.select(F.array_min("inside").alias("src"), F.explode("inside").alias("dst")).where("src <> dst")
    return kept.union(stars).distinct()


def near_duplicates(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document."""
    return components_of(materialize(fingerprints(docs, cfg), "fingerprints"), cfg)


def components_of(prints: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "different-fingerprints")
    linked = connected_components(fingerprint_links(distinct.select("fp"), cfg)).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").select("fp", "first_doc", "n", F.col("component"))
    first = rooted.where("component IS NOT NULL").groupBy("component").agg(F.min("first_doc").alias("least"))
    # only fingerprints of several documents, or linked ones, need to be looked up
    named = rooted.where("n > 1 OR component IS NOT NULL").join(first, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("first_doc")).otherwise(F.col("least")).alias("named"), F.lit(True).alias("known"))
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("known"), F.col("named")).otherwise(F.col("doc_id")).alias("component_id")
    )
