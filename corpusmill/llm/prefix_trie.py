"""Conversation prefix trie: what conversations share from their first turn on, as a trie of turn sequences.

The trie is never built in one place. A prefix is known by two 64-bit sums (exclusive or) of hashes of its (position,
role, text) triples; running over a conversation they give every node of its path, and as they compose, a conversation
of any length is cut into blocks of turns whose sums are joined by offsets. Nodes are groups of equal sums.

Members of a node only fall away further down, so nodes of equal least member and equal number of members form a chain
without branches or ends. Chains make the compact trie. Each distinct turn sequence is one path of chains; paths are
range-partitioned in depth-first order into shards. A shard writes its part of the trie as balanced parentheses with the
least excess of each block of parentheses and a tree of minima over the blocks; ``findclose`` delimits a chain's
subtree, the rank of leaf pairs within it counts leaves, and cumulative arrays give savings. Only chains on the spine
between two shards lie in both; summing per chain merges them, since each leaf and each chain's own savings are entered
in one shard only. Nodes inside a chain follow from the chain and the words ahead of them.

Defined results: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns
come by number, null first, then by role, then by a hash of role and text, so repeated rows are turns of their own, one
after another; a conversation may be left without turns, and then ends at the root; an empty table gives no rows; extra
columns, whatever their names, are ignored; no turn or conversation is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.digests import listed_digest
from corpusmill.functions.ordering import with_positions

from .support import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation summed in one window.
BLOCK_TURNS = 1024


@dataclass(frozen=True)
class BorrowRule:
    """Each conversation takes the first ``crc32(id) % most`` turns of that of its group of ``group`` ids with the least."""

    group: int = 20
    most: int = 4


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, ix, a, b, words``: the turns with their place in the conversation, two hashes of role and text, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).cast("long")
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), words.alias("words"))
    placed = with_positions(slim, ["conv_id", "turn", "role", "a", "b"], "uid")
    first = placed.groupBy("conv_id").agg(F.min("uid").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("uid") - F.col("first")).alias("ix"), "a", "b", "words")


def rebuild(turns: DataFrame, rule: BorrowRule = BorrowRule()) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, last, a, b, words`` of the rebuilt conversations, and ``conv_id, length`` of all of them."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    draw = F.crc32(F.col("conv_id").cast("string").cast("binary")) % rule.most
    based = own.select("conv_id", "n", draw.alias("h"), (F.col("conv_id") - F.col("conv_id") % rule.group).alias("base"))
    bases = own.where(F.col("conv_id") % rule.group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    convs = materialize(based.join(bases, "base", "left").select("conv_id", "base", "h", taken, (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where((F.col("conv_id") % rule.group == 0) & (F.col("ix") < rule.most - 1)).withColumnRenamed("conv_id", "base")  # so many a group
    borrowed = convs.select("conv_id", "base", "taken", "length").join(heads, "base").where("ix < taken").select("conv_id", F.col("ix").alias("pos"), "length", "a", "b", "words")
    kept = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("ix >= h").select("conv_id", (F.col("taken") + F.col("ix") - F.col("h")).alias("pos"), "length", "a", "b", "words")
    rows = borrowed.unionByName(kept).select("conv_id", "pos", (F.col("pos") + 1 == F.col("length")).alias("last"), "a", "b", "words")
    return rows, convs.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, last, na, nb, words, total``: per turn the sums of the prefix it ends, and the prefix's words."""
    marked = rows.select("*", F.xxhash64("pos", "a", "b").alias("za"), F.xxhash64(F.lit(7), "b", "pos", "a").alias("zb"), F.expr(f"pos DIV {BLOCK_TURNS}").alias("block"))
    run = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marked.select("conv_id", "block", "pos", "last", "words", F.bit_xor("za").over(run).alias("na"), F.bit_xor("zb").over(run).alias("nb"), F.sum("words").over(run).alias("total"))
    long = marked.where("pos >= " + str(BLOCK_TURNS)).select("conv_id").distinct()
    totals = marked.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("za").alias("za"), F.bit_xor("zb").alias("zb"), F.sum("words").alias("w"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = totals.select("conv_id", "block", F.bit_xor("za").over(ahead).alias("oa"), F.bit_xor("zb").over(ahead).alias("ob"), F.sum("w").over(ahead).alias("ow")).where("block > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = inside.join(offsets, ["conv_id", "block"], "left")
    return joined.select("conv_id", (F.col("pos") + 1).alias("depth"), "last", F.col("na").bitwiseXOR(zero("oa")).alias("na"), F.col("nb").bitwiseXOR(zero("ob")).alias("nb"), "words", (F.col("total") + zero("ow")).alias("total"))


class Parentheses:
    """Balanced parentheses with the least excess of each block and a tree of minima over the blocks."""

    def __init__(self, opens: np.ndarray, block: int = 512) -> None:
        self.block = block
        self.excess = np.cumsum(np.where(opens, 1, -1))
        starts = np.arange(0, len(opens), block)
        self.levels = [np.minimum.reduceat(self.excess, starts)] if len(opens) else []
        while self.levels and len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append(np.minimum.reduceat(low, np.arange(0, len(low), 2)))

    def findclose(self, i: int) -> int:
        """Where the parenthesis opened at ``i`` is closed: the first place after it whose excess is below its own."""
        target = int(self.excess[i]) - 1
        edge = (i // self.block + 1) * self.block
        here = np.flatnonzero(self.excess[i + 1 : edge] == target)
        if len(here):
            return i + 1 + int(here[0])
        level, k = 0, i // self.block + 1
        while self.levels[level][k] > target:  # up and to the right until a stretch goes low enough
            if k % 2:
                k += 1
                while k % 2 == 0 and level + 1 < len(self.levels) and k // 2 < len(self.levels[level + 1]):
                    level, k = level + 1, k // 2
            else:
                k += 1
        while level:  # and down to its first block
            level, k = level - 1, 2 * k
            if self.levels[level][k] > target:
                k += 1
        return k * self.block + int(np.flatnonzero(self.excess[k * self.block : (k + 1) * self.block] == target)[0])


def encode_shard(batches, block: int = 512):
    """From sorted paths of one shard: per chain its leaves and savings in this shard."""
    opens, pair, own, at, chains = [], [], [], [], []  # per parenthesis: opened, leaf pair, savings; per chain: place, entry
    stack: list[tuple] = []
    for batch in batches:
        for conv, ends, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keep = 0
            while keep < len(stack) and keep < len(path) and stack[keep][:2] == (path[keep]["za"], path[keep]["zb"]):
                keep += 1
            for _ in range(len(stack) - keep):
                stack.pop()
                opens.append(False), pair.append(0), own.append(0)
            for k, entry in enumerate(path[keep:], keep):
                stack.append((entry["za"], entry["zb"], len(opens)))
                at.append(len(opens)), chains.append((entry, path[k - 1] if k else None))
                opens.append(True), pair.append(0), own.append(0)
            if path[-1]["n"] == ends:  # all members end here: a leaf, opened just now
                pair[stack[-1][2]] = 1
            for (_, _, place), entry in zip(stack, path, strict=True):
                if entry["m"] == conv:  # each chain has one such path
                    own[place] = entry["saved"]
    if not opens:
        return
    opens += [False] * len(stack)
    tree = Parentheses(np.array(opens), block)
    leaves, saved = np.concatenate(([0], np.cumsum(pair))), np.concatenate(([0], np.cumsum(np.array(own, np.int64))))
    for low in range(0, len(at), 10_000):
        part = list(zip(at[low : low + 10_000], chains[low : low + 10_000], strict=True))
        closes = [tree.findclose(i) for i, _ in part]
        columns = [[e[c] for _, (e, _) in part] for c in ("m", "n", "top", "end", "ahead")]
        columns += [[p and p[c] for _, (_, p) in part] for c in ("m", "n")]
        columns += [[int(leaves[min(j, len(pair))] - leaves[i]) for (i, _), j in zip(part, closes, strict=True)], [int(saved[min(j, len(own))] - saved[i]) for (i, _), j in zip(part, closes, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["m", "n", "top", "end", "ahead", "pm", "pn", "leaves", "saved"])


def chain_results(members: DataFrame, nodes: DataFrame, convs: DataFrame, root: tuple[int, int]) -> DataFrame:
    """``m, n, top, end, ahead, pm, children, leaves, saved`` per chain: its members' least and number, first and last
    depth, words ahead of it, its parent's least member, and what its subtree holds."""
    steps = members.join(nodes.select("na", "nb", F.col("conv_id").alias("m"), F.col("n_convs").alias("n")), ["na", "nb"]).select("conv_id", "depth", "na", "nb", "words", "total", "m", "n")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("na", "nb", "words", "total")), F.lit(root[0]).cast("long").alias("m"), F.lit(root[1]).cast("long").alias("n"))
    entry = steps.unionByName(tops).groupBy("conv_id", "m", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("end"), F.min_by("na", "depth").alias("za"), F.min_by("nb", "depth").alias("zb"), F.min(F.col("total") - F.col("words")).alias("ahead"), F.sum("words").alias("w")
    )
    saved = ((F.col("n") - 1) * F.col("w")).alias("saved")
    paths = entry.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("top", "za", "zb", "m", "n", "end", "ahead", saved))).alias("path"))
    tip = F.element_at("path", -1)
    distinct = paths.groupBy(tip["m"].alias("tm"), tip["n"].alias("tn")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("ends"), F.min_by("path", "conv_id").alias("path"))
    order = F.transform("path", lambda e: F.struct(e["za"], e["zb"]))
    shards = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.select("conv_id", "ends", "path", order.alias("order")).repartitionByRange(shards, "order").sortWithinPartitions("order").select("conv_id", "ends", "path")
    found = ranged.mapInArrow(encode_shard, "m long, n long, top long, end long, ahead long, pm long, pn long, leaves long, saved long")
    merged = materialize(found.groupBy("m", "n").agg(*(F.max(c).alias(c) for c in ("top", "end", "ahead", "pm", "pn")), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "chains")
    children = merged.where("pm IS NOT NULL").groupBy(F.col("pm").alias("m"), F.col("pn").alias("n")).agg(F.count("*").alias("children"))
    return merged.join(children, ["m", "n"], "left").drop("pn")


def ends_digests(members: DataFrame, convs: DataFrame) -> DataFrame:
    """``na, nb, ends_sha256`` of the nodes where conversations end."""
    ends = members.where("last").select("conv_id", "na", "nb").unionByName(convs.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("na", "nb"))))
    sizes = ends.groupBy("na", "nb").agg(F.count("*").alias("e"), F.min("conv_id").alias("one"))
    key = F.concat_ws(":", "na", "nb").alias("node")
    several = ends.join(sizes.where("e > 1").select("na", "nb"), ["na", "nb"], "left_semi").select(key, "conv_id")
    listed = listed_digest(several, "node", "conv_id")
    return sizes.select("na", "nb", key, "e", "one").join(listed, "node", "left").select("na", "nb", F.coalesce("digest", digest_of(F.col("one").cast("string"))).alias("ends_sha256"))


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix_trie(conversations: DataFrame, rule: BorrowRule = BorrowRule()) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = materialize(turns_in_order(conversations), "turns")
    rows, convs = rebuild(turns, rule)
    members = materialize(prefixes(rows), "prefixes")
    least, count = convs.agg(F.min("conv_id"), F.count("*")).head()
    inner = members.groupBy("na", "nb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("total").alias("total"))
    spark = conversations.sparkSession
    top = [(0, 0, 0, least, count, 0, 0)] if count else []
    root = spark.createDataFrame(top, "na long, nb long, depth long, conv_id long, n_convs long, words long, total long")
    nodes = materialize(inner.unionByName(root), "nodes")
    chains = chain_results(members, nodes.where("depth > 0"), convs, (least or 0, count))
    ends = ends_digests(members, convs)
    inside = F.col("depth") < F.col("end")
    above = (F.col("n_convs") - 1) * (F.col("total") - F.col("words") - F.col("ahead"))
    joined = nodes.join(chains.withColumnsRenamed({"m": "conv_id", "n": "n_convs"}), ["conv_id", "n_convs"]).join(ends, ["na", "nb"], "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("pm")).alias("parent_conv_id"), "n_convs",
        F.when(inside, F.lit(1)).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - above).alias("saved_tokens"), F.coalesce("ends_sha256", digest_of(F.lit(""))).alias("ends_sha256"),
    )


ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS ix
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda acc, b: xor(acc >> 8, tab[CAST(xor(acc, b) & 255 AS INT) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, ix) AS depth FROM (
    SELECT c.conv_id, 0 AS part, t.ix, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.ix < c.h
    UNION ALL SELECT t.conv_id, 1, t.ix, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.ix >= c.h)
), steps AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), last AS (
  SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id
), members AS (
  SELECT s.*, min(s.conv_id) OVER node AS node_conv, count(*) OVER node AS n_convs, s.depth = l.depth AS ends FROM steps s JOIN last l USING (conv_id) WINDOW node AS (PARTITION BY s.path)
), nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(node_conv) AS conv_id, any_value(n_convs) AS n_convs, (any_value(n_convs) - 1) * any_value(words) AS own, count(*) FILTER (ends) AS n_ends,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path
), above AS (
  SELECT n.path AS below, n.own, n.n_ends = n.n_convs AS leaf, n.depth AS below_depth, m.path, m.depth, m.node_conv FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
), sums AS (
  SELECT path, sum(own) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (below_depth = depth + 1) AS children FROM above GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.node_conv AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
"""
