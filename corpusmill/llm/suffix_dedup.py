"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed, by sorting suffixes.

Sorting all suffixes of a corpus would move hundreds of times its size, so suffixes are sampled by content. Of the starts
of ``window`` consecutive bytes the one with the least hash of its next ``gram`` bytes is an anchor (ties: the first). Each
window start of ``length`` bytes owns the anchor among its own first ``window`` bytes, so equal strings own anchors at
equal distances: two strings are equal if and only if the texts agree around their anchors, ``distance`` bytes back and
``length - distance`` ahead. Every start has exactly one anchor, so nothing is lost by looking at anchors alone.

1. Anchors, with the hash of the ``length - window + 1`` bytes that every string of an anchor shares; anchors whose hash
   stands alone are dropped (their distinguishing prefix is shorter than any match).
2. The suffixes at the others, followed by the bytes ahead of them in reverse, are sorted in runs. A run is cut at
   splitters drawn from a sample, ties by a hash of the place, so that a group of equal suffixes may lie in several
   parts. Each piece is front-coded (common prefix with the string before it, then the rest) and exchanged.
3. Each part merges its pieces by a loser tree whose entries know their common prefix with the last string put out: a
   longer one wins unseen, equal ones are compared behind it, and the front code is the common prefix of a piece's next
   string. The merged order comes with its common prefixes, so no known prefix is compared again.
4. Neighbours in that order prove strings equal: common bytes ahead and back make a range of distances. Suffixes of one
   kind lie in the order of the bytes back, so their neighbours share most. Strings that only suffixes further off could
   share are looked up by a 128-bit hash of the whole string, in groups that hold one.
5. The starts found are spans of removed bytes; they meet the texts once more to give what is left.

Defined results: null texts are empty; texts under ``length`` bytes lose nothing; a string and its overlap with itself
are two places; repeated rows and copies are wholly removed if long enough; ids may be null or repeated, as rows are
addressed by file and row; very long texts are read in pieces with the same anchors; an empty table gives no rows; extra
columns, whatever their names, are ignored. Cuts may fall inside a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize

PAD = b"\xff"  # no byte of UTF-8


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 400
    #: Bytes hashed at each place, a power of two; ``window + gram`` is at most ``length + 1``.
    gram: int = 16
    window: int = 320
    #: Bytes of strings sorted at a time.
    run_bytes: int = 48 << 20
    #: One of so many anchors is drawn for splitters; at most ``max_samples`` reach the driver.
    sample_rate: int = 256
    max_samples: int = 8192
    strings_per_part: int = 60_000
    piece_bytes: int = 1 << 20

    @property
    def shared(self) -> int:
        """Bytes ahead of an anchor that all of its strings hold."""
        return self.length - self.window + 1


# --- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < gram:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def sliding_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, from running minima of blocks both ways."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(text: bytes, cfg: SuffixConfig) -> np.ndarray:
    """Rows ``anchor, first start, last start`` in order; each start of ``length`` bytes lies in one row."""
    found, total = [], len(text) - cfg.length + 1
    data = np.frombuffer(text, np.uint8)
    for low in range(0, max(total, 0), cfg.piece_bytes):
        high = min(low + cfg.piece_bytes, total)
        hashes = gram_hashes(data[low : high + cfg.window + cfg.gram - 2], cfg.gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_minima((hashes & ~np.uint64(0xFFFFFF)) | places, cfg.window) & np.uint64(0xFFFFFF)
        cuts = np.flatnonzero(np.diff(least)) + 1
        firsts = np.concatenate(([0], cuts))
        lasts = np.concatenate((cuts - 1, [len(least) - 1]))
        piece = np.stack([least[firsts].astype(np.int64), firsts, lasts], 1) + low
        if found and found[-1][-1, 0] == piece[0, 0]:  # an anchor of starts on both sides
            piece[0, 1] = found[-1][-1, 1]
            found[-1] = found[-1][:-1]
        found.append(piece)
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def string_at(text: bytes, anchor: int, first: int, last: int, length: int) -> bytes:
    """What the strings of an anchor hold: bytes from it on, padded to ``length``, then those before it in reverse."""
    return text[anchor : last + length].ljust(length, PAD) + text[first:anchor][::-1]


def place_hash(file: int, row: int, anchor: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d:%d:%d" % (file, row, anchor))


def find_anchors(docs: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """``file, row, anchor, first, last, mark, sample``: anchors, the hash of their shared bytes, and a string of some."""

    names = ["file", "row", "anchor", "first", "last", "mark", "sample"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, marks, drawn = [], [], []
                for file, row, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    rows = anchors_of(text, cfg)
                    found.append(np.concatenate([np.full((len(rows), 2), (file, row), np.int64), rows], 1))
                    for anchor, first, last in rows.tolist():
                        marks.append(xxhash.xxh3_64_intdigest(text[anchor : anchor + cfg.shared]))
                        drawn.append(string_at(text, anchor, first, last, cfg.length) if place_hash(file, row, anchor) % cfg.sample_rate == 0 else None)
                table = np.concatenate(found)
                arrays = [*(pa.array(np.ascontiguousarray(table[:, c])) for c in range(5)), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(drawn, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, "file long, row long, anchor long, first long, last long, mark long, sample binary")


# --- front-coded pieces


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes], places: np.ndarray) -> bytes:
    """A sorted piece: common prefixes, lengths of the rests, places, and the rests, compressed."""
    prefixes = np.fromiter((common(x, y) for x, y in zip([b"", *strings[:-1]], strings, strict=True)), np.int32, len(strings))
    rests = [s[p:] for s, p in zip(strings, prefixes.tolist(), strict=True)]
    sizes = np.fromiter(map(len, rests), np.int32, len(rests))
    parts = [np.int64(len(strings)).tobytes(), prefixes.tobytes(), sizes.tobytes(), np.ascontiguousarray(places, np.int64).tobytes(), *rests]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def front_decode(piece: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """Common prefix with the string before, string, place, in order."""
    raw = zstandard.ZstdDecompressor().decompress(piece)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    prefixes = np.frombuffer(raw, np.int32, n, 8).tolist()
    sizes = np.frombuffer(raw, np.int32, n, 8 + 4 * n).tolist()
    places = np.frombuffer(raw, np.int64, 5 * n, 8 + 8 * n).reshape(n, 5).tolist()
    at, string = 8 + 48 * n, b""
    for prefix, size, place in zip(prefixes, sizes, places, strict=True):
        string = string[:prefix] + raw[at : at + size]
        at += size
        yield prefix, string, place


class LoserTree:
    """Merges sorted pieces. Each contestant is ``[common prefix with the last string put out, string, place, piece]``."""

    def __init__(self, pieces: list[Iterator]) -> None:
        self.pieces, self.size = pieces, max(len(pieces), 1)
        self.losers: list = [None] * self.size
        self.winner = self._build(1)

    def _next(self, k: int) -> list | None:
        entry = next(self.pieces[k], None) if k < len(self.pieces) else None
        return None if entry is None else [*entry, k]

    def _build(self, node: int) -> list | None:
        if node >= self.size:
            return self._next(node - self.size)
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    @staticmethod
    def _play(x: list | None, y: list | None) -> tuple:
        """Winner and loser; the loser then knows its common prefix with the winner."""
        if x is None or y is None:
            return (y, x) if x is None else (x, y)
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        known = x[0]
        shared = known + common(x[1][known:], y[1][known:])
        first, second = (x, y) if x[1][shared:] <= y[1][shared:] else (y, x)
        second[0] = shared
        return first, second

    def __iter__(self) -> Iterator[list]:
        while self.winner is not None:
            yield self.winner
            k = self.winner[3]
            contestant, node = self._next(k), (k + self.size) // 2
            while node:
                contestant, self.losers[node] = self._play(contestant, self.losers[node])
                node //= 2
            self.winner = contestant


def cut_runs(docs: DataFrame, splitters: list[tuple[bytes, int]], cfg: SuffixConfig) -> DataFrame:
    """``part, piece`` of ``file, row, text, anchors``: sorted runs, cut at the splitters and front-coded."""

    def flush(strings: list[tuple], places: list[tuple]):
        strings.sort()
        order = np.array([s[2] for s in strings], np.int64)
        cuts = [0, *(bisect_left(strings, s) for s in splitters), len(strings)]
        where = np.array(places, np.int64)[order]
        for part in range(len(cuts) - 1):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([front_code([s[0] for s in strings[a:b]], where[a:b])], pa.binary())], names=["part", "piece"])

    def run(batches):
        strings, places, held = [], [], 0
        for batch in batches:
            for file, row, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                file, row, text = file.as_py(), row.as_py(), text.as_py()
                for a in found.as_py():
                    anchor, first, last = a["anchor"], a["first"], a["last"]
                    string = string_at(text, anchor, first, last, cfg.length)
                    strings.append((string, place_hash(file, row, anchor), len(places)))
                    places.append((file, row, anchor, anchor - last, anchor - first))
                    held += len(string)
                    if held >= cfg.run_bytes:
                        yield from flush(strings, places)
                        strings, places, held = [], [], 0
        if strings:
            yield from flush(strings, places)

    return docs.mapInArrow(run, "part int, piece binary")


# --- matches from the merged order


def judge_part(merged: Iterator[list], clean: tuple[bool, bool], cfg: SuffixConfig) -> tuple[np.ndarray, Iterator[tuple]]:
    """From one part's merged order: rows ``file, row, low, high`` of starts proven repeated, and rows ``h1, h2, file,
    row, start, asked`` of strings to look up. ``clean`` says for both ends that no suffix beyond shares the bytes that
    matter; otherwise one beyond may share anything."""
    length, strings, places, prefixes, backs = cfg.length, [], [], [], []
    for prefix, string, place, _ in merged:
        if not strings or prefix < cfg.shared:
            back = 0
        else:
            back = prefix - length if prefix >= length else common(strings[-1][length:], string[length:])
        strings.append(string), places.append(place), prefixes.append(prefix), backs.append(back)
    n, prefix, back = len(strings), np.array(prefixes, np.int64), np.array(backs, np.int64)
    where = np.array(places, np.int64).reshape(n, 5)
    near, far = where[:, 3], where[:, 4]  # least and greatest distance of a start
    ahead = np.minimum(prefix, length)
    outer = [0 if c else length for c in clean]
    left, right = np.append(outer[0], ahead[1:]), np.append(ahead[1:], outer[1])  # common prefix with either neighbour

    proofs, k = [], np.arange(1, n)
    for own, other in ((k, k - 1), (k - 1, k)):
        agreed = np.minimum(ahead[k], length - np.maximum(near[own], near[other]))
        low, high = np.maximum(near[own], length - agreed), np.minimum(far[own], back[k])
        proofs.append(np.stack([own, low, high], 1)[low <= high])
    proof = np.concatenate(proofs)
    proof = proof[np.lexsort((proof[:, 1], proof[:, 0]))]
    owner, low, high = proof.T
    proven = np.stack([where[owner, 0], where[owner, 1], where[owner, 2] - high, where[owner, 2] - low], 1)
    sure_low, sure_high = np.zeros(n, np.int64), np.full(n, -1)  # of the ranges proven by both neighbours: joined, or the wider
    for i, a, b in proof.tolist():
        if sure_high[i] < 0:
            sure_low[i], sure_high[i] = a, b
        elif a <= sure_high[i] + 1:
            sure_high[i] = max(sure_high[i], b)
        elif b - a > sure_high[i] - sure_low[i]:
            sure_low[i], sure_high[i] = a, b

    # the most that any suffix shares that is neither a neighbour nor of the same kind (equal in all bytes ahead)
    begins = np.flatnonzero(np.append(True, ahead[1:] < length))
    ends = np.append(begins[1:], n) - 1
    kind = np.repeat(np.arange(len(begins)), ends - begins + 1)
    second_left = np.minimum(left, np.append(outer[0], left[:-1]))
    second_right = np.minimum(right, np.append(right[1:], outer[1]))
    beyond = np.where((begins == ends)[kind], np.maximum(second_left, second_right), np.maximum(left[begins[kind]], right[ends[kind]]))
    floor = np.maximum(near, length - beyond)  # least distance to look up
    asks = (floor <= far) & ((sure_low > floor) | (sure_high < far))
    group = np.cumsum(np.append(False, ahead[1:] < cfg.shared))
    wanted = np.isin(group, np.append(group[asks], [g for g, c in zip((group[0], group[-1]), clean, strict=True) if not c]))
    copy = np.append(False, (prefix[1:] == np.fromiter(map(len, strings[1:]), np.int64, n - 1)) & (near[1:] == near[:-1]) & (far[1:] == far[:-1]))
    least = np.maximum(near, length - np.maximum(left, right))

    def lookup():
        for i in np.flatnonzero(wanted & (asks | ~copy)).tolist():  # one of equal strings stands for all
            file, row, anchor, d0, d1 = places[i]
            body = strings[i][length:][::-1] + strings[i][: length - d0]
            for d in range(int(least[i]), d1 + 1):
                digest = xxhash.xxh3_128_digest(body[d1 - d : d1 - d + length])
                asked = bool(asks[i] and d >= floor[i] and not sure_low[i] <= d <= sure_high[i])
                yield int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), file, row, anchor - d, asked

    return proven, lookup()


def judge_parts(batches, clean: list[bool], cfg: SuffixConfig):
    """Pieces in order of their parts to rows ``h1, h2, file, row, low, high, asked``; the hashes are null in proven ranges."""
    part, pieces = None, []
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != part and pieces:
                yield from _judged(pieces, (clean[part], clean[part + 1]), cfg)
                pieces = []
            part = key
            pieces.append(piece)
    if pieces:
        yield from _judged(pieces, (clean[part], clean[part + 1]), cfg)


def _judged(pieces: list[bytes], clean: tuple[bool, bool], cfg: SuffixConfig):
    proven, lookup = judge_part(iter(LoserTree([front_decode(p) for p in pieces])), clean, cfg)
    names = ["h1", "h2", "file", "row", "low", "high", "asked"]
    if len(proven):
        none = pa.nulls(len(proven), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(proven[:, c])) for c in range(4)), pa.nulls(len(proven), pa.bool_())], names=names)
    while rows := list(islice(lookup, 20_000)):
        h1, h2, file, row, start, asked = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h1, h2, file, row, start, start)] + [pa.array(asked, pa.bool_())], names=names)


def choose_splitters(sample: list[tuple[bytes, int]], parts: int, cfg: SuffixConfig) -> tuple[list[tuple[bytes, int]], list[bool]]:
    """At most ``parts - 1`` splitters, and for each edge between parts, ends included, whether it is clean: whether the
    suffixes on its two sides differ in the bytes that any match shares. A cut moves to the first suffix with the bytes of
    its sample, unless a cut is there already: then the group is large, and is cut inside."""
    splitters: list[tuple[bytes, int]] = []
    clean = [True]
    for string, tie in sample[:: max(1, -(-len(sample) // parts))][1:]:
        head = (string[: cfg.shared], -1)
        fresh = not splitters or splitters[-1][0][: cfg.shared] != head[0]
        splitters.append(head if fresh else (string, tie))
        clean.append(fresh)
    return splitters, [*clean, True]


# --- the operator


def addressed(docs: DataFrame) -> DataFrame:
    """``file, row, doc_id, text``: rows of files by file and place in it; any other table is written once first."""
    columns = ["doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*place, *columns)
    except AnalysisException:  # not a scan of files
        return materialize(docs.select(*columns), "texts").select(*place, "doc_id", "text")


def repeated_starts(texts: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """``file, row, low, high``: ranges of places in texts from which ``length`` bytes start that also start elsewhere."""
    spark = texts.sparkSession
    anchors = materialize(find_anchors(texts.select("file", "row", "text"), cfg), "anchors")
    # written, so that the join reads two shuffles and Spark can split a mark that very many anchors have
    shared = materialize(anchors.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "marks")
    left = materialize(anchors.join(shared, "mark").select("file", "row", "anchor", "first", "last", "sample"), "suffixes")
    total = left.count()
    drawn = left.where("sample IS NOT NULL").orderBy(F.xxhash64("file", "row", "anchor")).limit(cfg.max_samples).select("file", "row", "anchor", "sample").collect()
    sample = sorted((bytes(r.sample), place_hash(r.file, r.row, r.anchor)) for r in drawn)
    splitters, clean = choose_splitters(sample, max(spark.sparkContext.defaultParallelism, -(-total // cfg.strings_per_part)), cfg)
    by_row = left.groupBy("file", "row").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("anchors"))
    pieces = cut_runs(texts.select("file", "row", "text").join(by_row, ["file", "row"]).select("file", "row", "text", "anchors"), splitters, cfg)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(splitters) + 1)
    dealt = pieces.repartition(width, "part").sortWithinPartitions("part")
    judged = materialize(dealt.mapInArrow(lambda b: judge_parts(b, clean, cfg), "h1 long, h2 long, file long, row long, low long, high long, asked boolean"), "matches")
    strings = judged.where("h1 IS NOT NULL")
    again = strings.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bool_or("asked").alias("wanted")).where("n > 1 AND wanted").select("h1", "h2")
    again = materialize(again, "strings")
    looked_up = strings.where("asked").join(again, ["h1", "h2"]).select("file", "row", "low", "high")
    return judged.where("h1 IS NULL").select("file", "row", "low", "high").unionByName(looked_up)


def cut_out(text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """The text without the strings that start in the ranges, and the number of stretches removed."""
    kept, spans, end = [], 0, 0
    for low, high in sorted(ranges):
        if low > end or not spans:
            kept.append(text[end:low])
            spans += 1
        end = max(end, high + length)
    kept.append(text[end:])
    return b"".join(kept), spans


def remove_repeats(docs: DataFrame, cfg: SuffixConfig = SuffixConfig()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row."""
    if cfg.window + cfg.gram > cfg.length + 1:
        raise ValueError("window and gram do not fit into length")
    texts = addressed(docs)
    ranges = repeated_starts(texts, cfg).groupBy("file", "row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n_removed, n_spans, digests = [], [], []
                for text, found in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    kept, spans = cut_out(text, [(r["low"], r["high"]) for r in found.as_py()], cfg.length)
                    n_removed.append(len(text) - len(kept)), n_spans.append(spans), digests.append(hashlib.sha256(kept).hexdigest())
                arrays = [part.column(0), part.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "row", "n_removed", "n_spans", "kept_sha256"])

    cut = texts.select("file", "row", "text").join(ranges, ["file", "row"]).select("file", "row", "text", "ranges").mapInArrow(run, "file long, row long, n_removed long, n_spans long, kept_sha256 string")
    whole = texts.select("file", "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(materialize(cut, "cut"), ["file", "row"], "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
