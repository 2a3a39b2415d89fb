"""Byte-level BPE encoding and decoding: two-tier lookup.

Tier one: a minimal perfect hash (hash, displace, compress) over the vocabulary's byte strings resolves each
pre-token that is a vocabulary entry as a whole; the stored entry is compared, so other strings never pass. Tier two:
the rest are merged on bytes linked in a list, with a heap of adjacent pairs by rank, then position.

A memo of at most ``memo_entries`` pre-tokens per worker spares repeated lookups; it is emptied when full.

Defined results: null and empty texts have no tokens and decode to nothing; malformed UTF-8 is encoded as U+FFFD; very
long texts are encoded whole, and a pre-token of n bytes costs n log n; of pairs of equal rank the leftmost is merged
first; repeated rows get equal results; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .support import decode, per_text

MASK = (1 << 64) - 1


@dataclass(frozen=True)
class BpeConfig:
    memo_entries: int = 500_000
    #: Longer pre-tokens are not kept in the memo.
    memo_bytes: int = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings to 0 .. n-1: keys fall into groups by one part of their hash, and each
    group, the largest first, gets the first displacement that puts all its keys on free slots; a lone key names its slot."""

    def __init__(self, keys: list[bytes], per_group: int = 2):
        self.size = max(1, len(keys))
        self.groups = max(1, len(keys) // per_group)
        hashes = [xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(keys):
            raise ValueError("keys repeat")
        members: list[list[int]] = [[] for _ in range(self.groups)]
        for i, h in enumerate(hashes):
            members[h % self.groups].append(i)
        self.shift = np.zeros(self.groups, np.int64)
        self.slot_of_key = np.full(len(keys), -1, np.int64)
        taken = bytearray(self.size)
        order = sorted(range(self.groups), key=lambda g: -len(members[g]))
        for g in (g for g in order if len(members[g]) > 1):
            pairs = [self._parts(hashes[i]) for i in members[g]]
            d = 0
            while True:
                slots = [self._slot(a, b, d) for a, b in pairs]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[g] = d
            for i, s in zip(members[g], slots, strict=True):
                taken[s] = 1
                self.slot_of_key[i] = s
        free = (s for s in range(self.size) if not taken[s])
        for g in (g for g in order if len(members[g]) == 1):  # a lone key simply names its slot
            s = next(free)
            self.shift[g] = -1 - s
            self.slot_of_key[members[g][0]] = s

    @staticmethod
    def _parts(h: int) -> tuple[int, int]:
        return h >> 32, (h * 0x9E3779B97F4A7C15 & MASK) >> 32

    def _slot(self, a: int, b: int, d: int) -> int:
        return (a + d * b + d * d) % self.size if d >= 0 else -1 - d

    def __call__(self, key: bytes) -> int:
        h = xxh64_intdigest(key)
        return self._slot(*self._parts(h), int(self.shift[h % self.groups]))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cfg: BpeConfig = BpeConfig()):
        self.cfg, self.pattern = cfg, pattern
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.entry: list[bytes | None] = [None] * self.hash.size
        self.rank = [0] * self.hash.size
        self.token: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, slot in zip(tokens, self.hash.slot_of_key.tolist(), strict=True):
            self.entry[slot], self.rank[slot] = token, ranks[token]
            self.token[ranks[token]] = token
        self.hash.shift = self.hash.shift.tolist()
        self.pair_rank = ranks.get  # of a joined pair, by its bytes
        self.memo: dict[str, bytes] = {}

    def lookup(self, piece: bytes) -> int | None:
        """Tier one: the rank of a whole vocabulary entry."""
        slot = self.hash(piece)
        return self.rank[slot] if self.entry[slot] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: always join the pair of least rank, the leftmost first, until no pair is in the vocabulary."""
        n, find = len(piece), self.pair_rank
        part = [find(piece[i : i + 1], -1) for i in range(n)]  # id of the part that starts here
        if -1 in part:
            raise ValueError("the vocabulary lacks a single byte")
        pair = [find(piece[i : i + 2], -1) for i in range(n - 1)]  # of the part that starts here and the next; -1: none
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if pair[i] != entry >> 32:
                continue  # one of the two parts has changed since
            middle = after[i]
            end = after[middle]
            part[i], pair[middle], after[i] = entry >> 32, -1, end
            if end < n:
                before[end] = i
                pair[i] = r = find(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            if i:
                p = before[i]
                pair[p] = r = find(piece[p:end], -1)
                if r >= 0:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.lookup(piece)
        return [whole] if whole is not None else self.merge(piece)

    def encoder(self):
        """A function from a text to its ids as little-endian unsigned 32-bit integers. The memo is the model's, so
        tasks that follow each other in a worker share it."""
        find = regex.compile(self.pattern).findall
        memo = self.memo
        get, limit, longest = memo.get, self.cfg.memo_entries, self.cfg.memo_bytes

        def encode(text: str) -> bytes:
            pieces = find(text)
            coded = list(map(get, pieces))
            if None in coded:
                for i, ids in enumerate(coded):
                    if ids is None:
                        p = pieces[i]
                        ids = get(p)
                        if ids is None:
                            ids = pack("<%dI" % len(ids := self.encode_piece(p.encode("utf-8", "replace"))), *ids)
                            if len(p) <= longest:
                                if len(memo) >= limit:
                                    memo.clear()
                                memo[p] = ids
                        coded[i] = ids
            return b"".join(coded)

        return encode

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, cfg: BpeConfig = BpeConfig(), with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    The tables sent to the tasks have the size of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(ranks, pattern, cfg))
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("ids", T.BinaryType()))

    def make():
        model = shared.value
        encode = model.encoder()

        def work(texts: list[bytes]) -> list[list]:
            coded = [encode(decode(t)) for t in texts]
            columns = [[len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(model.decode(c)).hexdigest() for c in coded]]
            return [*columns, coded] if with_ids else columns

        return work

    return per_text(docs, "doc_id", "text", fields, make, scan=True)


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from a column of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ByteBpe(ranks, pattern))
    return per_text(encoded, key, ids, [("text", T.StringType())], lambda: lambda rows: [[decode(shared.value.decode(r)) for r in rows]])
