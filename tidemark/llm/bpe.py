"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of pre-tokens form doubly linked lists. Each adjacent pair that is a token waits in a bucket of its merge rank;
a bucket holds list positions. Which buckets have entries is kept in bitmaps of three levels, 64 ranks to a word at the
lowest, so find-first-set on three words gives the lowest waiting rank. A bucket is sorted when its turn comes, its
positions are taken leftmost first, and an entry whose pair has changed since is stale and skipped. Work is n log n in the length of a pre-token, which
suits very long ones; many pre-tokens share one queue, as lists that end at each other's edges, which spreads the cost
of finding the next rank over all of them.

Texts are cut by a pattern and each match is encoded by itself. Pre-tokens are remembered (CACHED_PIECES of them). A null
text is an empty one and has no ids. Rows are independent: repeated rows, null ids and further columns pass through, and
an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 900_000
LONG_PIECE = 512
#: Characters of texts, and matches of a longer text, that are encoded together; bytes of pre-tokens that share a queue.
GROUP_CHARACTERS = 2 << 20
GROUP_MATCHES = 400_000
QUEUE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20


_BIT = [1 << i for i in range(64)]


class RankQueue:
    """Buckets of list positions by rank, with bitmaps of three levels over the buckets that have entries."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
        else:
            self.open(rank, [position])

    def open(self, rank: int, bucket: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        a = rank >> 6
        word = self.low.get(a, 0)
        self.low[a] = word | _BIT[rank & 63]
        if not word:
            b = a >> 6
            word = self.mid.get(b, 0)
            self.mid[b] = word | _BIT[a & 63]
            if not word:
                self.top |= 1 << b

    def first(self) -> int:
        """The lowest rank that waits; -1 if none does."""
        top = self.top
        if not top:
            return -1
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = b << 6 | (mid & -mid).bit_length() - 1
        low = self.low[a]
        return a << 6 | (low & -low).bit_length() - 1

    def close(self, rank: int) -> None:
        """Take out the bucket of a rank."""
        del self.buckets[rank]
        a = rank >> 6
        self.low[a] ^= _BIT[rank & 63]
        if not self.low[a]:
            b = a >> 6
            self.mid[b] ^= _BIT[a & 63]
            if not self.mid[b]:
                self.top ^= 1 << b


class Merger:
    """Encodes pre-tokens by merging."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.queue = ranks, RankQueue()
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pair = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as 32-bit numbers: of its pairs the lowest-ranked is merged, leftmost first, until
        no pair is a token; one that is a token as a whole is that token."""
        out: list[bytes] = [b""] * len(pieces)
        todo, size = [], 0
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = struct.pack("=i", whole)
                continue
            todo.append(i)
            size += len(piece)
            if size >= QUEUE_BYTES:
                self._merge(pieces, todo, out)
                todo, size = [], 0
        if todo:
            self._merge(pieces, todo, out)
        return out

    def _merge(self, pieces: list[bytes], which: list[int], out: list[bytes]) -> None:
        raw = b"".join([pieces[i] for i in which])
        n, rank_of, queue = len(raw), self.ranks.get, self.queue
        starts = np.concatenate(([0], np.cumsum([len(pieces[i]) for i in which])))
        data = np.frombuffer(raw, np.uint8).astype(np.int32)
        paired = np.full(n, -1, np.int32)
        paired[:-1] = self.pair[data[:-1] << 8 | data[1:]]
        paired[starts[1:] - 1] = -1  # no pair reaches over an edge
        edges = np.zeros(n + 1, np.uint8)
        edges[starts] = 1
        edge = edges.tobytes()
        link = np.arange(-1, n)
        link[starts] = -1
        before = link.tolist()  # -1 at the first place of a pre-token
        end = list(range(1, n + 1))  # the token at position i is raw[i : end[i]]
        token = self.single[data].tolist()
        waiting = paired.tolist()  # rank of the pair that starts at a position, as last pushed; -1 if none does
        live = bytearray(b"\1") * n
        at = np.flatnonzero(paired >= 0)
        at = at[np.argsort(paired[at], kind="stable")]
        names, first = np.unique(paired[at], return_index=True)
        for rank, some in zip(names.tolist(), np.split(at, first[1:]) if len(names) else []):
            queue.open(rank, some.tolist())
        buckets, push = queue.buckets, queue.push
        while (rank := queue.first()) >= 0:
            bucket, at, lower = buckets[rank], 0, False
            bucket.sort()
            while at < len(bucket) and not lower:
                i = bucket[at]
                at += 1
                if waiting[i] != rank:  # stale
                    continue
                j = end[i]
                waiting[j] = -1
                live[j] = 0
                token[i] = rank
                end[i] = k = end[j]
                new = None
                if not edge[k]:
                    before[k] = i
                    new = rank_of(raw[i : end[k]])
                if new is None:
                    waiting[i] = -1
                else:
                    waiting[i] = new
                    if new == rank:
                        insort(bucket, i, at)
                    else:
                        push(new, i)
                        lower = new < rank
                h = before[i]
                if h >= 0:
                    new = rank_of(raw[h:k])
                    if new is None:
                        waiting[h] = -1
                    else:
                        waiting[h] = new
                        if new == rank:
                            insort(bucket, h, at)
                        else:
                            push(new, h)
                            lower = lower or new < rank
            if at < len(bucket):
                buckets[rank] = bucket[at:]
            else:
                queue.close(rank)
        kept = np.frombuffer(live, np.uint8).astype(bool)
        ids = np.array(token, np.int32)[kept].tobytes()
        cut = np.concatenate(([0], np.cumsum(kept)))[starts] * 4
        for i, low, high in zip(which, cut[:-1].tolist(), cut[1:].tolist()):
            out[i] = ids[low:high]


def merge(piece: bytes, merger: Merger) -> list[int]:
    """The ids of one pre-token."""
    return np.frombuffer(merger([piece])[0], np.int32).tolist()


def forget_half(memory: dict) -> None:
    """Drop the older half of a memory; what is frequent soon comes back."""
    for key in list(islice(memory, len(memory) // 2)):
        del memory[key]


class Encoder:
    """Texts -> their ids as 32-bit numbers in the machine's byte order."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.merger = Merger(self.ranks)

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens; those that aren't known are merged together first."""
        known = self.pieces
        new = [p for p in set().union(*cut) if p not in known]
        known.update(zip(new, self.merger([p.encode() for p in new])))
        out = [b"".join(map(known.__getitem__, some)) for some in cut]
        for p in new:
            if len(p) > LONG_PIECE:
                del known[p]
        if len(known) > CACHED_PIECES:
            forget_half(known)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        short = [i for i, text in enumerate(texts) if len(text) <= GROUP_CHARACTERS]
        made = dict(zip(short, self._ids([self.pattern.findall(texts[i]) for i in short])))
        return [made[i] if i in made else self._long(text) for i, text in enumerate(texts)]

    def _long(self, text: str) -> bytes:
        matches, out = (m[0] for m in self.pattern.finditer(text)), []
        while some := list(islice(matches, GROUP_MATCHES)):
            out += self._ids([some])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _groups(column: pa.Array) -> Iterator[int]:
    """Where groups of rows end that hold about GROUP_CHARACTERS together."""
    size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate(([0], np.cumsum(size))), 0
    while at < len(size):
        at = max(at + 1, int(np.searchsorted(total, total[at] + GROUP_CHARACTERS, "right")) - 1)
        yield at


def _limited(ids: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose ids take about BATCH_BYTES."""
    begin = size = 0
    for i, x in enumerate(ids):
        size += len(x)
        if size >= BATCH_BYTES or i + 1 == len(ids):
            yield begin, i + 1
            begin, size = i + 1, 0


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of its text in place of the text; other columns stay."""
    at = df.columns.index(text_col)
    rest = [f for i, f in enumerate(df.schema.fields) if i != at and f.name != ids_col]
    names = [f.name for f in rest]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern).encode_all
        for batch in batches:
            others, column, begin = batch.select(names), batch.column(text_col), 0
            for stop in _groups(column):
                ids = own([t or "" for t in column[begin:stop].to_pylist()])
                for low, high in _limited(ids):
                    edges = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids[low:high]]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids[low:high]), np.int32)))
                    yield pa.RecordBatch.from_arrays([*others.slice(begin + low, high - low).columns, lists], [*names, ids_col])
                begin = stop

    schema = df.select(*[f"`{n}`" for n in names], F.lit(None).cast("array<int>").alias(ids_col)).schema
    return df.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern).decode
        for batch in batches:
            column, step = batch.column(ids_col), 256
            flat, edge = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            there = np.asarray(column.is_valid())
            for i in range(0, batch.num_rows, step):
                rows = range(i, min(i + step, batch.num_rows))
                made = [own(flat[edge[k] : edge[k + 1]].tolist()) if there[k] else None for k in rows]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, step).columns, pa.array(made, pa.binary())], [*batch.schema.names, bytes_col])

    schema = df.drop(bytes_col).withColumn(bytes_col, F.lit(None).cast("binary")).schema
    return df.drop(bytes_col).mapInArrow(run, schema)
