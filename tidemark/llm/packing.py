"""Packing of documents into fixed windows through a hierarchy of context sizes.

Tokenising and packing happen in one pass over each partition, without a shuffle. A document of n ids is routed: its
whole multiples of the longest tier become full windows of their own; the rest goes to the smallest tier that holds it.
Each tier packs its pieces by best fit, longest first, into windows of its size. Gaps of long windows are then filled
from shorter tiers, cutting a piece where it doesn't fit. What a group of documents leaves over is laid end to end and
cut at powers of two, so a sequence is either padded to the longest tier, or of a power-of-two length and not padded.
Full windows and the shorter sequences are dealt to steps so that all steps carry nearly equal numbers of tokens.

Documents are packed in groups of about GROUP_TOKENS ids, which bounds memory at any partition size; a single longer
document is a group of its own. A null text is an empty one and, like it, gives one piece with the end id alone. A null
document id passes through. Repeated rows are packed as rows of their own. Columns that the input has besides the id and
the text are left out.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
END_ID = 1
CACHED_WORDS = 200_000
PIECES = "doc_id long, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: Parts of these characters are normalised by lower-casing alone; none of them is white space, a mark, or composes.
_PLAIN = re.compile("[!-~¡-¬®-įı-ſ]*").fullmatch
#: The tokenizer's cut, as its file gives it for all of Unicode, for lower-cased text of those characters.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼-¾]+").findall


def byte_names() -> dict[int, str]:
    """The characters by which byte-level tokenizers name bytes: printable ones themselves, others from 256 on."""
    named = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in named} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in named)}


class WordEncoder(dict):
    """Part of a text between ASCII white space -> its ids as little-endian 32-bit bytes, remembered.

    The tokenizer lower-cases, drops white space and never merges across it, so encoding part by part gives the ids of
    the whole. A text that holds one of the tokenizer's special strings goes through the tokenizer itself, which gives
    that string's id. CACHED_WORDS parts at most are remembered; when half of that is new, those not used since the
    last time are forgotten.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.ordinary = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ordinary.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.normal, self.cut, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.named, self.older = byte_names(), {}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        made = self.older.get(part)
        if made is None:
            text = part.decode()
            if len(part) > 4096:  # leave long strings to the tokenizer, and forget them
                return np.array(self.ordinary.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if _PLAIN(text):
                pieces = [text.lower()] if text.isalpha() else _CUT(text.lower())
                if not text.isascii():
                    pieces = [p.encode().decode("latin-1").translate(self.named) for p in pieces]
            else:
                pieces = [p for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text))]
            made = b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])
        self[part] = made
        return made

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= CACHED_WORDS:
            self.pieces.clear()
        made = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
        return made

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Window:
    """A window under construction: pieces (document, start, length), and the room left."""

    __slots__ = ("pieces", "room")

    def __init__(self, room: int) -> None:
        self.pieces, self.room = [], room

    def put(self, piece: tuple[int, int, int]) -> None:
        self.pieces.append(piece)
        self.room -= piece[2]


def best_fit(pieces: list[tuple[int, int, int]], size: int) -> list[Window]:
    """Pieces of at most `size` ids in windows of `size`: longest first, each where the least room is left after it."""
    rooms: list[tuple[int, int]] = []  # (room, window), ascending
    windows: list[Window] = []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        at = bisect.bisect_left(rooms, (piece[2], -1))
        if at == len(rooms):
            windows.append(Window(size))
            which = len(windows) - 1
        else:
            which = rooms.pop(at)[1]
        windows[which].put(piece)
        if windows[which].room:
            bisect.insort(rooms, (windows[which].room, which))
    return windows


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id of the documents exactly once.

    Every sequence but those of a power-of-two length is as long as the last tier.
    """
    top = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        whole = n - n % top
        sequences += [[(doc, start, top)] for start in range(0, whole, top)]
        if n > whole:
            routed[next(t for t in tiers if n - whole <= t)].append((doc, whole, n - whole))
    built = {t: best_fit(routed[t], t) for t in tiers}
    spare = [w for t in tiers[:-1] for w in built[t] if w.room]  # shorter tiers' windows with a gap give their pieces
    sequences += [w.pieces for t in tiers[:-1] for w in built[t] if not w.room]
    donors = [p for w in sorted(spare, key=lambda w: -sum(p[2] for p in w.pieces)) for p in w.pieces]
    left: list[tuple[int, int, int]] = []
    for window in built[top]:
        while window.room and donors:
            doc, start, n = donors.pop()
            take = min(n, window.room)
            window.put((doc, start, take))
            if take < n:
                donors.append((doc, start + take, n - take))
        if window.room:
            left += window.pieces
        else:
            sequences.append(window.pieces)
    left += donors
    total = sum(p[2] for p in left)
    sizes = [top] * (total // top) + [1 << b for b in range(top.bit_length() - 1, -1, -1) if (total % top) >> b & 1]
    left.reverse()
    for size in sizes:
        window = Window(size)
        while window.room:
            doc, start, n = left.pop()
            take = min(n, window.room)
            window.put((doc, start, take))
            if take < n:
                left.append((doc, start + take, n - take))
        sequences.append(window.pieces)
    return sequences


def deal_steps(sizes: list[int], step_tokens: int) -> list[int]:
    """The step of each sequence: longest first, each to the step that has least so far."""
    import heapq

    steps = [(0, i) for i in range(max(1, round(sum(sizes) / step_tokens)))]
    chosen = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, step = steps[0]
        chosen[i] = step
        heapq.heapreplace(steps, (load + sizes[i], step))
    return chosen


def pack_documents(
    df: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit numbers in ids_le.

    sequence_id and step_group hold the partition in their upper bits; they are unique in the result.
    """
    top = tiers[-1]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId() << 33
        end, made, steps = np.array([END_ID], "<u4").tobytes(), 0, 0
        names, ids, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, steps, size
            lengths = [len(x) // 4 for x in ids]
            sequences = pack(lengths, tiers)
            totals = [sum(p[2] for p in s) for s in sequences]
            step = deal_steps(totals, step_tokens)
            columns: list[list] = [[] for _ in schema]
            for s, pieces in enumerate(sequences):
                offset = 0
                tier = next((t for t in tiers if totals[s] <= t), top)
                for doc, start, n in pieces:
                    row = (names[doc], start, n, ids[doc][4 * start : 4 * (start + n)], lengths[doc], part + made + s, offset, tier, part + steps + step[s])
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += n
            for i in range(0, len(columns[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 8192], f.type) for c, f in zip(columns, schema)], schema=schema)
            made, steps, size = made + len(sequences), steps + max(step, default=0) + 1, 0
            names.clear()
            ids.clear()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(encode(text.as_py() or "") + end)
                size += len(ids[-1]) // 4
                if size >= GROUP_TOKENS:
                    yield from out()
        if names:
            yield from out()

    kinds: dict[str, Callable] = {"long": pa.int64, "binary": pa.binary, "int": pa.int32}
    schema = pa.schema([(n, kinds[t]()) for n, t in (part.split() for part in PIECES.split(", "))])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packed, PIECES)
