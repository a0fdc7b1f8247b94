"""Removal of byte strings that an earlier document has, by suffix arrays built with two-stage sorting.

A byte goes if it is covered by a string of `width` bytes that also starts in a document of smaller id; strings are
judged on the input and never cross documents. Only stretches whose anchor another text has are looked at: a chunk sends
each distinct run of windows with a shared anchor, as bytes, with its smallest document. Equal windows have equal
anchors, so all stretches that hold a window meet in one bucket, and there a suffix array over the distinct stretches
puts equal windows side by side:

* stage 1 sorts directly only the suffixes that are smaller than their successors,
* stage 2 induces the others by scanning the buckets of first bytes in order: a suffix larger than its successor is
  placed when its successor is met,
* then the common prefixes of neighbours are computed; a run of neighbours sharing `width` bytes is one window.

Suffixes are compared up to the end of their stretch and up to `width` bytes, which is all that windows need; the array is
exact, whatever the hashes are. The smallest document of each window goes back to the chunks as one bit.

A null text is empty. A document without an id neither loses bytes nor takes any; rows with equal ids take nothing from
each other. Columns besides the id and the text come back in `rest`. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import _shared_windows as sw
from tidemark.llm._words import BASE, BYTE_CODE, INVERSE, mix, powers, rolling, slices, texts

WIDTH = 50
GRAM = 16
#: Parts of a bucket, by anchor, that a reducer sorts one after another; bounds its memory.
PARTS = 32


def words_of(s: np.ndarray) -> np.ndarray:
    """Seven values from each place on as one number, in order; nothing counts behind the first 0."""
    n = len(s)
    padded = np.zeros(n + 6, np.uint64)
    padded[:n] = s
    word, live = padded[:n] << np.uint64(54), padded[:n] > 0
    for k in range(1, 7):
        value = padded[k : n + k]
        word += np.where(live, value, np.uint64(0)) << np.uint64(9 * (6 - k))
        live &= value > 0
    return word


def suffix_array(s: np.ndarray, depth: int, word: np.ndarray | None = None, first: np.ndarray | None = None, count: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of s, in order of their first `depth` values; s holds 0 .. 256, and a 0 ends every stretch.

    With `first` and `count`, those that start at first .. first + count - 1, and the few behind them that place them: the
    suffixes up to the next one that is smaller than its successor.

    Two-stage sorting: suffixes smaller than their successors (and the 0s) are sorted directly, by words of seven
    values, each word splitting only the groups that are still tied; the others are induced.
    """
    n = len(s)
    word = words_of(s) if word is None else word
    after = np.append(s[1:], np.int16(-1))
    decided = np.flatnonzero(s != after)  # the place that decides each suffix is the next of these; the end always is one
    run = np.diff(decided, prepend=-1)
    small = np.repeat(s[decided] < after[decided], run)
    small |= s == 0
    needed = np.ones(n, bool) if first is None else _needed(small, first, count)
    direct = _direct(word, np.flatnonzero(small & needed & (s > 0)), depth)
    head = np.searchsorted(s[direct], np.arange(258))
    large = ~small & needed
    placed: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in np.flatnonzero(np.bincount(s, minlength=257)).tolist():
        if c == 0:
            here = [np.flatnonzero((s == 0) & needed)]
        else:
            queue = np.concatenate([np.zeros(0, np.int64), *placed[c]])
            here = []
            while len(queue):  # those placed now place their own predecessors of the same first value
                here.append(queue)
                before = queue[queue > 0] - 1
                queue = before[(s[before] == c) & large[before]]
            here.append(direct[head[c] : head[c + 1]])
        order = np.concatenate(here)
        out.append(order)
        before = order[order > 0] - 1
        before = before[large[before]]
        value = s[before]
        before, value = before[value > c], value[value > c]
        by = np.argsort(value, kind="stable")
        before = before[by]
        edge = np.cumsum(np.bincount(value, minlength=257)).tolist()
        for name in range(c + 1, 257):
            if edge[name] > edge[name - 1]:
                placed[name].append(before[edge[name - 1] : edge[name]])
        placed[c] = []
    return np.concatenate(out)


def _needed(small: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first .. first + count - 1, and on from a last one that is larger than its successor to the next small one."""
    last = first + count - 1
    places = np.flatnonzero(small)
    stop = np.where(small[last], last, places[np.searchsorted(places, last)])
    edge = np.zeros(len(small) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, stop + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _direct(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first `depth` values."""
    key = word[at]
    by = np.argsort(key)
    order, key, group = at[by], key[by], np.zeros(len(at), np.int64)
    tied = np.arange(len(at))  # places of `order` that aren't settled; those of one group lie together
    for shift in range(7, depth, 7):
        new = np.ones(len(tied) + 1, bool)  # where a group begins
        new[1:-1] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        live = ~(new[:-1] & new[1:]) & (key & np.uint64(511) > 0)  # others are alone, or have ended
        group, tied = np.cumsum(new[:-1])[live], tied[live]
        if not len(tied):
            break
        key = word[order[tied] + shift]
        by = np.lexsort((key, group))
        order[tied], key = order[tied][by], key[by]
    return order


def common_prefix_reaches(word: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix of `order`, whether it shares its first `width` values with the one before it.

    The common prefix is measured in steps of seven values over the pairs that still agree.
    """
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    alive = np.arange(1, len(order))
    for at in range(0, width, 7):
        rest = np.uint64(9 * (7 - min(7, width - at)))
        alive = alive[word[order[alive] + at] >> rest == word[order[alive - 1] + at] >> rest]
    same[alive] = True
    return same


class _Chunk:
    """The runs of windows of a chunk's texts."""

    def __init__(self, table: pa.Table, width: int, told: pa.Table) -> None:
        self.doc, (self.raw, self.edges), self.copied = sw.ids(table), texts(table["text"]), sw.copied(table, told)
        gram, parts = min(GRAM, width), []
        for at, stop in slices(self.edges):
            begin, end = self.edges[at], self.edges[stop]
            room = np.diff(self.edges[at : stop + 1]) - width + 1  # windows of each text
            room[self.copied[at:stop]] = 0
            start = np.arange(end - begin)
            which = np.repeat(np.arange(stop - at), np.diff(self.edges[at : stop + 1]))
            start = start[start - (self.edges[at:stop] - begin)[which] < room[which]]
            first, count, name = sw.runs(rolling(BYTE_CODE[self.raw[begin:end]], gram), width - gram + 1, start)
            parts.append((first + begin, count, name, at + which[first]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.start, self.count, self.name, self.row = (np.concatenate(c) for c in zip(none, *parts))


def _hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the stretches raw[start : start + size]; read in parts, so that the sums take little memory."""
    out = np.zeros(len(start), np.uint64)
    by = np.argsort(start, kind="stable")
    for at in range(0, len(by), 20_000):
        some = by[at : at + 20_000]
        low, high = int(start[some[0]]), int((start[some] + size[some]).max())
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODE[raw[low:high]] * powers(BASE, high - low), out=total[1:])
        a = start[some] - low
        out[some] = mix((total[a + size[some]] - total[a]) * powers(INVERSE, high - low + 1)[a] + size[some].astype(np.uint64))
    return out


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches' bytes, one after another."""
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return raw[np.repeat(start, size) + step]


class _Stretches:
    """The distinct stretches among a chunk's chosen runs, ordered by bucket and hash, with the smallest document of each."""

    def __init__(self, chunk: _Chunk, chosen: np.ndarray, width: int, buckets: int) -> None:
        start, self.count = chunk.start[chosen], chunk.count[chosen]
        doc = chunk.doc[chunk.row[chosen]]
        bucket = (chunk.name[chosen] % np.uint64(buckets)).astype(np.int64)
        part = (chunk.name[chosen] // np.uint64(buckets) % np.uint64(PARTS)).astype(np.uint8)
        by = np.lexsort((doc, h := _hash(chunk.raw, start, self.count + width - 1), part, bucket))
        new = np.ones(len(by), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (bucket[by][1:] != bucket[by][:-1]) | (part[by][1:] != part[by][:-1])
        self.of = np.zeros(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        keep = by[new]
        self.start, self.windows, self.least, self.bucket, self.part = start[keep], self.count[keep], doc[keep], bucket[keep], part[keep]


def _ask(chunk: int, raw: np.ndarray, found: _Stretches, width: int) -> pa.Table:
    rows = []
    for b, some in sw.by_bucket(found.bucket):
        size = found.windows[some] + width - 1
        rows.append((b, _gather(raw, found.start[some], size).tobytes(), size.astype(np.int32).tobytes(), found.least[some].tobytes(), found.part[some].tobytes()))
    column = lambda k, kind: pa.array([r[k] for r in rows], kind)
    return pa.table({"bucket": column(0, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "bytes": column(1, pa.binary()), "sizes": column(2, pa.binary()), "least": column(3, pa.binary()), "parts": column(4, pa.binary())})


def _smallest(raw: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For every window of every stretch, in order: the smallest document that has it."""
    s = np.zeros(int(size.sum()) + len(size), np.int16)  # each stretch, and a 0 behind it
    at = np.cumsum(size + 1) - (size + 1)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    s[np.repeat(at, size) + step] = raw[np.repeat(start, size) + step].astype(np.int16) + 1
    count = size - width + 1
    first = np.cumsum(count) - count
    window = np.full(len(s), -1, np.int64)
    step = np.arange(count.sum()) - np.repeat(first, count)
    window[np.repeat(at, count) + step] = np.arange(count.sum())
    word = words_of(s)
    order = suffix_array(s, width, word, at, count)
    order = order[window[order] >= 0]
    group = np.cumsum(~common_prefix_reaches(word, order, width)) - 1
    owner = np.repeat(least, count)
    low = np.full(int(group[-1]) + 1 if len(group) else 0, sw.NO_ID)
    np.minimum.at(low, group, owner[window[order]])
    out = np.empty(len(owner), np.int64)
    out[window[order]] = low[group]
    return out


def _smaller_elsewhere(table: pa.Table, width: int) -> pa.Table:
    """For each window of each stretch of each chunk, whether a smaller document than the chunk's own has it."""
    blob = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    parts, sizes = blob("bytes", np.uint8), [x.astype(np.int64) for x in blob("sizes", np.int32)]
    raw, size, least, part = np.concatenate(parts), np.concatenate(sizes), np.concatenate(blob("least", np.int64)), np.concatenate(blob("parts", np.uint8))
    start, count = np.cumsum(size) - size, size - width + 1
    first = np.cumsum(count) - count
    flag = np.zeros(int(count.sum()), bool)
    for name in np.unique(part):
        some = np.flatnonzero(part == name)
        step = np.arange(count[some].sum()) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        flag[np.repeat(first[some], count[some]) + step] = _flags(raw, start[some], size[some], least[some], width)
    edge = np.cumsum([0, *[int((x - width + 1).sum()) for x in sizes]])
    chunks, buckets = table["chunk"].to_pylist(), table["bucket"].to_pylist()
    return sw.answer(2, [(chunks[i], buckets[i], flag[edge[i] : edge[i + 1]]) for i in range(len(parts))])


def _flags(raw: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each window of each of these stretches, whether one of them with a smaller document has it too."""
    raw = _gather(raw, start, size)
    start = np.cumsum(size) - size
    _, first, which = np.unique(_hash(raw, start, size), return_index=True, return_inverse=True)
    equal = (size[first][which] == size).all()
    if equal:
        step = np.arange(len(raw)) - np.repeat(start, size)
        equal = (raw == raw[np.repeat(start[first][which], size) + step]).all()
    if not equal:  # stretches that differ share a hash: let all of them be sorted
        first = which = np.arange(len(size))
    low = np.full(len(first), sw.NO_ID)
    np.minimum.at(low, which, least)
    smallest = _smallest(raw, start[first], size[first], low, width)
    count = size - width + 1
    begin = (np.cumsum(count[first]) - count[first])[which]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return smallest[np.repeat(begin, count) + step] < np.repeat(least, count)


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (the maximal removed runs, in bytes), kept (the other bytes) and rest (a struct of df's
    other columns) for every row of df."""
    docs, n, copies = sw.chunked(df, id_col, text_col)

    def stretches(chunk: _Chunk, bits: pa.Table) -> tuple[np.ndarray, _Stretches]:
        flag = sw.Anchors(chunk.name, chunk.row, n).shared(sw.answers(bits, 1))
        chosen = np.flatnonzero(flag)
        return chosen, _Stretches(chunk, chosen, width, n)

    def send_anchors(table: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, bits)
        return sw.Anchors(chunk.name, chunk.row, n).ask(table["chunk"][0].as_py() if len(table) else 0)

    def send_stretches(table: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, bits)
        _, found = stretches(chunk, bits)
        return _ask(table["chunk"][0].as_py() if len(table) else 0, chunk.raw, found, width)

    def remove(table: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, bits)
        chosen, found = stretches(chunk, bits)
        smaller = sw.answers(bits, 2)
        begin = np.cumsum(found.windows) - found.windows
        count, row = chunk.count[chosen], chunk.row[chosen]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc = chunk.doc[row]
        gone = np.repeat(found.least[found.of] < doc, count)
        gone |= smaller[np.repeat(begin[found.of], count) + step]
        gone &= np.repeat(doc != sw.NO_ID, count)
        place, row = (np.repeat(chunk.start[chosen], count) + step)[gone], np.repeat(row, count)[gone]
        edge = np.searchsorted(row, np.arange(len(chunk.doc) + 1))  # runs come in order of rows and places
        raw, at, spans, kept = chunk.raw, chunk.edges, [], []
        for i in range(len(chunk.doc)):
            n = int(at[i + 1] - at[i])
            a, b = sw.covered(place[edge[i] : edge[i + 1]] - at[i], width, n) if not chunk.copied[i] else sw.whole(n, width)
            spans.append((a, b))
            text = raw[at[i] : at[i + 1]].tobytes()
            cut = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
            kept.append(b"".join([text[cut[k] : cut[k + 1]] for k in range(0, len(cut), 2)]))
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(at)), "spans": sw.spans_column(spans), "kept": pa.array(kept, pa.binary()), "rest": table["rest"]})

    asked = docs.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(send_anchors, sw.ASKED)
    first = asked.groupBy("bucket").applyInArrow(sw.held_elsewhere, sw.ANSWERED).union(copies)
    sent = docs.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_stretches, "bucket int, chunk int, bytes binary, sizes binary, least binary, parts binary")
    second = sent.groupBy("bucket").applyInArrow(lambda table: _smaller_elsewhere(table, width), sw.ANSWERED)
    made = sw.result(docs, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary", "rest")
    return docs.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInArrow(remove, made)
