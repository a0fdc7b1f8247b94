"""Removal of token passages that an earlier document has, by Rabin-Karp hashes of every fixed-length window.

A window is `width` consecutive words of one document. A word goes if a window that covers it, as a word sequence, also
starts in a document of smaller id; windows are judged on the input. The hash of a window is a polynomial of its words'
hashes, taken from prefix sums. Windows whose anchor no other text has can't recur and aren't sent; each chunk gives its
other distinct windows as rows (two hashes, chunk, smallest document). Spark counts the rows of each window and takes its
smallest document; the windows that a chunk has with a larger one go back to it. Removed windows are merged into maximal
intervals. Windows count as equal if both of their 64-bit hashes are.

A null text is empty. A document without an id neither loses words nor takes any; rows with equal ids take nothing from
each other. Other columns stay as they are. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _shared_windows as sw
from tidemark.llm._spark import stored
from tidemark.llm._words import CONSTANT, mix, rolling, slices, texts, words

WIDTH = 50
GRAM = 8


class _Chunk:
    """The runs of windows of a chunk's texts, and what is needed to look their windows up again."""

    def __init__(self, table: pa.Table, width: int, told: pa.Table) -> None:
        self.doc, (raw, edges), self.copied = sw.ids(table), texts(table["text"]), sw.copied(table, told)
        self.text, self.n_words = (raw, edges), np.zeros(len(self.doc), np.int64)
        gram = min(GRAM, width)
        parts, hashes, base = [], [], 0
        self.first = np.zeros(len(self.doc), np.int64)  # of each document, in the sequence of all the chunk's words
        for at, stop in slices(edges):
            row, _, _, h = words(raw[edges[at] : edges[stop]], edges[at : stop + 1] - edges[at])
            total = np.bincount(row, minlength=stop - at)
            self.n_words[at:stop] = total
            self.first[at:stop] = base + np.cumsum(total) - total
            place = np.arange(len(row)) - (self.first[at:stop] - base)[row]
            start, count, name = sw.runs(rolling(h, gram), width - gram + 1, np.flatnonzero((place + width <= total[row]) & ~self.copied[at:stop][row]))
            window = np.zeros((2, len(h)), np.uint64)
            for k, code in enumerate((h, mix(h ^ CONSTANT[3003]))):
                window[k, : max(0, len(h) - width + 1)] = rolling(code, width)
            hashes.append(window)
            parts.append((start + base, count, name, at + row[start]))
            base += len(h)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.start, self.count, self.name, self.row = (np.concatenate(c) for c in zip(none, *parts))
        self.hashes = np.concatenate([np.zeros((2, 0), np.uint64), *hashes], axis=1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and row of each window of the chosen runs."""
        count = self.count[chosen]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(self.start[chosen], count) + step, np.repeat(self.row[chosen], count)


class _Windows:
    """The distinct windows among some, by their pairs of hashes, ordered by these, with the smallest document of each."""

    def __init__(self, h: np.ndarray, doc: np.ndarray) -> None:
        by = np.lexsort((doc, h[1], h[0]))
        new = np.ones(len(by), bool)
        new[1:] = (h[:, by[1:]] != h[:, by[:-1]]).any(0)
        self.h, self.least = h[:, by[new]], doc[by[new]]
        self.of = np.empty(len(by), np.int64)  # the distinct window of each
        self.of[by] = np.cumsum(new) - 1

    def among(self, h: np.ndarray) -> np.ndarray:
        """Which distinct windows have one of these pairs of hashes."""
        flag = np.zeros(len(self.least), bool)
        at = np.searchsorted(self.h[0], h[0])
        todo = np.arange(len(at))
        while len(todo):  # goes round again only where windows share the first hash
            todo = todo[at[todo] < len(flag)]
            todo = todo[self.h[0, at[todo]] == h[0, todo]]
            same = self.h[1, at[todo]] == h[1, todo]
            flag[at[todo[same]]] = True
            todo = todo[~same]
            at[todo] += 1
        return flag


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, spans (the removed intervals, in words), kept (the other words, joined by one space) and rest
    (a struct of df's other columns), and on request the whole text, for every row of df."""
    docs, n, copies = sw.chunked(df, id_col, text_col)

    def shared_windows(chunk: _Chunk, bits: pa.Table) -> tuple[np.ndarray, np.ndarray, _Windows]:
        flag = sw.Anchors(chunk.name, chunk.row, n).shared(sw.answers(bits, 1))
        place, row = chunk.windows(np.flatnonzero(flag))
        return place, row, _Windows(chunk.hashes[:, place], chunk.doc[row])

    def send_anchors(table: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, bits)
        return sw.Anchors(chunk.name, chunk.row, n).ask(table["chunk"][0].as_py())

    def send_windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        _, _, found = shared_windows(_Chunk(table, width, bits), bits)
        chunk = np.full(len(found.least), table["chunk"][0].as_py() if len(table) else 0, np.int32)
        return pa.table({"h1": found.h[0].view(np.int64), "h2": found.h[1].view(np.int64), "chunk": chunk, "least": found.least})

    def remove(table: pa.Table, bits: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, bits)
        place, row, found = shared_windows(chunk, bits)
        told = bits.filter(pc.equal(bits["kind"], 2))
        smaller = found.among(np.stack([told[c].combine_chunks().to_numpy().view(np.uint64) for c in ("doc", "mark")]))
        doc = chunk.doc[row]
        gone = (smaller[found.of] | (found.least[found.of] < doc)) & (doc != sw.NO_ID)
        place, row = place[gone] - chunk.first[row[gone]], row[gone]
        by = np.lexsort((place, row))
        place, edge = place[by], np.searchsorted(row[by], np.arange(len(chunk.doc) + 1))
        (raw, at), spans, kept = chunk.text, [], []
        for i in range(len(chunk.doc)):
            n = int(chunk.n_words[i])
            start, stop = sw.covered(place[edge[i] : edge[i + 1]], width, n) if not chunk.copied[i] else sw.whole(n, width)
            all_words, own, last = raw[at[i] : at[i + 1]].tobytes().split(), [], 0
            for a, b in zip(start.tolist(), stop.tolist()):
                own += all_words[last:a]
                last = b
            kept.append(b" ".join(own + all_words[last:] if last else all_words).decode())
            spans.append((start, stop))
        made = {"doc_id": table["doc_id"], "n_words": pa.array(chunk.n_words), "spans": sw.spans_column(spans), "kept": pa.array(kept, pa.string()), "rest": table["rest"]}
        return pa.table(made | ({"text": table["text"]} if with_text else {}))

    asked = docs.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(send_anchors, sw.ASKED)
    first = asked.groupBy("bucket").applyInArrow(sw.held_elsewhere, sw.ANSWERED).union(copies)
    sent = stored(docs.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_windows, "h1 long, h2 long, chunk int, least long"), "windows")
    counted = sent.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("least").alias("smallest")).where("times > 1")
    none = [F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("bits")]
    second = sent.join(counted, ["h1", "h2"]).where("smallest < least").select("chunk", *none, F.col("h1").alias("doc"), F.col("h2").alias("mark"))
    made = sw.result(docs, "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept string", "rest", *["text"] * with_text)
    return docs.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInArrow(remove, made)


def n_removed(spans: str = "spans"):
    """How many words or bytes the spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
