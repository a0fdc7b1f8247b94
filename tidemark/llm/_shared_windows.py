"""Finding the windows of texts that other texts may share, without sending every window over the network.

A text that equals one of a smaller document is a copy: it goes as a whole if it holds a window, and is left out of
all that follows. Copies are told by their SHA-256, in Spark.

Texts lie in chunks of bounded size, dealt by a hash; one exchange of the texts serves all passes. In each text every
window of fixed width has an anchor: the gram of lowest hash inside it (the leftmost of equals). Equal windows have equal
anchors, so a window can only recur in another text if its anchor does. Consecutive windows with one anchor form a run.

A chunk sends each of its distinct anchors once, as six bytes, and gets one bit back: whether another chunk has it. Such
exchanges go by buckets, `ask` being what a chunk sends and `answer` what a bucket's reducer returns. An anchor that a
third of all texts hold is one value for each chunk. Six-byte names can collide, which only lets a run through that
isn't shared; what is removed is decided on the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import stored
from tidemark.llm._words import mix

CHUNK_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 28) - 1)


def chunked(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame]:
    """doc_id, text, the other columns as `rest`, a hash of the text, and the chunk; the number of chunks; and the copies,
    as answers of kind 0."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<none:int>")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(2, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")
    docs = docs.withColumns({"chunk": chunk, "mark": F.xxhash64("text")})
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    told = stored(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "chunk", "mark", digest), "digests")
    least = told.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    none = [F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("bits")]
    copies = told.join(least, "digest").where("doc_id > least").select("chunk", *none, F.col("doc_id").alias("doc"), "mark")
    return docs.repartition(n, "chunk"), n, stored(copies, "copies")


def copied(table: pa.Table, told: pa.Table) -> np.ndarray:
    """Which rows of a chunk are copies."""
    rows = told.filter(pc.equal(told["kind"], 0))
    known = set(zip(rows["doc"].to_pylist(), rows["mark"].to_pylist()))
    return np.fromiter((x in known for x in zip(table["doc_id"].to_pylist(), table["mark"].to_pylist())), bool, len(table))


def result(docs: DataFrame, made: str, *passed: str) -> T.StructType:
    """The schema of columns made anew and of columns passed through as they are."""
    return T.StructType([*T.StructType.fromDDL(made).fields, *[docs.schema[name] for name in passed]])


def ids(table: pa.Table) -> np.ndarray:
    """Document ids; a missing one is larger than all others."""
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()


def runs(grams: np.ndarray, width: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor's name for each run of the windows that start at `starts`, ascending.

    A window at p holds the grams p .. p + width - 1.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return starts[new], np.diff(np.append(new, len(starts))), mix(grams[anchor[new]]) >> np.uint64(16)


def by_bucket(bucket: np.ndarray) -> Iterable[tuple[int, slice]]:
    """Ranges of an ascending array of buckets."""
    names, first = np.unique(bucket, return_index=True)
    for i, name in enumerate(names):
        yield int(name), slice(int(first[i]), int(first[i + 1]) if i + 1 < len(names) else len(bucket))


def six(names: np.ndarray) -> bytes:
    """Names, which are below 2 ** 48, as six bytes each."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def of_six(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((raw.size // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.view(np.uint64).ravel()


class Anchors:
    """The distinct anchors of a chunk, ordered by bucket and name."""

    def __init__(self, name: np.ndarray, row: np.ndarray, buckets: int) -> None:
        by = np.argsort(name, kind="stable")  # rows of a name stay in order
        ordered = name[by]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(name) else by
        last = np.append(first[1:], len(name))[: len(first)] - 1
        found, row = ordered[first], row[by]
        bucket = (found % np.uint64(buckets)).astype(np.int64)
        self.by = np.argsort(bucket, kind="stable")
        self.sorted, self.bucket, self.repeated = found, bucket[self.by], row[first] != row[last]
        self.place = np.empty(len(name), np.int64)  # of each run's anchor
        self.place[by] = np.repeat(np.arange(len(first)), last - first + 1)

    def ask(self, chunk: int) -> pa.Table:
        names = self.sorted[self.by]
        rows = [(b, six(names[some])) for b, some in by_bucket(self.bucket)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "names": pa.array([r[1] for r in rows], pa.binary())})

    def shared(self, bits: np.ndarray) -> np.ndarray:
        """Which runs have an anchor that another text has, given the answers in order."""
        flag = np.zeros(len(self.sorted), bool)
        flag[self.by] = bits[: len(self.by)]
        return (flag | self.repeated)[self.place]


ASKED = "bucket int, chunk int, names binary"
ANSWERED = "chunk int, kind int, bucket int, n int, bits binary, doc long, mark long"


def answer(kind: int, rows: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    """A bucket's bits for each chunk: (chunk, bucket, bits)."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    columns = [[c for c, _, _ in rows], [kind] * len(rows), [b for _, b, _ in rows], [len(x) for _, _, x in rows], [np.packbits(x).tobytes() for _, _, x in rows], *[[None] * len(rows)] * 2]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "kind", "bucket", "n", "bits", "doc", "mark"])


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """The bits of one kind that a chunk got, by bucket."""
    rows = sorted((r["bucket"], r["n"], r["bits"]) for r in table.filter(pc.equal(table["kind"], kind)).to_pylist())
    return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows]]).astype(bool)


def held_elsewhere(table: pa.Table) -> pa.Table:
    """Answers to `Anchors.ask`: the anchors that two or more chunks hold."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in table["names"]]
    _, which, count = np.unique(of_six(np.concatenate(parts)), return_inverse=True, return_counts=True)
    edge = np.cumsum([0, *map(len, parts)])
    flag = count[which] >= 2
    chunks, buckets = table["chunk"].to_pylist(), table["bucket"].to_pylist()
    return answer(1, [(chunks[i], buckets[i], flag[edge[i] : edge[i + 1]]) for i in range(len(parts))])


def spans_column(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """An array of (start, stop) structs for each row."""
    edge = np.cumsum([0, *[len(a) for a, _ in rows]]).astype(np.int32)
    join = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *[r[k] for r in rows]]))
    return pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([join(0), join(1)], ["start", "stop"]))


def covered(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows of `width` that start at `starts`, ascending, in a text of n."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + width)))
    return starts[new], np.minimum(starts[np.append(new[1:] - 1, len(starts) - 1)] + width, n)


def whole(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What goes of a copy that has n units: everything, if it holds a window."""
    size = np.full(1 if n >= width else 0, n)
    return np.zeros_like(size), size
