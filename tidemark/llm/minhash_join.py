"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set holds the hashes of its distinct word shingles; its signature holds the minimum of COORDINATES permutations
of the set. Texts with equal sets are one class, represented by its smallest id, so copies never meet each other.

* Postings. A representative is posted under its PREFIX rarest coordinate-value pairs only. Two signatures that agree in
  MATCHES coordinates or more share one of those, whatever the order of rarity, as PREFIX = COORDINATES - MATCHES + 1: the
  short lists are merged, the MATCHES - 1 longest ones of each document are skipped and probed in the signature, of which
  a posting holds one byte a coordinate. Rarity comes from a counting sketch of fixed size. A list longer than LIST_ROWS
  is dealt into parts, and any two parts meet in a list of their own.
* Candidates. Two members of a list are candidates if their sizes allow the similarity and enough coordinates collide. A
  list gives its candidates' spanning forest, so never more rows than it has postings.
* Clusters are the components of those forests. All links lie within clusters.
* Links. A cluster's sets meet in one group, or in blocks of about BLOCK_ELEMENTS elements if it is larger. There
  intersections are counted exactly, by merging the lists of a set's elements. A set that is already in the group's
  largest component needn't be counted: its links to sets outside are found from those. Blocks share their cluster's
  smallest set, which joins their components. What then still lies outside the cluster's largest component meets every
  block. So a large group of close copies costs about its size, and no link between two components is left out.

With 64 coordinates and 36 matches a pair at similarity 0.8 is missed with probability below 1e-5, at 0.85 below 1e-8.

A null text, or one without a word, has an empty set, links with nothing and is its own component. Rows without an id
take no part in linking: their component is null and they are kept. Rows that repeat an id get one verdict. Further
columns are left out. An empty table gives an empty one. Ids are whole numbers; others must be cast before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored
from tidemark.llm._words import CONSTANT, mix, slices, texts, words

COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
SKETCH_SLOTS = 1 << 18
ID_SLOTS = 1 << 23
LIST_ROWS = 100_000
BLOCK_ELEMENTS = 1 << 20
#: Members of clusters that are few enough to be broadcast to their sets, some 40 bytes each; more meet them by a shuffle.
BROADCAST_ROWS = 500_000
POSTINGS = "bucket int, token binary, doc binary, size binary, brief binary"
_MULTIPLY, _FLIP = CONSTANT[:COORDINATES], CONSTANT[COORDINATES : 2 * COORDINATES]


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, stop, the rows' set elements sorted within a row, and where each row's begin.

    A text of fewer than `width` words, but one at least, has all its words as its one element.
    """
    raw, edges = texts(column)
    for at, stop in slices(edges):
        row, _, _, h = words(raw[edges[at] : edges[stop]], edges[at : stop + 1] - edges[at], lower=True)
        total = np.bincount(row, minlength=stop - at)
        size = np.minimum(total, width)[row] if len(row) else row
        first = np.concatenate(([0], np.cumsum(total)))
        place = np.arange(len(row)) - first[row]
        starts = np.flatnonzero(place + size <= total[row])
        starts = starts[(total[row[starts]] >= width) | (place[starts] == 0)]
        value = size[starts].astype(np.uint64)
        for k in range(width):
            inside = k < size[starts]
            value = np.where(inside, mix(value * CONSTANT[3000] + h[np.minimum(starts + k, len(h) - 1)]), value)
        row = row[starts]
        by = np.lexsort((value, row))
        row, value = row[by], value[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
        yield at, stop, value, np.searchsorted(row, np.arange(stop - at + 1))


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that stand for the set, and the signature; of an empty set it is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, value, edge in shingle_sets(batch.column(1), width):
                size = np.diff(edge)
                full = np.flatnonzero(size)
                least = np.zeros((stop - at, COORDINATES), np.uint32)
                sums = np.zeros((2, stop - at), np.uint64)
                if len(full):
                    begin = edge[full]
                    for k in range(COORDINATES):
                        least[full, k] = np.minimum.reduceat((value ^ _FLIP[k]) * _MULTIPLY[k], begin) >> np.uint64(32)
                    sums[0, full], sums[1, full] = np.add.reduceat(mix(value), begin), np.add.reduceat(mix(value ^ CONSTANT[3001]), begin)
                signature = [least[i].tobytes() if size[i] else None for i in range(stop - at)]
                columns = [batch.column(0).slice(at, stop - at), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _tokens(signature: np.ndarray) -> np.ndarray:
    """64-bit names of coordinate-value pairs."""
    return mix((signature.astype(np.uint64) << np.uint64(8)) + np.arange(COORDINATES, dtype=np.uint64))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def rarity(signed: DataFrame) -> np.ndarray:
    """A counting sketch of coordinate-value pairs, of SKETCH_SLOTS counters whatever the number of documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((_tokens(_matrix(batch.column(0))) % np.uint64(SKETCH_SLOTS)).astype(np.int64).ravel(), minlength=SKETCH_SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    summed = signed.select("signature").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH_SLOTS, np.int64)
    sketch[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return np.minimum(sketch, (1 << 31) - 1).astype(np.int32)


def _parts(token: np.ndarray, doc: np.ndarray, sketch: np.ndarray, list_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the lists that postings go to, and the place of each one's posting.

    A token whose list may have more than `list_rows` rows, beyond what other tokens add to its counter on average, is
    split: a document belongs to one part, and goes to the list of each two parts of which one is its own.
    """
    beyond = sketch[(token % np.uint64(SKETCH_SLOTS)).astype(np.int64)] - int(sketch.mean())
    parts = np.maximum(1, -(-beyond // list_rows)).astype(np.int64)
    which = np.repeat(np.arange(len(token)), parts)
    if len(which) == len(token):
        return token, which
    own = (mix(doc.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)[which]
    other = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    tile = (np.minimum(own, other) * parts[which] + np.maximum(own, other)).astype(np.uint64)
    split = parts[which] > 1
    return np.where(split, mix(token[which] ^ mix(tile + CONSTANT[3002])), token[which]), which


def _post(signed: DataFrame, sketch: np.ndarray, buckets: int, list_rows: int) -> DataFrame:
    """Packed postings: list, document, size of its set, and one byte of each coordinate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signature = _matrix(part.column(2))
                token = _tokens(signature)
                order = np.lexsort((token, sketch[(token % np.uint64(SKETCH_SLOTS)).astype(np.int64)]), axis=1)[:, :PREFIX]
                doc, size = part.column(0).to_numpy(), np.minimum(part.column(1).to_numpy(), (1 << 31) - 1).astype(np.int32)
                which = np.repeat(np.arange(len(signature)), PREFIX)
                token, place = _parts(np.take_along_axis(token, order, 1).ravel(), doc[which], sketch, list_rows)
                which = which[place]
                bucket = (token % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                brief = np.ascontiguousarray(signature & 255).astype(np.uint8)
                names, first = np.unique(bucket[by], return_index=True)
                rows = [[], [], [], [], []]
                for name, some in zip(names, np.split(by, first[1:])):
                    who = which[some]
                    for column, value in zip(rows, (int(name), token[some].tobytes(), doc[who].tobytes(), size[who].tobytes(), brief[who].tobytes())):
                        column.append(value)
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["bucket", "token", "doc", "size", "brief"])

    return signed.select("doc_id", "n_shingles", "signature").mapInArrow(run, POSTINGS)


def _forest(size: np.ndarray, brief: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a list's members that span the components of its candidate graph; each b occurs once."""
    left, found_a, found_b = np.arange(len(size)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = (brief[left] == brief[i]).sum(1, dtype=np.int16) >= MATCHES
            near &= 100 * np.minimum(size[left], size[i]) >= percent * np.maximum(size[left], size[i])
            if near.any():
                found_a.append(np.full(near.sum(), i))
                found_b.append(left[near])
                todo += left[near].tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all candidate pairs of all lists."""

    def run(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        token, doc, size = whole("token", np.uint64), whole("doc", np.int64), whole("size", np.int32).astype(np.int64)
        brief = whole("brief", np.uint8).reshape(-1, COORDINATES)
        by = np.lexsort((doc, token))
        edge = np.flatnonzero(np.concatenate(([True], token[by][1:] != token[by][:-1], [True])))
        none = np.zeros(0, np.int64)
        found_a, found_b = [none], [none]
        for i in np.flatnonzero(np.diff(edge) > 1):
            some = by[edge[i] : edge[i + 1]]
            a, b = _forest(size[some], brief[some], percent)
            found_a.append(doc[some[a]])
            found_b.append(doc[some[b]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    return postings.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def _set_table(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id and elements (64-bit hashes, ascending) of the texts with these ids, and some others.

    Which texts are hashed goes by a bitmap of ID_SLOTS bits, however many ids there are; the caller joins by id.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS))
    bits = ids.select(slot("doc_id").alias("s")).select(F.expr("s div 32").alias("word"), F.expr("shiftleft(1L, CAST(s % 32 AS INT))").alias("bit"))
    seen = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    wanted = np.zeros(ID_SLOTS // 32, np.uint32)
    wanted[seen["word"].to_numpy()] = seen["bits"].to_numpy().astype(np.uint32)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted[s // 32] >> (s % 32).astype(np.uint32) & 1).astype(bool)))
            for at, stop, value, edge in shingle_sets(batch.column(1), width):
                raw = [value[edge[i] : edge[i + 1]].tobytes() for i in range(stop - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(raw, pa.binary())], ["doc_id", "elements"])

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("slot"))
    return hashed.mapInArrow(sets, "doc_id long, elements binary")


def joined(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """A number for each set's component, given names of components known before; sets are ascending and distinct.

    The sets outside the largest component are counted against all sets, one after another, until none is left. For each
    the lists of the sets that hold its elements are merged, which gives its intersection with every set at once.
    """
    n = len(sets)
    label = np.unique(label, return_inverse=True)[1]
    if not label.any():
        return label
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.full(2, label.min()) if 100 * both >= percent * (size.sum() - both) else label
    value = np.concatenate(sets)
    by = np.argsort(value, kind="stable")
    holder = np.repeat(np.arange(n), size)[by]
    new = np.concatenate(([True], value[by][1:] != value[by][:-1]))
    element = np.empty(len(by), np.int64)
    element[by] = np.cumsum(new) - 1
    head = np.append(np.flatnonzero(new), len(by))
    first = np.concatenate(([0], np.cumsum(size)))
    counted = np.zeros(n, bool)
    while True:
        left = np.flatnonzero(~counted & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        i = left[0]
        counted[i] = True
        own = element[first[i] : first[i + 1]]
        length = head[own + 1] - head[own]
        at = np.arange(length.sum()) + np.repeat(head[own] - (np.cumsum(length) - length), length)
        both = np.bincount(holder[at], minlength=n)
        names = np.unique(label[100 * both >= percent * (size + size[i] - both)])
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]


def _linked(met: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) that join the components of `met` that have links between them, as stars around smallest documents.

    The rows of a (cluster, x, y) hold doc_id, component and elements and make a group; groups are dealt to buckets, so
    that small ones share a call.
    """

    def run(table: pa.Table) -> pa.Table:
        key = np.stack([table[c].combine_chunks().to_numpy() for c in ("doc_id", "y", "x", "cluster")])
        by = np.lexsort(key)
        key = key[:, by]
        component, elements = table["component"].combine_chunks().to_numpy()[by], table["elements"].combine_chunks()
        again = (key[:, 1:] == key[:, :-1]).all(0)
        keep = np.concatenate(([True], ~again)) if len(by) else np.zeros(0, bool)
        key, by, component = key[:, keep], by[keep], component[keep]
        edge = np.flatnonzero(np.concatenate(([True], (key[1:, 1:] != key[1:, :-1]).any(0), [True])))
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        for low, high in zip(edge[:-1], edge[1:]):
            if high - low < 2:
                continue
            doc = key[0, low:high]
            sets = [np.frombuffer(elements[int(i)].as_buffer(), np.uint64) for i in by[low:high]]
            label = joined(sets, component[low:high], percent)
            _, known = np.unique(component[low:high], return_index=True)  # one document of each component speaks for it
            _, first, which = np.unique(label, return_index=True, return_inverse=True)
            least = doc[first][which][known]
            a.append(least[least != doc[known]])
            b.append(doc[known][least != doc[known]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    bucket = F.pmod(F.xxhash64("cluster", "x", "y"), F.lit(buckets))
    return met.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "a long, b long")


def _links(clusters: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, block_elements: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links; clusters has id and component."""
    members = clusters.toDF("doc_id", "cluster").join(classes.select("doc_id", "n_shingles"), "doc_id")
    sizes = members.groupBy("cluster").agg(F.sum("n_shingles").alias("n"))
    blocks = F.ceil(F.col("n") / block_elements).cast("long")
    large = sizes.where(blocks > 1).select("cluster", blocks.alias("blocks"))
    members = members.join(large, "cluster", "left")
    members = stored(members.select("doc_id", "cluster", "n_shingles", F.coalesce("blocks", F.lit(1)).alias("blocks")), "members")
    n, total = members.agg(F.count("*"), F.sum("n_shingles")).first()
    if not total:
        return clusters.select(F.col("component").alias("a"), F.col("id").alias("b")).limit(0)
    sets, block = stored(_set_table(members, docs, width), "sets"), F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    everywhere = F.when(F.col("doc_id") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
    dealt = members.withColumn("x", F.explode(everywhere)).withColumns({"y": F.col("x"), "component": F.col("doc_id")})
    if n <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    within = stored(_linked(sets.join(dealt, "doc_id"), percent, -(-total // block_elements)), "links")
    if not large.limit(1).count():
        return within
    known = components(within.join(members.where("blocks > 1").select(F.col("doc_id").alias("b")), "b", "left_semi"))
    known = members.where("blocks > 1").join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    home = known.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("home"))
    known = stored(known.join(home, "cluster").withColumn("outside", F.col("component") != F.col("home")), "known")
    rows = known.where("outside").groupBy("cluster").agg(F.sum("n_shingles").alias("n"))
    rows = known.join(rows.select("cluster", F.ceil(F.col("n") / block_elements).cast("long").alias("groups")), "cluster")
    span = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    common = ["doc_id", "cluster", "component"]
    asking = rows.where("outside").select(*common, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("groups")).alias("x"), F.explode(span("blocks")).alias("y"))
    asked = rows.select(*common, F.explode(span("groups")).alias("x"), block.alias("y"))
    tiles = asking.unionByName(asked).join(sets, "doc_id")
    return within.unionByName(stored(_linked(tiles, percent, 4 * -(-total // block_elements)), "links"))


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id that it reaches, for every id of the edges (a, b).

    Labels flow along edges and then jump to their label's label, so the rounds grow with the logarithm of a
    component's diameter. Each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("id", "other"), "edges")
    labels = stored(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("id").agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("hop"), F.col("component").alias("old"))
        jump = step.join(labels.toDF("hop", "far"), "hop", "left").select("id", F.least("hop", F.coalesce("far", "hop")).alias("component"), "old")
        jump = stored(jump, "labels")
        if not jump.where("component <> old").limit(1).count():
            return labels
        labels = jump.select("id", "component")


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS, block_elements: int = BLOCK_ELEMENTS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of df."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(docs, width, "doc_id", "text"), "signatures")
    key = ["n_shingles", "set_a", "set_b"]
    shingled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shingled.groupBy(*key).agg(F.min(F.struct("doc_id", "signature")).alias("least"))
    classes = stored(classes.select(*key, "least.doc_id", "least.signature"), "classes")
    buckets = max(1, -(-classes.count() * PREFIX // list_rows))
    clusters = components(_candidates(_post(classes, rarity(classes), buckets, list_rows), percent))
    label = components(_links(clusters, classes, docs, width, percent, block_elements))

    of_class = classes.select(*key, F.col("doc_id").alias("id")).join(label, "id", "left")
    of_class = of_class.select(*key, F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", *key).join(of_class, key, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
