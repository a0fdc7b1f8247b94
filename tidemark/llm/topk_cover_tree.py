"""Exact top-k search by inner product with cover trees over queries and candidates, walked together.

Vectors are packed into shards of bounded size and queries into blocks of bounded size. Every block meets every shard
(a stated query set against all rows, in blocks): shards and blocks are dealt into groups of about GROUP each, a group of
shards meets a group of blocks under a key of their own, and nothing is broadcast. So a shard is sent once for each group
of blocks, not for each block, and no task holds more than the packed rows of two groups. There a cover tree is built for
each shard and block once, and node pairs are walked: for a query node with centre a and covering radius r, and a
candidate node with centre c and radius s,

    q . x  <=  a.c + |a| s + |c| r + r s

bounds every score of the pair, and the pair is pruned once that lies below the worst k-th score of the query group.
Equal bounds are kept, so ties are decided by the smaller id. Scores are integers and exact.

Rows that are null, empty, or hold a null or non-finite component take no part. Vectors meet only vectors of equal
length. Of equal candidate vectors inside a shard only the k + 1 smallest ids can rank, which keeps a very common vector
from filling a leaf. A repeated id is a row of its own; a query never meets rows of its own id. Scores outside the
64-bit range are clipped to it (its least value aside, which marks an empty place). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import stored

SHARD_ROWS = 2048
BLOCK_ROWS = 1024
LEAF_ROWS = 128
FAN_OUT = 32
GROUP = 16
PACKED = "part string, dim int, n int, ids binary, vectors binary"


class Tree:
    """A cover tree as flat arrays: node i covers rows order[start[i]:stop[i]] within radius[i] of row centre[i].

    A node's children are a net of its rows: centres at least some scale apart, and each row with its nearest centre,
    within that scale. The scale falls until it is half the radius or there are FAN_OUT centres, as in many dimensions
    half the radius would take a centre for nearly every row. Rows of very small children stay together in one leaf
    around the node's own centre.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.order = np.arange(len(x))
        self.start, self.stop, self.centre, self.radius, self.children = [], [], [], [], []
        square = (x * x).sum(1)
        self.norm = np.sqrt(square)
        todo = [(0, len(x), 0, -1)]
        while todo:
            start, stop, centre, parent = todo.pop()
            rows = self.order[start:stop]
            away = self._distance(x[rows], square[rows], x[centre], square[centre])
            node, radius = len(self.start), float(away.max(initial=0.0))
            for at, value in ((self.start, start), (self.stop, stop), (self.centre, centre), (self.radius, radius), (self.children, [])):
                at.append(value)
            if parent >= 0:
                self.children[parent].append(node)
            if stop - start <= LEAF_ROWS or radius == 0:
                continue
            nearest, who, centres = away, np.zeros(len(rows), np.int64), [centre]
            while True:
                far = int(nearest.argmax())
                if nearest[far] <= radius / 2 or len(centres) >= FAN_OUT:
                    break
                other = self._distance(x[rows], square[rows], x[rows[far]], square[rows[far]])
                closer = other < nearest
                who[closer], nearest = len(centres), np.where(closer, other, nearest)
                centres.append(rows[far])
            who[np.bincount(who, minlength=len(centres))[who] < LEAF_ROWS // 16] = 0
            if not who.any():
                continue
            by = np.argsort(who, kind="stable")
            self.order[start:stop] = rows[by]
            edges = start + np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(centres)))))
            todo += [(int(edges[i]), int(edges[i + 1]), int(c), node) for i, c in enumerate(centres) if edges[i] < edges[i + 1]]

    @staticmethod
    def _distance(rows: np.ndarray, square: np.ndarray, point: np.ndarray, own: float) -> np.ndarray:
        """Distances, a little enlarged so that rounding never makes a covering radius too small."""
        return np.sqrt(np.maximum(square + own - 2 * (rows @ point), 0) + 1e-12 * (square + own)) * (1 + 1e-9)


def _scores(q: np.ndarray, x: np.ndarray, exact: str) -> np.ndarray:
    if exact == "float":
        return (q @ x.T).astype(np.int64)
    if exact == "long":
        return q.astype(np.int64) @ x.astype(np.int64).T
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    whole = np.frompyfunc(int, 1, 1)  # Python's integers have no bound
    return np.frompyfunc(lambda v: min(max(v, low), high), 1, 1)(whole(q) @ whole(x).T).astype(np.int64)


def _exactness(q: np.ndarray, x: np.ndarray) -> str:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return "float" if most < 2**53 else "long" if most < 2**62 else "big"


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.worst = np.full(n, -np.inf)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Candidates' scores for some rows; own holds True where the candidate is the query itself."""
        low = np.iinfo(np.int64)
        score = np.where(own, low.min, score)
        name = np.where(own, low.max, np.broadcast_to(ids, score.shape))
        score, name = np.hstack([self.score[rows], score]), np.hstack([self.id[rows], name])
        best = np.lexsort((name, ~score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(name, best, 1)
        full = self.id[rows, -1] != low.max
        self.worst[rows] = np.where(full, self.score[rows, -1].astype(float), -np.inf)


def search(queries: Tree, query_ids: np.ndarray, data: Tree, ids: np.ndarray, best: Best) -> None:
    """Walk both trees from their roots, best bound first within each split, and offer what pruning leaves to `best`."""
    exact = _exactness(queries.x, data.x)
    todo = [(0, 0)]
    while todo:
        a, c = todo.pop()
        qa, xc = queries.centre[a], data.centre[c]
        r, s = queries.radius[a], data.radius[c]
        rows = queries.order[queries.start[a] : queries.stop[a]]
        bound = float(queries.x[qa] @ data.x[xc]) + queries.norm[qa] * s + data.norm[xc] * r + r * s
        bound += 1e-9 * (1 + queries.norm[qa] + r) * (1 + data.norm[xc] + s)
        if bound < best.worst[rows].min():
            continue
        below, beside = data.children[c], queries.children[a]
        if not below and not beside:
            at = data.order[data.start[c] : data.stop[c]]
            score = _scores(queries.x[rows], data.x[at], exact)
            best.offer(rows, score, ids[at], ids[at][None, :] == query_ids[rows][:, None])
        elif below and (not beside or s >= r):
            near = data.x[[data.centre[i] for i in below]] @ queries.x[qa]
            gain = near + queries.norm[qa] * np.array([data.radius[i] for i in below])
            todo += [(a, below[i]) for i in np.argsort(gain, kind="stable")]
        else:
            todo += [(i, c) for i in beside]


def _pack(df: DataFrame, id_col: str, vector_col: str, scale: float, rows: int, label: str) -> DataFrame:
    """One row for every `rows` vectors of equal length: floor(scale * x) as doubles."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting, made = TaskContext.get().partitionId(), {}, 0

        def out(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, x = (np.concatenate(v) for v in zip(*waiting.pop(dim)))
            for i in range(0, len(ids), rows):
                if len(ids) - i < least:
                    waiting[dim] = [(ids[i:], x[i:])]
                    break
                own = ids[i : i + rows], x[i : i + rows]
                columns = [[f"{label}-{part}-{made}"], [dim], [len(own[0])], [own[0].tobytes()], [own[1].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], schema.names)
                made += 1

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        schema = pa.schema(list(zip(("part", "dim", "n", "ids", "vectors"), kinds)))
        for batch in batches:
            lists, names = batch.column(1), batch.column(0)
            offsets = np.asarray(lists.offsets)
            flat = lists.values.cast(pa.float64(), safe=False)
            values = np.floor(scale * flat.to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0)
            odd = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            size = np.diff(offsets)
            fine = np.asarray(lists.is_valid()) & np.asarray(names.is_valid()) & (size > 0) & (odd[offsets[1:]] == odd[offsets[:-1]])
            ids = names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(size[fine]):
                at = np.flatnonzero(fine & (size == dim))
                waiting.setdefault(int(dim), []).append((ids[at], values[offsets[at][:, None] + np.arange(dim)]))
                yield from out(int(dim), rows)
        for dim in list(waiting):
            yield from out(dim, 1)

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return chosen.mapInArrow(packed, PACKED)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])


def _thinned(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, those with the k + 1 smallest different ids, at most k of each: a query excludes all rows of one id."""
    key = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, group = np.unique(key, return_inverse=True)
    by = np.lexsort((ids, group))
    ordered, name = group[by], ids[by]
    fresh = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (name[1:] != name[:-1])))[: len(by)]
    different = np.cumsum(fresh)
    different = different - different[np.searchsorted(ordered, ordered)]
    copy = np.arange(len(by)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    chosen = np.sort(by[(different <= k) & (copy < k)])
    return ids[chosen], x[chosen]


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Rows that repeat an id are queries and candidates of their own; a query excludes all candidates of its id.
    """

    def met(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        parts = [np.zeros(0, "U1")], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        asked = [(row["part"], *_unpack(row)) for row in blocks.to_pylist()]
        asked = [(part, ids, Tree(x), Best(len(ids), k)) for part, ids, x in asked]
        for i in range(len(shards) if asked else 0):
            ids, x = _thinned(*_unpack(shards.slice(i, 1).to_pylist()[0]), k)
            tree = Tree(x)
            for _, query_ids, queries, best in asked:
                search(queries, query_ids, tree, ids, best)
        for part, ids, _, best in asked:
            full = best.id != np.iinfo(np.int64).max
            at = np.repeat(np.arange(len(ids), dtype=np.int32), full.sum(1))
            for column, value in zip(parts, (np.full(len(at), part), at, ids[at], best.id[full], best.score[full])):
                column.append(value)
        return pa.table([pa.array(np.concatenate(c).tolist() if i == 0 else np.concatenate(c), t) for i, (c, t) in enumerate(zip(parts, kinds))], names=names)

    names, kinds = ["part", "row", "query_id", "vec_id", "score"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    shards = stored(_pack(candidates, id_col, vector_col, scale, SHARD_ROWS, "x"), "shards")
    blocks = stored(_pack(queries, id_col, vector_col, scale, BLOCK_ROWS, "q"), "blocks")
    n_shards, n_blocks = max(1, shards.count()), max(1, blocks.count())
    of_blocks = -(-n_blocks // GROUP)
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_shards = max(-(-n_shards // GROUP), min(n_shards, -(-tasks // of_blocks)))  # smaller groups where there would be few
    group = lambda n: F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shards.withColumn("g", group(of_shards)).withColumn("h", every(of_blocks))
    right = blocks.withColumn("h", group(of_blocks)).withColumn("g", every(of_shards))
    key = ["dim", "g", "h"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, "part string, row int, query_id long, vec_id long, score long")
    best = Window.partitionBy("part", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
