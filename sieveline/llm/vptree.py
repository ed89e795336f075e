"""Nearest neighbours by vantage-point trees, one per shard, with pruning relaxed by a factor.

Rows belong to the cell of the nearest of some pivots (at most `pivots` rows, picked by hash); a cell of many rows is
dealt out over shards of about `shard_rows`. Each shard's vectors form a tree: a node keeps a vantage point and the median
distance to it, and splits the others into near and far halves. A query first searches the shards of its own cell. Then
it goes to those cells only that can hold something nearer than its k-th best so far, by the triangle inequality on the
cell's pivot and radius; in a tree, a half is skipped by the same rule: near if d - mu > best * factor, far if
mu - d > best * factor. With factor 1 nothing that could be among the nearest is skipped and the search is exact;
smaller factors prune more and may miss some.

A shard's rows come first, then the queries pass through its tree in blocks, so neither side is ever held whole. In a
leaf, products of matrices tell which rows can matter; their distances are then computed in full. A window keeps the k
best of all shards. In spaces where all distances are alike nothing can be skipped, and an exact search is queries x rows.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as candidates or as
queries; vectors of different dimensions never meet; equal vectors are all candidates, ties go to the smaller id; rows
that repeat an id are candidates each, but never of a query of that id; equal query rows are one query, rows that repeat
an id with other vectors are queries of their own, told apart by query_key; fewer than k candidates give as many rows; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_frame

LEAF = 1024
BLOCK = 512
#: Share by which a bound from rounded sums is widened.
SLACK = 1e-9


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in doubles, summed from the first component on: the same for equal rows wherever they stand. x: (dims, rows)."""
    total = np.zeros(x.shape[1])
    for j in range(x.shape[0]):
        d = x[j] - q[j]
        total += d * d
    return np.sqrt(total)


def squares(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, rounded, of all pairs (queries, columns of x), and how far off they may be for each query."""
    xx, qq = (x * x).sum(axis=0), (q * q).sum(axis=1)
    off = SLACK * (qq + (xx.max() if len(xx) else 0.0))
    return np.maximum(qq[:, None] + xx[None, :] - 2 * (q @ x), 0.0), off


class Best:
    """The k best so far of each query of a block: distances and ids, nearest first, ties to the smaller id."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, limit: np.ndarray):
        self.q, self.own, self.k = q, own, k
        self.d = [np.zeros(0)] * len(q)
        self.ids = [np.zeros(0, np.int64)] * len(q)
        self.kth = limit.copy()  # nothing farther matters

    def look(self, x: np.ndarray, ids: np.ndarray, who: np.ndarray) -> None:
        d2, off = squares(x, self.q[who])
        d2[ids[None, :] == self.own[who][:, None]] = np.inf
        reach = np.minimum(self.kth[who] ** 2 + off, np.inf)
        if len(ids) > self.k:
            reach = np.minimum(reach, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1] + 2 * off)
        i, j = np.nonzero((d2 <= reach[:, None]) & np.isfinite(d2))
        if not len(i):
            return
        total = np.zeros(len(i))
        q = self.q[who[i]]
        for c in range(x.shape[0]):
            step = x[c, j] - q[:, c]
            total += step * step
        total = np.sqrt(total)
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for s, e in zip(cuts, [*cuts[1:], len(i)], strict=True):
            w = who[i[s]]
            d, names = np.r_[self.d[w], total[s:e]], np.r_[self.ids[w], ids[j[s:e]]]
            order = np.lexsort((names, d))[: self.k]
            self.d[w], self.ids[w] = d[order], names[order]
            if len(order) == self.k:
                self.kth[w] = min(self.kth[w], self.d[w][-1])


class Tree:
    """Over the columns of x (dims, rows)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.root = self.build(x, ids)

    def build(self, x: np.ndarray, ids: np.ndarray):
        n = len(ids)
        if n <= LEAF:
            return (x, ids)
        v = int(self.rng.integers(n))
        d = distances(x, x[:, v])
        mu = float(np.median(d))
        near = d <= mu
        if near.all() or not near.any():  # at least half of the vectors are equally far, as copies are: no split helps
            near = d < mu
            if not near.any():
                return (x, ids)
        return (x[:, v], mu, self.build(x[:, near], ids[near]), self.build(x[:, ~near], ids[~near]))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> Best:
        """The k best of each of the queries (rows of q) that are no farther than its limit."""
        best = Best(q, own, k, np.full(len(q), np.inf) if limit is None else limit)

        def visit(node, who: np.ndarray, bound: np.ndarray) -> None:
            some = bound <= best.kth[who] * factor
            who, bound = who[some], bound[some]
            if not len(who):
                return
            if len(node) == 2:
                best.look(*node, who)
                return
            point, mu, near, far = node
            d = distances(q[who].T, point)
            slack = SLACK * (d + mu)
            to_near, to_far = np.maximum(bound, d - mu - slack), np.maximum(bound, mu - d - slack)
            first = d <= mu
            for side in (first, ~first):
                if side.any():
                    w, a, b = who[side], to_near[side], to_far[side]
                    for child, c in ((near, a), (far, b)) if side is first else ((far, b), (near, a)):
                        visit(child, w, c)

        visit(self.root, np.arange(len(q)), np.zeros(len(q)))
        return best


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """Pivots by dimension; a dimension without any is a cell of its own, numbered -dim."""

    def __init__(self, vectors: list[list[float]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        distinct = [np.array(v) for v in dict.fromkeys(map(tuple, vectors))]
        for dim in {len(v) for v in distinct}:
            at = [i for i, v in enumerate(distinct) if len(v) == dim]
            self.of[dim] = (np.array(at), np.stack([distinct[i] for i in at]).T)

    def away(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the cells, distances of each row to their pivots)."""
        numbers, pivots = self.of[dim]
        return numbers, np.stack([distances(x.T, pivots[:, j]) for j in range(pivots.shape[1])], axis=1)


def by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows (id, v, dim) with the nearest cell, the distance to its pivot, and a number that deals a cell's rows out."""
    share = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, count = share.value, 0
        for b in batches:
            for dim, at in by_dimension(b):
                part = b.take(pa.array(at))
                cell, far = np.full(len(at), -dim), np.zeros(len(at))
                if dim in cells.of:
                    numbers, d = cells.away(dim, matrix(part.column("v")))
                    j = d.argmin(axis=1)
                    cell, far = numbers[j], d[np.arange(len(at)), j]
                deal = np.arange(count, count + len(at))
                count += len(at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(deal)], [*part.schema.names, "cell", "far", "deal"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, cell int, far double, deal long")


def other_cells(queries: DataFrame, cells: Cells, radius: dict[int, float], factor: float) -> DataFrame:
    """queries (with limit and their own cell) -> a row for each further cell that may hold something within the limit."""
    share = queries.sparkSession.sparkContext.broadcast((cells, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radius = share.value
        for b in batches:
            for dim, at in by_dimension(b):
                if dim not in cells.of:
                    continue
                for s in range(0, len(at), 256):
                    part = b.take(pa.array(at[s : s + 256]))
                    numbers, d = cells.away(dim, matrix(part.column("v")))
                    reach = np.array([radius.get(int(c), -np.inf) for c in numbers])
                    bound = d - reach[None, :] - SLACK * (d + np.maximum(reach, 0)[None, :])
                    own, limit = part.column("cell").to_numpy(), part.column("limit").to_numpy()
                    i, j = np.nonzero((bound <= limit[:, None] * factor) & (numbers[None, :] != own[:, None]))
                    if len(i):
                        out = part.take(pa.array(i))
                        yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(numbers[j].astype(np.int32)))

    return queries.mapInArrow(run, queries.schema)


ASK = "id long, v array<double>, dim int, query_key long, limit double, cell int"


def search(rows: DataFrame, asked: DataFrame, parts: DataFrame, tasks: int, k: int, factor: float, seed: int) -> DataFrame:
    """rows (in cells), asked (a row for each query and cell) -> the k best of each query in each shard."""
    spread = lambda d: d.join(F.broadcast(parts), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    r = spread(rows).select("id", "v", "dim", F.lit(0).cast("long").alias("query_key"), F.lit(0.0).alias("limit"), F.lit(False).alias("ask"), F.xxhash64("cell", F.col("deal") % F.col("parts")).alias("key"))
    q = spread(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    q = q.select("id", "v", "dim", "query_key", "limit", F.lit(True).alias("ask"), F.xxhash64("cell", F.col("part").cast("long")).alias("key"))
    met = r.unionByName(q).repartition(tasks, "key").sortWithinPartitions("key", "ask", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for b in batches:
            keys, ask, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ask", "id"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (ask[1:] != ask[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                if keys[s] != at:
                    at, held, tree = keys[s], [], None
                part = b.slice(s, e - s)
                if not ask[s]:
                    held.append((matrix(part.column("v")), ids[s:e]))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(np.ascontiguousarray(np.concatenate([h[0] for h in held]).T), np.concatenate([h[1] for h in held]), seed)
                x, query, limit = matrix(part.column("v")), part.column("query_key").to_numpy(), part.column("limit").to_numpy()
                for c in range(0, len(x), BLOCK):
                    best = tree.search(x[c : c + BLOCK], ids[s + c : s + c + BLOCK], k, factor, limit[c : c + BLOCK])
                    n = [len(d) for d in best.d]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[c : c + BLOCK], n)) for a in (ids[s:e], query)] + [pa.array(np.concatenate(a)) for a in (best.ids, best.d)], ["query_id", "query_key", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, query_key long, vec_id long, score double")
    return best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 8192, pivots: int = 256, seed: int = 0) -> DataFrame:
    """rows, queries (id, v, dim) -> query_id, rank, vec_id, score, query_key."""
    spark = rows.sparkSession
    n = rows.count()
    want = max(1, min(pivots, -(-n // shard_rows)))
    cells = Cells([r.v for r in rows.orderBy(F.xxhash64("id", "v", F.lit(seed)), "id").limit(want).select("v").collect()])
    placed = materialize(in_cells(rows.select("id", "v", "dim"), cells), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).where((F.col("cell") >= 0) | (F.col("n") > shard_rows)).collect()
    parts = small_frame(spark, [(r.cell, -(-r.n // shard_rows)) for r in sizes], "cell int,parts int")
    tasks = max(1, min(20_000, sum(-(-r.n // shard_rows) for r in sizes)))
    once = queries.select("id", "v", "dim").distinct().withColumn("query_key", F.xxhash64("id", "v"))
    asked = materialize(in_cells(once, cells).withColumn("limit", F.lit(float("inf"))).select(*[x.split()[0] for x in ASK.split(", ")]), "queries")
    first = search(placed, asked, parts, tasks, k, factor, seed)
    if len(sizes) < 2:
        return first
    first = materialize(first, "first")
    limit = first.groupBy(F.col("query_id").alias("id"), "query_key").agg(F.when(F.count("*") >= k, F.max("score")).alias("l"))
    further = asked.join(limit, ["id", "query_key"], "left").withColumn("limit", F.coalesce("l", F.lit(float("inf")))).select(*asked.columns)
    more = search(placed, other_cells(further, cells, {r.cell: r.far for r in sizes}, factor), parts, tasks, k, factor, seed)
    return best_of(first.unionByName(more).select("query_id", "query_key", "vec_id", "score"), k)


def op7(embeddings: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    rows = usable(embeddings, "vec_id", "embedding")
    return nearest(rows, rows.where("id % 100 = 0"), k, factor).select("query_id", "rank", "vec_id", "score")


#: Exact, over all pairs of a query and a row; distances are summed in the same order.
OP7_SQL = r"""
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id, sqrt(list_reduce(list_transform(range(1, len(r.v) + 1), lambda i: (r.v[i] - q.v[i]) * (r.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM r q JOIN r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 10
"""
