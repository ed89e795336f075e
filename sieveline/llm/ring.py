"""Consistent-hash ring with virtual nodes and bounded loads, from DataFrame functions alone.

Each shard owns many points (virtual nodes) on a ring. A key belongs to the next point clockwise; if that point's shard
is full the key goes on clockwise to the next shard that has room. Keys on one arc all walk past the same shards, so the
walk is planned on the arcs' key counts (at most shards x virtual nodes rows, whatever the input), and each key then
finds its shard by its rank on its arc. Ranks come from fine cells (arc x cell) whose counts are summed, so no window
ever holds an arc whole.

Defined cases: a null text has size 1 and the checksum of nothing; null ids are keys like any other; rows that are equal
in every column are told apart by rank only; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_frame

RING = 1 << 30
#: Cells of an arc, and rows of a cell from which on there are more.
CELLS, CELL_ROWS = 16, 1_000_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order. A node's places depend on its number alone, so one more shard only adds points."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"node {s}.{v}".encode()).digest()[:8], "big") % RING
    return sorted({at(s, v): s for s in range(shards) for v in range(vnodes)}.items())


def walks(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each point, the distinct shards in the order in which a key that starts there meets them."""
    out, order = [[] for _ in points], []
    for i in range(2 * len(points) - 1, -1, -1):  # backwards, the latest shard met moves to the front
        s = points[i % len(points)][1]
        if s in order:
            order.remove(s)
        order.insert(0, s)
        out[i % len(points)] = list(order)
    return out


def plan(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, past the last, shard, first slot) for each run of an arc's keys.

    Round by round every arc offers what it has left to the next shard of its walk; shards take in ring order until full.
    """
    paths = walks(points, len(capacity))
    room, filled = list(capacity), [0] * len(capacity)
    left, taken, runs = dict(counts), dict.fromkeys(counts, 0), []
    for step in range(len(capacity)):
        for arc in sorted(left):
            if not left[arc] or step >= len(paths[arc]):
                continue
            s = paths[arc][step]
            if n := min(left[arc], room[s]):
                runs.append((arc, taken[arc], taken[arc] + n, s, filled[s]))
                room[s] -= n
                filled[s] += n
                taken[arc] += n
                left[arc] -= n
    return runs


def even_capacity(n: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Room for (1 + epsilon) times the mean; with epsilon 0 the room is n in all and counts are at most one apart."""
    if epsilon > 0:
        return [-(-int(n * (1 + epsilon) * 1_000_000) // (1_000_000 * shards)) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def arc_of(place: Column, points: list[tuple[int, int]]) -> Column:
    """The index of the first point at or after a place; past the last it is the first. A lookup in a coarse grid, then a short search."""
    grid = len(points)
    of = [p * grid // RING for p, _ in points]
    starts = [sum(o < g for o in of) for g in range(grid)]
    most = max(of.count(g) for g in set(of))
    cell = F.floor(place * grid / RING).cast("int")
    lit = lambda xs: F.lit(",".join(map(str, xs)))
    firsts, places = F.split(lit(starts), ",").cast("array<int>"), F.split(lit([p for p, _ in points]), ",").cast("array<bigint>")
    first = F.element_at(firsts, cell + 1)
    near = F.filter(F.slice(places, first + 1, most), lambda p: p < place)
    return ((first + F.size(near)) % len(points)).cast("int")


def shard_keys(df: DataFrame, key: list[Column], shards: int, vnodes: int = 128, epsilon: float = 0.0) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard). Columns named __* are taken."""
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    place = F.pmod(F.xxhash64(*key, F.lit("ring")), F.lit(RING))
    arc_cells = max(CELLS, -(-df.count() // (len(points) * CELL_ROWS)))
    marked = df.withColumn("__place", place)
    keyed = marked.withColumn("__arc", arc_of(F.col("__place"), points)).withColumn("__cell", F.pmod(F.xxhash64(*key, F.lit("cell")), F.lit(arc_cells)).cast("int"))
    cells = keyed.groupBy("__arc", "__cell").count().collect()  # at most shards x vnodes x CELLS rows, or a row for CELL_ROWS keys
    counts: dict[int, int] = {}
    firsts = []
    for r in sorted(cells, key=lambda r: (r["__arc"], r["__cell"])):
        firsts.append((r["__arc"], r["__cell"], counts.get(r["__arc"], 0)))
        counts[r["__arc"]] = counts.get(r["__arc"], 0) + r["count"]
    runs = plan(counts, points, even_capacity(sum(counts.values()), shards, epsilon))
    first = small_frame(spark, firsts, "__arc int,__cell int,__first bigint")
    run = small_frame(spark, runs, "__arc int,__from bigint,__to bigint,shard int,__slot bigint")
    ranked = keyed.withColumn("__n", F.row_number().over(W.partitionBy("__arc", "__cell").orderBy("__place", *key)) - 1)
    ranked = ranked.join(F.broadcast(first), ["__arc", "__cell"]).withColumn("__rank", F.col("__n") + F.col("__first"))
    placed = ranked.join(F.broadcast(run), (ranked["__arc"] == run["__arc"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return placed.select(*df.columns, F.col("shard").cast("int"), (F.col("__slot") + F.col("__rank") - F.col("__from")).cast("long").alias("slot"))


def op3(documents: DataFrame, shards: int = 8) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return shard_keys(rows, key, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
