"""Conversation prefix tries: which conversations share which first turns, and what storing each shared turn once saves.

A turn's label is a hash of 128 bits of its role and text; a prefix is named by the exclusive or of the hashes of its labels
and their places. Texts are hashed where they are read and move nowhere. Nodes over HEAVY turns of whose conversations stand at
or below them form the upper levels; what hangs below them are prefix shards of at most HEAVY turns. A task gathers whole
shards up to BUNDLE turns and builds one succinct trie of them in numpy: LOUDS bits and an array of labels, in level order.
Parents are read off the bits, and np.add.at in reverse level order rolls leaves and savings up to the shards' roots.

The upper levels are merged apart from that, without rounds: a conversation owns the nodes whose smallest member it is, which are
the last of its path. What it owns (and the rolled-up shard, if it owns that one's root) is summed from its end upwards along
its own path, and each upper node adds this up over its members, with a combine before the shuffle.

Ranks and sums along a conversation go by cells of CELL places, whose totals are summed first, so that no window holds a
long conversation whole.

Defined cases: null role or text is empty; null turns come first; turns of one number come in the order of their labels, repeated
rows among them; rows without conv_id belong to no conversation; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tune

HEAVY, BUNDLE = 1024, 65_536
CELL = 12  # as a power of two
EMPTY = hashlib.sha256(b"").hexdigest()
#: Conversations whose numbers have the same quotient by GROUP begin alike, by up to MOST - 1 turns.
GROUP, MOST = 5, 9


def labelled(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, l1, l2, bytes): each turn by the hashes of its role and text, and its text's length in UTF-8."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = conversations.where("conv_id IS NOT NULL")
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("l1"), F.xxhash64(F.lit(1), role, text).alias("l2"), F.octet_length(text).cast("long").alias("bytes"))


def running(rows: DataFrame, cell: Column, order: list, totals: dict[str, tuple], back: bool = False) -> DataFrame:
    """rows with running totals along each conv_id (name -> aggregate, column, how two totals make one), this row included. cell: grows with the order."""
    cells = F.col("cell").desc() if back else F.col("cell")
    rows = rows.withColumn("cell", cell)
    within = W.partitionBy("conv_id", "cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv_id").orderBy(cells).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "cell").agg(*(f(c).alias(n) for n, (f, c, _) in totals.items()))
    sums = sums.select("conv_id", "cell", *(F.coalesce(f(n).over(before), F.lit(0)).alias(f"{n}_before") for n, (f, _, _) in totals.items()))
    inner = rows.select("*", *(f(c).over(within).alias(n) for n, (f, c, _) in totals.items()))
    out = inner.join(sums, ["conv_id", "cell"])
    return out.select(*(c for c in rows.columns if c != "cell"), *(how(F.col(n), F.col(f"{n}_before")).alias(n) for n, (_, _, how) in totals.items()))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def ranked(turns: DataFrame) -> DataFrame:
    """labelled turns with their place k from 1: by turn, null first, ties by label."""
    cell = F.coalesce(F.shiftright("turn", CELL), F.lit(-(1 << 62)))
    return running(turns, cell, [F.col("turn").asc_nulls_first(), "l1", "l2"], {"k": (F.sum, F.lit(1).cast("long"), _plus)}).drop("turn")


def rebuilt(places: DataFrame, group: int = GROUP, most: int = MOST) -> DataFrame:
    """ranked turns -> sequences, (conv_id, pos, l1, l2, bytes, length): the first h turns of the group's first conversation, then the own ones after h.

    h is the number's CRC-32 modulo most. A row of pos 0 stands for each conversation's beginning, turnless ones too.
    """
    own = places.groupBy("conv_id").agg(F.max("k").alias("n"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = own.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = materialize(own.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    head = places.where(F.col("k") < most).withColumnRenamed("conv_id", "base")
    head = own.join(head, "base").where("k <= taken").select("conv_id", F.col("k").alias("pos"), "l1", "l2", "bytes", "length")
    rest = own.join(places, "conv_id").where("k > h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).alias("pos"), "l1", "l2", "bytes", "length")
    zero = F.lit(0).cast("long")
    return own.select("conv_id", zero.alias("pos"), zero.alias("l1"), zero.alias("l2"), zero.alias("bytes"), "length").unionAll(head).unionAll(rest)


def paths(sequences: DataFrame) -> DataFrame:
    """sequences with the names of the prefix that ends here (p1, p2) and of the one before (q1, q2); the beginning's is 0, 0."""
    g = [F.when(F.col("pos") == 0, 0).otherwise(F.xxhash64(F.lit(i), "l1", "l2", "pos")) for i in (2, 3)]
    both = lambda a, b: a.bitwiseXOR(b)
    rows = sequences.withColumns({"g1": g[0], "g2": g[1]})
    rows = running(rows, F.shiftright("pos", CELL), ["pos"], {f"p{i}": (F.bit_xor, F.col(f"g{i}"), both) for i in (1, 2)})
    return rows.withColumns({f"q{i}": both(F.col(f"p{i}"), F.col(f"g{i}")) for i in (1, 2)}).drop("g1", "g2")


class Louds:
    """A forest in level order. Its bits have a 1 for each root and a 0, then for each node a 1 for each child and a 0; the i-th 1 is node i."""

    def __init__(self, root: np.ndarray, conv: np.ndarray, pos: np.ndarray, labels: np.ndarray):
        """Rows of sequences in the order of conv and pos, all places of a conversation below its root's; labels: (rows, 2)."""
        first = np.r_[True, conv[1:] != conv[:-1]] if len(conv) else np.zeros(0, bool)
        depth = np.arange(len(conv)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.node = np.zeros(len(conv), np.int64)  # of each row
        rows, above, n = np.flatnonzero(depth == 0), None, 0
        degree, self.levels, names = [], [], []
        while len(rows):
            up = root[rows] if above is None else self.node[rows - 1]
            order = np.lexsort((labels[rows, 1], labels[rows, 0], up))
            rows, up = rows[order], up[order]
            new = np.r_[True, (up[1:] != up[:-1]) | (labels[rows[1:]] != labels[rows[:-1]]).any(axis=1)]
            if above is None:
                degree.append(np.array([new.sum()]))
            else:
                degree.append(np.bincount(up[new] - above[0], minlength=above[1] - above[0]))
            self.node[rows] = n + np.cumsum(new) - 1
            above = (n, n + int(new.sum()))
            names.append(labels[rows[new]])
            self.levels.append(above)
            n = above[1]
            rows = np.flatnonzero(depth == len(self.levels))
        degree.append(np.zeros(above[1] - above[0] if above else 0, np.int64))
        ends = np.cumsum(np.concatenate(degree) + 1) - 1
        self.bits = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
        self.bits[ends] = 0
        self.labels = np.concatenate(names) if names else np.zeros((0, 2), np.int64)

    @staticmethod
    def parents(bits: np.ndarray) -> np.ndarray:
        """Each node's parent, -1 for roots: the zeros before its 1, less the roots' one."""
        ones = np.flatnonzero(bits)
        return ones - np.arange(len(ones)) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree."""
        out, parent = values.copy(), self.parents(self.bits)
        for a, b in reversed(self.levels[1:]):
            np.add.at(out, parent[a:b], out[a:b])
        return out


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD = ["s1", "s2", "conv_id", "pos", "l1", "l2", "bytes", "length", "above"]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole shards, of rows that come sorted by them, some BUNDLE rows at a time."""
    held, n = [], 0

    def arrays(t: pa.Table):
        return {c: t.column(c).to_numpy() for c in _SHARD}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n > BUNDLE:
            t = pa.Table.from_batches(held).combine_chunks()
            s1, s2 = t.column("s1").to_numpy(), t.column("s2").to_numpy()
            last = int(np.argmax((s1 == s1[-1]) & (s2 == s2[-1])))  # it may go on in the next batch
            if last:
                yield arrays(t.slice(0, last))
            held, n = t.slice(last).to_batches(), t.num_rows - last
    if held:
        yield arrays(pa.Table.from_batches(held))


def _trie(x: dict[str, np.ndarray]) -> Louds:
    first = np.r_[True, (x["s1"][1:] != x["s1"][:-1]) | (x["s2"][1:] != x["s2"][:-1])]
    return Louds(np.cumsum(first) - 1, x["conv_id"], x["pos"], np.stack([x["l1"], x["l2"]], axis=1))


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _bundles(batches):
        t = _trie(x)
        count, parent, node = len(t.labels), Louds.parents(t.bits), t.node
        n, least, depth, size, above = (np.zeros(count, np.int64) for _ in range(5))
        np.add.at(n, node, 1)
        least[:] = np.iinfo(np.int64).max
        np.minimum.at(least, node, x["conv_id"])
        depth[node], size[node], above[node] = x["pos"], x["bytes"], x["above"]
        children = np.zeros(count, np.int64)
        np.add.at(children, parent[parent >= 0], 1)
        leaves = t.rolled_up((children == 0).astype(np.int64))
        saved = t.rolled_up((n - 1) * size)
        ends = np.full(count, EMPTY, object)
        at = np.flatnonzero(x["pos"] == x["length"])
        at = at[np.lexsort((x["conv_id"][at], node[at]))]
        for same in np.split(at, np.flatnonzero(np.diff(node[at])) + 1) if len(at) else ():
            ends[node[same[0]]] = hashlib.sha256(",".join(map(str, x["conv_id"][same].tolist())).encode()).hexdigest()
        up = np.where(parent >= 0, least[parent], above)
        yield from pa.table({"conv_id": least, "depth": depth, "parent_conv_id": up, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends, pa.string()), "top": parent < 0}).to_batches()


def _shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _bundles(batches):
        t = _trie(x)
        start = np.flatnonzero(np.r_[True, np.diff(x["s1"]) != 0] | np.r_[True, np.diff(x["s2"]) != 0])
        yield pa.RecordBatch.from_pydict(
            {"roots": [[{"s1": int(a), "s2": int(b)} for a, b in zip(x["s1"][start], x["s2"][start], strict=True)]], "nodes": [len(t.labels)], "bits": [np.packbits(t.bits).tobytes()], "labels": [t.labels.astype("<i8").tobytes()]},
            schema=pa.schema([("roots", pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64())]))), ("nodes", pa.int64()), ("bits", pa.binary()), ("labels", pa.binary())]),
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists, sorted by node and place, hashed one after the other: a list is never held whole."""
    last, sha, out = None, None, []
    for b in batches:
        for *node, ids in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
            if node != last:
                if sha:
                    out.append((*last, sha.hexdigest()))
                last, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["p1", "p2", "ends_sha256"])
            out = []
    if sha:
        out.append((*last, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["p1", "p2", "ends_sha256"])


def split(prefixes: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """paths -> (rows of the upper nodes, the upper nodes, rows of the shards with their root's name and the node above it)."""
    weight = F.sum(F.col("length") - F.col("pos") + 1)
    large = prefixes.groupBy("p1", "p2").agg(weight.alias("w"), F.min("pos").alias("pos")).where((F.col("w") > heavy) | (F.col("pos") == 0))
    large = materialize(large.select("p1", "p2", F.lit(True).alias("upper")), "large")
    marked = materialize(prefixes.join(large, ["p1", "p2"], "left"), "marked")
    upper, below = marked.where("upper"), marked.where("upper IS NULL")
    nodes = upper.groupBy("p1", "p2").agg(*(F.min(c).alias(c) for c in ("conv_id", "pos", "bytes", "q1", "q2")), F.count("*").alias("n_convs"))
    nodes = materialize(nodes, "upper")
    root = below.groupBy("conv_id").agg(F.min(F.struct("pos", "p1", "p2", "q1", "q2")).alias("r")).select("conv_id", F.col("r.p1").alias("s1"), F.col("r.p2").alias("s2"), F.col("r.q1").alias("p1"), F.col("r.q2").alias("p2"))
    root = root.join(nodes.select("p1", "p2", F.col("conv_id").alias("above")), ["p1", "p2"]).drop("p1", "p2")
    return upper, nodes, below.join(root, "conv_id").select(*_SHARD)


def _sharded(rows: DataFrame) -> DataFrame:
    tune(rows.sparkSession)
    return rows.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id", "pos")


def tries(sequences: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(roots, nodes, bits, labels): the succinct tries. Bits are packed, the first one highest; labels are 16 bytes for each node."""
    rows = split(materialize(paths(sequences), "paths"), heavy)[2]
    return _sharded(rows).mapInArrow(_shard_tries, "roots array<struct<s1: long, s2: long>>, nodes long, bits binary, labels binary")


def nodes(sequences: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A row for each node, with the counts of its members and the sums over its subtree."""
    upper, top, rows = split(materialize(paths(sequences), "paths"), heavy)
    shards = materialize(_sharded(rows).mapInArrow(_shard_nodes, _NODE + ", top boolean"), "shards")
    hung = shards.where("top")
    # children of upper nodes: other upper nodes, and shards, by the smallest member of the node that they hang from
    below = top.where("pos > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.lit(1).alias("c"))
    at = top.select("p1", "p2", F.col("conv_id").alias("parent_conv_id"), (F.col("pos") + 1).alias("depth"))
    below = below.unionAll(hung.groupBy("parent_conv_id", "depth").agg(F.count("*").alias("c")).join(at, ["parent_conv_id", "depth"]).select("p1", "p2", "c"))
    children = below.groupBy("p1", "p2").agg(F.sum("c").alias("n_children"))
    top = materialize(top.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "children")
    # what each conversation owns at each place of its path
    owned = top.select("conv_id", "pos", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    owned = owned.unionAll(hung.select("conv_id", (F.col("depth") - 1).alias("pos"), F.col("n_leaves"), F.col("saved_tokens")))
    owned = owned.groupBy("conv_id", "pos").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = upper.select("conv_id", "pos", "p1", "p2").join(owned, ["conv_id", "pos"], "left").fillna(0, ["leaves", "saved"])
    along = running(along, F.shiftright("pos", CELL), [F.col("pos").desc()], {n: (F.sum, F.col(c), _plus) for n, c in (("n_leaves", "leaves"), ("saved_tokens", "saved"))}, back=True)
    sums = along.groupBy("p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ids = upper.where("pos = length").groupBy("p1", "p2", F.shiftright("conv_id", 10).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ids.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "bucket").select("p1", "p2", "ids").mapInArrow(_digest, "p1 long, p2 long, ends_sha256 string")
    up = top.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    parent = F.when(F.col("pos") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    out = top.join(sums, ["p1", "p2"]).join(ends, ["p1", "p2"], "left").join(up, ["q1", "q2"], "left")
    out = out.select("conv_id", F.col("pos").alias("depth"), parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return out.unionByName(shards.drop("top"))


def op12(conversations: DataFrame) -> DataFrame:
    turns = materialize(labelled(conversations), "turns")
    return nodes(rebuilt(materialize(ranked(turns), "ranked")))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), x AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), c AS (SELECT conv_id, conv_id::VARCHAR AS s, list(turn ORDER BY k) AS turns FROM t GROUP BY conv_id),
b AS (SELECT *, list_prepend(4294967295, list_transform(range(length(s)), lambda i: ascii(substr(s, i + 1, 1))::BIGINT)) AS bytes FROM c),
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(bytes, lambda c, y: xor(c >> 8, x.t[(xor(c, y) & 255) + 1]))) % 9 AS h FROM b, x),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(f.turns, 1, h.h), []), coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), [])) AS path
  FROM h LEFT JOIN c f ON f.conv_id = h.conv_id - h.conv_id % 5
), p AS (SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM r),
q AS (SELECT conv_id, n, depth, list_slice(path, 1, depth) AS path FROM p),
g AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends,
    CASE WHEN depth > 0 THEN strlen(path[depth]['text']) ELSE 0 END AS bytes
  FROM q GROUP BY depth, path
), u AS (SELECT g.depth, g.path, m.conv_id AS parent, g.conv_id FROM g LEFT JOIN g m ON g.depth > 0 AND m.depth = g.depth - 1 AND m.path = list_slice(g.path, 1, g.depth - 1)),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON g.path = k.path),
a AS (SELECT *, unnest(range(depth + 1)) AS up FROM f),
s AS (SELECT list_slice(path, 1, up) AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM a GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.parent AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON f.path = u.path JOIN s ON f.path = s.path
"""
