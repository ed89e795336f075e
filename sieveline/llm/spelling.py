"""Spelling variants: a trie self-join over the vocabulary finds all words at edit distance one.

Words meet in prefix partitions. Two words of lengths L and L or L + 1 that differ in one place share all code points before
the place and all after it. So each word enters the tries of its length's class twice: by its first half, for places behind
it, and by its last half, for places before; a class's halves are (L + 1) // 2 places. A shard of more words than SHARD
is halved again within the places that it has left, until it is small enough or one place is left, where its size is bounded
by the alphabet. No word is left out and no pair is found in two shards.

In a task, shards are built into tries level by level, and active nodes (pairs of nodes at distance one) are propagated
down: from a node, two children of it are one replacement apart, and its child c is an insertion away from it; from there
both go on by the same letters. Where both nodes end words of the shard, the pair is emitted. An insertion in a run of
equal letters counts at the run's end only, which makes each pair's way down the trie unique.

Defined cases: null and empty texts have no words; a null doc_id is the empty string where it is hashed; repeated rows count
as often as they stand; an empty table gives no rows. Ties of n go to the smaller word in code-point order.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tune

MIN_CHARS, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Words of one shard, beyond which it is halved.
SHARD = 50_000
#: Words that a worker counts, or builds into tries, at a time.
HELD = 200_000
RUN = "[a-zÀ-ÿ]+"


def vocabulary(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters, each of which lost a code point where every divides the hash of it and its document."""
    tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        total: Counter[str] = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                begin = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(find(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    if len(w) < min_chars:
                        continue
                    h = zlib.crc32(w.encode(), begin)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_chars:
                            continue
                    total[w] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    words = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shards(rows: DataFrame) -> DataFrame:
    """With the shard: class, places left, and what all its words share at either end."""
    tail = F.greatest(F.lit(0), F.col("size") - F.col("hi"))
    shared = F.concat_ws(" ", "size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail))
    return rows.withColumn("shard", shared)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row for the places from the middle on, and for those before it."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    return _shards(rows.select("word", "n", "size", F.explode(halves).alias("p")).select("word", "n", "size", "p.lo", "p.hi"))


def partitioned(vocab: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, size, lo, hi, shard): every word in each shard where it may have near words; those of all pairs' places lo to hi."""
    n = F.length("word")
    classes = F.filter(F.array(n, n - 1), lambda x: x > 0)
    rows = vocab.select("word", "n", F.explode(classes).alias("size")).select("word", "n", "size", F.lit(0).alias("lo"), (F.col("size") + 1).alias("hi"))
    done, rows = [], _halved(rows)
    while True:
        large = rows.where("hi - lo > 1").groupBy("shard").agg(F.count("*").alias("words")).where(F.col("words") > shard).select("shard")
        if not large.limit(1).count():
            break
        large = materialize(large, "large")
        done.append(rows.join(large, "shard", "left_anti"))
        rows = _halved(rows.join(large, "shard", "left_semi"))
    return functools.reduce(DataFrame.unionByName, [*done, rows])


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges that begin at first and hold count: which range, and each number in it."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.repeat(first, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def near(words: list[str], shard: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, sorted within shards, of which one is an insertion or replacement from the other: each pair once, the shorter first."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(length) - length + lo
    middle = length - lo - np.maximum(0, size - hi)  # the code points that the shard's words don't share
    # the trie, a level at a time: nodes are numbered from the top, and in a level by parent and letter
    at, root = np.unique(shard, return_inverse=True)[1], len(np.unique(shard))
    level, parents, letters, over = [0, root], [np.full(root, -1)], [np.zeros(root, np.int64)], [np.full(root, -1)]
    span = np.zeros(root, np.int64)
    span[at] = hi - lo
    spans, depth = [span], 0
    over[0][at[middle == 0]] = np.flatnonzero(middle == 0)
    alive = np.flatnonzero(middle > 0)
    while len(alive):
        p, c = at[alive], points[begin[alive] + depth]
        new = np.ones(len(alive), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        at[alive] = level[-1] + np.cumsum(new) - 1
        depth += 1
        ends = alive[middle[alive] == depth]
        over.append(np.full(new.sum(), -1))
        over[-1][at[ends] - level[-1]] = ends
        parents.append(p[new])
        letters.append(c[new])
        spans.append(spans[-1][p[new] - level[-2]])
        level.append(level[-1] + int(new.sum()))
        alive = alive[middle[alive] > depth]
    parent, letter, word = np.concatenate(parents), np.concatenate(letters), np.concatenate(over)
    way = parent << 21 | letter  # ascending
    degree = np.bincount(parent[root:], minlength=len(parent))
    first = root + np.cumsum(degree) - degree

    def step(node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of them have a child by that letter, and the child."""
        q = node << 21 | letter
        i = np.minimum(np.searchsorted(way, q), len(way) - 1)
        ok = way[i] == q
        return ok, i

    def down(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Active nodes go on by the letters that both have."""
        which, child = _spread(first[a], degree[a])
        ok, other = step(b[which], letter[child])
        return child[ok], other[ok]

    left, right = [], []

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        x, y = word[a], word[b]
        ok = (x >= 0) & (y >= 0)
        x, y = x[ok], y[ok]
        ok = length[x] == size[x]  # two words of length L + 1 meet in their own class
        left.append(x[ok])
        right.append(y[ok])

    none = np.zeros(0, np.int64)
    same, longer = (none, none), (none, none)  # active pairs of one depth, and those whose second node is one deeper
    for d in range(depth + 1):
        emit(*same)
        emit(*longer)
        nodes = np.arange(level[d], level[d + 1])
        nodes = nodes[(spans[d] > d) & (degree[nodes] > 0)]
        which, child = _spread(first[nodes], degree[nodes])
        emit(nodes[which], child)
        pair, other = _spread(first[nodes[which]], degree[nodes[which]])
        child = child[pair]
        differ = child != other
        child, other = child[differ], other[differ]
        ok, deeper = step(child, letter[other])
        less = child < other
        new_same, new_longer = (child[less], other[less]), (other[ok], deeper[ok])
        same, longer = down(*same), down(*longer)
        same = np.concatenate([same[0], new_same[0]]), np.concatenate([same[1], new_same[1]])
        longer = np.concatenate([longer[0], new_longer[0]]), np.concatenate([longer[1], new_longer[1]])
    return np.concatenate(left), np.concatenate(right)


def near_words(vocab: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n) -> (word, near, near_n): each word with every word at edit distance one from it. Words are distinct and not empty."""
    rows = partitioned(vocab, shard).select("shard", "word", "n", "size", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table):
            key = t.column("shard").combine_chunks().dictionary_encode()
            of = key.indices.to_numpy()
            # a word that is alone in its shard has no partner there
            kept = np.flatnonzero(np.bincount(of)[of] > 1) if len(of) else of
            if not len(kept):
                return
            t, of = t.take(pa.array(kept)), of[kept]
            size, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("size", "lo", "hi"))
            words = t.column("word")
            a, b = near(words.to_pylist(), of, size, lo, hi)
            for x, y in ((a, b), (b, a)):
                for s in range(0, len(x), HELD):
                    i, j = pa.array(x[s : s + HELD]), pa.array(y[s : s + HELD])
                    yield from pa.table({"word": words.take(i), "near": words.take(j), "near_n": t.column("n").take(j)}).to_batches()

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n > HELD:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = t.column("shard").combine_chunks()
                # the last shard may go on in the next batch
                last = int(pc.index(keys, keys[-1]).as_py())
                yield from found(t.slice(0, last))
                held = t.slice(last).to_batches()
                n = t.num_rows - last
        if held:
            yield from found(pa.Table.from_batches(held))

    return rows.repartition("shard").sortWithinPartitions("shard", "word").mapInArrow(run, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): of links, each word's next one, the last that can be reached; the way doubles in each round. Links have no cycles."""
    links = materialize(links.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not links.join(on, "root", "left_semi").limit(1).count():
            return links
        old, links = links, materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        discard(old)


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n): each word's form is its near word of largest n, where that is ratio times its own or more."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    seen = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= F.lit(ratio) * F.col("n")
    return vocab.join(seen, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form_n).alias("form_n"))


def op11(documents: DataFrame) -> DataFrame:
    vocab = materialize(vocabulary(documents), "vocabulary")
    out = materialize(forms(vocab, near_words(vocab)), "forms")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 by its table, which a rule makes; near words by what is left of them without one code point.
OP11_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL
), b AS (
  SELECT run, n, list_prepend(4294967295, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)) AS bytes FROM d
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM b, t
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1
), v AS (SELECT * FROM w WHERE length(word) >= 6 AND n >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM x),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM y a JOIN y b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT y.word, v.word, v.n FROM y JOIN v ON y.less = v.word
  UNION SELECT v.word, y.word, y.n FROM y JOIN v ON y.less = v.word
), f AS (
  SELECT v.word, v.n, count(p.near)::BIGINT AS n_near, first(p.near ORDER BY p.near_n DESC, p.near) AS best, max(p.near_n) AS best_n FROM v LEFT JOIN p ON v.word = p.word GROUP BY v.word, v.n
), g AS (
  SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f
), c AS (
  WITH RECURSIVE c AS (SELECT word, coalesce(form, word) AS root, 0 AS k FROM g UNION ALL SELECT c.word, g.form, k + 1 FROM c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL)
  SELECT word, arg_max(root, k) AS root FROM c GROUP BY word
)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c ON g.word = c.word
"""
