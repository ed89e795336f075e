"""Each corpus operator against a brute-force version or an exact round trip, on a small table with the awkward cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, imatch, jaccard, licenses, mixing, packing, passages, ring, toxicity, vptree, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long, __k string, score string, size string, shard string"


def words(r, n):
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('bcdfglmnprst')}{r.randrange(60)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    passage = " ".join(words(r, 60))
    base = words(r, 150)
    out = [(i, " ".join(words(r, r.randrange(3, 120)))) for i in range(60)]
    out += [(60 + i, " ".join(base[: 20 + i] + ["new"] * (i % 3) + base[21 + i :])) for i in range(12)]
    out += [(72 + i, " ".join(words(r, 40)) + "\n" + passage + "\n" + " ".join(words(r, 40))) for i in range(4)]
    out += [(76, ""), (77, None), (78, "  \t\n "), (79, "one"), (80, "One"), (81, out[5][1]), (82, out[5][1]), (83, " ".join(words(r, 9000))), (84, "ünï © ½ " * 9)]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", "x", "x", "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("limits", [(1024, 512), (3, 2)])  # the second sends groups down the distributed paths
def test_jaccard_join(docs, nothing, rows, limits, monkeypatch):
    monkeypatch.setattr(jaccard, "BALL", limits[0])
    monkeypatch.setattr(jaccard, "LOCAL", limits[1])
    s = sets(rows, 4)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6(docs).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in s}
    assert jaccard.op6(nothing).count() == 0


def test_one_of_each_keeps_columns_and_null_ids(spark, docs):
    more = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    out = jaccard.one_of_each(more)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(5) == 1 and 81 not in ids and ids.count(None) == 1


def test_passages(docs, nothing, rows):
    seen, need = {}, defaultdict(set)
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        w = (t or "").encode().lower().split()
        for j in range(len(w) - 50):
            key = tuple(w[j : j + 51])
            if seen.setdefault(key, i) != i:
                need[i].update(range(j, j + 51))
    got = defaultdict(set)
    for r in passages.find(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    for i in need:
        assert len(need[i] & got[i]) >= 0.95 * len(need[i])
    assert not set(got) & set(range(60))  # texts that share nothing are left alone
    assert passages.find(nothing).count() == 0
    left = {r.doc_id: r for r in passages.cut_out(docs, passages.find(docs)).collect()}
    assert 82 not in left or len(left[82].text) < 10 or (5 not in need)
    assert len(left[73].text.split()) == 80 and left[73].n_chars == len(left[73].text)
    assert left[72].text == next(r[1] for r in rows if r[0] == 72) and 77 in left


def covered(spark, texts):
    """doc_id -> the words of it that passages.find reports."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in passages.find(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return got


def test_passage_before_a_shared_line(spark):
    texts, r = {}, random.Random(11)
    word = lambda: f"w{r.randrange(10**9)}"
    for n in range(40):
        shared, line = [word() for _ in range(60)], [word() for _ in range(3)]
        for side in (0, 1):
            filler = [[word() for _ in range(20)] for _ in range(3)]
            texts[2 * n + side] = " ".join(filler[0] + (line + filler[1] if n % 2 else []) + shared + filler[2] + line)
    got = covered(spark, texts)
    for n in range(40):
        at = 43 if n % 2 else 20
        assert got[2 * n + 1] == set(range(at, at + 60))


def test_passage_whose_seeds_smaller_documents_have(spark):
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    shared = [word() for _ in range(55)]
    texts = {i + 1: " ".join([word() for _ in range(20)] + shared[i : i + 5] + [word() for _ in range(20)]) for i in range(51)}
    for i in (100, 101):
        texts[i] = " ".join([word() for _ in range(30)] + shared + [word() for _ in range(30)])
    assert covered(spark, texts) == {101: set(range(30, 85))}


def blocks(rows, buckets):
    cols = [np.array(c, np.int64) for c in zip(*rows)]
    return [r for b in passages.combined(*cols, buckets) for r in b.to_pylist()]


def matches_in(blobs):
    return [tuple(int(c[i]) for c in cols) for cols in map(passages.unpack_by, blobs) for i in range(len(cols[0]))]


@pytest.mark.parametrize("buckets, many", [(1, 8), (7, 1000)])
def test_links(spark, buckets, many, monkeypatch):
    """What several buffers hold, matched in them or behind the shuffle."""
    r = random.Random(5)
    h = [(x << 30) | (x & 1) for x in range(12)]
    rows = sorted({(h[r.randrange(12)], r.randrange(-4, 5), r.randrange(3)) for _ in range(200)})
    monkeypatch.setattr(passages, "MANY", many)
    parts = [[(a, d, w, 10 * w, 7) for a, d, w in rows if d % 2 == p] for p in (0, 1)]
    made = [b for p in parts for b in blocks(p, buckets)]
    d = spark.createDataFrame([(x["bucket"], x["doc_bucket"], bytearray(x["blob"])) for x in made], passages.MATCHES)
    got = matches_in(x.blob for x in passages.links(d, buckets).collect())
    assert all(g[1] in (0, 1, 2) and g[3] == 10 * g[2] and g[0] > g[5] and (g[4], g[8]) == (7, 7) for g in got)
    if many == 1000:
        want = []
        for a, doc, w in rows:
            less = sorted({x[1] for x in rows if x[0] == a and x[1] < doc})
            for m in sorted({less[0], less[-1]} if a % 2 == 0 else {less[0]}) if less else []:
                want.append((doc, passages.LONG if a % 2 else passages.FIRST if m == less[0] else passages.SECOND, w, m, min(x[2] for x in rows if x[:2] == (a, m))))
        assert sorted((g[0], g[1], g[2], g[5], g[6]) for g in got) == sorted(want)
    # every row of a seed that a smaller document has is matched at least once
    assert {(g[0], g[2]) for g in got} == {(x[1], x[2]) for x in rows if any(y[0] == x[0] and y[1] < x[1] for y in rows)}


def test_packed_blocks_are_read_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        cols = [r.integers(-(2**62), 2**62, n), r.integers(0, 3, n), r.integers(0, 70_000, n)]
        assert all((a == b).all() for a, b in zip(cols, passages.unpacked(passages.packed(*cols)), strict=True))
        ids = r.integers(-5, 5, n) * 2**60
        assert all((a == b).all() for a, b in zip([ids, *cols], passages.unpack_by(passages.pack_by(ids, *cols)), strict=True))


def test_a_buffer_matches_what_many_have():
    rows = [(h, d, d * 10 + p, 0, 0) for h in (6, 7) for d in range(12) for p in range(2)] + [(9, d, 5, 0, 0) for d in range(3)]
    out = blocks(rows, 3)
    left = [(int(h), int(d)) for x in out if x["doc_bucket"] < 0 for d, h in [passages.unpack_by(x["blob"])[:2]] for h, d in zip(np.cumsum(h), d)]
    assert sorted(left) == [(6, 0), (6, 0), (7, 0), (7, 0), (9, 0), (9, 1), (9, 2)]
    links = matches_in(x["blob"] for x in out if x["doc_bucket"] >= 0)
    want = [(d, 0, k) for d in range(1, 12) for k in (passages.LONG, passages.SHORT)] + [(d, d - n, passages.SHORT) for n in range(1, passages.NEXT + 1) for d in range(n + 1, 12)]
    assert Counter((g[0], g[5], g[1]) for g in links) == Counter({x: 2 for x in want}) and all(g[6] == 10 * g[5] for g in links)


def test_no_run_is_lost_between_holders_of_its_pieces(spark):
    """60 equal words, of which six smaller documents have a piece of 19 each; then pieces of 45 words that overlap."""
    r = random.Random(14)
    word = lambda: f"w{r.randrange(10**9)}"
    filler = lambda n: [word() for _ in range(n)]
    shared, other = filler(60), filler(100)
    texts = {i: " ".join(filler(20) + shared[at : at + 19] + filler(20)) for i, at in enumerate(range(0, 48, 8))}
    texts |= {20 + i: " ".join(filler(20) + other[at : at + 45] + filler(20)) for i, at in enumerate((0, 30, 55))}
    for i in (100, 101):
        texts[i] = " ".join(filler(30) + shared + filler(30) + other + filler(10))
    got = covered(spark, texts)
    assert set(got) == {101, 100} and got[101] >= set(range(30, 90)) | set(range(120, 220)) and got[100] <= set(range(120, 220))


def test_every_exact_run_is_found(spark):
    """Against brute force over all runs of 50 words."""
    documents = common.read_table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in documents.collect()}
    seen, need = {}, defaultdict(set)
    for i in sorted(texts):
        w = texts[i]
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) != i:
                need[i].update(range(j, j + 50))
    got = defaultdict(set)
    for r in passages.find(documents).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert need and sum(len(need[i] - got[i]) for i in need) == 0


def test_repeated_ids_and_clashing_columns(spark):
    r = random.Random(15)
    filler = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    shared = filler(60)
    rows = [(1, f"{filler(30)} {shared}"), (2, f"a {filler(30)} {shared} {filler(5)}"), (2, "z " * 20 + shared), (None, shared), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' AS __id", "1 AS __spans", "'x' AS exact", "length(text) AS n_chars")
    found = passages.find(d)
    assert {(x.doc_id, x.start_word, x.end_word) for x in found.collect()} == {(2, 31, 91)}
    out = passages.cut_out(d, found)
    assert out.columns == d.columns and {x["__id"] for x in out.collect()} == {"kept"}
    assert sorted((x.text or "").count(" ") for x in out.where("doc_id = 2").collect()) == [36, 79]
    assert out.where("doc_id IS NULL").first().text == shared and out.count() == 6


@pytest.mark.parametrize("share, least", [(0.05, 0.97), (0.1, 0.9), (0.15, 0.7)])
def test_passages_with_words_changed_at_random(spark, share, least):
    texts, r = {}, random.Random(16)
    word = lambda: f"w{r.randrange(10**9)}"
    for n in range(100):
        shared = [word() for _ in range(80)]
        for side, part in enumerate((shared, [word() if r.random() < share else w for w in shared])):
            texts[2 * n + side] = " ".join([word() for _ in range(60)] + part + [word() for _ in range(60)])
    got = covered(spark, texts)
    assert sum(len(got[2 * n + 1] & set(range(60, 140))) >= 40 for n in range(100)) >= 100 * least


@pytest.mark.parametrize("every, inserted, least", [(10, False, 0.99), (8, False, 0.95), (6, False, 0.5), (10, True, 0.99)])
def test_passages_with_changed_words(spark, every, inserted, least):
    texts, r = {}, random.Random(13)
    word = lambda: f"w{r.randrange(10**9)}"
    for n in range(100):
        shared = [word() for _ in range(60)]
        changed = [x for i, w in enumerate(shared) for x in (([w, word()] if inserted else [word()]) if i % every == every // 2 else [w])]
        for side, part in enumerate((shared, changed)):
            texts[2 * n + side] = " ".join([word() for _ in range(30)] + part + [word() for _ in range(30)])
    got = covered(spark, texts)
    assert sum(len(got[2 * n + 1]) >= 50 for n in range(100)) >= 100 * least


def test_chain_is_the_best_of_all():
    r = random.Random(3)
    for _ in range(30):
        x, y = np.array([r.randrange(60) for _ in range(9)]), np.array([r.randrange(60) for _ in range(9)])
        best = 0.0
        for m in range(1, 1 << 9):
            p = sorted((int(x[i]), int(y[i])) for i in range(9) if m >> i & 1)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(p, p[1:])):
                best = max(best, 5.0 * len(p) - passages.GAP * (p[-1][0] - p[0][0] + p[-1][1] - p[0][1]))
        c = passages.chains(x, y, 5.0)
        first = c[0]
        got = 5.0 * len(first) - passages.GAP * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert abs(got - best) < 1e-9 and sorted(i for p in c for i in p) == list(range(9))


def test_ring(docs, nothing, rows):
    out = ring.op3(docs).collect()
    assert len(out) == len(rows)
    n = Counter(r.shard for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in out)
    assert ring.op3(nothing).count() == 0


def test_ring_walk_is_sequential_and_moves_little(spark):
    keys = spark.range(4000)
    at = {n: {r.id: r.shard for r in ring.shard_keys(keys, [F.col("id")], n, 64, 0.25).collect()} for n in (8, 9)}
    assert max(Counter(at[8].values()).values()) <= 4000 * 1.25 / 8 + 2
    assert sum(at[8][i] != at[9][i] for i in at[8]) < 0.35 * 4000
    points = ring.ring_points(3, 4)
    counts = {a: 5 for a in range(len(points))}
    runs = ring.plan(counts, points, ring.even_capacity(60, 3))
    assert sum(b - a for _, a, b, _, _ in runs) == 60


def test_mixing(docs, nothing, rows):
    out = mixing.op9(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert {r.doc_id: r["size"] for r in out} == size
    of = {r[0]: r[3] for r in rows}
    total = Counter()
    for i in size:
        total[of[i]] += size[i]
    names = sorted(x for x in total if x is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free, target, left = set(names), {}, 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[of[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(size[i] for i in size if of[i] == s)
    assert sorted(map(tuple, mixing.op9(docs).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.op9(nothing).count() == 0
    copies = Counter(r.doc_id for r in mixing.mix_in(docs).collect())
    want = {r.doc_id: r.taken // r["size"] for r in out if r["size"]}
    assert sum(abs(copies[i] - want[i]) for i in want) <= len(names) * 4


def test_packing(docs, nothing, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    out = defaultdict(list)
    for r in packing.op4(docs, 512).collect():
        out[r.doc_id].append(r)
    bins = defaultdict(list)
    for i, t, *_ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(out[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(p, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 512))]
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    total = sum(n for p in bins.values() for _, n in p)
    assert len(bins) <= -(-total // 512) * 1.2 + 1
    assert packing.op4(nothing).count() == 0


def test_plan_is_best_fit():
    r = random.Random(1)
    for _ in range(20):
        counts = Counter(r.randrange(1, 101) for _ in range(200))
        rooms: list[int] = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(100 - n)
        runs = packing.plan(counts, 100)
        used = {s + (k - a) // e for _, a, b, s, e, _ in runs for k in range(a, b)}
        assert len(used) == len(rooms)


def test_toxicity(spark, nothing):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, 40) + (["grumble", "grumbler"] if i % 6 == 0 else []))) for i in range(600)]
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "grumble")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 600, 2)] + [(1, 1, None), (0, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.op5(d, labels).collect()}
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    right = [out[i].predicted == (i % 6 == 0) for i in range(600) if out[i].held_out]
    assert sum(right) >= 0.95 * len(right)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in toxicity.op5(d, flipped).collect()}
    assert toxicity.op5(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.op5(d, labels.where("false")).collect()} == {0}


def test_fit_minimises_the_non_negative_risk():
    """Against the risk written out: no small step from the fit lowers it by much, and it is well below that of no model."""
    r = np.random.default_rng(5)
    positive = [np.unique(np.r_[r.integers(0, 6, 3), r.integers(20, 60, 8)]) for _ in range(60)]
    unlabelled = [np.unique(r.integers(20, 60, 9)) if i % 5 else np.unique(np.r_[r.integers(0, 6, 3), r.integers(20, 60, 8)]) for i in range(300)]
    prior = 0.2
    names, w, bias = toxicity.fit(positive, unlabelled, prior)

    def risk(w, bias):
        z = lambda docs: np.array([bias + sum(w[np.searchsorted(names, f)] for f in d if f in names) for d in docs])
        loss = lambda z: 1 / (1 + np.exp(z))  # of saying yes; that of no is its complement
        yes, no_u, no_p = loss(z(positive)).mean(), 1 - loss(z(unlabelled)).mean(), 1 - loss(z(positive)).mean()
        return prior * yes + max(0.0, no_u - prior * no_p)

    best = risk(w, bias)
    assert best < 0.5 * min(risk(0 * w, 0.0), risk(0 * w, -5.0), risk(0 * w, 5.0))
    for _ in range(30):
        step = r.normal(size=len(w) + 1) * 0.1
        assert risk(w + step[:-1], bias + step[-1]) > best - 0.01
    score = lambda d: bias + sum(w[np.searchsorted(names, f)] for f in d if f in names)
    assert np.mean([score(d) > 0 for d in positive]) > 0.9 and np.mean([score(d) > 0 for i, d in enumerate(unlabelled) if i % 5]) < 0.1


def test_vantage_points(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 8)).astype("float32")
    x[300:500] = x[300]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, 2.0]), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    q = vptree.usable(d, "vec_id", "embedding")
    for row in vptree.nearest(q, q.where("id % 100 = 0"), 10, 1.0, 200).collect():
        got[row.query_id].append((row["rank"], row.vec_id, row.score))
    x = x.astype(float)
    for i in range(0, 900, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(900), d)) if j != i][:10]
        assert [v for _, v, _ in sorted(got[i])] == want
    assert set(got) == set(range(0, 900, 100))  # the one vector of another dimension has no neighbours
    found = total = 0
    for row in vptree.nearest(q, q.where("id % 100 = 0"), 10, 0.7, 200).collect():
        found += (row["rank"], row.vec_id) in {(a, b) for a, b, _ in got[row.query_id]}
        total += 1
    assert total == 90 and found >= 0.5 * total


def test_repeated_queries_and_rows(spark):
    """Against the SQL, with repeated ids, copies and several dimensions; equal query rows are one query."""
    import duckdb
    import pandas as pd

    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=4)]) for i in range(350)]
    rows += [(350 + i, rows[200][1]) for i in range(60)] + [(100, rows[7][1])] + [(700 + i, [1.0, float(i)]) for i in range(12)]
    embeddings = pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]})
    want = duckdb.sql(vptree.OP7_SQL).fetchall()
    d = spark.createDataFrame(rows + [rows[0], rows[100]], "vec_id long, embedding array<float>")
    q = vptree.usable(d, "vec_id", "embedding")
    got = vptree.nearest(q, q.where("id % 100 = 0"), 10, 1.0, 32)
    by_key = defaultdict(list)
    for x in got.collect():
        by_key[x.query_id, x.query_key].append((x["rank"], x.vec_id, x.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by_key.values())
    # id 100 has two vectors, so two queries; the SQL ranks both together
    plain = [(i, *x) for (i, _), v in by_key.items() if i != 100 for x in v]
    # the rows that were given twice are candidates twice, so only queries that don't meet them are compared
    twice = {i for i, _, v, _ in plain if v in (0, 100)}
    assert sorted(x for x in plain if x[0] not in twice) == sorted(x for x in want if x[0] != 100 and x[0] not in twice) and len(twice) < 5
    assert len([k for k in by_key if k[0] == 100]) == 2
    none = vptree.op7(spark.createDataFrame([], "vec_id long, embedding array<float>, v int, cell string"))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_imatch(spark, docs, nothing, rows):
    out = {r.doc_id: r for r in imatch.op8(docs, 3).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    import hashlib

    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        assert out[d].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest() and out[d].n_chars == len(t)
    assert out[5].fingerprint == out[81].fingerprint == out[82].fingerprint != out[6].fingerprint
    assert np.mean([out[i].near_edited for i in range(60)]) > 0.25 > 0.05 > np.mean([out[i].near_next for i in range(60)])
    assert imatch.op8(nothing).count() == 0
    terms = imatch.lexicon(docs, 1 / 10, 1 / 2)
    n = Counter(w for r in rows for w in set(common.words_of(r[1])))
    assert len(terms) == sum(len(rows) / 10 <= c <= len(rows) / 2 for c in n.values())


def test_fingerprints_by_hand():
    """Fingerprints and their likeness, term by term."""
    import xxhash

    r = random.Random(8)
    vocabulary = words(r, 60)
    terms = np.sort(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in set(vocabulary[:40])], np.uint64))
    prints = imatch.Prints(terms)
    one = lambda x: int(imatch.mix(np.array([x], np.uint64))[0])

    def by_hand(text):
        own = sorted({xxhash.xxh3_64_intdigest(w) for w in set(text.lower().encode().split())})
        found = [t for t in own if t in set(terms.tolist())] or own
        out = []
        for k in range(imatch.RATES * imatch.EACH):
            rate = k // imatch.EACH + 1
            total, n = 0, 0
            for t in found:
                if one(t ^ one(k + 1)) >> (64 - rate) == 0:
                    total = (total + one((t + n * 0x9E3779B97F4A7C15) % 2**64)) % 2**64
                    n += 1
            out.append(f"{one(total) >> (64 - 4 * imatch.SLOT):0{imatch.SLOT}x}" if n else "-" * imatch.SLOT)
        return out

    def alike(x, y):
        best = 1.0 if x == y else 0.0
        for at in range(0, len(x), imatch.EACH):
            pairs = [(a, b) for a, b in zip(x[at : at + imatch.EACH], y[at : at + imatch.EACH]) if {a, b} != {"-" * imatch.SLOT}]
            if len(pairs) >= imatch.EACH // 3:
                best = max(best, sum(a == b for a, b in pairs) / len(pairs))
        return best

    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (0, 1, 3, 10, 30, 30)] + [vocabulary[50]]
    texts.append(texts[4] + " " + vocabulary[3])
    hand = [by_hand(t) for t in texts]
    assert [prints.of(t) for t in texts] == ["".join(h) for h in hand]
    for x, y in ((a, b) for a in hand for b in hand):
        assert imatch.likeness("".join(x), "".join(y)) == alike(x, y)


def test_licenses(spark, nothing):
    cases = [("some text\nReleased under the MIT License.\nmore", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("the license of the house", ""), (None, ""), ("", ""), ("Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,CC-BY-NC")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.families for r in licenses.op10(d).orderBy("doc_id").collect()] == [f for _, f in cases]
    assert licenses.op10(nothing).count() == 0


def test_licenses_that_training_has_not_seen(spark):
    m = licenses.model()
    said = m.report()
    assert said["family_recall"] >= 0.95 and said["family_precision"] >= 0.95 and said["unseen_licences_unknown"] >= 0.85 and said["calibration_error"] < 0.1
    seen = {t.lower() for t in (x[1] for x in licenses.texts_by_part()[0])}
    for line in ("Released under the MIT License", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3"):
        family = m.predict(line)[0]
        assert family in ("MIT", "Apache-2.0", "CC-BY-NC", "GPL"), (line, line.lower() in seen)
    unknown = ["Licensed under the Acme Public License, version 9", "Distributed under the EUPL License", "Released under the terms of the zlib license", "This code is covered by the Nonesuch Software License 2.1"]
    assert [m.predict(x)[0] for x in unknown] == ["unknown"] * len(unknown)
    prose = ["She lost her driving license on the way home", "The general spoke to the public about the library", "Seats are reserved for guests"]
    assert [m.predict(x)[0] for x in prose] == ["none"] * len(prose)


def test_wrapped_and_long_paragraphs(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet"
    mit = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
    long = " ".join(["word"] * 200_000)
    cases = [(1, bsd), (2, mit), (3, long + "\nReleased under the MIT License.\n" + long), (None, bsd), (None, bsd), (5, long)]
    d = spark.createDataFrame([(*c, "x") for c in cases], "doc_id long, text string, __found string")
    out = licenses.scan(d).orderBy("doc_id").collect()
    assert [r.families for r in out] == ["BSD", "BSD", "BSD", "MIT", "MIT", ""] and {r["__found"] for r in out} == {"x"}
    assert list(licenses.paragraphs(bsd)) == [bsd.replace("\n", " ")]
    with pytest.raises(ValueError):
        licenses.scan(d.withColumn("found", F.lit(1)))


def test_warc(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\n 2\r\n\r\n<p>caf\xe9 &amp; <b>bar</b></p><script>x</script><div>y</div>"
    d = spark.createDataFrame([("<urn:1>", "https://a.example/", "2024-01-01T00:00:00Z", bytearray(block)), (None, None, None, None), ("<urn:2>", "u", "d", bytearray(b"no headers"))], "record_id string, target_uri string, date string, block binary")
    out = [r.asDict() for r in warc.derivatives(d).collect()]
    assert len(out) == 6
    meta, conv = (next(r for r in out if r["refers_to"] == "<urn:1>" and r["record_type"] == k) for k in ("metadata", "conversion"))
    assert conv["content"] == "café & bar\ny" and conv["block_digest"] == warc.digest("café & bar\ny".encode())
    assert meta["source_block_digest"] == warc.digest(block) and "http-header-x-a: 1 2\r\n" in meta["content"] and conv["record_id"] in meta["content"]
    assert conv["http_status"] == 200 and [h["name"] for h in conv["source_headers"]] == ["Content-Type", "X-A"]
    import gzip

    head, _, body = gzip.decompress(warc.serialize(conv)).partition(b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:1>" in head and body == "café & bar\ny".encode() + b"\r\n\r\n"
    assert warc.op1(spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")).count() == 4


def test_warc_headers_and_codings(spark):
    import gzip

    page = b"<p>caf\xc3\xa9</p>"
    packed = gzip.compress(page, mtime=0)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:10], packed[10:])) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    headers = [("WARC-Block-Digest", "sha1:GIVEN"), ("WARC-IP-Address", "192.0.2.1")]
    ddl = "record_id string, target_uri string, date string, block binary, warc_headers array<struct<name: string, value: string>>, k string"
    out = warc.derivatives(spark.createDataFrame([("<urn:1>", "u", "d", bytearray(block), headers, "x"), ("<urn:2>", "u", "d", bytearray(block[:-30]), None, "y")], ddl), ["k"]).collect()
    conv = {r.refers_to: r for r in out if r.record_type == "conversion"}
    meta = {r.refers_to: r for r in out if r.record_type == "metadata"}
    assert conv["<urn:1>"].content == "café" and conv["<urn:1>"].source_block_digest == "sha1:GIVEN" and conv["<urn:1>"].k == "x"
    assert "warc-header-warc-ip-address: 192.0.2.1\r\n" in meta["<urn:1>"].content and meta["<urn:1>"].source_payload_digest == warc.digest(chunked)
    assert conv["<urn:2>"].source_block_digest == warc.digest(block[:-30])
    with pytest.raises(ValueError):
        warc.derivatives(spark.createDataFrame([], ddl).withColumn("content", F.lit(1)), ["content"])
    assert warc.op1(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unclosed_tags_take_linear_time():
    import time

    began = time.time()
    assert warc.plain_text("<p>x</p>" + "<a " * 300_000).startswith("x\n<a <a")
    assert time.time() - began < 5


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, f"word {i}", f"s{i % 2}", f"key {i}", i) for i in range(50)] + [(None, "null id", None, "key", None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, __k string, __key long")
    out = mixing.mix_in(d)
    assert out.columns == d.columns
    assert all(r["__k"] == f"key {r.doc_id}" and r["__key"] == r.doc_id for r in out.collect() if r.doc_id is not None)


def test_work_dir_must_be_shared(spark, monkeypatch):
    class Cluster:
        conf = spark.conf

        class sparkContext:
            master = "spark://host:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            common.work_dir(Cluster)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)] + [(None, 1), (5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        if u is not None and u != v:
            x, y = sorted((find(u), find(v)))
            root[y] = x
    got = dict(common.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: find(i) for i in root}
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame(links, "u long, v long"), 1)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = common.read_table(spark, sf, "documents")
    d = docs
    for _, stage in cp.STAGES[:-1]:
        d = common.materialize(stage(spark, d, sf), "stage")
        assert d.columns == docs.columns
    packed = cp.run(spark, sf)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in d.select("doc_id").distinct().collect()}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_runs_are_encoded_as_in_whole_texts():
    """Runs with the mark, or whose normal form is the mark, special tokens, control characters and other white space."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", None, " a `b c` ` `` d", "` ́x é ` z", "<|endoftext|> x<|startoftext|>y ", "\x1cf\x1dg \x0bx\x0cy\x85z w it's don't", "a" * 5000]
    runs = packing.ChunkIds(packing.default_tokenizer())
    for _ in range(2):  # unseen, then remembered
        ids, ends = runs.encode(texts)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == tk.encode(t or "", add_special_tokens=False).ids


def test_awkward_rows(spark):
    """Repeated ids with equal and other texts, null ids, very long and empty texts, clashing columns: a row for each of the rows."""
    r = random.Random(21)
    text = lambda n: " ".join(words(r, n))
    one, long = text(80), text(30_000)
    rows = [(1, one), (1, one), (1, text(70)), (2, one), (None, one), (None, None), (None, text(5)), (3, long), (3, long), (4, ""), (5, None), (5, None), (6, "word"), (-7, one + " more")]
    d = spark.createDataFrame([(*x, "en", f"s{i % 3}" if i % 4 else None) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for c in ("score", "piece", "start", "length", "fingerprint", "__k", "__cell", "shard", "component_id", "id", "size"):
        d = d.withColumn(c, F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    n = len(rows)
    assert sorted(r.slot for r in ring.op3(d, 1).collect()) == list(range(n))
    pieces = packing.op4(d).collect()
    assert len([p for p in pieces if p.piece == 0]) == n and sum(p.length for p in pieces if p.doc_id is None) > 6
    assert toxicity.op5(d, labels).count() == n and toxicity.op5(d, labels.limit(0)).count() == n
    six = jaccard.op6(d).collect()
    assert len(six) == n and {x.component_id for x in six if x.doc_id in (1, 2, -7) and x.n_shingles > 66} == {-7} and {x.component_id for x in six if x.doc_id is None} == {None}
    assert {x.component_id for x in six if x.doc_id == 1} == {-7}  # with its other text
    eight = imatch.op8(d, 4).collect()
    assert len(eight) == n and len({x.fingerprint for x in eight if x.doc_id in (1, 2) and x.n_chars == len(one)}) == 1
    assert mixing.op9(d).count() == n and licenses.op10(d).count() == n
    assert {(1, -7), (2, -7)} <= {(x.doc_id, x.match_id) for x in passages.find(d).collect()} <= {(1, -7), (2, -7), (2, 1)}
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns
    ids = Counter(x.doc_id for x in kept.collect())
    assert ids == {None: 3, -7: 1, 1: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    more = d.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert jaccard.one_of_each(more).count() == 9
    assert jaccard.one_of_each(d.where("doc_id IS NULL")).count() == 3  # nothing else decides about rows without an id


def test_a_large_cluster_in_regions(spark, monkeypatch):
    """A chain of variants and a ball of copies, beyond what one task joins; against all pairs."""
    monkeypatch.setattr(jaccard, "LOCAL", 24)
    monkeypatch.setattr(jaccard, "CELL", 64)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BALL", 16)
    r = random.Random(22)
    base, rows = words(r, 120), []
    for i in range(150):  # each differs from the next in one word, the ends in all
        rows.append((i, " ".join(base)))
        base = [*base]
        base[i % 120] = words(r, 1)[0] + "x"
    core = words(r, 120)
    for i in range(200):
        w = [*core]
        w[r.randrange(120)] = f"v{i}"
        rows.append((1000 + i, " ".join(w)))
    far = [*core]
    for i in range(0, 120, 9):
        far[i] = f"f{i}"
    rows += [(2000, " ".join(far)), (2001, " ".join(words(r, 120)))]
    s = sets([(i, t) for i, t in rows], 4)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in jaccard.op6(d).collect()} == {i: find(i) for i in s}


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    """Each stage's result from its input, by plain loops."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    r = random.Random(31)
    more = [(200 + i, " ".join(words(r, 40) + ["grumble", "grumbler"] * (i % 4 == 0)), "en", f"s{i % 4}", 1, "x", "x", "x", "x") for i in range(120)]
    spark.createDataFrame(rows + more, DDL).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i[0], 1, int("grumble" in i[1])) for i in more], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, d = str(tmp_path), common.read_table(spark, str(tmp_path), "documents")
    text = lambda df: {x.doc_id: x.text for x in df.collect()}
    stages = dict(cp.STAGES)
    clean = common.materialize(stages["toxicity"](spark, d, sf), "a")
    labels = common.read_table(spark, sf, "labels")
    names, w, bias = toxicity.train(d.select("doc_id", "text"), labels)
    weight = dict(zip(names.tolist(), w.tolist()))
    of = toxicity.WordFeatures()
    assert set(text(clean)) == {i for i, t in text(d).items() if bias + sum(weight.get(f, 0.0) for f in toxicity.features(t, of)) < 0}
    assert not any("grumble" in (t or "") for t in text(clean).values()) and len(text(clean)) >= len(rows) + 80
    one = common.materialize(stages["ngram_jaccard_join"](spark, clean, sf), "b")
    s, root = sets(text(clean).items(), 5), {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(text(one)) == {i for i in s if find(i) == i}
    cut = common.materialize(stages["substring_dedup"](spark, one, sf), "c")
    before, after, seen = text(one), text(cut), set()
    for i in sorted(before):
        words_ = common.words_of(before[i])
        runs = {tuple(words_[j : j + 50]) for j in range(len(words_) - 49)}
        if not runs & seen:
            assert after[i] == before[i]
        kept = common.words_of(after.get(i))
        assert not {tuple(kept[j : j + 50]) for j in range(len(kept) - 49)} & seen
        seen |= runs
    mixed = common.materialize(stages["source_mixing"](spark, cut, sf), "d")
    want = {x.doc_id: x.copies for x in mixing.systematic(cut.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("__k")), ["doc_id", "__k"]).collect()}
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({i: n for i, n in want.items() if n})
    tk = Tokenizer.from_file(packing.default_tokenizer())
    packed = stages["best_fit_packing"](spark, mixed, sf).collect()
    assert sum(p.length for p in packed) == sum(len(tk.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in mixed.collect())
    assert {(p.doc_id, p.length) for p in packed} == {(p.doc_id, p.length) for p in cp.run(spark, sf).collect()}


def test_all_chains_over_the_same_words_are_asked_for():
    """Ten smaller documents share three short seeds each with the same forty words, in other places."""
    seeds = [(x, other) for other in range(10) for x in (0, 15, 30)]
    x, other = (np.array(c, np.int64) for c in zip(*seeds, strict=True))
    y, none = x + 100 + other, np.zeros(len(x), np.int64)
    rows = passages.chains_of(50, np.full(len(x), passages.SHORT), x, 6 * x, none, other, y, 6 * y, none, 5, 44, 2)
    assert Counter(r[1] for r in rows if r[2] >= 0) == Counter(range(10))
