"""Line dedup, spelling variants and conversation tries against brute force, on small tables with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveline.llm import lines, spelling, tries

DDL = "doc_id long, text string, source string, n_chars long, word string, n long, mark string, pos string, __mark string, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", len(t or ""), "w", 1, "m", "p", "m", "n") for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    common = [f"Line {i} of many é" for i in range(6)] + ["É", "  \x0b\f", "", "a\r", "ü" * 3]
    out = []
    for i in range(60):
        body = [" " * r.randrange(3) + r.choice([str.upper, str.lower, str])(r.choice(common)) + "\t" * r.randrange(2) for _ in range(r.randrange(9))]
        out.append((i, "\n".join(body + [f"own {i}"] * r.randrange(3))))
    out += [(60, None), (61, ""), (62, "\n"), (63, "one\n" * 40), (64, "\n".join(f"row {i % 50}" for i in range(30_000))), (None, common[0]), (None, common[0] + "\nx")]
    out += [(70, "seldom"), *[(71, "seldom")] * 20, *[(80 + i, "gone") for i in range(10)]]
    return out


def brute_lines(rows, least, chars=1):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= chars:
                docs[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        left = [x for x in ls if len(docs.get(key(x), ())) < least]
        out.append((i, len(ls), len(ls) - len(left), "\n".join(left)))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_line_dedup(spark, rows):
    docs = frame(spark, rows)
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, 10)]
    assert in_order(map(tuple, lines.op13(docs).collect())) == in_order(want)
    assert {d for *_, d, _ in want} > {0, 1}
    out = lines.drop_lines(docs, min_docs=7, min_chars=3)
    assert out.columns == docs.columns
    given = {i: t for i, t in rows if t is None}
    want = [(i, given.get(i, t) if t == "" else t, len(t)) for i, _, _, t in brute_lines(rows, 7, 3)]
    assert in_order((x.doc_id, x.text, x.n_chars) for x in out.collect()) == in_order(want)
    assert lines.op13(docs.limit(0)).count() == 0


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


@pytest.mark.parametrize("shard", [1, 7, 50_000])  # the first halve shards until one place is left
def test_near_words(spark, shard):
    r = random.Random(shard)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"a" * n for n in range(1, 12)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149}
    vocab = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = sorted((x.word, x.near, x.near_n) for x in spelling.near_words(vocab, shard).collect())
    assert got == sorted((a, b, len(b)) for a in words for b in words if apart(a, b))


def test_variants(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(6, 12))) for _ in range(30)]
    bag = []
    for k, w in enumerate(base):
        a = w[:2] + "z" + w[3:]
        bag += [w] * (40 if k % 2 else 260) + [a] * 45 + [a[:5] + "q" + a[5:]] * 6 + [w[1:] + "é"] * 5 + [w + "É"] * 8
    r.shuffle(bag)
    rows = [(i, " ".join(bag[i * 50 : i * 50 + 50]).title() if i % 2 else "1;".join(bag[i * 50 : i * 50 + 50])) for i in range(len(bag) // 50 + 1)]
    rows += [(900, None), (901, ""), (902, "×÷ÀÿabcD " * 6), (None, f"{base[0]} " * 9), (903, "word" * 3000)] + [rows[0]] * 2
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: sorted(v for v in n if apart(v, w)) for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    want = sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)
    got = spelling.op11(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(form[w] and form[form[w]] for w in n)  # ways of more than one step
    assert spelling.op11(frame(spark, [])).count() == 0


TURN = "conv_id long, turn long, role string, text string, k long, pos string, cell string"


def conversations(r):
    rows = []
    for c in [*range(-7, 60), 1000, 1003, 5002]:
        if c in (20, 30):
            continue
        talk = [(r.choice("ua"), f"text {r.randrange(3)} é") for _ in range(r.choice([1, 3, 6, 12, 30]))]
        if 40 <= c < 55:
            talk = [("u", "hello"), ("a", "hi")] * (c % 3)
        rows += [(c, None if not k and c % 2 else k, role, text) for k, (role, text) in enumerate(talk)]
    rows += [(70, 1, None, None), (70, 1, "", ""), (70, 2, "u", "twice"), (70, 2, "u", "twice"), (None, 1, "u", "none")]
    rows += [(81, k, "u", "same") for k in range(5000)] + [(82, k, "u", "same") for k in range(2500)]  # over one cell
    return rows


def brute_nodes(rows):
    turns = defaultdict(list)
    for c, *t in rows:
        if c is not None:
            turns[c].append(t)
    label = {c: [(r or "", t or "") for k, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in turns.items()}
    path = {}
    for c in label:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(np.fmod(c, 5))
        path[c] = label.get(first, [])[:h] + label[c][h:]
    # nodes by number: a dict from (node above, label)
    ids, members, ends, up, size, depth = {}, defaultdict(list), defaultdict(list), {0: None}, {0: 0}, {0: 0}
    for c in sorted(path):
        at = 0
        members[0].append(c)
        for t in path[c]:
            new = ids.setdefault((at, t), len(ids) + 1)
            up[new], size[new], depth[new] = at, len(t[1].encode()), depth[at] + 1
            at = new
            members[at].append(c)
        ends[at].append(c)
    children = Counter(up.values())
    leaves, saved = Counter(), Counter()
    for m in sorted(up, key=lambda m: -depth[m]):
        leaves[m] += not children[m]
        saved[m] += (len(members[m]) - 1) * size[m]
        if m:
            leaves[up[m]] += leaves[m]
            saved[up[m]] += saved[m]
    sha = lambda m: hashlib.sha256(",".join(map(str, ends[m])).encode()).hexdigest()
    return sorted(((min(members[m]), depth[m], min(members[up[m]]) if m else None, len(members[m]), children[m], leaves[m], saved[m], sha(m)) for m in up), key=repr)


@pytest.mark.parametrize("heavy", [1, 9, 1024, 10**9])  # from all nodes in the upper levels to the root alone
def test_conversation_tries(spark, heavy, monkeypatch):
    monkeypatch.setattr(tries, "BUNDLE", 100 if heavy > 9 else 65_536)
    rows = conversations(random.Random(4))
    c = spark.createDataFrame([(*x, 1, "p", "c") for x in rows], TURN).repartition(5)
    sequences = tries.rebuilt(tries.ranked(tries.labelled(c)))
    assert sorted(map(tuple, tries.nodes(sequences, heavy).collect()), key=repr) == brute_nodes(rows)


def test_no_conversations(spark):
    assert tries.op12(spark.createDataFrame([], TURN)).count() == 0


def test_succinct_tries_hold_all_prefixes(spark):
    """The bits and labels alone give back the labels of every path below the upper levels."""
    rows = conversations(random.Random(6))
    c = spark.createDataFrame([(*x, 1, "p", "c") for x in rows if x[0] not in (81, 82)], TURN)
    sequences = tries.rebuilt(tries.ranked(tries.labelled(c))).cache()
    want = defaultdict(list)
    for x in sorted(sequences.where("pos > 0").collect(), key=lambda x: (x.conv_id, x.pos)):
        want[x.conv_id].append((x.l1, x.l2))
    want = {tuple(v[:d]) for v in want.values() for d in range(1, len(v) + 1)}
    got = set()
    for x in tries.tries(sequences, 10**9).collect():
        bits = np.unpackbits(np.frombuffer(x.bits, np.uint8))[: 2 * x.nodes + 1]
        labels, parent = np.frombuffer(x.labels, "<i8").reshape(-1, 2).tolist(), tries.Louds.parents(bits).tolist()
        assert bits.sum() == x.nodes == len(labels) and parent.count(-1) == len(x.roots)
        for i in range(x.nodes):
            way, j = [], i
            while j >= 0:
                way.append(tuple(labels[j]))
                j = parent[j]
            got.add(tuple(way[::-1]))
    assert got == want


def test_mixing_counts_copies_at_any_place(spark):
    """As exact integers have it, far beyond 2**32 documents in a source."""
    from pyspark.sql import functions as F

    from sieveline.llm import mixing

    r = random.Random(8)
    cases = [(p, e, o) for p in (1, 2, 3, 10**6, 5_000_000_000, 5_000_000_001, 2**40 + 7) for e in (0, 1, 2**29, 2**30 - 1, 2**30, 2**31, r.randrange(2**31)) for o in (0, 4 * r.randrange(2**28))]
    df = spark.createDataFrame(cases, "p long, e long, o long")
    got = df.select("p", "e", "o", mixing.crossed(F.col("p"), F.col("e"), F.col("o")).alias("n")).collect()
    assert len(got) == len(cases)
    for p, e, o, n in got:
        assert n == ((p * e + o) >> 30) - (((p - 1) * e + o) >> 30)


def test_toxic_stage_keeps_a_clashing_column(spark):
    from sieveline.llm import toxicity

    docs = spark.createDataFrame([(i, "vile words here" if i % 3 == 0 else "kind words there", f"x{i}") for i in range(60)], "doc_id long, text string, __toxicity string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns
    assert {(x.doc_id, x["__toxicity"]) for x in out.collect()} <= {(i, f"x{i}") for i in range(60)}


def test_word_hashes_are_of_words_alone():
    """The same word has the same hash wherever it stands, also across the spans that are hashed together; others differ."""
    from sieveline.llm import passages

    r = random.Random(12)
    pool = ["a", "b", "ab", "ba", "aa", "é", "ü½", "\0", "\0\0", "x" * 5000, "x" * 5001, *("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) for _ in range(3000))]
    words = [r.choice(pool) for _ in range(90_000)]
    text = " \t" + "".join(w + r.choice([" ", "\n", "  ", "\x0b"]) for w in words)
    h, first, end = passages.word_hashes(text.encode(), passages.Powers())
    assert len(h) == len(words) and len(text.encode()) > passages.SPAN
    assert [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)] == words
    seen = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    alone = passages.word_hashes(b"y" * (passages.SPAN + 9) + b" ab", passages.Powers())[0]
    assert alone[1] == seen["ab"] and len(passages.word_hashes(b" \n", passages.Powers())[0]) == 0


def test_changed_passages_of_many_holders_are_found(spark):
    """400 documents with one passage, of whose words a tenth is changed at random in each; exact runs come out alike however rows are dealt."""
    from sieveline.llm import passages

    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    base, exact = [word() for _ in range(80)], [word() for _ in range(60)]
    texts = []
    for i in range(400):
        changed = [word() if r.random() < 0.1 else x for x in base]
        texts.append((i, " ".join([word() for _ in range(40)] + changed + [word() for _ in range(40)] + exact * (i % 3 == 0))))
    docs, runs = spark.createDataFrame(texts, "doc_id long, text string"), []
    for parts in (1, 7):
        got = defaultdict(set)
        found = passages.find(docs.repartition(parts)).collect()
        for x in found:
            got[x.doc_id].update(range(x.start_word, x.end_word))
        assert sum(len(got[i] & set(range(40, 120))) >= 40 for i in range(1, 400)) >= 0.9 * 399
        runs.append({i: sorted(got[i] & set(range(160, 220))) for i in range(0, 400, 3)})
    assert runs[0] == runs[1] and all(len(runs[0][i]) == 60 for i in range(3, 400, 3))
