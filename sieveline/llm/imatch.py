"""I-Match document fingerprints from randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. Its lower frequency bounds its size whatever
the corpus: documents have so many distinct terms on average, and each lexicon term is in at least a given share of them.
For each of several randomised subsets of the lexicon, at rates from 1/2 to 1/256, a document's distinct terms in that
subset are sorted and hashed; the fingerprint lists these hashes. Dense subsets serve texts with few lexicon terms, thin
ones serve long texts. The likeness of two fingerprints is the best share, over the rates, of the subsets on which they
agree among those that either has terms in.

Defined cases: a null text is empty. A text without any lexicon term is fingerprinted from all its terms in the same
way, and one without terms has dashes only; fingerprints that are equal have likeness 1, as equal texts do. Repeated
rows and ids are fingerprinted each; a null doc_id is ordered last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, small_frame, tune, words_of

#: A term's share of documents: the band of inverse document frequency is [log(1 / HIGH), log(1 / LOW)].
LOW, HIGH = 1 / 2000, 1 / 10
RATES = 8
EACH = 12
#: Words whose places a worker remembers; beyond that it starts anew.
CACHE_PLACES = 300_000
SLOT = 4  # hex digits


def lexicon(documents: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted hashes of the terms within the band, of all documents."""
    tune(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, found = WordHashes(), Counter()

        def out():
            h = np.fromiter(found.keys(), np.uint64, len(found)).view(np.int64)
            n = np.fromiter(found.values(), np.int64, len(found))
            for s in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[s : s + 50_000]), pa.array(n[s : s + 50_000])], ["term", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(map(cache.__getitem__, set(words_of(t))))
                if len(found) > 1_000_000:
                    yield from out()
                    found.clear()
        yield from out()

    n = documents.count()
    terms = documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = terms.where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).select("term")
    return np.sort(kept.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def memberships(terms: np.ndarray) -> np.ndarray:
    """(terms, RATES x EACH) booleans: the subsets that each term is in."""
    out = np.zeros((len(terms), RATES * EACH), bool)
    for k in range(RATES * EACH):
        out[:, k] = mix(terms ^ mix(np.array([k + 1], np.uint64))) >> np.uint64(64 - (k // EACH + 1)) == 0
    return out


def hashes(terms: np.ndarray, slot: np.ndarray, at: np.ndarray) -> str:
    """The hash of each subset's terms in their order; dashes where a subset has none. terms: sorted; terms[at] are in slot, which is in order, and so is at within a slot."""
    out = ["-" * SLOT] * (RATES * EACH)
    if len(slot):
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        each = mix(terms[at] + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k, h in zip(slot[first].tolist(), mix(np.add.reduceat(each, first)).tolist(), strict=True):
            out[k] = f"{h >> (64 - 4 * SLOT):0{SLOT}x}"
    return "".join(out)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    best, none = 0.0, "-" * SLOT
    for r in range(RATES):
        same = some = 0
        for k in range(r * EACH, (r + 1) * EACH):
            x, y = a[k * SLOT : (k + 1) * SLOT], b[k * SLOT : (k + 1) * SLOT]
            some += x != none or y != none
            same += x == y != none
        if some >= EACH // 3:
            best = max(best, same / some)
    return best


class Prints:
    """Fingerprints of texts, by a lexicon. Broadcast as it is, so that a worker keeps what it remembers from task to task."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.hash = terms, WordHashes()
        each, self.slots = np.nonzero(memberships(terms))
        self.slots = self.slots.astype(np.uint8)
        self.ends = np.r_[0, np.cumsum(np.bincount(each, minlength=len(terms)))].astype(np.int64)
        self.places: dict[bytes, int] = {}  # of words in the lexicon; -1: not in it

    def positions(self, words: set[bytes]) -> np.ndarray:
        """Where the words that the lexicon has are in it, in order."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        if len(self.places) >= CACHE_PLACES:
            self.places.clear()
        if new := list(words.difference(self.places)):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            self.places.update(zip(new, np.where(self.terms[at] == h, at, -1).tolist(), strict=True))
        at = np.sort(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)))
        at = at[np.searchsorted(at, 0) :]
        return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at

    def of(self, text: str) -> str:
        words = set(words_of(text))
        at = self.positions(words)
        if not len(at):
            h = np.unique(self.hash.of(list(words)))
            return hashes(h, *np.nonzero(memberships(h).T))
        n = self.ends[at + 1] - self.ends[at]
        before = np.cumsum(n) - n
        slot = self.slots[np.repeat(self.ends[at] - before, n) + np.arange(n.sum())]
        order = np.argsort(slot, kind="stable")
        return hashes(self.terms[at], slot[order], np.repeat(np.arange(len(at)), n)[order])


def fingerprints(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """texts with fingerprint; the other columns are kept."""
    tune(texts.sparkSession)
    share = texts.sparkSession.sparkContext.broadcast(Prints(terms))
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = share.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([prints.of(t or "") for t in b.column(at).to_pylist()], pa.string())], [*b.schema.names, "fingerprint"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{ddl}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the next text's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OP8 = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op8(documents: DataFrame, most_ranges: int = 4096) -> DataFrame:
    """Documents go once to ranges of doc_id; each range also gets the first row of the next, so that every row meets the one that follows."""
    spark = documents.sparkSession
    terms = lexicon(documents)
    share = spark.sparkContext.broadcast(Prints(terms))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"))
    ids = docs.select("o")
    want = min(most_ranges, 4 * max(8, documents.rdd.getNumPartitions()))
    cuts = sorted({int(x) for x in ids.select(F.col("o").cast("double").alias("o")).approxQuantile("o", [i / want for i in range(1, want)], 0.2 / want)})
    # the range's number is that of the cuts below
    number = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("o"))).cast("int")
    docs = docs.withColumn("range", number)
    heads = sorted(docs.groupBy("range").agg(F.max("o")).collect())  # at most most_ranges rows
    sent = [(top, heads[(i + 1) % len(heads)][0]) for i, (_, top) in enumerate(heads)]
    copies = docs.join(F.broadcast(small_frame(spark, sent, "o bigint,to int")), "o").select("doc_id", "text", "o", F.col("to").alias("range"), F.lit(True).alias("copy"))
    dealt = docs.withColumn("copy", F.lit(False)).unionByName(copies).repartition("range").sortWithinPartitions("range", "copy", F.desc("o"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = share.value
        last, rows = None, []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)], [x.split()[0] for x in OP8.split(", ")])
            rows.clear()
            return out

        for b in batches:
            doc, text, of, copy = (b.column(c) for c in ("doc_id", "text", "range", "copy"))
            for i in range(b.num_rows):
                t, r, c = text[i].as_py(), of[i].as_py(), copy[i].as_py()
                own = prints.of(t)
                if last and last[2] == r:
                    new = edited(last[1], t)
                    p = prints.of(new)
                    rows.append((last[0], len(last[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[3], p, likeness(last[3], p), likeness(last[3], own)))
                    if len(rows) >= 2000:
                        yield flush()
                last = None if c else (doc[i].as_py(), t, r, own)
        if rows:
            yield flush()

    return dealt.mapInArrow(run, OP8)
