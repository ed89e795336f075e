"""Line dedup: lines that many documents hold are dropped from all of them.

A line's key is the line without ASCII white space at its ends, A-Z in lower case, as a hash of 128 bits. Lines are
exploded and counted with a combine before the shuffle; only keys of enough lines are then counted by distinct documents,
over their own occurrences alone. What is dropped goes to its document as a list of positions, and the lines left are put
together again in their order. Texts move once, in a join that adaptive execution may split or broadcast; lines never do:
a row is a position and a hash.

Defined cases: null and empty text is one empty line; keys of fewer than min_chars code points are never dropped; rows that
repeat a doc_id are one document in the counts, as are all rows without one, and each gets its own result; a text whose
lines all go becomes empty; an empty table gives no rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, materialize, tune

MIN_DOCS = 10
_SPACE = b" \t\n\x0b\x0c\r"
_LINES = "doc_id long, mark long, pos int, h1 long, h2 long"


def exploded(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row for each line with a key of min_chars code points: its document (doc_id, and mark for the text), place and key's hash."""
    tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in chunks(texts):
                places, hashes, counts = [], [], []
                for t in texts[s:e]:
                    n = len(places)
                    if t:
                        for i, line in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n")):
                            key = line.strip(_SPACE).lower()
                            if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                                places.append(i)
                                hashes.append(xxhash.xxh3_128_digest(key))
                    counts.append(len(places) - n)
                at = pa.array(np.repeat(np.arange(s, e), counts))
                h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(places, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "mark", "pos", "h1", "h2"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, _LINES)


def dropped_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """(doc_id, mark, dropped): for each text that loses lines, their positions from 0, in no order."""
    lines = exploded(documents, min_chars)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    # written, so that the next joins are planned by its true size: broadcast while it is small, else by a shuffle
    often = materialize(often, "often")
    hits = materialize(lines.join(often, ["h1", "h2"]), "hits")
    docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    shared = materialize(hits.groupBy("h1", "h2").agg(docs.alias("docs")).where(F.col("docs") >= min_docs).select("h1", "h2"), "shared")
    return hits.join(shared, ["h1", "h2"], "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    """The text without the lines at these positions, in time linear in its lines."""
    left = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), dropped), lambda i: ls[i]), "\n")
    return F.transform(F.array(F.split(text, "\n")), left)[0]


def with_dropped(documents: DataFrame, n_lines: str, n_dropped: str, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """documents, the text being what is left of it, with two more columns of these names: its lines before, and how many were dropped."""
    mark, own, at, what = fresh(documents, "mark", "own", "at", "what")
    found = dropped_lines(documents, min_docs, min_chars).select(F.col("doc_id").alias(at), F.col("mark").alias(mark), F.col("dropped").alias(what))
    d = documents.withColumn(own, F.xxhash64("text"))
    d = d.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.col(own) == F.col(mark)), "left")
    text = F.when(F.col(what).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(what)))
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return d.select(*kept, lines.alias(n_lines), F.when(F.col(what).isNull(), 0).otherwise(F.size(what)).cast("long").alias(n_dropped))


def drop_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """documents, their texts without the lines that min_docs documents or more hold; n_chars follows, where there is one."""
    lines, n = fresh(documents, "lines", "n")
    out = with_dropped(documents, lines, n, min_docs, min_chars)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))


def op13(documents: DataFrame) -> DataFrame:
    out = with_dropped(documents.select("doc_id", "text"), "n_lines", "n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY = "trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
