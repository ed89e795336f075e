"""Delivery: payload structs, chunks bounded by number and characters, and a sender with an injected transport."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, clean_description, truncate, when_reported

#: Colors by contract type, and the shape of a webhook's address.
COLORS = {"internship": 0x5865F2, "apprenticeship": 0x57F287, "other": 0x99AAB5}
WEBHOOK = r"^https://(discord|discordapp)\.com/api/webhooks/\d+/\S+$"


def is_webhook(url: Column) -> Column:
    return F.coalesce(url.rlike(WEBHOOK), F.lit(False))


def embed(keywords: Column | None = None, posted: Column | None = None) -> Column:
    """A posting as a struct(title, url, description, color, fields, footer). posted: the date that the source gives, a timestamp; else it is read from source_posted_at."""
    c = F.col
    posted = when_reported(c("source_posted_at")) if posted is None else posted
    text = F.coalesce(c("description"), F.lit(""))
    place = F.when(F.coalesce(c("location"), F.lit("")) == "", "Not specified").otherwise(c("location"))
    field = lambda n, v: F.struct(F.lit(n).alias("name"), truncate(v, 1024).alias("value"))
    fields = [field("Company", c("company")), field("Location", place), field("Contract type", c("contract_type"))]
    if keywords is not None:
        words = F.array_join(keywords, ", ")
        fields.append(F.when(words != "", field("Keywords", words)))
    color = F.lit(COLORS["other"])
    for k, v in COLORS.items():
        color = F.when(c("contract_type") == k, v).otherwise(color)
    day = F.date_format(posted, "yyyy-MM-dd")
    foot = F.concat(F.lit("Source: "), c("source"), F.when(day.isNotNull(), F.concat(F.lit(" · Date reported by the company: "), day)).otherwise(""))
    shown = bind(clean_description(text), lambda t: F.when(t == "", "No description provided.").otherwise(truncate(t, 300)))
    return F.struct(
        truncate(c("title"), 256).alias("title"), c("url").alias("url"), shown.alias("description"),
        color.alias("color"), F.array_compact(F.array(*fields)).alias("fields"), foot.alias("footer"),
    )


def embed_chars(e: str) -> Column:
    """Title, description, footer and all field names and values; address and color don't count."""
    each = F.aggregate(f"{e}.fields", F.lit(0), lambda n, f: n + F.length(f["name"]) + F.length(f["value"]))
    return F.length(f"{e}.title") + F.length(f"{e}.description") + F.length(f"{e}.footer") + each


def chunks(df: DataFrame, group: list[str], order: str, chars: str, most: int = 10, most_chars: int = 6000) -> DataFrame:
    """df -> (group, order, chunk): greedy in order; a chunk is closed before it would exceed either bound; one that is too large goes alone.

    Where a chunk begins depends on all before it, so a group is read in order by one task, as a stream that holds nothing
    but the open chunk's counts.
    """
    rows = df.select(*group, F.col(order), F.coalesce(F.col(chars).cast("long"), F.lit(0)).alias("__c"))
    out = T.StructType([*rows.drop("__c").schema.fields, T.StructField("chunk", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, n, total = None, 0, 0, 0
        for b in batches:
            made = []
            for key, c in zip(zip(*(b.column(g).to_pylist() for g in group), strict=True), b.column("__c").to_pylist(), strict=True):
                if key != at:
                    at, chunk, n, total = key, 0, 0, 0
                elif n >= most or total + c > most_chars:
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + c
                made.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.int32())], [*b.schema.names[:-1], "chunk"])

    return rows.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, out)


def error_summary(errors: DataFrame, order: list[str], name: str, limit: int = 2000) -> DataFrame:
    """errors (error, order) -> one row: their number and a message of at most `limit` characters that lists them in order; no row without errors."""
    first = errors.orderBy(*order).limit(limit // 3).agg(F.sort_array(F.collect_list(F.struct(*order, "error"))).alias("e"))  # each line has 3 characters at least
    lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit("- "), x["error"])), "\n")
    both = first.crossJoin(errors.agg(F.count("*").alias("failed"))).where("failed > 0")  # a row each
    return both.select("failed", truncate(F.concat(F.lit(f"{name}: "), F.col("failed"), F.lit(" source(s) failed this run:\n"), lines), limit).alias("message"))


def send(chunked: DataFrame, post: Callable[[list], tuple[int, float]], tries: int = 3, sleep: Callable[[float], None] = time.sleep, dry_run: bool = False) -> list[str]:
    """Send a bounded backlog chunk by chunk (chunk, job_ids, payloads) and return the ids that were confirmed.

    post gives (status, seconds to wait). 429 waits and tries again, 5xx once; a chunk that fails leaves the others alone.
    """
    done: list[str] = []
    if dry_run:
        return done
    for r in chunked.orderBy("chunk").toLocalIterator():
        for attempt in range(tries):
            status, wait = post(r["payloads"])
            if 200 <= status < 300:
                done.extend(r["job_ids"])
                break
            if status == 429:
                sleep(wait)
            elif status < 500 or attempt:
                break
    return done
