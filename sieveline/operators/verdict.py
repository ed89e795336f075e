"""The stateful core: a verdict for each recorded posting, and the next state, as joins and windows.

Batch columns: job_id, content_fingerprint, the compared fields, seq (the order of the whole batch). State: one row per
job_id, and one per fingerprint. `now` is a literal; the clock is never read here.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPARED = ["content_fingerprint", "title", "location", "company", "contract_type", "url", "description", "source_posted_at", "external_id"]
HISTORY = ["job_id", "first_seen_at", "last_seen_at", "published_at", "disappeared_at", "is_stale", "last_verdict", "publish_pending"]
DAY = 86_400_000_000


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours, not midnights."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / DAY)


def differs(a: str, b: str, fields: list[str]) -> Column:
    return reduce(or_, (~F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in fields))


def verdicts(batch: DataFrame, jobs: DataFrame, fingerprints: DataFrame, now: Column, resurrection: int = 7, repost: int = 180, seed: bool = False, fields: list[str] | None = None) -> DataFrame:
    """batch with verdict. Rows of one batch see each other's effects, in order of seq."""
    fields = [c for c in fields or COMPARED if c in batch.columns]
    if seed:
        return batch.withColumn("verdict", F.lit("seeded"))
    own = W.partitionBy("job_id").orderBy("seq")
    b = batch.withColumn("__n", F.row_number().over(own))
    for c in fields:
        b = b.withColumn(f"__before_{c}", F.lag(c).over(own))
    s = jobs.select(F.col("job_id"), F.col("last_seen_at").alias("__seen"), *[F.col(c).alias(f"__state_{c}") for c in fields])
    # a minimum that is combined before its shuffle, and a join: a common fingerprint is no window
    f = batch.groupBy("content_fingerprint").agg(F.min("seq").alias("__first_fp")).join(fingerprints.select("content_fingerprint", F.col("last_seen_at").alias("__fp_seen")), "content_fingerprint", "left")
    b = b.join(s, "job_id", "left").join(f, "content_fingerprint", "left")
    again = F.when(differs("", "__before_", fields), "bump").otherwise("known")
    known = F.when(days_between(now, F.col("__seen")) > resurrection, "resurrection").when(differs("", "__state_", fields), "bump").otherwise("known")
    seen_fp = (F.col("__first_fp") < F.col("seq")) | F.coalesce(days_between(now, F.col("__fp_seen")) <= repost, F.lit(False))
    new = F.when(seen_fp, "repost").otherwise("new")
    return b.select(*batch.columns, F.when(F.col("__n") > 1, again).when(F.col("__seen").isNotNull(), known).otherwise(new).alias("verdict"))


def next_jobs(judged: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """State after the batch. Content is the last occurrence's; first_seen_at and publish_pending stay with rows that exist."""
    content = [c for c in jobs.columns if c not in HISTORY]
    own = W.partitionBy("job_id")
    b = judged.withColumn("__n", F.row_number().over(own.orderBy(F.desc("seq")))).withColumn("__first", F.min_by("verdict", "seq").over(own)).where("__n = 1")
    b = b.select("job_id", F.lit(True).alias("__in"), F.col("verdict").alias("__v"), "__first", *[F.col(c).alias(f"__b_{c}") for c in content])
    m = jobs.join(b, "job_id", "full")
    fresh = F.col("__in").isNotNull()
    old = F.col("first_seen_at").isNotNull()
    seeded = F.col("__v") == "seeded"
    return m.select(
        "job_id",
        *[F.when(fresh, F.col(f"__b_{c}")).otherwise(F.col(c)).alias(c) for c in content],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(fresh, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(fresh & seeded, now).otherwise(F.col("published_at")).alias("published_at"),
        F.when(fresh, F.lit(None).cast("timestamp")).otherwise(F.col("disappeared_at")).alias("disappeared_at"),
        F.coalesce("is_stale", F.lit(0)).alias("is_stale"),
        F.when(fresh, F.col("__v")).otherwise(F.col("last_verdict")).alias("last_verdict"),
        F.when(old, F.col("publish_pending")).otherwise((F.col("__first") == "new").cast("int")).alias("publish_pending"),
    )


def next_fingerprints(judged: DataFrame, fingerprints: DataFrame, now: Column) -> DataFrame:
    b = judged.groupBy("content_fingerprint").agg(F.min_by("job_id", "seq").alias("__job"))
    m = fingerprints.join(b, "content_fingerprint", "full")
    return m.select(
        "content_fingerprint",
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("__job").isNotNull(), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.coalesce("origin_job_id", "__job").alias("origin_job_id"),
    )


def mark_absent(jobs: DataFrame, fetched: DataFrame, succeeded: DataFrame, now: Column) -> DataFrame:
    """Rows of sources (source, company) that were fetched with success, but not in fetched (source, company, job_id), disappear."""
    key = ["source", "company"]
    m = jobs.join(succeeded.select(*key).distinct().withColumn("__ok", F.lit(True)), key, "left")
    m = m.join(fetched.select(*key, "job_id").distinct().withColumn("__here", F.lit(True)), [*key, "job_id"], "left")
    gone = F.col("__ok").isNotNull() & F.col("__here").isNull() & F.col("disappeared_at").isNull()
    return m.withColumn("disappeared_at", F.when(gone, now).otherwise(F.col("disappeared_at"))).select(*jobs.columns)


def age_ghosts(jobs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    old = F.col("first_seen_at").cast("timestamp") < now - F.expr(f"INTERVAL {days} DAYS")
    return jobs.withColumn("is_stale", F.when(old, 1).otherwise(F.col("is_stale")))


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("publish_pending = 1 AND is_stale = 0 AND disappeared_at IS NULL")


def mark_published(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    m = jobs.join(ids.select("job_id").distinct().withColumn("__sent", F.lit(True)), "job_id", "left")
    sent = F.col("__sent").isNotNull()
    return m.withColumn("published_at", F.when(sent, now).otherwise(F.col("published_at"))).withColumn("publish_pending", F.when(sent, 0).otherwise(F.col("publish_pending"))).select(*jobs.columns)


def state_counts(jobs: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c)).alias
    return jobs.agg(F.count("*").alias("total"), n("published_at IS NOT NULL")("published"), n("publish_pending = 1")("pending"), n("is_stale = 1")("stale"), n("disappeared_at IS NOT NULL")("disappeared"))
