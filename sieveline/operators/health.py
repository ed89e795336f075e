"""Source health: failures in a row, last success, and whether a source ever had postings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(outcomes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """outcomes (key, order, at, ok boolean, n postings, error) replayed in order -> one row per key.

    Failures in a row are those after the last success. Its place is a maximum, and what comes after it a count: both are combined
    before they are shuffled, so that a source with most of the outcomes is no sorted window of one task.
    """
    place = F.struct(*order)
    won = outcomes.where("ok").groupBy(*key).agg(F.max(place).alias("__won"))
    o = outcomes.alias("o").join(won.select(*[F.col(k).alias(f"__{k}") for k in key], "__won"), reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"__{k}")) for k in key)), "left")
    after = F.col("__won").isNull() | (place > F.col("__won"))
    last = lambda cond, c: F.max_by(F.when(cond, F.col(c)), F.when(cond, place))
    return o.groupBy(*key).agg(
        F.count_if(~F.col("ok") & after).cast("int").alias("consecutive_failures"),
        last(F.col("ok"), "at").alias("last_success_at"),
        last(~F.col("ok"), "at").alias("last_failure_at"),
        last(~F.col("ok"), "error").alias("last_error"),
        F.max(F.when(F.col("ok") & (F.col("n") > 0), 1).otherwise(0)).alias("has_seen_postings"),
    )


def unhealthy(health: DataFrame, threshold: int = 3) -> DataFrame:
    return health.where(F.col("consecutive_failures") >= threshold)


def routed(outcomes: DataFrame, health: DataFrame, key: list[str]) -> DataFrame:
    """outcomes (key, build_error, fetch_error, n) -> with outcome: skipped, failure or success. An empty board of a source that had postings failed."""
    seen = health.select(*key, F.col("has_seen_postings").alias("__seen"))
    outcome: Column = (
        F.when(F.col("build_error").isNotNull(), "skipped").when(F.col("fetch_error").isNotNull(), "failure").when((F.col("n") == 0) & (F.coalesce("__seen", F.lit(0)) == 1), "failure").otherwise("success")
    )
    return outcomes.join(seen, key, "left").withColumn("outcome", outcome).drop("__seen")
