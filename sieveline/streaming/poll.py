"""Polls as a stream: each micro-batch of raw payload files is one cycle over the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.cycle import run_cycle
from ..sources import state as store
from ..sources.vendors import PARSERS, POSTINGS, broken, parse

RAW = "ats string, source string, company string, company_idx int, payload string, polled_at timestamp"


def postings_of(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batch (RAW) -> postings of all its vendors, and an outcome for each source: errors of unknown vendors and of payloads that can't be read."""
    vendors = [r[0] for r in batch.select("ats").distinct().collect()]  # as many as there are parsers
    known = [v for v in vendors if v in PARSERS]
    key = ["source", "company"]
    postings, bad = None, batch.where(~F.col("ats").isin(known)).select(*key, F.concat(F.lit("no parser for "), F.coalesce("ats", F.lit("null"))).alias("build_error"), F.lit(None).cast("string").alias("fetch_error"))
    for v in known:
        own = batch.where(F.col("ats") == v)
        got = parse(own, v)
        postings = got if postings is None else postings.unionByName(got)
        bad = bad.unionByName(broken(own, v).select(*key, F.lit(None).cast("string").alias("build_error"), F.col("error").alias("fetch_error")))
    errors = bad.groupBy(*key).agg(F.min("build_error").alias("build_error"), F.min("fetch_error").alias("fetch_error"))
    sources = batch.groupBy(*key).agg(F.min("company_idx").alias("company_idx"))
    if postings is None:
        postings = batch.sparkSession.createDataFrame([], POSTINGS)
    postings = postings.join(sources, key)
    counts = postings.groupBy(*key).agg(F.count("*").alias("n"))
    outcomes = sources.select(*key).join(counts, key, "left").na.fill(0, ["n"]).join(errors, key, "left")
    return postings, outcomes


def start(spark: SparkSession, raw_dir: str, root: str, config, checkpoint: str, on_new=None, **how) -> StreamingQuery:
    """State never expires and a posting's absence means something, so this is foreachBatch over snapshots, not a watermark.

    A snapshot carries its batch's number: a batch that is replayed starts from the snapshot before it and takes its own's
    place, whether or not the pointer had moved. on_new may see a replayed batch's postings again; they are the same ones.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        latest = batch.agg(F.max("polled_at")).first()[0]
        if latest is not None:
            postings, outcomes = postings_of(batch)
            name = f"batch-{number:08d}"
            c = run_cycle(postings, outcomes, store.load(spark, root, name), config, F.lit(latest), **how)
            if on_new:
                on_new(c.publishable, number)
            store.save(spark, root, name, c.state)
            c.release()
        batch.unpersist()

    return spark.readStream.schema(RAW).json(raw_dir).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
