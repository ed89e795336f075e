"""Verdicts by keyed streaming state give what the joins over stored state give, batch by batch and after restarts."""

import random

from pyspark.sql import functions as F

from sieveline.operators import verdict
from sieveline.streaming import stateful

POSTING = "job_id string, content_fingerprint string, title string, location string, seq long, polled_at timestamp"
JOBS = "job_id string, content_fingerprint string, title string, location string, first_seen_at timestamp, last_seen_at timestamp, published_at timestamp, disappeared_at timestamp, is_stale int, last_verdict string, publish_pending int"
FINGERPRINTS = "content_fingerprint string, first_seen_at timestamp, last_seen_at timestamp, origin_job_id string"


def batches(r):
    """Four polls: rows that repeat a job or a fingerprint, jobs that change, come back late, or never again."""
    out = []
    for k, day in enumerate(("2024-01-01", "2024-01-04", "2024-01-20", "2024-04-20")):
        rows = []
        for i in range(40):
            j = r.randrange(25) + 6 * k
            rows.append((f"j{j}", f"f{r.randrange(12) + 8 * k if r.random() < 0.5 else j + 100}", f"t{j if r.random() < 0.8 else -j}", None if j % 9 == 0 else "x", i, f"{day} 10:00:00"))
        out.append(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, POSTING.replace("polled_at timestamp", "at string")).withColumn("polled_at", F.to_timestamp("at")).drop("at")


def fixed(d):
    return d.sparkSession.createDataFrame(d.collect(), d.schema)


def test_same_as_joins_over_stored_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        fields = ["content_fingerprint", "title", "location"]
        jobs, fps = spark.createDataFrame([], JOBS), spark.createDataFrame([], FINGERPRINTS)
        source, sink, point = (str(tmp_path / x) for x in ("in", "out", "point"))
        for n, rows in enumerate(batches(random.Random(3))):
            b = frame(spark, rows)
            now = F.lit(rows[0][5]).cast("timestamp")
            judged = fixed(verdict.verdicts(b.drop("polled_at"), jobs, fps, now, fields=fields))
            fps = fixed(verdict.next_fingerprints(judged, fps, now))
            jobs = fixed(verdict.age_ghosts(verdict.next_jobs(judged, jobs, now), now))
            b.coalesce(1).write.mode("append").parquet(source)
            # each batch is a query of its own, which goes on from the checkpoint
            stream = spark.readStream.schema(b.schema).parquet(source)
            q = stateful.judged(stream, fields=fields, late="0 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).trigger(availableNow=True).start()
            q.awaitTermination()
            out = spark.read.parquet(sink)
            want = sorted((r.seq, r.job_id, r.verdict) for r in judged.collect())
            got = out.where(f"kind = 'verdict' AND polled_at = '{rows[0][5]}'")
            assert sorted((r.seq, r.job_id, r.verdict) for r in got.collect()) == want
            cols = ["job_id", "first_seen_at", "last_seen_at", "is_stale", "last_verdict", "publish_pending"]
            assert sorted(map(tuple, stateful.current(out).select(*cols).collect())) == sorted(map(tuple, jobs.select(*cols).collect()))
        kinds = {r.verdict for r in out.collect()}
        assert kinds == {"new", "known", "bump", "repost", "resurrection"} and jobs.where("is_stale = 1").count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
