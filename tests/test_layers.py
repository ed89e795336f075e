"""State in layers: what it holds, what a batch reads and writes, merging, replays."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import verdict
from sieveline.sources import layers, state

BATCH = "job_id string, content_fingerprint string, company string, source string, external_id string, title string, location string, contract_type string, url string, description string, source_posted_at string, seq long"


def batch(spark, r, n, low, high, day):
    rows = []
    for i in range(n):
        j = r.randrange(low, high)
        rows.append((f"j{j}", f"f{j // 2}", f"c{j % 5}", "s", str(j), f"t{j}" if r.random() < 0.9 else "other", "Paris", "other", f"u{j}", "x" * 200, None, i))
    return spark.createDataFrame(rows, BATCH), F.lit(f"{day} 09:00:00").cast("timestamp")


def content(d):
    return sorted(map(repr, d.select(*sorted(d.columns)).collect()))


def fixed(d):
    """The same rows without their history."""
    return d.sparkSession.createDataFrame(d.collect(), d.schema)


def test_same_as_whole_snapshots(spark, tmp_path):
    store = layers.Layers(spark, f"file://{tmp_path}/s", buckets=4, most=3)
    jobs, fps = (spark.createDataFrame([], state.TABLES[t]) for t in ("jobs", "fingerprints"))
    r, counts = random.Random(2), []
    for k in range(4):
        b, now = batch(spark, r, 30, 10 * k, 40 + 15 * k, f"2024-0{2 * k + 1}-05")
        ok = spark.createDataFrame([("s", f"c{x}") for x in range(k % 5 + 1)], "source string, company string")
        judged = fixed(verdict.verdicts(b, jobs, fps, now))
        fps = fixed(verdict.next_fingerprints(judged, fps, now))
        jobs = fixed(verdict.age_ghosts(verdict.mark_absent(verdict.next_jobs(judged, jobs, now), b, ok, now), now))
        got = layers.advance(store, f"b{k}", b, now, b, ok)
        assert content(got) == content(judged)
        assert content(store.read("jobs")) == content(jobs) and content(store.read("fingerprints")) == content(fps)
        counts.append(len(store.layers("jobs")))
    assert max(counts) <= 3 and jobs.where("is_stale = 1").count() and jobs.where("disappeared_at IS NOT NULL").count()
    gone = store.prune()
    assert gone and content(store.read("jobs")) == content(jobs)


def rows_of(spark, ids, day="2024-01-01"):
    at = F.lit(f"{day} 00:00:00").cast("timestamp")
    d = spark.createDataFrame([(i,) for i in ids], "n int").withColumn("job_id", F.concat(F.lit("j"), F.col("n")))
    return d.select(*[F.col("job_id") if c == "job_id" else at.alias(c) if c in ("first_seen_at", "last_seen_at") else F.lit(0).alias(c) if c in ("is_stale", "publish_pending") else F.lit(None).cast(t).alias(c) if t != "string" else F.sha2(F.concat("job_id", F.lit(day + c)), 256).alias(c) for c, t in (x.split() for x in state.JOBS.split(", "))])


def test_a_batch_reads_its_buckets_and_writes_its_rows(spark, tmp_path):
    store = layers.Layers(spark, f"file://{tmp_path}/s", {"jobs": state.JOBS}, {"jobs": "job_id"}, buckets=64)
    first = store.write("a", {"jobs": rows_of(spark, range(4000))})["jobs"][0]
    second = store.write("b", {"jobs": rows_of(spark, range(3), "2024-02-01")})["jobs"][1]
    assert len(first["buckets"]) == 64 and len(second["buckets"]) <= 3 and second["bytes"] < first["bytes"] / 20
    some = rows_of(spark, [1, 2]).select("job_id")
    read = store.read("jobs", some)
    assert {x.last_seen_at.month for x in read.collect()} == {2} and read.count() == 2
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) <= 2
    assert store.read("jobs").count() == 4000 and store.read("jobs").where("last_seen_at > '2024-01-15'").count() == 3
    # merging small layers leaves the large one alone
    for i in range(8):
        now = store.write(f"c{i}", {"jobs": rows_of(spark, [i], "2024-03-01")})["jobs"]
    assert now[0] == first and len(now) <= 6 and store.read("jobs").where("last_seen_at > '2024-02-15'").count() == 8


def test_replay_starts_from_the_layers_before(spark, tmp_path):
    store = layers.Layers(spark, f"file://{tmp_path}/s", {"jobs": state.JOBS}, {"jobs": "job_id"}, buckets=4)
    assert store.read("jobs").count() == 0 and store.prune() == []
    store.write("a", {"jobs": rows_of(spark, range(5))})
    store.write("b", {"jobs": rows_of(spark, range(3, 9), "2024-02-01")})
    assert store.read("jobs").count() == 9 and store.read("jobs", batch="b").count() == 5
    store.write("b", {"jobs": rows_of(spark, range(3, 7), "2024-02-01")})  # the driver died after the pointer had moved
    assert store.read("jobs").count() == 7 and len(store.layers("jobs")) == 2 and len(store.prune()) == 1
    # a batch that dies while it writes leaves the state as it was
    with pytest.raises(Exception):  # noqa: B017
        store.write("c", {"jobs": rows_of(spark, range(20)).withColumn("is_stale", F.raise_error(F.lit("lost")).cast("int"))})
    assert store.read("jobs").count() == 7
    store.write("d", {"jobs": rows_of(spark, [])})
    assert store.read("jobs").count() == 7


def test_a_batch_is_computed_once(spark, tmp_path):
    store = layers.Layers(spark, f"file://{tmp_path}/s", buckets=4)
    b, now = batch(spark, random.Random(4), 40, 0, 30, "2024-01-05")
    made = spark.sparkContext.accumulator(0)

    def folded(x):
        made.add(1)
        return x

    judged = layers.advance(store, "a", b.withColumn("content_fingerprint", F.udf(folded, "string")("content_fingerprint")), now)
    assert made.value == 40 and judged.count() == 40
