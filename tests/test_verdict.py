"""Verdicts against a sequential model on random batches; the stated scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import verdict as v

T0 = dt.datetime(2024, 1, 1, 12)
BATCH = "seq long, job_id string, content_fingerprint string, title string, url string"
JOBS = "job_id string, content_fingerprint string, title string, url string, first_seen_at timestamp, last_seen_at timestamp, published_at timestamp, disappeared_at timestamp, is_stale int, last_verdict string, publish_pending int"
FPS = "content_fingerprint string, first_seen_at timestamp, last_seen_at timestamp, origin_job_id string"


def model(batch, jobs, fps, now):
    out = []
    for _, j, f, title, url in batch:
        if j in jobs:
            old = jobs[j]
            if (now - old["seen"]) // dt.timedelta(days=1) > 7:
                kind = "resurrection"
            else:
                kind = "known" if old["c"] == (f, title, url) else "bump"
        else:
            kind = "repost" if f in fps and (now - fps[f]) // dt.timedelta(days=1) <= 180 else "new"
        jobs[j] = {"seen": now, "c": (f, title, url)}
        fps[f] = now
        out.append(kind)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_the_sequential_model(spark, seed):
    r = random.Random(seed)
    lit = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    jobs, fps, mj, mf, now = spark.createDataFrame([], JOBS), spark.createDataFrame([], FPS), {}, {}, T0
    for _ in range(3):
        batch = [(i, f"j{r.randrange(25)}", f"f{r.randrange(20)}", r.choice(["a", "b", None]), "u") for i in range(60)]
        d = v.verdicts(spark.createDataFrame(batch, BATCH), jobs, fps, lit(now))
        got = [x.verdict for x in d.orderBy("seq").collect()]
        assert got == model(batch, mj, mf, now)
        nj, nf = v.next_jobs(d, jobs, lit(now)).collect(), v.next_fingerprints(d, fps, lit(now)).collect()
        assert {x.job_id: (x.content_fingerprint, x.title, x.url) for x in nj} == {k: x["c"] for k, x in mj.items()}
        assert {x.content_fingerprint: x.last_seen_at for x in nf} == mf
        jobs, fps = spark.createDataFrame(nj, JOBS), spark.createDataFrame(nf, FPS)
        now += dt.timedelta(days=r.choice([3, 7, 30, 200]), hours=r.choice([0, 23]))


def test_days_are_periods_of_24_hours(spark):
    d = spark.sql("SELECT timestamp'2024-01-01 23:00:00' a, timestamp'2024-01-09 00:00:01' b").select(v.days_between(F.col("b"), F.col("a")))
    assert d.first()[0] == 7


def test_absence_and_backlog(spark):
    jobs = spark.createDataFrame([("s", "c", "1", None, 1, 0), ("s", "c", "2", None, 1, 0), ("s", "d", "3", None, 1, 0)], "source string, company string, job_id string, disappeared_at timestamp, publish_pending int, is_stale int")
    here = spark.createDataFrame([("s", "c", "1")], "source string, company string, job_id string")
    ok = spark.createDataFrame([("s", "c")], "source string, company string")
    out = v.mark_absent(jobs, here, ok, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.job_id for r in out.where("disappeared_at IS NOT NULL").collect()) == ["2"]
    assert sorted(r.job_id for r in v.pending(out).collect()) == ["1", "3"]
