"""Verdicts as keyed streaming state: a stream of postings gives a stream of verdicts and of changed rows of the state.

Two stateful steps. By fingerprint: when it was last seen before this batch, and whether an earlier row of the batch has it. By
job: the verdict, the job's next state, and a timer that ages it. State is kept by Spark's state store, in buckets of keys by
hash, so a batch reads and writes the buckets that it touches: each call of the store from Python takes longer than the work on a
key, and a bucket needs four. `buckets` stays the same for a checkpoint; about a few hundred keys in each are best. A restart
goes on from the checkpoint. A row's own polled_at is its clock, nothing reads another.

Input: job_id, content_fingerprint, seq (the order of the whole batch), polled_at, and the fields whose change is a bump. Rows of
one bucket and batch are held together while they are put in order, which the trigger's size bounds. Rows older than the
watermark (the latest polled_at of the batches before, less `late`) are dropped by Spark, as everywhere with event time: `late`
must be as long as a source may lag behind the others. A job that nothing touches ages as soon as the watermark is past its 90
days; one that a batch touches, in that batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.verdict import COMPARED

DAY_US = 86_400_000_000
#: at is polled_at in microseconds.
ROW = "job_id string, content_fingerprint string, seq long, polled_at timestamp, at long, mark string"
SEEN = ROW + ", fp_seen long, fp_again boolean"
FINGERPRINT = "content_fingerprint string, at long"
JOB = "job_id string, first_seen_at long, last_seen_at long, is_stale int, last_verdict string, publish_pending int, mark string"
#: kind is `verdict` for a row of input, and `state` for a job's changed state; times of states are in microseconds, and so is at.
OUT = "kind string, job_id string, seq long, verdict string, first_seen_at long, last_seen_at long, is_stale int, publish_pending int, at long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096


def by_key(rows: Iterator[Row], name: str) -> Iterator[tuple[str | None, list[Row]]]:
    """Each key's rows, in order of seq."""
    of = lambda r: r[name]
    order = sorted(rows, key=lambda r: (of(r) is not None, of(r) or "", r.seq))
    return ((k, list(g)) for k, g in groupby(order, of))


class Fingerprints(StatefulProcessor):
    """Adds fp_seen, the time that the state has, and fp_again, whether an earlier row of the batch has the fingerprint."""

    def init(self, handle) -> None:
        self.held = handle.getListState("held", FINGERPRINT)

    def handleInputRows(self, key, rows, timerValues):
        held = dict(tuple(x) for x in self.held.get())
        for k, d in by_key(rows, "content_fingerprint"):
            old = held.get(k)
            held[k] = max(r.at for r in d)
            for i, r in enumerate(d):
                yield Row(**{c: v for c, v in r.asDict().items() if c != "bucket"}, fp_seen=old, fp_again=i > 0)
        self.held.put(list(held.items()))

    def close(self) -> None:
        pass


class Jobs(StatefulProcessor):
    def __init__(self, resurrection: int, repost: int, stale: int):
        self.resurrection, self.repost, self.stale = resurrection, repost, stale * DAY_US

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", JOB)

    def due(self, job: tuple) -> int:
        return (job[0] + self.stale) // 1000 + 1

    def kept(self, held: dict[str | None, tuple]) -> None:
        """Write a bucket's jobs, with a timer at the next one's age."""
        self.held.put([(k, *x) for k, x in held.items()])
        if waiting := [self.due(x) for x in held.values() if not x[2]]:
            self.handle.registerTimer(min(waiting))

    def read(self) -> dict[str | None, tuple]:
        return {x[0]: tuple(x[1:]) for x in self.held.get()}

    def handleInputRows(self, key, rows, timerValues):
        held = self.read()
        for k, d in by_key(rows, "job_id"):
            now = max(r.at for r in d)
            old = held.get(k)
            given, mark = [], old[5] if old else None
            for i, r in enumerate(d):
                if i or old:
                    late = not i and (now - old[1]) // DAY_US > self.resurrection
                    given.append("resurrection" if late else "bump" if r.mark != mark else "known")
                else:
                    recent = r.fp_seen is not None and (now - r.fp_seen) // DAY_US <= self.repost
                    given.append("repost" if r.fp_again or recent else "new")
                mark = r.mark
            first = old[0] if old else now
            pending = old[4] if old else int(given[0] == "new")
            stale = int(bool(old and old[2]) or first < now - self.stale)
            held[k] = (first, now, stale, given[-1], pending, mark)
            for r, v in zip(d, given, strict=True):
                yield Row(kind="verdict", job_id=k, seq=r.seq, verdict=v, first_seen_at=None, last_seen_at=None, is_stale=None, publish_pending=None, at=r.at)
            yield state_row(k, held[k], now)
        self.kept(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All of the bucket's jobs whose age the watermark is past."""
        held, past = self.read(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        aged = {k: (*x[:2], 1, *x[3:]) for k, x in held.items() if not x[2] and self.due(x) <= past}
        if aged or held:
            self.kept({**held, **aged})
        for k, x in aged.items():
            yield state_row(k, x, self.due(x) * 1000)

    def close(self) -> None:
        pass


def state_row(job_id: str | None, x: tuple, at: int) -> Row:
    return Row(kind="state", job_id=job_id, seq=None, verdict=x[3], first_seen_at=x[0], last_seen_at=x[1], is_stale=x[2], publish_pending=x[4], at=at)


def judged(postings: DataFrame, resurrection: int = 7, repost: int = 180, stale: int = 90, late: str = "1 day", fields: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of postings -> a stream of OUT, with polled_at as a timestamp for at."""
    spark = postings.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    fields = [c for c in fields or COMPARED if c in postings.columns]
    mark = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    polled = F.col("polled_at").cast("timestamp")
    rows = postings.select("job_id", "content_fingerprint", F.col("seq").cast("long").alias("seq"), polled.alias("polled_at"), F.unix_micros(polled).alias("at"), mark.alias("mark"))
    rows = rows.withWatermark("polled_at", late)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    seen = rows.withColumn("bucket", bucket("content_fingerprint")).groupBy("bucket").transformWithState(statefulProcessor=Fingerprints(), outputStructType=SEEN, outputMode="Append", timeMode="EventTime", eventTimeColumnName="polled_at")
    out = seen.withColumn("bucket", bucket("job_id")).groupBy("bucket").transformWithState(statefulProcessor=Jobs(resurrection, repost, stale), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.select(*[c for c in out.columns if c != "at"], F.timestamp_micros("at").alias("polled_at"))


def current(changes: DataFrame) -> DataFrame:
    """The state that a stream's output adds up to: each job's last row, an aged one after the batch's own."""
    last = F.max_by(F.struct("first_seen_at", "last_seen_at", "is_stale", "verdict", "publish_pending"), F.struct("last_seen_at", "is_stale")).alias("s")
    s = changes.where("kind = 'state'").groupBy("job_id").agg(last)
    at = lambda c: F.timestamp_micros(f"s.{c}").alias(c)
    return s.select("job_id", at("first_seen_at"), at("last_seen_at"), F.col("s.is_stale").alias("is_stale"), F.col("s.verdict").alias("last_verdict"), F.col("s.publish_pending").alias("publish_pending"))
