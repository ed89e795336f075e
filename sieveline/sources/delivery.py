"""Delivery as a sink: tasks post messages and confirm them, and only what is confirmed is marked.

    confirmed = deliver(pending, F.col("job_id"), payload, root, transport, lanes=4)      # a frame of job_id
    jobs = verdict.mark_published(jobs, confirmed, now)

Rows go to `lanes` tasks by ranges of their order, and each task cuts its own into messages of at most `most` entries and
`chars` characters, in order. After each message that was taken, the task writes a receipt (the message's ids) to a folder
that all machines see; a message that has one already is not sent again, so a task that is tried again goes on where it died.
Commit messages hold counts, never ids: the driver reads nothing but them. A message that isn't taken, and whatever a lost
task had not sent, stays pending. One lane keeps the order of all messages; with more, each lane keeps its own.

A transport is what factory(options) gives (module:factory, or `accepting`): post(payloads) -> (status, seconds to wait). 429
waits and tries again, a server's error is tried once more, anything else is final.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROW = "job_id string, chars long, payload string"
#: Entries and characters of a message.
MOST, CHARS = 10, 6000


@dataclass
class Counts(WriterCommitMessage):
    messages: int = 0
    sent: int = 0
    repeated: int = 0
    failed: int = 0


class Accepting:
    """Takes everything. With `posts`, a folder, each message leaves a file there."""

    def __init__(self, options):
        self.posts = options.get("posts")

    def post(self, payloads: list[str]) -> tuple[int, float]:
        if self.posts:
            import os
            import uuid

            with open(os.path.join(self.posts, uuid.uuid4().hex), "w") as f:
                json.dump(payloads, f)
        return 204, 0.0


def messages(rows: Iterator, most: int, chars: int) -> Iterator[list]:
    """Rows in order, in groups that are full by number or size; a row that is too long is a message of its own."""
    held, size = [], 0
    for r in rows:
        if held and (len(held) >= most or size + r.chars > chars):
            yield held
            held, size = [], 0
        held.append(r)
        size += r.chars
    if held:
        yield held


def posted(transport, payloads: list[str], tries: int = 3, sleep=time.sleep) -> bool:
    again = 0
    for _ in range(tries):
        status, wait = transport.post(payloads)
        if 200 <= status < 300:
            return True
        if status == 429:
            sleep(wait)
        elif status >= 500 and not again:
            again = 1
        else:
            return False
    return False


class SinkWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, iterator) -> Counts:
        from pyarrow.fs import FileSystem

        o, done = self.options, Counts()
        module, _, name = o.get("transport", "accepting").partition(":")
        transport = (getattr(importlib.import_module(module), name) if name else {"accepting": Accepting}[module])(o)
        fs, root = FileSystem.from_uri(o["root"])
        fs.create_dir(root, recursive=True)
        for rows in messages(iterator, int(o.get("most", MOST)), int(o.get("chars", CHARS))):
            ids = [r.job_id for r in rows]
            receipt = f"{root}/{hashlib.sha256(json.dumps(ids).encode()).hexdigest()}.json"
            done.messages += 1
            if fs.get_file_info(receipt).type.name == "File":
                done.repeated += len(ids)
            elif posted(transport, [r.payload for r in rows]):
                with fs.open_output_stream(f"{receipt}.tmp") as f:
                    f.write("".join(json.dumps({"job_id": i}) + "\n" for i in ids).encode())
                fs.move(f"{receipt}.tmp", receipt)
                done.sent += len(ids)
            else:
                done.failed += len(ids)
        return done

    def _noted(self, messages, outcome: str) -> None:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.options["root"])
        fs.create_dir(root, recursive=True)
        known = [m for m in messages if m is not None]
        total = {k: sum(getattr(m, k) for m in known) for k in ("messages", "sent", "repeated", "failed")}
        with fs.open_output_stream(f"{root}/_outcome") as f:
            f.write(json.dumps({"outcome": outcome, "tasks": len(known)} | total).encode())

    def commit(self, messages) -> None:
        self._noted(messages, "committed")

    def abort(self, messages) -> None:
        self._noted(messages, "aborted")  # receipts stay: those messages were taken


class MessageSink(DataSource):
    """Options: root, of the receipts; transport; most and chars, of a message; the transport's own."""

    @classmethod
    def name(cls) -> str:
        return "message_sink"

    def writer(self, schema, overwrite: bool) -> SinkWriter:
        return SinkWriter(self.options)


def confirmed(spark: SparkSession, root: str) -> DataFrame:
    """The job_ids of all messages that were taken, whether or not the write came to its end."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("job_id string").option("pathGlobFilter", "*.json").json(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "job_id string")  # nothing was ever sent


def deliver(rows: DataFrame, order: Column, payload: Column, root: str, transport: str = "accepting", lanes: int = 1, must_end: bool = True, **options) -> DataFrame:
    """Send rows (job_id and what order and payload need) and give what is confirmed under root. Not must_end: a task that is lost for good ends the write, and not the caller."""
    spark = rows.sparkSession
    spark.dataSource.register(MessageSink)
    d = rows.select("job_id", payload.alias("payload"), order.alias("__o")).withColumn("chars", F.length("payload").cast("long"))
    d = d.repartitionByRange(lanes, "__o", "job_id").sortWithinPartitions("__o", "job_id").select("job_id", "chars", "payload")
    w = d.write.format("message_sink").mode("append").option("root", root).option("transport", transport)
    for k, v in options.items():
        w = w.option(k, str(v))
    try:
        w.save()
    except Exception:
        if must_end:
            raise
    return confirmed(spark, root)
