"""State as versioned Parquet snapshots: a snapshot is written whole, then a pointer file names it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
JOBS = "job_id string, content_fingerprint string, company string, source string, external_id string, title string, location string, contract_type string, url string, description string, source_posted_at string, first_seen_at timestamp, last_seen_at timestamp, published_at timestamp, disappeared_at timestamp, is_stale int, last_verdict string, publish_pending int"
FINGERPRINTS = "content_fingerprint string, first_seen_at timestamp, last_seen_at timestamp, origin_job_id string"
HEALTH = "source string, company string, last_success_at timestamp, last_failure_at timestamp, consecutive_failures int, last_error string, has_seen_postings int"
TABLES = {"jobs": JOBS, "fingerprints": FINGERPRINTS, "health": HEALTH}
#: Columns that versions brought, with what older snapshots have there.
ADDED = {2: {"health": {"has_seen_postings": 0}}, 3: {"jobs": {"publish_pending": 0}}}


def migrate(df: DataFrame, table: str, version: int) -> DataFrame:
    """Bring a snapshot's table to the current version, step by step; doing it twice changes nothing."""
    for v in range(version + 1, VERSION + 1):
        for c, value in ADDED.get(v, {}).get(table, {}).items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(value))
    return df


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: the snapshot's folder and version, the batch that wrote it, and the folder that the batch started from."""
    fs, path = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/CURRENT").first()[0])


def load(spark: SparkSession, root: str, batch: str | None = None) -> dict[str, DataFrame]:
    """The current state. A batch that is replayed after its snapshot became current starts from the one before, as it did at first."""
    now = current(spark, root)
    name, version = (None, VERSION) if now is None else (now["before"], now["before_version"]) if batch is not None and now["batch"] == batch else (now["folder"], now["version"])
    if name is None:
        return {t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}
    return {t: migrate(spark.read.parquet(f"{root}/{name}/{t}"), t, int(version)) for t in TABLES}


def point(spark: SparkSession, root: str, name: str, content: dict) -> None:
    """Let the pointer file say this from now on: a new file takes its place by a rename. name: of the one who writes, not used twice."""
    fs, at = _fs(spark, f"{root}/.CURRENT-{name}")
    out = fs.create(at, True)
    out.write(bytearray((json.dumps(content) + "\n").encode()))
    out.close()
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, _fs(spark, f"{root}/CURRENT")[1], how)


def save(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame]) -> str:
    """Write a snapshot into a folder of its own, then let the pointer name it, by a rename. One writer at a time.

    Nothing that a pointer names is ever written again: an attempt that dies leaves the state as it was, and a replay of
    the current batch takes its place, with the same predecessor. Gives the folder's name.
    """
    folder = f"{batch}-{uuid.uuid4().hex[:12]}"
    for t, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{t}")
    now = current(spark, root)
    again = now is not None and now["batch"] == batch
    before = (None, VERSION) if now is None else (now["before"], now["before_version"]) if again else (now["folder"], now["version"])
    point(spark, root, folder, {"folder": folder, "version": VERSION, "batch": batch, "before": before[0], "before_version": before[1]})
    return folder


def prune(spark: SparkSession, root: str) -> list[str]:
    """Remove snapshots that neither the pointer nor a replay of its batch can need; gives their names."""
    now = current(spark, root)
    fs, at = _fs(spark, root)
    gone = []
    for f in fs.listStatus(at) if now else []:
        name = f.getPath().getName()
        if f.isDirectory() and name not in (now["folder"], now["before"]):
            fs.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)
