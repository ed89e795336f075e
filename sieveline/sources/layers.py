"""State as layers of changed rows: a batch writes what it changes, in folders by bucket of the key, and reads the buckets that it touches.

A table is a list of layers, oldest first; a key's current row is that of the newest layer that has it. Reading joins each layer
against the keys of the newer ones, which are of a batch's size and broadcast while they are small: old rows don't shuffle.
Layers are merged when there are more than `most`: the newest ones, as long as an older one is not more than twice as large as
what is merged already. So a row is written again as often as the state doubles, not with each batch.

One pointer file names all layers, and those before the last batch: a batch that is replayed after its layers became current
starts from the ones before, and takes its own's place. Nothing that a pointer names is written again. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, state

KEYS = {"jobs": "job_id", "fingerprints": "content_fingerprint"}


@dataclass
class Layers:
    spark: SparkSession
    root: str
    tables: dict[str, str] = field(default_factory=lambda: {t: state.TABLES[t] for t in KEYS})
    keys: dict[str, str] = field(default_factory=lambda: dict(KEYS))
    buckets: int = 256
    most: int = 6

    def _pointer(self) -> dict | None:
        fs, path = state._fs(self.spark, f"{self.root}/CURRENT")
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT").first()[0]) if fs.exists(path) else None

    def layers(self, table: str, batch: str | None = None) -> list[dict]:
        """{folder, bytes, buckets} of each layer, oldest first; for a batch that is replayed, those before it."""
        now = self._pointer()
        if now is None:
            return []
        return (now["before"] if batch is not None and now["batch"] == batch else now["tables"]).get(table, [])

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[table]), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of some keys; at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket(table)).distinct().collect())

    def read(self, table: str, keys: DataFrame | None = None, columns: list[str] | None = None, batch: str | None = None) -> DataFrame:
        """Current rows: of all keys, or of those in `keys` (a column of the key's name), from their buckets' files alone."""
        key = self.keys[table]
        wanted = None if keys is None else self.touched(table, keys)
        out = self._merged(table, self.layers(table, batch), columns, wanted)
        return out if keys is None else out.join(keys.select(key).distinct(), key, "left_semi")

    def _merged(self, table: str, layers: list[dict], columns: list[str] | None = None, wanted: list[int] | None = None) -> DataFrame:
        key, ddl = self.keys[table], self.tables[table]
        columns = columns or [x.strip().split()[0] for x in ddl.split(",")]
        out, newer = [], None
        for layer in reversed(layers):
            some = layer["buckets"] if wanted is None else sorted(set(wanted) & set(layer["buckets"]))
            if not some:
                continue
            d = self.spark.read.option("basePath", f"{self.root}/{layer['folder']}").schema(f"{ddl}, bucket int").parquet(*[f"{self.root}/{layer['folder']}/bucket={b}" for b in some] if wanted is not None else [f"{self.root}/{layer['folder']}"])
            rows = d.select(*columns)
            out.append(rows if newer is None else rows.join(newer, key, "left_anti"))
            newer = d.select(key) if newer is None else newer.unionAll(d.select(key))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], ddl).select(*columns)

    def _written(self, table: str, rows: DataFrame, name: str) -> dict | None:
        folder = f"{name}/{table}"
        rows.withColumn("bucket", self.bucket(table)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        fs, at = state._fs(self.spark, f"{self.root}/{folder}")
        found = sorted(int(m[1]) for f in fs.listStatus(at) if (m := re.fullmatch(r"bucket=(\d+)", f.getPath().getName())))
        return {"folder": folder, "bytes": fs.getContentSummary(at).getLength(), "buckets": found} if found else None

    def write(self, batch: str, changes: dict[str, DataFrame]) -> dict[str, list[dict]]:
        """Add a layer of changed rows (whole rows, one for each key) to each of some tables, and merge layers where there are too many."""
        name = f"{batch}-{uuid.uuid4().hex[:12]}"
        before = {t: self.layers(t, batch) for t in self.tables}
        after = {t: list(x) for t, x in before.items()}
        for t, rows in changes.items():
            if made := self._written(t, rows, name):
                after[t].append(made)
            if len(after[t]) > self.most:
                after[t] = self._compacted(t, after[t], name)
        state.point(self.spark, self.root, name, {"batch": batch, "tables": after, "before": before, "version": state.VERSION})
        return after

    def _compacted(self, table: str, layers: list[dict], name: str) -> list[dict]:
        n, size = len(layers) - 1, layers[-1]["bytes"]
        while n and (layers[n - 1]["bytes"] <= 2 * size or len(layers) - n < 2):
            n -= 1
            size += layers[n]["bytes"]
        merged = self._written(table, self._merged(table, layers[n:]), f"{name}-merged")
        return [*layers[:n], merged] if merged else layers[:n]

    def prune(self) -> list[str]:
        """Remove folders that neither the pointer nor a replay of its batch can need; gives their names."""
        now = self._pointer()
        if now is None:
            return []
        used = {x["folder"].split("/")[0] for part in ("tables", "before") for ls in now[part].values() for x in ls}
        fs, at = state._fs(self.spark, self.root)
        gone = [f.getPath() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName() not in used]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def advance(store: Layers, name: str, batch: DataFrame, now: Column, fetched: DataFrame | None = None, succeeded: DataFrame | None = None, resurrection: int = 7, repost: int = 180, stale: int = 90, seed: bool = False, stored: bool = False) -> DataFrame:
    """Judge a batch (as operators.verdict takes it) against the layers and add one with what it changes. Gives the judged batch, in files that stay until prune.

    Jobs and fingerprints of the batch are read from their buckets. What is absent or too old is found in a few columns of all
    jobs, and only such rows are read and written whole. fetched and succeeded: as in verdict.mark_absent. The batch is read six
    times, so it is written to files first, unless it is stored already: what its columns cost is paid once.
    """
    from ..operators import verdict

    here = f"{store.root}/{name}-{uuid.uuid4().hex[:12]}-batch"
    if not stored:
        batch = scratch.stored(batch, f"{here}/read")
    known = store.read("jobs", batch, batch=name)
    prints = store.read("fingerprints", batch, batch=name)
    judged = scratch.stored(verdict.verdicts(batch, known, prints, now, resurrection, repost, seed), f"{here}/judged")
    rest = store.read("jobs", None, ["job_id", "source", "company", "first_seen_at", "disappeared_at", "is_stale"], name).join(batch.select("job_id").distinct(), "job_id", "left_anti")

    def later(rows: DataFrame) -> DataFrame:
        if fetched is not None:
            rows = verdict.mark_absent(rows, fetched, succeeded, now)
        return verdict.age_ghosts(rows, now, stale)

    old = rest.select("job_id", F.struct("disappeared_at", "is_stale").alias("__was"))
    moved = later(rest).join(old, "job_id").where(~F.struct("disappeared_at", "is_stale").eqNullSafe(F.col("__was"))).select("job_id").persist(StorageLevel.DISK_ONLY)
    # all known jobs are in the batch, which brings their content
    history = known.select(*[c if c in verdict.HISTORY or c not in judged.columns else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns])
    changed = later(verdict.next_jobs(judged, history, now)).unionByName(later(store.read("jobs", moved, batch=name)))
    store.write(name, {"jobs": changed, "fingerprints": verdict.next_fingerprints(judged, prints, now)})
    moved.unpersist()
    return judged
