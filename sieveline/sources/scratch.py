"""Folders for intermediate files that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset, below one of our own, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_sieveline_scratch", None)
        if not root:
            path = tempfile.mkdtemp(prefix="sieveline-")
            atexit.register(shutil.rmtree, path, True)
            root = spark._sieveline_scratch = "file://" + path
    return f"{root}/sieveline/{uuid.uuid4().hex}/{name}"


def stored(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to files once and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
