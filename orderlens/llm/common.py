"""Readers, shared folder and small expressions used by all operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir, written

_HOME = str(Path(__file__).resolve().parents[2])
# Arrow batches are bounded by rows and by bytes, so that very long texts do not
# pile up in one Python worker.
BATCH_ROWS = 500
BATCH_BYTES = 32 << 20
# Rows of at most some 100 bytes that are broadcast after they were counted.
BROADCAST_ROWS = 200_000

T = TypeVar("T")


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    # Python workers find this package as the driver does, wherever the driver was started.
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_HOME, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text modulo `modulus`; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: str | Column, modulus: int, rest: int = 2) -> Column:
    """Rows kept away from learning; a null key is not held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def raw_bytes(column: str) -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written, narrow table, broadcast if its counted rows are few; a larger one is left
    to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What `make` gives, once per worker process; only the latest key is held, so that the
    models and caches of an earlier stage do not stay in memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


__all__ = ["broadcast_if_small", "held_out", "kept", "prepare", "raw_bytes", "remainder", "table", "written"]
