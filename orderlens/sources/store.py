"""Processed outputs by logical name: parquet tables, JSON assets, CSV export."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..constants import JSON_ASSETS, PROCESSED_TABLES

BUILD_HINT = "Run `python -m orderlens build` first."


def _located(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _located(spark, path)
    return files.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    files, target = _located(spark, path)
    files.delete(target, True)


def write_json(spark: SparkSession, path: str, payload: dict[str, Any], mode="overwrite") -> None:
    """One small record as a JSON line, on any file system Spark can write."""
    line = spark.createDataFrame([(json.dumps(payload, default=str),)], "value string")
    line.coalesce(1).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


class Store:
    """The processed tables and JSON assets below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        kind = "json" if name in JSON_ASSETS else "parquet"
        return f"{self.root}/{name}.{kind}"

    def paths(self) -> dict[str, str]:
        return {name: self.path(name) for name in [*PROCESSED_TABLES, *JSON_ASSETS]}

    def _complete(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def missing(self) -> list[str]:
        return [name for name in self.paths() if not self._complete(name)]

    def ready(self) -> bool:
        return not self.missing()

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and return it as read back, with its lineage cut."""
        self._known(name, PROCESSED_TABLES, "table")
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str, build: Callable[[], Any] | None = None) -> DataFrame:
        """A processed table; build runs only when given and the table is missing."""
        self._known(name, PROCESSED_TABLES, "table")
        self._present(name, build)
        return self.spark.read.parquet(self.path(name))

    def write_json(self, name: str, payload: dict[str, Any]) -> None:
        self._known(name, JSON_ASSETS, "JSON asset")
        write_json(self.spark, self.path(name), payload)

    def read_json(self, name: str, build: Callable[[], Any] | None = None) -> dict[str, Any]:
        self._known(name, JSON_ASSETS, "JSON asset")
        self._present(name, build)
        return read_json(self.spark, self.path(name))

    def export_csv(self, target: str) -> dict[str, str]:
        """Every processed table as CSV with a header, for tools without parquet."""
        written = {}
        for name in PROCESSED_TABLES:
            written[name] = f"{target.rstrip('/')}/{name}.csv"
            self.read(name).write.mode("overwrite").option("header", True).csv(written[name])
        return written

    def _known(self, name: str, names: list[str], kind: str) -> None:
        if name not in names:
            raise KeyError(f"Unknown {kind}: {name}")

    def _present(self, name: str, build: Callable[[], Any] | None) -> None:
        if self._complete(name):
            return
        if build is not None:
            build()
        if not self._complete(name):
            raise FileNotFoundError(f"{name!r} is missing at {self.path(name)}. {BUILD_HINT}")
