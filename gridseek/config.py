"""Settings of the pipeline and the state of its stages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Defaults change results; they are those of the published system."""

    strategy: str = "RelationGraph"
    dev_table_pct: float = 0.2
    dev_n: int = 2000
    train_incr_size: int = 1500
    retr_top_n: int = 2000
    max_retr: int = 10000
    min_tables: int = 5
    rel_num_train: int = 100
    rel_num_test: int = 250
    top_tables: int = 5
    n_probe: int = 512

    @classmethod
    def read(cls, path: str) -> Config:
        given = json.loads(Path(path).read_text())
        return cls(**{k: v for k, v in given.items() if k in {f.name for f in fields(cls)}})


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark keeps it, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Stages in order; a stage that is run again makes those behind it stale.
ORDER = ("rows", "tables", "passages", "embeddings", "lists", "words")


class Stages:
    """Which stages of a working folder are done, by marker files beside the tables, wherever Spark keeps them.

    A finished stage is not run again unless asked, or unless a stage before it was."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _marker(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_done/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def run(self, name: str, work: Callable[[], object], again: bool = False) -> None:
        files, marker = self._marker(name)
        if not again and files.exists(marker):
            return
        for later in ORDER[ORDER.index(name.split("/")[0]) :]:
            files.delete(self._marker(later)[1], True)
        work()
        files.create(marker, True).close()
