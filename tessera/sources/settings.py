"""What a run is set up with: listed files, stage settings, stop words and model factories."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stem


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, stem)`` of the Parquet files below a folder, in order of their paths; read by any file system of Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return files.select("path").withColumn("stem", stem(F.col("path"))).orderBy("path")


def settings(spark: SparkSession, path: str, kind: type):
    """A dataclass filled from a JSON or, where a YAML parser is installed, a YAML file; unknown names are an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    unknown = set(found) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**found)


def stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A stop-word list, one entry a line, several words and upper case allowed; blank lines don't count."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("w")).distinct()
    return tuple(sorted(r.w for r in rows.collect()))


class Models:
    """Model factories by name; an unknown name is an error that lists the known ones."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def add(self, name: str, factory: Callable) -> None:
        self.known[name] = factory

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise ValueError(f"no model {name!r}; known: {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]
