"""Sources as things to be plugged in: a name, a kind, a priority, and how their documents are read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """read: gives (doc_id, text)."""

    name: str
    type: str
    priority: int
    read: Callable[[SparkSession], DataFrame]


def ordered(sources: list[Source]) -> list[Source]:
    """By priority, then by name; a name stands once."""
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("a source stands twice")
    return sorted(sources, key=lambda s: (s.priority, s.name))


def table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(name, type, priority) of sources, of which there are a few dozen."""
    return spark.createDataFrame([(s.name, s.type, s.priority) for s in ordered(sources)], "name string, type string, priority int")


def documents(spark: SparkSession, sources: list[Source], skip: set[str] | None = None) -> DataFrame:
    """(doc_id, source, text, source_type) of all sources that are not to be skipped, as those that are done."""
    out = None
    for s in ordered(sources):
        if s.name not in (skip or set()):
            part = s.read(spark).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(s.name).alias("source"), "text", F.lit(s.type).alias("source_type"))
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "doc_id string, source string, text string, source_type string") if out is None else out


def config(spark: SparkSession, path: str) -> dict:
    """The mapping in a configuration file: JSON, or YAML where its library is installed. An empty file is an empty mapping; anything but a mapping raises."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        data = json.loads(text or "{}")
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} is not a mapping")
    return data


def config_path(root: str, language: str, name: str) -> str:
    return f"{root.rstrip('/')}/{language}/configs/{name}"
