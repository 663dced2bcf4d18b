"""Feature stages persisted step by step, each under the key of what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import path_exists


@dataclass(frozen=True)
class Stage:
    """A step: its version changes when its code does; `make` gets the tables of the stages it comes after."""

    name: str
    version: int
    make: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()


def keys(stages: list[Stage], source: str) -> dict[str, str]:
    """The key of each stage: its name, version, the keys of those before it and the source's own key."""
    out: dict[str, str] = {}
    for s in stages:
        if s.name in out or not set(s.after) <= out.keys():
            raise ValueError(f"stage {s.name!r} is there twice or comes before one that it needs")
        said = json.dumps([s.name, s.version, [out[a] for a in s.after] or [source]])
        out[s.name] = hashlib.sha256(said.encode()).hexdigest()[:16]
    return out


def run_stages(spark: SparkSession, path: str, stages: list[Stage], source: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The stages' tables and the names of those that this run made, in order.

    A stage lies below `path`/name/key, its manifest beside it and written last. One whose manifest is there is read,
    not made; so a run that was broken off goes on at its first stage that isn't whole, a lost stage is redone alone
    and a new version redoes that stage and those after it. `source` says which input it is (a partition, a
    snapshot); another one gives other keys. Older keys stay until they are deleted.
    """
    made, tables, ids = [], {}, keys(stages, source)
    for s in stages:
        at = f"{path}/{s.name}/{ids[s.name]}"
        if not path_exists(spark, f"{at}-manifest/_SUCCESS"):
            s.make({a: tables[a] for a in s.after}).write.mode("overwrite").option("compression", "zstd").parquet(at)
            entry = {"stage": s.name, "version": s.version, "key": ids[s.name], "after": [ids[a] for a in s.after], "source": source}
            spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}-manifest")
            made.append(s.name)
        tables[s.name] = spark.read.parquet(at)
    return tables, made


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """stage, version, key, after, source of every whole stage below `path`."""
    return spark.read.schema("stage string, version int, key string, after array<string>, source string").json(f"{path}/*/*-manifest")


def forget(spark: SparkSession, path: str, stages: list[Stage], source: str, name: str) -> None:
    """Delete one stage's manifest and table, as if they had been lost."""
    at = f"{path}/{name}/{keys(stages, source)[name]}"
    for p in (f"{at}-manifest", at):
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
