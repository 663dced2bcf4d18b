"""Extraction by chunks with statistics and resume, databases read in parts, catalogues and run logs."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_exists

# ---- chunks


@dataclass(frozen=True)
class Chunk:
    label: str
    since: dt.date
    until: dt.date

    def holds(self, day: str) -> Column:
        return F.col(day).between(F.lit(self.since), F.lit(self.until))


def _shift(month: dt.date, by: int) -> dt.date:
    n = month.year * 12 + month.month - 1 + by
    return dt.date(n // 12, n % 12 + 1, 1)


def chunks(first: str, last: str, size: int = 1, unit: str = "month", before: int = 0, after: int = 0) -> list[Chunk]:
    """Chunks of `size` months or days over the months first..last (yyyymm), with buffer months before and after.

    The last chunk may be shorter; labels are yyyymm or yyyymmdd, with the end where a chunk holds more than one.
    """
    low, high = (dt.datetime.strptime(m, "%Y%m").date() for m in (first, last))
    if low > high or size < 1 or min(before, after) < 0:
        raise ValueError(f"no chunks of {size} from {first} to {last} with buffers {before} and {after}")
    low, end = _shift(low, -before), _shift(high, after + 1)
    out = []
    while low < end:
        nxt = min(end, _shift(low, size) if unit == "month" else low + dt.timedelta(size))
        until = nxt - dt.timedelta(1)
        form = "%Y%m" if unit == "month" else "%Y%m%d"
        names = dict.fromkeys((low.strftime(form), until.strftime(form)))
        out.append(Chunk("_".join(names), low, until))
        low = nxt
    return out


def _stats(day: str, source: str, sources: tuple[str, ...]) -> list[Column]:
    counted = [F.count(F.when(F.col(source) == s, 1)).alias(f"n_{s.lower()}") for s in sources]
    return [F.count(F.lit(1)).alias("n_records"), *counted, F.min(F.col(day).cast("string")).alias("first_day"), F.max(F.col(day).cast("string")).alias("last_day")]


def extract(spark: SparkSession, path: str, plan: list[Chunk], records: Callable[[Chunk], DataFrame], day: str = "start_date", source: str = "source", sources: tuple[str, ...] = ("T30", "T60")) -> list[str]:
    """Write the records of each chunk of `plan` below `path`; returns the labels that this run wrote.

    A chunk's statistics are taken from the two columns that they need of what was written, so each row counts once
    however often a task is run again. They are logged after the chunk is whole: a run that was broken off leaves the
    chunk at hand without a log, and the next run writes just that one and those after it. `records` gives a chunk's
    rows, usually a condition that the source evaluates. A chunk without rows is logged with null days.

    Observed metrics would spare the second look, but a session that has used an `Observation` can't fit a logistic
    regression any more in Spark 4.1: its observation manager goes into the fit's closure and isn't serializable.
    """
    done = []
    for chunk in plan:
        log, at = f"{path}/_log/{chunk.label}", f"{path}/records_{chunk.label}"
        if path_exists(spark, f"{log}/_SUCCESS"):
            continue
        rows = records(chunk)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(at)
        seen = spark.read.schema(rows.schema).parquet(at).agg(*_stats(day, source, sources)).first().asDict()
        entry = {"label": chunk.label, "since": chunk.since.isoformat(), "until": chunk.until.isoformat(), **seen}
        spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(log)
        done.append(chunk.label)
    return done


def extract_log(spark: SparkSession, path: str, sources: tuple[str, ...] = ("T30", "T60")) -> DataFrame:
    """One row per finished chunk: label, since, until, counts, first and last day."""
    schema = "label string, since string, until string, n_records long, " + ", ".join(f"n_{s.lower()} long" for s in sources) + ", first_day string, last_day string"
    return spark.read.schema(schema).json(f"{path}/_log/*")


def extracted(spark: SparkSession, path: str, plan: list[Chunk]) -> DataFrame:
    """The records of the finished chunks of a plan."""
    whole = [c.label for c in plan if path_exists(spark, f"{path}/_log/{c.label}/_SUCCESS")]
    if not whole:
        raise ValueError(f"{path} holds no finished chunk")
    return spark.read.parquet(*(f"{path}/records_{label}" for label in whole))


def extract_summary(spark: SparkSession, path: str, plan: list[Chunk], person: str = "patient_id") -> DataFrame:
    """Chunks, records per source, distinct persons and days of a whole run; counts of rows come from the log."""
    log = extract_log(spark, path)
    totals = log.agg(F.count(F.lit(1)).alias("n_chunks"), *(F.sum(c).alias(c) for c in log.columns if c.startswith("n_")), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    people = extracted(spark, path, plan).agg(F.countDistinct(person).alias("n_persons"))
    return totals.crossJoin(people)


# ---- run logs


def append_run(spark: SparkSession, path: str, run_id: str, logged: str, facts: dict) -> None:
    """One run's record as JSON in a folder of its own; the same run again replaces it."""
    spark.createDataFrame([(json.dumps({"run_id": run_id, "logged": logged, "facts": {k: str(v) for k, v in facts.items()}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run={run_id}")


def run_catalogue(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """The latest runs, newest first (ties by id): run_id, logged, facts. Lines that don't parse are left out."""
    rows = spark.read.text(f"{path}/run=*").select(F.from_json("value", "run_id string, logged string, facts map<string,string>").alias("r")).select("r.*")
    return rows.where("run_id is not null").orderBy(F.desc("logged"), "run_id").limit(most)


def baseline_report(results: DataFrame) -> DataFrame:
    """One row per run from result records (run_id, track, name, value): a column track_name for each pair of them.

    Of records that repeat a cell the greatest value stays; a run without one has null there.
    """
    return results.withColumn("_key", F.concat_ws("_", "track", "name")).groupBy("run_id").pivot("_key").agg(F.max("value"))


# ---- partitions by their folders' names


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column by the names of the folders alone, ascending; no file is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory()]
    return sorted(n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}="))


def read_recent(spark: SparkSession, path: str, column: str, schema: str, n: int) -> DataFrame:
    """JSON records (alerts, drift reports) of the last `n` partitions, which the folders' names tell; no other is read."""
    last = partition_values(spark, path, column)[-n:] if n > 0 else []
    reader = spark.read.schema(f"{schema}, {column} string").option("basePath", path)
    return reader.json([f"{path}/{column}={v}" for v in last]) if last else spark.createDataFrame([], f"{schema}, {column} string")


# ---- databases


def read_jdbc_parts(spark: SparkSession, url: str, table: str, conditions: list[str], pages: tuple[str, list[str]] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A database table read in parts, one for each condition (a month list, a range of days) and page of ids.

    `pages` is an id column and ascending edges: k edges make k + 1 pages, so together they hold every row; rows
    without an id are on the first. Conditions must not overlap. Further filters and the columns taken go to the
    database too.
    """
    where = [f"({c})" for c in conditions]
    if pages:
        column, edges = pages
        quoted = ["'" + e.replace("'", "''") + "'" for e in edges]
        ranges = [f"({column} < {quoted[0]} OR {column} IS NULL)", *(f"({column} >= {a} AND {column} < {b})" for a, b in zip(quoted, quoted[1:])), f"({column} >= {quoted[-1]})"]
        where = [f"{c} AND {r}" for c in where for r in ranges]
    return spark.read.jdbc(url, table, predicates=where, properties=options or {})


def month_conditions(column: str, months: list[str]) -> list[str]:
    """A condition for each month (yyyymm) of a text column yyyymmdd."""
    return [f"{column} LIKE '{m}%'" for m in months]


# ---- catalogues and contracts


def catalogue(spark: SparkSession, database: str | None = None, prefix: str = "") -> DataFrame:
    """table_name, column_name, data_type of all tables and views of a database whose names begin with `prefix`."""
    found = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) if t.name.startswith(prefix) for c in spark.catalog.listColumns(t.name if t.isTemporary or not database else f"{database}.{t.name}")]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string")


def contract_problems(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """table_name, column_name, problem: `missing` and `extra` columns, and `type` where both have another type.

    Names compare without regard to case. A wanted data_type of null takes any type. Anti joins in both directions.
    """
    keys = ["table_name", "column_name"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(*(F.lower(k).alias(k) for k in keys), F.lower("data_type").alias("data_type"))

    have, want = keyed(found), keyed(wanted)
    other = have.join(want.withColumnRenamed("data_type", "wanted"), keys).where("wanted <> data_type")
    sides = [(want.join(have, keys, "left_anti"), "missing"), (have.join(want.select("table_name").distinct(), "table_name", "left_semi").join(want, keys, "left_anti"), "extra"), (other, "type")]
    rows = [df.select(*keys, F.lit(problem).alias("problem")) for df, problem in sides]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def feature_problems(df: DataFrame, wanted: list[str], leave: tuple[str, ...] = ("patient_id",)) -> tuple[list[str], list[str]]:
    """(missing, extra) columns of a feature frame against a model's list, each in its order."""
    have = [c for c in df.columns if c not in leave]
    return [c for c in wanted if c not in have], [c for c in have if c not in wanted]
