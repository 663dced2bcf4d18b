"""Sources and sinks. Paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream of a Parquet table that is a file or a folder of files; new files are new rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the given schema if there is none."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_dated(spark: SparkSession, path: str, schema: T.StructType, since: str, until: str, pattern: str = r"records_(\d{8})\.parquet") -> DataFrame:
    """Files with a date in their name, of the days asked for; other names are skipped.

    The date column is what a date-partitioned table is written from, see `write_dated`.
    """
    name = F.regexp_extract(F.input_file_name(), pattern, 1)
    days = spark.read.schema(schema).parquet(path).withColumn("dt", F.to_date(F.nullif(name, F.lit("")), "yyyyMMdd"))
    return days.where(F.col("dt").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def write_dated(df: DataFrame, path: str, day: str) -> None:
    """Parquet partitioned by day; only the days in `df` are replaced."""
    df.withColumn("dt", F.to_date(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def missing_days(present: DataFrame, day: str, since: str, until: str) -> DataFrame:
    """Days of a range without a row."""
    spark = present.sparkSession
    n = (dt.date.fromisoformat(until) - dt.date.fromisoformat(since)).days + 1
    wanted = spark.range(n).select(F.date_add(F.lit(since).cast("date"), F.col("id").cast("int")).alias("day"))
    return wanted.join(present.select(F.to_date(day).alias("day")).distinct(), "day", "left_anti")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_review_csv(df: DataFrame, path: str, columns: list[str], blanks: list[str]) -> None:
    """Only the listed columns, with empty columns for the reviewers."""
    df.select(*columns, *(F.lit("").alias(b) for b in blanks)).write.mode("errorifexists").csv(path, header=True)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, low: int, high: int, partitions: int, where: str = "true", options: dict[str, str] | None = None) -> DataFrame:
    """A database table in parallel ranges of a numeric column, the condition evaluated there."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"(select * from {table} where {where}) t", partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    return reader.options(**(options or {})).load()


_ITEM = "map<string,string>"


def read_landed_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed API responses, one per row as a map; an item list may be nested or single."""
    body = f"struct<body:struct<items:array<struct<item:{_ITEM}>>>>"
    flat = f"struct<body:struct<items:array<{_ITEM}>>>"
    raw = spark.read.text(path, wholetext=True)
    nested, plain = F.from_json("value", body)["body"]["items"], F.from_json("value", flat)["body"]["items"]
    items = F.when(F.exists(nested, lambda x: x["item"].isNotNull()), F.transform(nested, lambda x: x["item"])).otherwise(plain)
    return raw.select(F.explode(items).alias("item"))


def standard_fields(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Map items to named columns."""
    return items.select(*(F.col("item")[k].alias(v) for k, v in fields.items()))


_SECTIONS = ("enzyme", "transporter", "carrier")


def read_drug_xml(spark: SparkSession, path: str, row_tag: str = "drug", save: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drugs, interactions, enzymes) of a drug XML file by the built-in XML source.

    With `save` the nested rows are read once and written there, and all three tables come from them. A drug's id is
    its primary one, else it drops; codes and groups are joined by |; an interaction without a partner id drops. Of the
    enzymes those with CYP in their name count, and all transporters; each action is a row, a missing known-action is
    `unknown`, and one without an action gives no row. Texts keep 500 characters.
    """
    parts = "struct<{0}:array<struct<name:string,`known-action`:string,actions:struct<action:array<string>>>>>"
    schema = (
        "`drugbank-id` array<struct<_VALUE:string,_primary:boolean>>, name string, description string, indication string, groups struct<group:array<string>>, `atc-codes` struct<`atc-code`:array<struct<_code:string>>>, "
        "`drug-interactions` struct<`drug-interaction`:array<struct<`drugbank-id`:string,name:string,description:string>>>, " + ", ".join(f"{s}s {parts.format(s)}" for s in _SECTIONS)
    )
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    ids = F.col("drugbank-id")
    primary = F.coalesce(F.get(F.filter(ids, lambda x: x["_primary"]), F.lit(0))["_VALUE"], F.get(ids, F.lit(0))["_VALUE"])
    rows = rows.withColumn("drug_id", F.trim(primary)).where("drug_id <> ''")
    if save:
        rows.write.mode("overwrite").parquet(save)
        rows = spark.read.parquet(save)

    def short(c: F.Column) -> F.Column:
        return F.substring(F.trim(c), 1, 500)

    codes = F.transform(F.col("atc-codes")["atc-code"], lambda x: F.trim(x["_code"]))
    drugs = rows.select("drug_id", F.trim("name").alias("name"), F.array_join(F.transform(F.col("groups")["group"], F.trim), "|").alias("groups"), F.array_join(F.filter(codes, lambda x: x != ""), "|").alias("atc_codes"), short(F.col("description")).alias("description"), short(F.col("indication")).alias("indication"))
    pairs = rows.select(F.col("drug_id").alias("a_id"), F.trim("name").alias("a_name"), F.explode(F.col("drug-interactions")["drug-interaction"]).alias("x"))
    pairs = pairs.select("a_id", "a_name", F.trim(F.col("x")["drugbank-id"]).alias("b_id"), F.trim(F.col("x")["name"]).alias("b_name"), short(F.col("x")["description"]).alias("description")).where("b_id <> ''")
    items = F.array(*(F.struct(F.lit(f"{s}s").alias("section"), F.col(f"{s}s")[s].alias("found")) for s in _SECTIONS))
    each = rows.select("drug_id", F.col("name").alias("drug"), F.inline(items)).select("drug_id", "drug", "section", F.explode("found").alias("x"))
    kept = (F.upper(F.col("x")["name"]).contains("CYP")) | ((F.col("section") == "transporters") & (F.trim(F.col("x")["name"]) != ""))
    known = F.coalesce(F.nullif(F.trim(F.col("x")["known-action"]), F.lit("")), F.lit("unknown"))
    enzymes = each.where(kept).select("drug_id", "drug", F.trim(F.col("x")["name"]).alias("enzyme"), known.alias("known_action"), "section", F.explode(F.col("x")["actions"]["action"]).alias("action"))
    return drugs, pairs, enzymes.select("drug_id", "drug", "enzyme", F.trim("action").alias("action"), "known_action", "section").where("action <> ''")


def enzyme_key(name: F.Column) -> F.Column:
    """cyp3a4 and the like from an enzyme's name in free form; null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(F.regexp_replace(F.upper(name), "CYTOCHROME P450 ", "CYP"), "(CYP[0-9]+[A-Z]+[0-9]+)", 1), F.lit("")))


def write_features(df: DataFrame, path: str, partition: str, overwrite: bool = False) -> str:
    """One month of the feature store; an existing month is refused unless `overwrite`."""
    at = f"{path.rstrip('/')}/partition={partition}"
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(at)
    return at


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write unless empty; says whether it was."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_dataset(coo: DataFrame, labels: DataFrame, path: str, id_: str = "patient_id") -> None:
    """A sparse set, one row an id: its label, ascending columns (idx) and their values. Ids without a label drop."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("cells")
    rows = coo.groupBy(id_).agg(cells).join(labels.select(id_, "label"), id_)
    rows.select(id_, "label", F.col("cells.idx").alias("columns"), F.col("cells.value").alias("values")).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts (day, severity, kind, subject, n) as JSON, one folder a day; a day that is written again is replaced."""
    alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(path)


def read_features(spark: SparkSession, path: str, partition: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("partition") == partition).drop("partition")


def export_subset(df: DataFrame, path: str, since: str, until: str, ids: DataFrame | None = None, id_: str = "patient_id") -> None:
    subset(df, since, until, ids, id_).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def subset(df: DataFrame, since: str, until: str, ids: DataFrame | None = None, id_: str = "patient_id") -> DataFrame:
    """Lines that touch a date range, of the listed ids."""
    out = df.where((F.col("start_date") <= F.lit(until).cast("date")) & (F.col("end_date") >= F.lit(since).cast("date")))
    return out if ids is None else out.join(ids.select(id_).distinct(), id_, "left_semi")


def check_range(since: str, until: str, first: str, last: str, purpose: str, purposes: tuple[str, ...]) -> None:
    """Policy gate: raises for a purpose that isn't allowed or a range outside the window."""
    if purpose not in purposes:
        raise PermissionError(f"purpose {purpose!r} is not one of {', '.join(purposes)}")
    if not first <= since <= until <= last:
        raise PermissionError(f"{since}..{until} lies outside {first}..{last}")


def table_profile(df: DataFrame, day: str, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).cast("date").cast("string").alias("first_day"), F.max(day).cast("date").cast("string").alias("last_day"), F.countDistinct(key).alias("n_keys"))


def history(df: DataFrame, until: str, days: int, ids: DataFrame | None = None, id_: str = "patient_id") -> DataFrame:
    """Lines that start in the `days` days up to `until`, of the listed ids or of all."""
    last = F.lit(until).cast("date")
    out = df.where(F.col("start_date").between(F.date_sub(last, days - 1), last))
    return out if ids is None else out.join(ids.select(id_).distinct(), id_, "left_semi")


def preview(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a table in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def distinct_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """The least `most` values of a column, ascending."""
    return df.select(F.col(column).alias("value")).distinct().orderBy("value").limit(most)


def read_log(spark: SparkSession, path: str, schema: T.StructType, hours: int | None = None, now: str | None = None, column: str = "timestamp") -> DataFrame:
    """JSON lines; lines that don't parse are skipped, naive times count as UTC (the session's zone)."""
    raw = spark.read.text(path)
    rows = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where(F.col(column).isNotNull()).withColumn("ts", F.try_to_timestamp(column))
    if hours is None:
        return rows
    until = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return rows.where((F.col("ts") > until - F.expr(f"interval {hours} hours")) & (F.col("ts") <= until))


def table_kind(name: F.Column) -> F.Column:
    """Kind of table by words in its file name."""
    n = F.lower(name)
    return F.when(n.contains("t20"), "header").when(n.contains("t30"), "line").when(n.contains("t40"), "diagnosis").when(n.contains("t60"), "outpatient").when(n.contains("yoyang") | n.contains("inst"), "institution").otherwise("unknown")
