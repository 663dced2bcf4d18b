"""Session helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 400
#: A key is hot if it holds more than one in so many rows; so there are never more hot keys than that.
HOT_SHARE = 2_000


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches short, so that a batch of long texts fits beside a task's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    Only where that setting is missing and the master is local (tests) a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rxlattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that aren't read any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row per key and counts in `n` how many rows have it.

    Hot keys, of which there are at most HOT_SHARE by arithmetic, are met by a broadcast, so that their rows
    stay where they are; all other keys hold few rows each and are met by a shuffle. Both inputs are read more
    than once and should be tables.
    """
    key = [key] if isinstance(key, str) else key
    total = keyed.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > total
    hot = keyed.where(is_hot)
    if total < HOT_SHARE or hot.isEmpty():
        return rows.join(keyed, key)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(keyed.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one wide row per key, too wide to be broadcast.

    The rows of a hot key are dealt over salts by their column `spread`, and its row of `keyed` is copied to
    each salt: at most 2 * HOT_SHARE copies in all. `rows` is read more than once and should be a table.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") * HOT_SHARE > total).select(key, F.ceil(F.col("_n") * HOT_SHARE / F.lit(float(max(total, 1)))).cast("int").alias("_salts"))
    if total < HOT_SHARE or hot.isEmpty():
        return rows.join(keyed, key)
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = keyed.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
