"""Shared helpers of the corpus operators: table access and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="syllabary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote and nothing will read again."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Mark a table of short rows for broadcast if it has ``rows`` at most; a larger one is left to shuffled joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``__key``, one number a distinct (doc_id, text) in the order of doc_id; null where doc_id is null.

    It is the doc_id itself where no two texts share one.
    """
    ids = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("__mark"))
    if ids.groupBy("doc_id").agg(F.min("__mark").alias("lo"), F.max("__mark").alias("hi")).where("lo < hi").isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    spark = docs.sparkSession
    dealt = saved(ids.distinct().repartitionByRange(partitions(spark), "doc_id", "__mark").withColumn("part", F.spark_partition_id()), "row-keys")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    starts = zip([p for p, _ in sizes], accumulate([0] + [n for _, n in sizes[:-1]]), strict=True)
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "__mark"))
    keys = dealt.withColumn("within", within).join(F.broadcast(spark.createDataFrame(list(starts), "part int, start long")), "part")
    keys = keys.select("doc_id", "__mark", (F.col("start") + F.col("within")).alias("__key"))
    return saved(docs.withColumn("__mark", F.xxhash64("text")).join(keys, ["doc_id", "__mark"], "left").drop("__mark"), "keyed")


def attach(rows: DataFrame, classes: DataFrame, key: list[str], copies: str) -> DataFrame:
    """Join each row with its class, where few classes may hold most rows.

    ``copies`` is a class's number of rows.  Classes with more than a ten-thousandth of
    all rows, at most 10,000, are broadcast; the others are joined by shuffling.
    """
    each = max(1, (classes.agg(F.sum(copies)).first()[0] or 0) // 10_000)
    hot = F.broadcast(classes.where(F.col(copies) > each))
    mine = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(mine.join(classes.where(F.col(copies) <= each), key))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
