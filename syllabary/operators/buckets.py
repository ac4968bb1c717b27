"""Keyed tables in hash buckets.

A version of a table is a list of folders, one a bucket.  An upsert reads and writes the
buckets its keys fall into; the new version lists their new folders and all other folders
as they were.  A version appears by one rename at the end, so a reader sees a whole version
or none of it, and an upsert that is tried again overwrites what the first try left.

    path/table                      number of buckets, key, columns (one row)
    path/data/v=N/bucket=B          rows that version N wrote
    path/changes/v=N                the batch behind version N, one row a key
    path/statistics/v=N             counts by university and level, kept by signed changes
    path/versions/v=N               bucket and folder of each bucket of version N

Null keys count as equal.  Two writers at once: the second to finish fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import maintained
from .store import KEY, keep_last

_STATISTICS = "university string, level string, courses long, parsed long, with_text long"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's versions, in order."""
    files, where = _files(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))


def _share(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _publish(folders: DataFrame, path: str, version: int) -> None:
    """Write the list of folders beside the versions and rename it into place."""
    spark = folders.sparkSession
    staged = f"{path}/staged-{uuid.uuid4().hex[:12]}"
    folders.coalesce(1).write.parquet(staged)  # a row a bucket
    files, target = _files(spark, f"{path}/versions/v={version}")
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(_files(spark, staged)[1], target):
        raise RuntimeError(f"version {version} of {path} is already there")


def _write(rows: DataFrame, path: str, version: int, buckets: int) -> DataFrame:
    """Write rows by their ``bucket``; the folders that came of it."""
    folder = f"{path}/data/v={version}"
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    made = rows.sparkSession.read.schema(rows.schema).parquet(folder).select("bucket").distinct()
    return made.select("bucket", F.concat(F.lit(f"data/v={version}/bucket="), F.col("bucket").cast("string")).alias("folder"))


def _counted(table: DataFrame) -> bool:
    return set(maintained.CELL) | {"prerequisites_parsed", "prerequisites_text"} <= set(table.columns)


def create(table: DataFrame, path: str, buckets: int = 64, key: list[str] = KEY, order: str = "nseq", unique: bool = False) -> int:
    """Version 0 of a table: the last row of each key."""
    spark = table.sparkSession
    described = spark.createDataFrame([(buckets, key, table.schema.json())], "buckets int, key array<string>, columns string")
    described.write.mode("errorifexists").json(f"{path}/table")
    rows = keep_last(table, order, key, unique).withColumn("bucket", _share(key, buckets))
    rows.write.mode("overwrite").parquet(f"{path}/changes/v=0")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/changes/v=0")
    folders = _write(rows, path, 0, buckets)
    if _counted(table):
        maintained.cells(rows).write.mode("overwrite").parquet(f"{path}/statistics/v=0")
    _publish(folders, path, 0)
    return 0


def _table(spark: SparkSession, path: str) -> tuple[int, list[str], StructType]:
    r = spark.read.schema("buckets int, key array<string>, columns string").json(f"{path}/table").first()
    return r["buckets"], r["key"], StructType.fromJson(json.loads(r["columns"]))


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a version (the newest by default), of all buckets or of some."""
    columns = _table(spark, path)[2]
    version = versions(spark, path)[-1] if version is None else version
    listed = spark.read.schema("bucket int, folder string").parquet(f"{path}/versions/v={version}")
    listed = listed if buckets is None else listed.where(F.col("bucket").isin(buckets))
    folders = [f"{path}/{r['folder']}" for r in listed.orderBy("bucket").collect()]  # one a bucket
    return spark.read.schema(columns).parquet(*folders) if folders else spark.createDataFrame([], columns)


def lookup(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The row of a key: its bucket is all that is read."""
    buckets, names, _ = _table(spark, path)
    wanted = spark.createDataFrame([key], ", ".join(f"{k} string" for k in names)).select(_share(names, buckets).alias("b")).first()["b"]
    return read(spark, path, buckets=[wanted]).where(reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(names, key, strict=True)])).limit(1)


def upsert(batch: DataFrame, path: str, order: str = "nseq", unique: bool = False) -> int:
    """Rows of the batch (the last of each key) replace rows of the table; the number of the version that came of it."""
    spark = batch.sparkSession
    buckets, key, columns = _table(spark, path)
    last = versions(spark, path)[-1]
    version = last + 1
    log = f"{path}/changes/v={version}"
    keep_last(batch.select(*columns.names), order, key, unique).withColumn("bucket", _share(key, buckets)).write.mode("overwrite").parquet(log)
    new = spark.read.schema(StructType([*columns.fields, StructField("bucket", IntegerType())])).parquet(log)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
    old = read(spark, path, last, touched)
    keys = new.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    kept = old.join(keys, same, "left_anti").withColumn("bucket", _share(key, buckets))
    folders = _write(kept.unionByName(new), path, version, buckets)
    before = spark.read.schema("bucket int, folder string").parquet(f"{path}/versions/v={last}")
    if _counted(new):
        stored = spark.read.schema(_STATISTICS).parquet(f"{path}/statistics/v={last}")
        maintained.apply(stored, maintained.delta(old.join(keys, same, "left_semi"), new)).write.mode("overwrite").parquet(f"{path}/statistics/v={version}")
    _publish(before.join(F.broadcast(folders.select("bucket")), "bucket", "left_anti").unionByName(folders), path, version)  # a row a bucket
    return version


def statistics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's statistics as its upserts have kept them; no row of the table is read."""
    version = versions(spark, path)[-1] if version is None else version
    return maintained.statistics(spark.read.schema(_STATISTICS).parquet(f"{path}/statistics/v={version}"))
