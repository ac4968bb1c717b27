"""Text search by an index of trigrams.

``build`` writes the rows by shares of their id, for each folded title and description the
rows it stands in, and for each distinct text its distinct runs of three characters: a text
that many rows repeat is indexed once.  A text goes by a hash; texts of one hash make a
candidate more and lose none.  A search takes the literal parts of its pattern, finds the
texts that have all their trigrams, the rows they stand in, reads the shares these rows are
in, and lets LIKE decide, so it returns what :func:`store.search` returns.  A pattern
without three literal characters in a row is searched without the index.

    path/rows/share=S               rows
    path/texts/share=S              field, text's hash, id, id's share; in order of hashes
    path/postings/share=S           trigram, field, text's hash, its share; in order of trigrams
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_ascii
from .store import fold_query, search

SHARES = 64
FIELDS = ("title", "description")


def _share(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SHARES)).cast("int")


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a folded text."""
    low = fold_ascii(c)
    some = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substring(low, k, F.lit(3)))
    return F.when(F.length(low) > 2, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, path: str, row_id: str = "nseq") -> None:
    """Write the index of ``rows``; ``row_id`` tells rows apart and is not null."""
    rows.withColumn("share", _share(row_id)).repartition("share").write.mode("overwrite").partitionBy("share").parquet(f"{path}/rows")
    each = [rows.select(F.lit(f).alias("field"), fold_ascii(F.col(f)).alias("low"), F.col(row_id).alias("id")) for f in FIELDS]
    texts = each[0].unionByName(each[1]).where(F.length("low") > 2).withColumns({"text": F.xxhash64("low"), "row_share": _share("id")}).withColumn("share", _share("text"))
    _write_dealt(texts.drop("low"), f"{path}/texts", "text", "id")
    distinct = texts.select("field", "text", "low", F.col("share").alias("text_share")).distinct()
    postings = distinct.select(F.explode(trigrams(F.col("low"))).alias("trigram"), "field", "text", "text_share")
    _write_dealt(postings.withColumn("share", _share("trigram")), f"{path}/postings", "trigram", "text")


def _write_dealt(rows: DataFrame, path: str, *order: str) -> None:
    """Write rows by share, in order within it; Spark splits shares that frequent values make large."""
    rows.hint("rebalance", "share").sortWithinPartitions("share", *order).write.mode("overwrite").partitionBy("share").parquet(path)


def literal_trigrams(query: str) -> list[str]:
    """Trigrams that every text which matches ``%query%`` has."""
    parts = re.split("[%_]", fold_query(query))
    return sorted({p[k : k + 3] for p in parts for k in range(len(p) - 2)})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``id, row_share`` of the rows with all trigrams of the query in one field; None where it has none."""
    wanted = literal_trigrams(query)
    if not wanted:
        return None
    shares = [r["s"] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(_share("t").alias("s")).distinct().collect()]
    found = spark.read.parquet(f"{path}/postings").where(F.col("share").isin(shares) & F.col("trigram").isin(wanted))
    found = found.groupBy("field", "text", "text_share").agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted))
    shares = [r["text_share"] for r in found.select("text_share").distinct().collect()]  # SHARES at most
    return spark.read.parquet(f"{path}/texts").where(F.col("share").isin(shares)).join(found, ["field", "text"], "left_semi").select("id", "row_share").dropDuplicates(["id"])


def indexed_search(spark: SparkSession, path: str, query: str, university: str | None = None, row_id: str = "nseq") -> DataFrame:
    """The rows of :func:`store.search` over the indexed table."""
    rows = spark.read.parquet(f"{path}/rows")
    found = candidates(spark, path, query)
    if found is not None:
        shares = [r["row_share"] for r in found.select("row_share").distinct().collect()]  # SHARES at most
        rows = rows.where(F.col("share").isin(shares)).join(found.select(F.col("id").alias(row_id)), row_id, "left_semi")
    return search(rows.drop("share"), query, university)
