"""Incremental ingest of course lines and of catalogue hashes with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.refresh import check, next_state
from ..operators.store import KEY
from ..operators.validation import normalize, with_errors
from ..sources.courses import parse_lines


#: Keyed state lives on disk, and a batch uploads its changes only, however many keys there are.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _accept(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The key's first line, once in the life of the stream: smallest nseq, nulls last, then smallest line."""
    if state.exists:
        return
    best = None
    for batch in rows:
        for nseq, line in zip(batch["nseq"], batch["value"], strict=True):
            place = (pd.isna(nseq), 0 if pd.isna(nseq) else int(nseq), line)
            best = place if best is None or place < best else best
    state.update((True,))
    yield pd.DataFrame({"nseq": pd.array([None if best[0] else best[1]], "Int64"), "value": [best[2]]})


def first_lines(lines: DataFrame, run_time: str) -> DataFrame:
    """Of a stream ``nseq, value`` of JSON lines, those that are the first valid course of their key.

    A key is taken once: the batch that first has it decides, within the batch the smallest
    nseq, nulls last, then the smallest line.  Later lines of the key, smaller nseq or not,
    are duplicates.  The state holds a flag a key.
    """
    parsed = with_errors(normalize(parse_lines(lines).where("construct_error is null"), run_time)).where("is_valid")
    short = parsed.select(*KEY, "nseq", F.col("line").alias("value"))
    return short.groupBy(*KEY).applyInPandasWithState(_accept, "nseq long, value string", "accepted boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_lines(spark: SparkSession, folder: str, target: str, checkpoint: str, run_time: str, files: int | None = None):
    """Append each key's first valid course of arriving ``nseq<TAB>json`` text files to ``target``.

    :func:`first_lines` decides; a batch reads its own lines and the state of its own keys,
    nothing of earlier batches.  Its rows go to a folder named by the batch, so a repeated
    batch overwrites itself.  ``files`` bounds the files a batch takes.  A line without a tab
    has no nseq.
    """
    own = spark.newSession()  # settings of this stream alone
    for k, v in STATE_STORE.items():
        own.conf.set(k, v)
    reader = own.readStream.schema("value string")
    raw = (reader if files is None else reader.option("maxFilesPerTrigger", files)).text(folder)
    lines = raw.select(F.split_part("value", F.lit("\t"), F.lit(1)).try_cast("bigint").alias("nseq"), F.substring_index("value", "\t", -1).alias("value"))

    def write(batch: DataFrame, number: int) -> None:
        rows = with_errors(normalize(parse_lines(batch), run_time))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return first_lines(lines, run_time).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_catalogues(spark: SparkSession, folder: str, state: str, checkpoint: str, now: str):
    """Fold arriving ``university, content_hash, seq`` rows into versions of the snapshot table.

    Within a batch only each university's last content counts, by ``seq``.
    """
    schema = "university string, content_hash string, seq long"
    empty = "university string, url string, content_hash string, last_checked timestamp, last_updated timestamp, course_count long, notes string"
    rows = spark.readStream.schema(schema).parquet(folder)

    def fold(batch: DataFrame, number: int) -> None:
        current = batch.groupBy("university").agg(F.max_by("content_hash", "seq").alias("content_hash"))
        old = spark.read.schema(empty).parquet(f"{state}/v{number - 1}") if number else spark.createDataFrame([], empty)
        next_state(check(current, old, now, force=True), old).write.mode("overwrite").parquet(f"{state}/v{number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
