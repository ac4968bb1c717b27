"""A training-corpus pipeline: five stages, each over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage as Parquet to the shared folder and reads it again for the next one.

Every row is decided by its own text.  Rows that share a doc_id and the text get equal
results; rows that share a doc_id but not the text count as documents of their own, in
the order of doc_id and a hash of the text.  Rows with a null doc_id are kept or
dropped by language and rate only: they neither link with others nor lose passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.llm import bpe, jaccard, language_id, mixing, substrings
from syllabary.llm.common import keyed, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected; ``lang`` becomes the language found.

    Null and empty texts and texts without a letter are rejected; repeated rows and rows
    with a null doc_id are judged by their text like all others; an empty table stays empty.
    """
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = language_id.classify(docs, language_id.learn(known), carry=True).where(~F.col("rejected"))
    return found.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of linked documents.

    Texts without words link with nothing and stay, as do rows with a null doc_id; rows
    equal in doc_id and text stay or go together; an empty table stays empty.
    """
    rows = keyed(docs)
    groups = jaccard.near_groups(rows.select(F.col("__key").alias("doc_id"), "text"))
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(gone, "__key", "left_anti").select(*docs.columns)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that an earlier document has; documents left without words go.

    Texts that had no words stay as they are, as do rows with a null doc_id; rows equal in
    doc_id and text get equal texts; an empty table stays empty.
    """
    rows = keyed(docs)
    known = rows.where("__key is not null")
    found = substrings.remove_repeats(known.select(F.col("__key").alias("doc_id"), "text"), texts=True).where("n_removed < n_words or n_words = 0")
    found = found.select(F.col("doc_id").alias("__key"), F.col("kept_text").alias("__text")).dropDuplicates(["__key"])
    kept = known.join(found, "__key").withColumn("text", F.col("__text")).drop("__text").unionByName(rows.where("__key is null"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its fitted rate says.

    Documents without words have rate 1 and stay; the chance of a copy follows doc_id and
    text, so equal rows are taken equally often; an empty table stays empty.
    """
    taken = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), "copies")), "row").select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of ids and decoded text; null texts have no ids."""
    vocabulary = bpe.read_vocabulary()
    encoded = bpe.encode_decode(docs, vocabulary, bpe.build_lexicon(docs, vocabulary), texts=True)
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("substring_dedup", remove_substrings),
    ("mixing", mix_domains),
    ("bpe", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
