"""The corpus pipeline: stages over documents, each result written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektura.llm.common import shared_dir, table
from lektura.llm.langid import identified, train
from lektura.llm.line_dedup import line_dedup
from lektura.llm.mixing import mixed
from lektura.llm.near_copies import one_of_each
from lektura.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go: no letters, or unlike every language they learned. ``lang``
    becomes the language found."""
    found = identified(docs, train(docs)).where(~F.col("_lang.rejected"))
    return found.withColumn("lang", F.col("_lang.lang_pred")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many of their source's documents leave the texts; no document goes, and one that is
    nothing but such lines stays as it is: it is a copy, which the next stage sees to."""
    found = line_dedup(docs.select(*COLUMNS), F.col("source"), F.col("text"), spare_whole=True)
    text = F.when(F.col("_dropped") > 0, F.col("_kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Near copies have a Jaccard
    similarity of 0.8 or more on five-word shingles, which SimHash within few bits does not find; min-hash keys do."""
    return one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times."""
    found = mixed(docs).where("_copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]
#: Language models, min-hashes and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
