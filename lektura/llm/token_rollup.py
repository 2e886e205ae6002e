"""Delta-maintained token counts: totals by source, language and tokenizer version that batches of changes update.

Each batch becomes signed rows: an insert adds a document's tokens, a delete takes back what the ledger holds for the
document, a revision does both. Totals only ever add the batches' sums. A batch writes to a folder of its own name and
counts only once its commit is written, so a batch that failed half-way or is sent again changes nothing twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lektura.llm.common import SPACES, WORDS, cut, small_batches
from lektura.llm.tokens import byte_bpe

KEY = ["source", "lang", "version"]
LEDGER = "doc_id string, source string, lang string, version string, docs long, tokens long, batch string"


class TokenRollup:
    """The ledger, the totals and the commits under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], "batch string, changes long").write.mode("append").parquet(f"{path}/commits")

    def commits(self) -> list[str]:
        """Names of the committed batches; one short row each."""
        return [r["batch"] for r in self.spark.read.schema("batch string, changes long").parquet(f"{self.path}/commits").select("batch").distinct().collect()]

    def _batches(self, part: str, schema: str) -> DataFrame:
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/{b}" for b in done])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes: op (insert, delete or revise), doc_id, source, lang, version, tokens; False if the batch
        was committed before.

        An insert adds a document, even if one of its id exists; a delete takes away all that the ledger holds under
        the id and version, and nothing if there is none; a revision is a delete and an insert. Within a batch deletes
        come before inserts. Null source, language and version are values of their own; null tokens count 0; rows of a
        null id can be inserted only. Any other op is an error. Other columns are ignored; no rows are a batch too.
        """
        if batch in self.commits():
            return False
        if not changes.where("op is null or op not in ('insert', 'delete', 'revise')").select("op").isEmpty():
            raise ValueError("op must be insert, delete or revise")
        rows = changes.select("op", F.col("doc_id").cast("string").alias("doc_id"), *KEY, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        added = rows.where("op in ('insert', 'revise')").select("doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens")
        undone = rows.where("op in ('delete', 'revise')").select("doc_id", F.col("version").alias("v")).distinct().withColumnRenamed("doc_id", "d")
        ledger = self._batches("ledger", LEDGER)
        there = ledger.join(undone, (F.col("doc_id") == F.col("d")) & F.col("version").eqNullSafe(F.col("v")), "left_semi")
        held = there.groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        signed = added.unionByName(held.select("doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        signed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        own = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch}")
        own.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("changes")).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        self.spark.createDataFrame([(batch, own.count())], "batch string, changes long").write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: the sums of the committed batches, without groups that came to nothing."""
        sums = self._batches("totals", "source string, lang string, version string, docs long, tokens long, changes long")
        return sums.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def with_token_counts(docs: DataFrame, text: Column, tokenizer: str | None = None) -> DataFrame:
    """doc_id (as text), source, lang, version, tokens: a row for each document and tokenizer version, ``words`` and
    ``byte_bpe_50k``. A null text has no tokens. Columns doc_id, source and lang are read, others ignored."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def bpe(texts: pd.Series) -> pd.Series:
        encoder = byte_bpe(tokenizer)
        return pd.Series([len(encoder.encode(t)) if t else 0 for t in texts], dtype="int64")

    words = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", words.alias("words"), bpe(text).alias("bpe"))
    versions = F.explode(F.array(F.struct(F.lit("words").alias("version"), F.col("words").alias("tokens")), F.struct(F.lit("byte_bpe_50k").alias("version"), F.col("bpe").alias("tokens"))))
    return found.select("doc_id", "source", "lang", versions.alias("x")).select("doc_id", "source", "lang", "x.*")


def documents_rollup(docs: DataFrame, path: str) -> DataFrame:
    """Totals of ``docs`` after three batches: all documents come in; documents whose text another of a smaller id has
    go, and texts with runs of white space are counted again with single spaces; then that batch is sent once more.

    A null text has no tokens; rows that repeat an id are documents of their own that come and go together; a null id
    stays; texts are read whole; an empty table gives an empty result; columns other than doc_id, text, source and lang
    are ignored."""
    spark = docs.sparkSession
    rollup = TokenRollup(spark, path)
    rollup.commit("load", with_token_counts(docs, F.col("text")).withColumn("op", F.lit("insert")))
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("keep"))
    copies = keyed.join(first, "h").where("doc_id <> keep").select("doc_id").distinct()
    single = F.trim(F.regexp_replace("text", SPACES, " "))
    changed = docs.where(F.col("text") != single).join(copies, "doc_id", "left_anti")
    versions = F.explode(F.array(F.lit("words"), F.lit("byte_bpe_50k")))
    none = F.lit(None).cast("string")
    deletes = copies.select(F.col("doc_id").cast("string").alias("doc_id"), none.alias("source"), none.alias("lang"), versions.alias("version"), F.lit(0).cast("long").alias("tokens"), F.lit("delete").alias("op"))
    fixes = cut(deletes.unionByName(with_token_counts(changed, single).withColumn("op", F.lit("revise"))))
    rollup.commit("fixes", fixes)
    rollup.commit("fixes", fixes)
    return rollup.totals()
