"""Streams that keep their results as they run: totals, sessions, and tables that a batch changes by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

BUCKETS = 64


def running_totals(usage: DataFrame, provider: str, cost: str, event: str, at: str, repeats_within: str) -> DataFrame:
    """A stream of (provider, requests, cost): the totals so far of the providers that a batch touched, for update mode.

    An event that comes again within ``repeats_within`` of its first arrival counts once; beyond that time its id is
    forgotten, so the state holds the ids of that time and one row for each provider. An event that is later than that
    against the newest one seen is not counted; ``take`` returns how many were not. Events without a time or an id are
    not counted either. A null cost is a request that costs nothing; null providers are a provider of their own."""
    timed = usage.where(F.col(event).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    once = timed.withWatermark(at, repeats_within).dropDuplicatesWithinWatermark([event])
    return once.groupBy(provider).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost"))


def sessions(reviews: DataFrame, card: str, at: str, gap: str, right: Column, late: str | None = None) -> DataFrame:
    """(card, started, ended, reviews, correct): reviews less than ``gap`` apart are one session. Of a stream, a session
    is given once it ended ``late`` before the newest review seen, for append mode; reviews that come later than that
    are left out, and ``take`` returns how many. A table gives all sessions. Reviews without a time are in none."""
    given = reviews.schema[at].dataType  # watermarks want times with a zone; without one they are in the session's
    rows = reviews.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if reviews.isStreaming else rows
    found = rows.groupBy(card, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("reviews"), F.count(F.when(right, 1)).alias("correct"))
    return found.select(card, F.col("_w.start").cast(given).alias("started"), F.col("_w.end").cast(given).alias("ended"), "reviews", "correct")


def take(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Hands ``each`` all batches that the stream has now, with their numbers; a batch that failed comes again under its
    number. What has been taken is kept under ``path``. Returns how many rows state operators left out as late."""
    run = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(int(s["numRowsDroppedByWatermark"]) for p in run.recentProgress for s in p["stateOperators"])


def upsert(path: str, batch: DataFrame, number: int, keys: list[str], newest: Column) -> None:
    """Puts a batch into the table under ``path``: of each key the row with the largest ``newest`` stays, of equal ones
    the one that was there. Only buckets with a key of the batch are read and written anew, side by side with their old
    files; the list of every bucket's newest files, written last, makes the change count as a whole. A batch that runs
    again finds the list of the one before it, and leaves the same table. ``number`` rises from batch to batch.

    A key is held in no list: a batch costs one shuffle of its rows and of the buckets it touches. Null keys are keys."""
    spark, columns = batch.sparkSession, batch.columns
    batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]  # at most BUCKETS rows
        if not touched:
            return
        before = _files(spark, path, number)
        rows = batch.withColumn("_new", F.lit(1))
        old = [f"{path}/rows/{before[b]}/_bucket={b}" for b in touched if b in before]
        if old:
            there = spark.read.schema(batch.select(*columns).schema).parquet(*old)
            there = there.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).withColumn("_new", F.lit(0))
            rows = rows.unionByName(there)
        others = [c for c in columns if c not in keys]
        best = F.max_by(F.struct(*others), F.struct(newest, -F.col("_new"))) if others else F.first(F.lit(1))
        merged = rows.repartition("_bucket").groupBy("_bucket", *keys).agg(best.alias("_row"))
        merged = merged.select("_bucket", *keys, *[F.col("_row")[c].alias(c) for c in others])
        merged.write.partitionBy("_bucket").mode("overwrite").parquet(f"{path}/rows/{number}")
        listed = sorted({**before, **dict.fromkeys(touched, number)}.items())
        spark.createDataFrame(listed, "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/number={number}")
    finally:
        batch.unpersist()


def upserted(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table that ``upsert`` keeps under ``path``, as of its newest list."""
    files = [f"{path}/rows/{n}/_bucket={b}" for b, n in _files(spark, path).items()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket: the batch that wrote its newest files, of the newest list (of a batch before the given one)."""
    try:
        lists = spark.read.schema("bucket int, written long, number long").parquet(f"{path}/lists")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if before is not None:
        lists = lists.where(F.col("number") < before)
    newest = lists.agg(F.max("number")).first()[0]
    return {} if newest is None else {r["bucket"]: r["written"] for r in lists.where(F.col("number") == newest).collect()}  # BUCKETS rows at most
