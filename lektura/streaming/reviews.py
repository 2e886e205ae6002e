"""Spaced repetition from a review log, in batch and as streams; usage totals and newest versions as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

STATE = "struct<ef: double, interval: long, reps: int>"


def review_step(state: Column, q: Column) -> Column:
    """The state (ef, interval, reps) after a review of quality q, held to 0..5. Under 3 the card starts again; else
    the interval is 1, 6 and then the old one times the easiness before this review, rounded half to even."""
    q = F.greatest(F.lit(0), F.least(F.lit(5), q))
    ef, interval, reps = state["ef"], state["interval"], state["reps"]
    later = F.when(reps == 0, F.lit(1)).when(reps == 1, F.lit(6)).otherwise(F.bround(interval * ef)).cast("long")
    return F.struct(
        F.greatest(F.lit(1.3), ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)).alias("ef"),
        F.when(q < 3, F.lit(1).cast("long")).otherwise(later).alias("interval"),
        F.when(q < 3, F.lit(0)).otherwise(reps + 1).cast("int").alias("reps"),
    ).cast(STATE)


def folded_reviews(reviews: DataFrame, card: str, order: list[str], quality: str) -> DataFrame:
    """card, ef, interval, reps, reviews: each card's reviews in order, folded. A card's own reviews are one row's list."""
    start = F.struct(F.lit(2.5).alias("ef"), F.lit(1).cast("long").alias("interval"), F.lit(0).alias("reps")).cast(STATE)
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(quality).cast("int").alias("_q"))))
    folded = reviews.groupBy(card).agg(listed.alias("_l")).withColumn("_s", F.aggregate("_l", start, lambda s, x: review_step(s, x["_q"])))
    return folded.select(card, F.round("_s.ef", 6).alias("ef"), F.col("_s.interval").alias("interval"), F.col("_s.reps").alias("reps"), F.size("_l").cast("long").alias("reviews"))


def python_step(ef: float, interval: int, reps: int, q: int) -> tuple[float, int, int]:
    """``review_step`` for one review, for the stateful stream."""
    q = max(0, min(5, q))
    new_ef = max(1.3, ef + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    if q < 3:
        return new_ef, 1, 0
    return new_ef, (1 if reps == 0 else 6 if reps == 1 else round(interval * ef)), reps + 1


def review_states(stream: DataFrame) -> DataFrame:
    """A stream of (card long, ts, pos long, q int) as one of (card, ef, interval, reps, reviews, late): the states of
    the cards that a batch touched. Reviews of a batch are sorted. A review that is older than one already folded sets
    ``late`` for good: the state is then one of another order, and ``settled`` folds the card's log anew."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ef, interval, reps, n, at, place, late = state.get if state.exists else (2.5, 1, 0, 0, -(1 << 62), 0, False)
        for ts, pos, q in pd.concat(batches).sort_values(["ts", "pos"])[["ts", "pos", "q"]].itertuples(index=False):
            late = late or (ts.value, pos) < (at, place)
            at, place = max((at, place), (ts.value, int(pos)))
            ef, interval, reps = python_step(ef, interval, reps, int(q))
            n += 1
        state.update((ef, interval, reps, n, at, place, late))
        yield pd.DataFrame({"card": [key[0]], "ef": [round(ef, 6)], "interval": [interval], "reps": [reps], "reviews": [n], "late": [late]})

    kept = "ef double, interval long, reps int, reviews long, at long, place long, late boolean"
    return stream.groupBy("card").applyInPandasWithState(update, "card long, ef double, interval long, reps int, reviews long, late boolean", kept, "update", "NoTimeout")


def settled(states: DataFrame, reviews: DataFrame, order: list[str]) -> DataFrame:
    """card, ef, interval, reps, reviews: the newest states of a stream, those with late reviews folded from the log."""
    late = states.where("late").select("card")
    again = folded_reviews(reviews.join(late, "card", "left_semi"), "card", order, "q")
    return states.where("not late").drop("late").unionByName(again)


def run_to_end(stream: DataFrame, path: str, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Takes all that the stream has, a folder under ``path`` for each batch; a batch that runs again writes the same
    folder anew, so each counts once. What has been taken is kept in the stream's checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/out/*")


def latest(rows: DataFrame, key: str, by: Column, *columns: str) -> DataFrame:
    """Each key's columns of its largest ``by``."""
    return rows.groupBy(key).agg(*[F.max_by(F.col(c), by).alias(c) for c in columns])
