"""Ranking, deduplication by rank, running budgets, ordered samples and forward fill."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektura.session import cut


def dealt_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows by ranges of key and order, each range in a partition of its own number ``_part``: a key with many rows has many
    partitions. Cut, so that the numbers stay."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``place``, the row's number in its key from 1, and running sums by name, up to and with the row; null counts as 0.

    No task holds a whole key: ranges are numbered and summed by themselves, and what a key has in the ranges before is
    added. ``order`` should tell all rows of a key apart; null keys are one key.
    """
    made = dict(sums or {})
    valued = rows.withColumns({f"_v{k}": F.coalesce(c, F.lit(0)) for k, c in enumerate(made.values())}) if made else rows
    dealt = dealt_in_order(valued, keys, order)
    own = [f"_k{k}" for k in range(len(keys))]
    totals = dealt.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, own)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(made))])
    before = Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = totals.select(*own, "_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *[f"_t{k}" for k in range(len(made))]]])
    met = F.col("_part") == F.col("_p")
    for c, k in zip(keys, own):
        met = met & F.col(c).eqNullSafe(F.col(k))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(ahead, met)
    added = {name: F.col(f"_t{k}") + F.sum(f"_v{k}").over(upto) for k, name in enumerate(made)}
    if place:
        added[place] = (F.col("_n") + F.row_number().over(within)).cast("int")
    return found.withColumns(added).drop("_part", "_p", "_n", *own, *[f"_{x}{k}" for k in range(len(made)) for x in "vt"])


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str = "rank") -> DataFrame:
    """``running`` with the place alone."""
    return running(rows, keys, order, place)


def percentile_classes(rows: DataFrame, order: Sequence[Column], high: float = 0.15, medium: float = 0.5) -> DataFrame:
    """Adds rank and class: HIGH to the ceiling of 15 % (at least 1), MEDIUM to that of 50 % (at least one more), then LOW."""
    rows = cut(rows)
    n = rows.count()
    top = max(1, math.ceil(n * high))
    middle = max(top + 1, math.ceil(n * medium))
    found = ranked(rows, [], order)
    return found.withColumn("class", F.when(F.col("rank") <= top, "HIGH").when(F.col("rank") <= middle, "MEDIUM").otherwise("LOW"))


def newest_versions(rows: DataFrame, keys: Sequence[str], date: str, pos: str) -> DataFrame:
    """One row a key: pos and date of the newest version, the first read of equal dates, and how often reading in
    order would have replaced it (``replaced``) or met another (``collisions``)."""
    seen = rows.withColumn("_best", F.max(date).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)))
    replaced = F.count(F.when(F.col(date) > F.col("_best"), 1))
    return seen.groupBy(*keys).agg(F.min_by(pos, F.struct(-F.unix_micros(date), pos)).alias(pos), F.max(date).alias(date), replaced.alias("replaced"), (F.count(F.lit(1)) - 1).alias("collisions"))


def budget_prefix(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], length: Column, budget: int, per_block: bool = False, joint: int = 2) -> DataFrame:
    """Ranked rows up to the first that would pass the budget; later ones that would fit do not follow. ``per_block``
    holds each length, with what joins it to the next, against the budget alone."""
    counted = F.when(length + joint > budget, 1).otherwise(0) if per_block else length
    found = running(rows, keys, order, sums={"_run": counted})
    return found.where(F.col("_run") <= (0 if per_block else budget)).drop("_run")


def forward_filled(rows: DataFrame, keys: Sequence[str], order: str, value: str, fallback: Column) -> DataFrame:
    """Adds ``filled``: the value itself, else the last one before it, else the fallback."""
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("filled", F.coalesce(last, fallback))


def first_exhausted(usage: DataFrame, provider: str, order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """provider, spent, and the first event at which its running cost reaches the budget (null if never)."""
    at = running(usage, [provider], [F.col(c) for c in order], sums={"_run": F.col(cost)})
    return at.groupBy(provider).agg(F.round(F.sum(cost), 6).alias("spent"), F.min(F.when(F.col("_run") >= budget, F.col(order[-1]))).alias("exhausted_at"))


def seeded_order(key: Column, seed: str = "7") -> Column:
    """A random-looking but repeatable order."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: str = "7") -> DataFrame:
    """n rows over the groups: if there are n groups or more, one of each of the n largest; else the same from each,
    what is over going to the largest, and what small groups lack to the others, each in the seeded order."""
    order = seeded_order(F.col(key), seed)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, key)))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    place = Window.orderBy(F.desc("_size"), group)  # one row a group
    sizes = sizes.withColumns({"_place": F.row_number().over(place), "_groups": F.count(F.lit(1)).over(Window.partitionBy())})
    quota = F.when(F.col("_groups") >= n, (F.col("_place") <= n).cast("int")).otherwise(F.floor(F.lit(n) / F.col("_groups")) + (F.col("_place") <= F.lit(n) % F.col("_groups")).cast("int"))
    joined = ranked.join(F.broadcast(sizes.withColumn("_quota", quota)) if sizes.limit(10_001).count() <= 10_000 else sizes.withColumn("_quota", quota), group)
    # Within the quota first, then the rest in the seeded order until there are n.
    late = F.when(F.col("_r") <= F.col("_quota"), 0).otherwise(1)
    return joined.orderBy(late, F.when(late == 1, order), F.col(key)).limit(n).drop("_r", "_size", "_place", "_groups", "_quota")


def flagged_and_filled(rows: DataFrame, flagged: DataFrame, key: str, size: int, seed: str = "7") -> DataFrame:
    """All flagged rows and, in the seeded order, others up to ``size``; refuses more flagged ones than that."""
    all_flagged = rows.join(flagged.select(key).distinct(), key, "left_semi")
    n = all_flagged.count()
    if n > size:
        raise ValueError(f"{n} flagged rows do not go into a sample of {size}")
    rest = rows.join(flagged.select(key).distinct(), key, "left_anti").orderBy(seeded_order(F.col(key), seed), key).limit(size - n)
    return all_flagged.withColumn("flagged", F.lit(True)).unionByName(rest.withColumn("flagged", F.lit(False)))
