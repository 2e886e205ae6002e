"""Joins by exact, normalised and fuzzy keys, upserts, and set differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lektura.session import cut

PARTS = 100_000  # rows of ids and parts that go to every task


def sequence_ratio(a: str, b: str) -> float:
    """The share of characters in matching blocks; order matters, and long second texts skip frequent characters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b)])


def first_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup(left: DataFrame, right: DataFrame, key: str, order: Column, *columns: str, last: bool = False) -> DataFrame:
    """Left rows with columns of the first (or last) right row of their key, null where there is none. The right side
    is reduced to one row a key by a pre-aggregated minimum, so no key can multiply rows or gather in one task."""
    pick = F.max_by if last else F.min_by
    one = right.groupBy(key).agg(*[pick(F.col(c), order).alias(c) for c in columns])
    return left.join(one, key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, least: int, insert: bool = False) -> DataFrame:
    """key, value, outcome for keys of either side: ``replaced`` where the new value has the length, ``short`` where it
    has not, ``kept`` without a new one; new keys are ``inserted`` or ``unmatched``. One row a key on both sides."""
    both = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in")).join(new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_up")), key, "full_outer")
    long_enough = F.length(F.trim(F.coalesce("_new", F.lit("")))) >= least
    outcome = F.when(F.col("_in").isNull(), F.lit("inserted" if insert else "unmatched")).when(F.col("_up").isNull(), "kept").when(long_enough, "replaced").otherwise("short")
    return both.withColumn("outcome", outcome).select(key, F.when(F.col("outcome").isin("replaced", "inserted"), F.col("_new")).otherwise(F.col("_old")).alias(value), "outcome")


def fill_empty(old: DataFrame, new: DataFrame, key: str, value: str, order: str, least: int = 50) -> DataFrame:
    """Old rows take the first new value of their key only where their own is shorter than ``least``; all new rows of
    unknown keys follow."""
    filled = lookup(old, new.select(key, F.col(value).alias("_new"), F.col(order).alias("_order")), key, F.col("_order"), "_new")
    own = F.length(F.trim(F.coalesce(F.col(value), F.lit("")))) >= least
    filled = filled.withColumn(value, F.when(own | F.col("_new").isNull(), F.col(value)).otherwise(F.col("_new"))).select(key, value)
    return filled.unionByName(new.join(old, key, "left_anti").select(key, value))


def consume_once(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, *columns: str) -> DataFrame:
    """The n-th left row of a key takes the n-th right row; ``matched`` is false for those left over."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.select(*keys, right_order, *columns).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b.drop(right_order).withColumn("_hit", F.lit(True)), [*keys, "_n"], "left").withColumn("matched", F.col("_hit").isNotNull()).drop("_n", "_hit")


def two_sided_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one side only; a null key equals none, so it is of each side that has one. One aggregation: rows
    are reduced to a key in the task, and no table of keys is built."""
    both = left.select(key, F.lit(True).alias("_left")).union(right.select(key, F.lit(False)))
    sides = both.groupBy(key).agg(F.bool_or("_left").alias("_l"), F.bool_and("_left").alias("_r"))
    one = F.col(key).isNull() | (F.col("_l") == F.col("_r"))
    side = F.when(F.col("_l") & one, "left"), F.when(~F.col("_r") & one, "right")
    return sides.select(key, F.explode(F.array_compact(F.array(*side))).alias("side"))


def shared_parts(left: DataFrame, right: DataFrame, least: int = 2, longer: int = 3) -> DataFrame:
    """Pairs (lid, rid) whose name keys (lname, rname) share at least ``least`` different parts longer than ``longer``, with
    ``shared``. Rows of one id count together.

    Up to ``PARTS`` parts of the left side go to every task, which counts those that a row shares with each left id, so the
    right side is not shuffled and no row is made for each part of a pair. Right rows that repeat an id, and all where the left
    parts are more, are counted by an equi-join on parts."""
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda p: F.length(p) > longer))
    asked = left.select("lid", F.explode(parts("lname")).alias("part")).distinct()
    held = right.select("rid", parts("rname").alias("parts"))
    few = asked.limit(PARTS + 1).collect()
    lids = sorted({r["lid"] for r in few}, key=lambda x: (x is None, x))

    def joined(rows: DataFrame) -> DataFrame:
        met = asked.join(rows.select("rid", F.explode("parts").alias("part")).distinct(), "part")
        return met.groupBy("lid", "rid").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)

    if len(few) > PARTS or len(lids) > PARTS // 10:
        return joined(held)
    again = cut(right.groupBy("rid").count().where("count > 1").select(F.col("rid").alias("_rid")))
    place, lists = {x: i for i, x in enumerate(lids)}, {}
    for r in few:
        lists.setdefault(r["part"], []).append(place[r["lid"]])
    of_part = {part: np.array(at) for part, at in lists.items()}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch) if lids else 0, step := max(1, 1_000_000 // max(len(lids), 1))):
                part = batch.iloc[at : at + step]
                shared = np.zeros((len(part), len(lids)), np.int64)
                for n, held in enumerate(part["parts"]):
                    if found := [of_part[x] for x in held if x in of_part]:
                        shared[n] = np.bincount(np.concatenate(found), minlength=len(lids))
                row, lid = np.nonzero(shared >= least)
                yield pd.DataFrame({"lid": [lids[k] for k in lid], "rid": part["rid"].array[row], "shared": shared[row, lid]}, columns=["lid", "rid", "shared"])

    schema = StructType([left.schema["lid"], right.schema["rid"], StructField("shared", LongType())])
    if again.isEmpty():
        return held.where("parts is not null").mapInPandas(each, schema)
    here = F.col("rid").eqNullSafe(F.col("_rid"))
    once = held.join(again, here, "left_anti").where("parts is not null").mapInPandas(each, schema)
    return once.unionByName(joined(held.join(again, here, "left_semi")))


def ranked_matches(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
