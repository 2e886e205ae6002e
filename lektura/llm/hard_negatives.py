"""Hard negatives by slots between the positives' scores.

An anchor's positives set upper limits on the scores of its negatives. Sorted, the limits part all scores into disjoint
slots, so a negative belongs to one slot whatever windows overlap there. Each task keeps the best few of each slot for
each anchor; merging the slots from the lowest limit up gives, for every positive, the best few at or under its limit,
and the window's lower limit cuts the tail of those.

Vectors and anchors are dealt by hash into blocks, packed, and each block of anchors meets each block of vectors once a pass:
one pass for the positives, one for the slots. A task holds two blocks; what it passes on is a few rows an anchor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektura.llm.common import cut

VECTORS, ANCHORS = 8192, 1024
NONE, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # no score, and the greatest
MOST = float(np.finfo(float).max)
EXACT = float(1 << 53)  # sums of whole numbers up to here are exact in doubles


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, in 64 bits; what lies beyond those is held at their limits."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * anchors.shape[1]
    if largest < EXACT:
        return (anchors @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in anchors], object) @ np.array([[int(x) for x in row] for row in vectors], object).T
    return np.clip(exact, -HIGH, HIGH).astype(np.int64)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest allowed scores of each row, ties to the first columns, greatest first."""
    n, columns = score.shape
    k = min(k, columns)
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if columns > 4 * k and np.abs(score).max() < (1 << 62) // columns:  # one number for score and place: no ties
        key = np.where(allowed, score * columns + np.arange(columns - 1, -1, -1), NONE)
        at = np.argpartition(key, columns - k, axis=1)[:, columns - k :]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1, kind="stable"), 1)
    else:
        at = np.lexsort((np.broadcast_to(np.arange(columns), score.shape), -score, ~allowed), axis=-1)[:, :k]
    there = np.take_along_axis(allowed, at, 1)
    return np.repeat(np.arange(n), k)[there.ravel()], at[there]


def usable(rows: DataFrame, id_col: str, label: Column, vector: Column, scale: float) -> DataFrame:
    """id, label, v: rows that take part, components in whole numbers."""
    made = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("v"))
    made = made.where("id is not null and label is not null and v is not null")
    made = made.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    made = made.select("id", F.struct("label", F.transform("v", lambda x: _floored(x * scale)).alias("v")).alias("s"))
    return made.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.label", "s.v", F.size("s.v").alias("dim"))


def _floored(x: Column) -> Column:
    """The floor, in doubles whatever their size: from 2^53 on they are whole. Infinity becomes the greatest double."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x)))


def _packed(rows: DataFrame, per: int, salt: int, extra: Column | None = None) -> tuple[DataFrame, int]:
    """dim, block, packed: the rows in blocks of about ``per`` by hash of their id, each sorted by id; and how many blocks."""
    blocks = max(1, -(-rows.count() // per))
    rows = rows.select("dim", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int").alias("block"), "id", "label", "v", (extra if extra is not None else F.lit(None).cast("array<long>")).alias("limits"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        held = (part["id"].to_numpy(np.int64), part["label"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float), part["limits"].tolist())
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "block": part["block"].iloc[:1], "packed": [pickle.dumps(held)]})

    return rows.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, packed binary"), blocks


def _met(anchors: DataFrame, vectors: DataFrame, blocks: int, look: Callable, schema: str) -> DataFrame:
    """What ``look`` yields of each block of anchors and each of the ``blocks`` of vectors of their number of components.

    Packed blocks shrink to a sixth in a shuffle, by which Spark would take them for small and send them through the driver;
    so this join, like all whose sides grow with the input, merges."""
    spread = anchors.select("dim", F.col("block").alias("of"), F.col("packed").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return look(pickle.loads(rows["a"].iloc[0]), pickle.loads(rows["packed"].iloc[0]))

    return spread.join(vectors.hint("merge"), ["dim", "block"]).groupBy("dim", "block", "of").applyInPandas(each, schema)


def top(rows: DataFrame, keys: list[str], k: int, score: str = "score", by: str = "id") -> DataFrame:
    """The k rows of the greatest score of each key, ties to the smaller id, with ``place`` from 1. Tasks have left k a
    block at most, so a key's rows are few."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), by))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
    least: tuple[int, int] = (80, 100), scale: float = 256.0, vector_block: int = VECTORS, anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of components times ``scale``, rounded down; higher ones come first, ties by smaller id. An
    anchor's positives are its first other rows of the same label; for each of them the first rows of another label
    follow whose score is at most the positive's and at least ``least`` of it (a share as two whole numbers). So a
    negative positive score, and one with no such rows, has no row.

    Rows with a null id, label or vector or a null or non-finite component take no part; vectors meet those of their
    own number of components. Of rows that repeat an id the least by label, then vector, counts. ``is_anchor`` and
    ``label`` are columns of ``vectors``; others are ignored, whatever their names. An empty table gives no rows.
    """
    label = F.col("label") if label is None else label
    chosen = vectors.withColumns({"_anchor": is_anchor, "_label": label, "_v": F.col(vector_col)}).select(F.col(id_col).alias("_id"), "_anchor", "_label", "_v")
    rows = cut(usable(chosen, "_id", F.col("_label"), F.col("_v"), scale))
    wanted = chosen.where("_anchor").select(F.col("_id").cast("long").alias("id")).distinct()
    anchors = cut(rows.join(wanted.hint("merge"), "id", "left_semi"))
    blocks_of_vectors, n = _packed(rows, vector_block, 1)
    held = cut(blocks_of_vectors)

    def alike(a: tuple, v: tuple) -> pd.DataFrame:
        score = scores(a[2], v[2])
        row, column = best(score, (a[1][:, None] == v[1][None, :]) & (a[0][:, None] != v[0][None, :]), positives)
        return pd.DataFrame({"anchor": a[0][row], "id": v[0][column], "score": score[row, column]})

    first, _ = _packed(anchors, anchor_block, 2)
    found = cut(top(_met(first, held, n, alike, "anchor long, id long, score long"), ["anchor"], positives))
    limits = found.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))  # few an anchor
    limited = anchors.join(limits.withColumnRenamed("anchor", "id").hint("merge"), "id")

    def slotted(a: tuple, v: tuple) -> pd.DataFrame:
        score, other = scores(a[2], v[2]), a[1][:, None] != v[1][None, :]
        limit = np.full((len(a[0]), positives + 1), NONE)
        for k, own in enumerate(a[3]):
            limit[k, : len(own)] = own
        out = []
        for s in range(positives):  # slot s is what is at or under limit s and over the next
            row, column = best(score, other & (score <= limit[:, s : s + 1]) & (score > limit[:, s + 1 : s + 2]), negatives)
            out.append(pd.DataFrame({"anchor": a[0][row], "slot": np.full(len(row), s, np.int32), "id": v[0][column], "score": score[row, column]}))
        return pd.concat(out)

    second, _ = _packed(limited, anchor_block, 2, F.col("limits"))
    slots = cut(top(_met(second, held, n, slotted, "anchor long, slot int, id long, score long"), ["anchor", "slot"], negatives))
    return _windows(found, slots, limits, negatives, least)


def _windows(found: DataFrame, slots: DataFrame, limits: DataFrame, negatives: int, least: tuple[int, int]) -> DataFrame:
    """Merges each anchor's slots from the lowest limit up and answers every positive's window from the slot of its limit."""
    entry = F.struct((-F.col("score")).alias("n"), "id")
    per_slot = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", entry.alias("e"))).alias("es"))  # positives x negatives at most
    ready = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(limits.hint("merge"), "anchor").join(per_slot.hint("merge"), "anchor")
    own = F.array_position("limits", F.col("positive_score")) - 1
    merged = ready.withColumn("own", own).select("*", F.slice(F.array_sort(F.transform(F.filter("es", lambda x: x["slot"] >= F.col("own")), lambda x: x["e"])), 1, negatives).alias("first"))
    low = F.lit(least[0]).cast("decimal(38,0)") * F.col("positive_score")
    inside = F.filter("first", lambda x: F.lit(least[1]).cast("decimal(38,0)") * -x["n"] >= low)
    out = merged.select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("pos", "x"))
    return out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.n")).alias("negative_score"),
    )
