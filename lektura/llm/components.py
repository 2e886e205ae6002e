"""Connected components by repeated contraction, all in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import cut, written


FEW = 500_000  # edges, 16 bytes each, that one task joins


def roots_of(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, root = at[: len(src)], at[len(src) :], np.arange(len(nodes))
    while (open_ := root[a] != root[b]).any():
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((jump := root[root]) != root).any():
            root = jump
    return nodes, nodes[root]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [batch[["src", "dst"]].to_numpy(np.int64) for batch in batches]
    if held:
        nodes, roots = roots_of(*np.concatenate(held).T)
        yield pd.DataFrame({"node": nodes, "root": roots})


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """``edges``: columns src and dst (long). Returns node, root: one row for each node that has an edge to another;
    nodes are of one component if and only if their roots are the same node of it.

    Each round lets every node follow the least of itself and its neighbours, in an order drawn anew by hash, and
    merges the edges; node counts fall by a constant share a round, long chains included. A hub's neighbours are
    pre-aggregated before the shuffle. Once the edges are counted to be ``few`` (``FEW`` where not given), one task joins them,
    so that many small graphs do not take a plan and several jobs a round each. A round's edges are written as a table: the size that Spark expects of a checkpoint
    would be the cube of the last round's, a number that soon fills the driver. Joins are by merging, for the same reason.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    roots: DataFrame | None = None
    turn, few = 0, FEW if few is None else few
    while (n := left.limit(few + 1).count()) > few:
        turn += 1
        both = left.union(left.select("dst", "src"))
        order = F.xxhash64("dst", F.lit(turn))
        least = both.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", order).alias("nb"), F.min(order).alias("rank"))
        own = F.xxhash64("node", F.lit(turn))
        step = written(least.select("node", F.when(F.col("rank") < own, F.col("nb")).otherwise(F.col("node")).alias("root")))
        a, b = step.toDF("src", "a"), step.toDF("dst", "b")
        left = written(left.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        roots = _followed(roots, step)
    if n:
        roots = _followed(roots, left.repartition(1).mapInPandas(_joined, "node long, root long"))
    return written(roots) if roots is not None else left.toDF("node", "root")


def _followed(roots: DataFrame | None, step: DataFrame) -> DataFrame:
    if roots is None:
        return step
    return roots.join(step.toDF("root", "to").hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def lot_of(column: str) -> Column:
    """A number from 0 to 1 drawn by hash."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / (1 << 30)
