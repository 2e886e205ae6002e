"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard of the vectors.

A shard's vectors fall into bands of like length, a tree each: within a band the longest is at most ``BAND`` times the
shortest. A further coordinate, the root of M^2 - |x|^2 with M the longest vector of the band, gives all its vectors one
length; then the largest inner product with a query is the smallest Euclidean distance, and the triangle inequality
holds. In narrow bands that coordinate is small, so distances stay far apart however widely lengths spread. A node splits
its vectors at the median distance to one of them. A query goes down the nearer side and takes the other side too if the
distance to the border is less than its k-th best distance divided by ``factor``. A factor of one, the default, misses
nothing; a larger one misses what lies just across a border, which in tight clusters may be nearly half. Bands are
taken from the longest down, and one is left out for the queries whose k-th best product no vector of its length can
reach, which is exact at any factor.

Every row is in the tree of its shard, every query goes to every shard, in blocks: a task holds one shard and one block.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.llm.common import cut

LEAF = 64
BAND = 1.1
SHARD = 8192
BLOCK = 1024
NONE = np.iinfo(np.int64).max  # no neighbour


class VpTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, seed: int = 7):
        """Of equal vectors, the ``keep`` with the smallest ids are kept; no others can be among as many nearest."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.ids, self.x = ids[nth < keep], vectors[nth < keep]
        self.y = self.x / np.abs(self.x).max()  # distances are of scaled vectors, whose squares do not overflow
        norms = (self.y * self.y).sum(axis=1)
        below = np.log(norms.max() / np.maximum(norms, np.finfo(float).tiny)) / (2 * np.log(BAND))
        band = np.floor(np.maximum(below, 0)).astype(int)
        self.extra = np.zeros(len(norms))
        self.nodes: list[tuple] = []
        self.bands: list[tuple[float, int]] = []  # square of the longest length, root
        self.rng = np.random.default_rng(seed)
        for b in np.unique(band):
            at = np.flatnonzero(band == b)
            longest = norms[at].max()
            self.extra[at] = np.sqrt(np.maximum(longest - norms[at], 0))
            self.bands.append((longest, self._build(at, longest)))
        del self.rng

    def _build(self, at: np.ndarray, longest: float) -> int:
        if len(at) > LEAF:
            vantage = int(self.rng.choice(at))
            square = 2 * longest - 2 * (self.y[at] @ self.y[vantage] + self.extra[at] * self.extra[vantage])
            distance = np.sqrt(np.maximum(square, 0))
            border = float(np.median(distance))
            near = distance <= border
            if near.any() and not near.all():
                node = (vantage, border, self._build(at[near], longest), self._build(at[~near], longest))
                self.nodes.append(node)
                return len(self.nodes) - 1
        self.nodes.append((at,))
        return len(self.nodes) - 1

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest of each query, its own id left out, ties to the smaller id; where there
        are fewer, NONE as id."""
        self.q, self.qid, self.k, self.factor = queries, ids, k, factor
        self.p = queries / np.abs(queries).max(axis=1, keepdims=True)
        self.p2 = (self.p * self.p).sum(axis=1)
        self.best = np.full((len(ids), k), -np.inf)
        self.scaled = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NONE)
        who = np.arange(len(ids))
        for longest, root in self.bands:
            most = np.sqrt(self.p2 * longest)
            self._visit(root, who[self._worst(who) <= most + 1e-9 * (1 + most)], longest)
        return self.found, self.best

    def _worst(self, who: np.ndarray) -> np.ndarray:
        """The k-th best product of scaled vectors, minus infinity where fewer are found."""
        return np.where(self.found[who, -1] == NONE, -np.inf, self.scaled[who].min(axis=1))

    def _visit(self, node: int, who: np.ndarray, longest: float) -> None:
        if not len(who):
            return
        if len(self.nodes[node]) == 1:
            at = self.nodes[node][0]
            # Sums in one order, so that equal vectors have equal products whatever the block.
            with np.errstate(over="ignore", invalid="ignore"):
                products = np.einsum("qd,xd->qx", self.q[who], self.x[at])
            scaled = self.p[who] @ self.y[at].T
            products = np.where(np.isnan(products), np.copysign(np.inf, scaled), products)  # too large on both sides of zero
            ids = np.where(self.qid[who][:, None] == self.ids[at][None, :], NONE, self.ids[at][None, :])
            score = np.hstack([self.best[who], products])
            ids, scaled = np.hstack([self.found[who], ids]), np.hstack([self.scaled[who], scaled])
            order = np.lexsort((ids, -score, ids == NONE), axis=-1)[:, : self.k]
            self.best[who], self.found[who], self.scaled[who] = (np.take_along_axis(x, order, axis=1) for x in (score, ids, scaled))
            return
        vantage, border, inner, outer = self.nodes[node]
        squares = self.p2[who] + longest
        slack = np.sqrt(4e-16 * self.y.shape[1] * squares)  # what rounding of a square may add to a distance near zero
        distance = np.sqrt(np.maximum(squares - 2 * (self.p[who] @ self.y[vantage]), 0))
        inside = distance <= border
        self._visit(inner, who[inside], longest)
        self._visit(outer, who[~inside], longest)
        reach = np.sqrt(np.maximum(squares - 2 * self._worst(who), 0)) / self.factor
        cross = np.abs(distance - border) <= reach + 3 * slack
        self._visit(outer, who[inside & cross], longest)
        self._visit(inner, who[~inside & cross], longest)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, score: for each query its k nearest among ``vectors`` by largest inner product in
    double precision, its own id left out, ties to the smaller id; fewer if there are fewer. Exact unless ``factor`` is
    over one.

    Vectors that are null, zero, or hold a null or a component that is not finite take no part on either side, nor do
    rows of a null id; vectors meet those of their own number of components only. Of rows that repeat an id the smallest
    vector counts. A product beyond the range of doubles is infinite. Other columns are ignored.
    """
    index, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    index = cut(index.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["count"] for r in index.groupBy("dim").count().collect()}  # one row for each number of components
    shards = F.create_map(*[x for dim, n in sizes.items() for x in (F.lit(dim), F.lit(-(-n // shard_rows)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    trees = index.withColumn("shard", F.pmod(F.xxhash64("id"), shards[F.col("dim")]).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = VpTree(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float), k + 1)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})

    trees = cut(trees.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))
    asked = cut(asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    blocks = max(1, -(-asked.count() // block_rows))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps((rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float)))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "block": rows["block"].iloc[:1], "queries": [packed]})

    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(gather, "dim int, block int, queries binary")
    spread = blocked.select("dim", "block", "queries", F.explode(F.sequence(F.lit(0), (shards[F.col("dim")] - 1).cast("int"))).alias("shard")) if sizes else blocked.select("dim", "block", "queries", F.lit(0).alias("shard"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        tree, (ids, q) = pickle.loads(rows["tree"].iloc[0]), pickle.loads(rows["queries"].iloc[0])
        found, score = tree.search(ids, q, k, factor)
        out = pd.DataFrame({"query_id": np.repeat(ids, k), "id": found.ravel(), "score": score.ravel()})
        return out[out["id"] != NONE]

    pairs = spread.join(trees, ["dim", "shard"]).groupBy("dim", "shard", "block").applyInPandas(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
