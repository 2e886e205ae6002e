"""Lexical and embedding retrieval, context assembly and blends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lektura.functions.automaton import pattern_hits
from lektura.functions.text import words
from lektura.operators.joins import ranked_matches
from lektura.operators.ranking import budget_prefix
from lektura.session import cut

QUERIES_TO_BROADCAST = 100_000
PATTERNS = 5_000  # words that one scan looks for
QUERY_BLOCK, KB_BLOCK = 1024, 8192


def shared_words(queries: DataFrame, docs: DataFrame, least: int = 2, k: int = 5, stop: Sequence[str] = ()) -> DataFrame:
    """qid, id, score, rank: the k documents (id, text) that share most different words with each query (qid, text),
    ties to the smaller id; ``least`` shared words at least. Rows of one id count together.

    The words of the queries go to every task while they are few: it counts those that each document shares with each query and
    passes on the k first documents of each query and batch, so neither pairs nor their counts are gathered. Rows that
    repeat an id, and all rows where the words are many, are counted by a join.
    """
    asked = queries.select("qid", F.explode(words(F.col("text"), stop=tuple(stop))).alias("word"))
    of = lambda rows: rows.select("id", words(F.col("text"), stop=tuple(stop)).alias("words"))
    counted = lambda rows: of(rows).select("id", F.explode("words").alias("word")).join(asked, "word").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score")).where(F.col("score") >= least)
    few = asked.limit(QUERIES_TO_BROADCAST + 1).collect()
    if len(few) > QUERIES_TO_BROADCAST:
        return ranked_matches(counted(docs), "qid", [F.desc("score"), F.col("id")], k)
    again = cut(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.col("id").alias("_id")))
    met = F.col("id").eqNullSafe(F.col("_id"))
    scores = _counted_in_tasks(few, of(docs.join(again, met, "left_anti")), least, k, StructType([asked.schema["qid"], docs.schema["id"], StructField("score", LongType())]))
    if not again.isEmpty():
        scores = scores.union(counted(docs.join(again, met, "left_semi")).select("qid", "id", "score"))
    return ranked_matches(scores, "qid", [F.desc("score"), F.col("id")], k)


def _counted_in_tasks(asked: Sequence, docs: DataFrame, least: int, k: int, schema: StructType) -> DataFrame:
    """qid, id, score: of each batch of ``docs`` (id, words) the k first documents of each query of ``asked``, rows of qid and word."""
    qids = list(dict.fromkeys(r["qid"] for r in asked))
    number, lists = {q: i for i, q in enumerate(qids)}, {}
    for r in asked:
        lists.setdefault(r["word"], []).append(number[r["qid"]])
    lists = {w: np.array(x, np.int64) for w, x in lists.items()}
    rows = max(1, 1_000_000 // max(1, len(qids)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("id", kind="stable")  # equal scores then stand by id
            for at in range(0, len(batch) if qids else 0, rows):
                part = batch.iloc[at : at + rows]
                score = np.zeros((len(part), len(qids)), np.int64)
                for n, held in enumerate(part["words"]):
                    if found := [lists[w] for w in held if w in lists]:
                        score[n] = np.bincount(np.concatenate(found), minlength=len(qids))
                first = np.argsort(-score, axis=0, kind="stable")[:k]
                best = np.take_along_axis(score, first, axis=0).ravel()
                kept = best >= least
                yield pd.DataFrame({"qid": [qids[q] for q in np.tile(np.arange(len(qids)), len(first))[kept]], "id": part["id"].to_numpy()[first.ravel()][kept], "score": best[kept]})

    return docs.where("words is not null").mapInPandas(each, schema)


def held_words(asked: DataFrame, docs: DataFrame, weights: Sequence[float], over: float, k: int) -> DataFrame:
    """qid, id, score, rank: the k documents (id, t) over the score ``over`` of each query (qid, w0, w1 ...), which is the sum of
    the weights of those of its words that stand in the text, ties to the smaller id. An empty word stands in every text.

    Up to ``PATTERNS`` words of the queries are looked for in one scan of a text, and a task passes on the k first documents of
    each query and batch, so pairs are not shuffled. More queries are compared with each document."""
    order = [F.desc("score"), F.col("id")]
    names = [f"w{i}" for i in range(len(weights))]
    few = asked.limit(PATTERNS // len(names) + 1).collect()
    if len(few) > PATTERNS // len(names):
        score = sum((F.contains("t", F.col(w)).cast("int") * x for w, x in zip(names, weights)), F.lit(0.0))
        pairs = docs.crossJoin(F.broadcast(asked) if asked.limit(QUERIES_TO_BROADCAST + 1).count() <= QUERIES_TO_BROADCAST else asked)
        return ranked_matches(pairs.withColumn("score", F.round(score, 6)).where(F.col("score") > over).select("qid", "id", "score"), "qid", order, k)
    patterns = sorted({r[w] for r in few for w in names} - {""})
    place = {w: i for i, w in enumerate(patterns)} | {"": len(patterns)}
    of = np.array([[place[r[w]] for w in names] for r in few], np.int64).reshape(-1, len(names))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("id", kind="stable")  # equal scores then stand by id
            for at in range(0, len(batch) if len(of) else 0, 1000):
                part = batch.iloc[at : at + 1000]
                held = np.zeros((len(part), len(patterns) + 1), bool)
                held[:, -1] = True
                rules = [np.asarray(x, np.int64) for x in part["rules"]]
                held[np.repeat(np.arange(len(part)), [len(x) for x in rules]), np.concatenate(rules)] = True
                score = np.round(sum((held[:, of[:, i]] * x for i, x in enumerate(weights)), np.zeros((len(part), len(of)))), 6)
                first = np.argsort(-score, axis=0, kind="stable")[:k]
                found = np.take_along_axis(score, first, axis=0)
                yield pd.DataFrame({"q": np.tile(np.arange(len(of)), len(first)), "id": part["id"].to_numpy()[first.ravel()], "score": found.ravel()})[found.ravel() > over]

    rules = F.transform(pattern_hits(F.col("t"), patterns), lambda x: x["rule"]) if patterns else F.array().cast("array<int>")
    best = docs.where("t is not null and id is not null").select("id", rules.alias("rules")).mapInPandas(each, f"q int, id {docs.schema['id'].dataType.simpleString()}, score double")
    numbered = docs.sparkSession.createDataFrame([(i, r["qid"]) for i, r in enumerate(few)], StructType([StructField("q", IntegerType()), asked.schema["qid"]]))
    return ranked_matches(best.join(F.broadcast(numbered), "q").select("qid", "id", "score"), "qid", order, k)


def unit(vector: Column) -> Column:
    """The vector in doubles at length one; null where it has none."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(queries: DataFrame, kb: DataFrame, k: int = 10, least: float | None = None, boost: float = 1.1, default_least: float = 0.3, few: int = 5_000) -> DataFrame:
    """qid, id, score, rank: the k nearest of ``kb`` (id, embedding, tier) to each query (qid, embedding) by cosine.

    Tier 1 is raised by ``boost`` before the threshold; scores are capped at 1 after ranking. ``least`` None is the
    default, 0 is 0. Vectors of other lengths than the query's take no part. Unit vectors are made once a side; up to
    ``few`` queries are broadcast, so the knowledge base is scanned once and never shuffled. More are compared in blocks:
    a task multiplies one block of queries with one of the knowledge base and passes on the k nearest of each query.
    """
    least = default_least if least is None else least
    asked = queries.select("qid", unit(F.col("embedding")).alias("q"))
    held = kb.select("id", "tier", unit(F.col("embedding")).alias("v")).where("v is not null")
    if asked.limit(few + 1).count() <= few:
        raw = held.join(F.broadcast(asked), F.size("v") == F.size("q")).withColumn("raw", dot(F.col("v"), F.col("q")) * F.when(F.col("tier") == 1, boost).otherwise(1.0))
    else:
        raw = _by_blocks(asked.where("q is not null"), held, k, boost)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("raw", 9)), "id"))
    return raw.where(F.col("raw") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", "tier", F.round(F.least(F.col("raw"), F.lit(1.0)), 6).alias("score"), "rank")


def first_of_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each row, to nine digits, ties to the smaller id; sorted a few rows at a time, so
    that sorting holds little beside the scores."""
    parts = [score[i : i + 32] for i in range(0, len(score), 32)]
    return np.concatenate([np.lexsort((np.broadcast_to(ids, x.shape), -np.round(x, 9)), axis=-1)[:, :k].copy() for x in parts])


def _by_blocks(asked: DataFrame, held: DataFrame, k: int, boost: float) -> DataFrame:
    """qid, id, tier, raw: of each pair of blocks the k nearest of each query."""
    nq, nv = (max(1, -(-rows.count() // size)) for rows, size in ((asked, QUERY_BLOCK), (held, KB_BLOCK)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("qid", "q", F.size("q").alias("dim"), number("qid", nq).alias("qb"), every(nv).alias("vb"))
    right = held.select("id", "tier", "v", F.size("v").alias("dim"), number("id", nv).alias("vb"), every(nq).alias("qb"))
    schema = StructType([asked.schema["qid"], held.schema["id"], held.schema["tier"], StructField("raw", DoubleType())])

    def nearest(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame(columns=schema.names)
        score = np.stack(queries["q"].to_numpy()) @ np.stack(vectors["v"].to_numpy()).T * np.where(vectors["tier"] == 1, boost, 1.0)
        ids = vectors["id"].to_numpy()
        order = first_of_rows(score, ids, k)
        return pd.DataFrame({"qid": np.repeat(queries["qid"].to_numpy(), order.shape[1]), "id": ids[order.ravel()], "tier": vectors["tier"].to_numpy()[order.ravel()], "raw": np.take_along_axis(score, order, axis=1).ravel()})

    by = ("dim", "qb", "vb")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, schema)


def context(hits: DataFrame, texts: DataFrame, strong: float = 0.5, few: int = 3, budget: int = 3000) -> DataFrame:
    """Hits (qid, id, tier, score) that make a query's context: tier 1 from ``strong``; tier 2 only where fewer than
    ``few`` of those are; then texts (id, length) in order while they stay within the budget."""
    first = hits.where((F.col("tier") == 1) & (F.col("score") >= strong))
    enough = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= few)
    more = hits.where(F.col("tier") == 2).join(enough, "qid", "left_anti")
    both = first.unionByName(more).join(texts, "id")
    return budget_prefix(both, ["qid"], [F.col("tier"), F.desc("score"), F.col("id")], F.col("length"), budget)


def blend(knowledge: DataFrame, hits: DataFrame, fixed: float = 2.0, least: float = 0.15, n: int = 5) -> DataFrame:
    """The first n of each query's knowledge rows, which score ``fixed``, and hits over ``least``."""
    both = knowledge.select("qid", "id", F.lit(fixed).alias("score")).unionByName(hits.where(F.col("score") > least).select("qid", "id", "score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n)
