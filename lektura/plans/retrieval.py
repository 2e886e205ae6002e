"""Retrieval (R) over the tables: documents and embeddings as knowledge base, benchmark and every twentieth embedding as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.operators import retrieval as R
from lektura.operators.joins import first_per_key
from lektura.plans.projections import WORDS_SQL
from lektura.plans.registry import query
from lektura.session import Tables

LEXICAL_SQL = f"""WITH q AS (SELECT item_id AS qid, unnest({WORDS_SQL.format('text')}) AS w FROM benchmark), d AS (SELECT doc_id AS id, unnest({WORDS_SQL.format('text')}) AS w FROM documents),
    s AS (SELECT qid, id, count(*) AS score FROM q JOIN d ON q.w = d.w GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


def lexical(t: Tables, k: int = 5) -> DataFrame:
    return R.shared_words(t.benchmark.select(F.col("item_id").alias("qid"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"), k=k)


@query("r4_lexical_top_k", f"{LEXICAL_SQL} SELECT * FROM k WHERE rank <= 5")
def r4(t: Tables) -> DataFrame:
    return lexical(t)


@query("r1_kb_build", "SELECT content_id, doc_id FROM (SELECT coalesce(source, '') || '_' || substr(md5(text), 1, 12) AS content_id, doc_id, row_number() OVER (PARTITION BY coalesce(source, '') || '_' || substr(md5(text), 1, 12) ORDER BY doc_id DESC) AS n FROM documents WHERE length(trim(text, ' ')) >= 10) WHERE n = 1")
def r1(t: Tables) -> DataFrame:
    kept = t.documents.where(F.length(F.trim("text")) >= 10).select(X.content_id(F.col("source"), F.col("text")).alias("content_id"), "doc_id")
    return first_per_key(kept, ["content_id"], F.desc("doc_id"))


def kb(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") < 3, 1).otherwise(2).alias("tier"))


COSINE_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label < 3 THEN 1 ELSE 2 END AS tier FROM embeddings),
    r AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.tier, list_cosine_similarity(e.v, q.v) * CASE WHEN e.tier = 1 THEN 1.1 ELSE 1 END AS raw FROM e, e q WHERE q.vec_id % 20 = 0),
    s AS (SELECT qid, id, tier, round(least(raw, 1), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, id) AS rank FROM r WHERE raw >= 0.3),
    h AS (SELECT * FROM s WHERE rank <= 10)"""


def hits(t: Tables) -> DataFrame:
    """The ten nearest vectors to the stated query set, every vector whose id is divisible by 20."""
    return R.cosine_top_k(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), kb(t))


@query("r2_cosine_top_k", f"{COSINE_SQL} SELECT * FROM h")
def r2(t: Tables) -> DataFrame:
    return hits(t)


@query("r3_context", f"""{COSINE_SQL}, f AS (SELECT * FROM h WHERE tier = 1 AND score >= 0.5), n AS (SELECT qid FROM f GROUP BY qid HAVING count(*) >= 3),
    b AS (SELECT * FROM f UNION ALL SELECT * FROM h WHERE tier = 2 AND qid NOT IN (SELECT qid FROM n)),
    c AS (SELECT qid, id, sum(n_chars) OVER (PARTITION BY qid ORDER BY tier, score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM b JOIN documents d ON b.id = d.doc_id) SELECT qid, id FROM c WHERE run <= 3000""")
def r3(t: Tables) -> DataFrame:
    return R.context(hits(t), t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))).select("qid", "id")


@query("r6_topic_knowledge", r"""WITH d AS (SELECT doc_id, lang, source, lower(text) AS t FROM documents), s AS (SELECT b.item_id AS qid, d.doc_id AS id, 0.5 * CAST(contains(d.t, lower(split_part(b.text, ' ', 1))) AS INT) + 0.2 * CAST(contains(d.t, lower(split_part(b.text, ' ', 2))) AS INT) + 0.15 * CAST(contains(d.t, lower(split_part(b.text, ' ', 3))) AS INT) AS score FROM benchmark b, d)
    SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score > 0.1) WHERE rank <= 3""")
def r6(t: Tables) -> DataFrame:
    parts = F.split(F.lower("text"), " ")
    asked = t.benchmark.where("text is not null").select(F.col("item_id").alias("qid"), *[F.coalesce(F.get(parts, i), F.lit("")).alias(f"w{i}") for i in range(3)])
    docs = t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    return R.held_words(asked, docs, (0.5, 0.2, 0.15), 0.1, 3).select("qid", "id", "score", "rank")


@query("r7_keyword_scan", f"{LEXICAL_SQL} SELECT qid, id, score FROM k WHERE rank <= 3")
def r7(t: Tables) -> DataFrame:
    return lexical(t, 3).select("qid", "id", "score")


@query("r8_blend", f"""{COSINE_SQL}, b AS (SELECT vec_id AS qid, vec_id + 1000000 AS id, 2.0::DOUBLE AS score FROM embeddings WHERE vec_id % 20 = 0 AND label < 5 UNION ALL SELECT qid, id, score FROM h WHERE score > 0.15)
    SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 5""")
def r8(t: Tables) -> DataFrame:
    known = t.embeddings.where("vec_id % 20 = 0 and label < 5").select(F.col("vec_id").alias("qid"), (F.col("vec_id") + 1000000).alias("id"))
    return R.blend(known, hits(t))
