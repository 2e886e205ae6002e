"""The queries opN_<name>, their SQL, and the pipeline's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektura.llm.chat import chat_digests
from lektura.llm.common import cut, shared_dir, table
from lektura.llm.exact_dedup import exact_dedup
from lektura.llm.filter_audit import filter_audit
from lektura.llm.hard_negatives import hard_negatives
from lektura.llm.langid import language_id
from lektura.llm.line_dedup import ENTITIES, HTML_STEPS, host_of, html_lines, line_dedup
from lektura.llm.mixing import mix_sources
from lektura.llm.packing import pack
from lektura.llm.passages import near_dup_passages
from lektura.llm.simhash import simhash_near_dups
from lektura.llm.token_rollup import documents_rollup
from lektura.llm.toxicity import toxicity
from lektura.llm.vptree import nearest


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = cut(table(spark, sf_dir, "pages").select("page_id", "url", html_lines(F.col("html")).alias("html")))  # read twice
    found = line_dedup(pages, host_of(F.col("url")), F.col("html"))
    names = {"_host": "host", "_host_pages": "host_pages", "_lines": "lines", "_dropped": "dropped", "_kept": "text"}
    return found.select("page_id", *[F.col(c).alias(n) for c, n in names.items()])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dups(table(spark, sf_dir, "documents"))


def op5_near_dup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_passages(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_rollup(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_vptree_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: A conversation whose texts hold what marks turns in templates.
MARKED = r"\### Assistant: </turn> ok"


def op11_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return chat_digests(said.unionByName(more))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_toxicity, op3_line_dedup, op4_simhash_near_dedup, op5_near_dup_passages, op6_mix_sources, op7_token_rollup, op8_pack, op9_language_id, op10_vptree_nearest, op11_format_chats, op12_hard_negatives, op13_filter_audit)
}


def _html_sql(column: str) -> str:
    for pattern, by in HTML_STEPS:
        column = "regexp_replace({}, '{}', {}, 'g')".format(column, pattern, "chr(10)" if by == "\n" else f"'{by}'")
    for entity, char in ENTITIES:
        column = "replace({}, '{}', '{}')".format(column, entity, char.replace("'", "''"))
    return column


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n""",
    "op3_line_dedup": rf"""
        WITH pages_ AS (
            SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
                   string_split({_html_sql("html")}, chr(10)) AS parts, row_number() OVER () AS r
            FROM pages),
        lines AS (SELECT r, host, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
                  FROM (SELECT r, host, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM pages_)),
        totals AS (SELECT host, count(*) AS host_pages FROM pages_ GROUP BY host),
        common AS (SELECT l.host, l.k FROM lines l JOIN totals t ON l.host = t.host WHERE l.k <> ''
                   GROUP BY l.host, l.k, t.host_pages HAVING count(DISTINCT r) >= 3 AND count(DISTINCT r) > 0.1 * t.host_pages),
        marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host = c.host AND l.k = c.k),
        per AS (SELECT r, count(*) FILTER (WHERE k <> '') AS filled, count(*) FILTER (WHERE gone) AS gone,
                       string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest
                FROM marked GROUP BY r)
        SELECT p.page_id, p.host, t.host_pages, CAST(coalesce(x.filled, 0) AS INTEGER) AS lines,
               CAST(coalesce(x.gone, 0) AS INTEGER) AS dropped, CASE WHEN x.r IS NOT NULL THEN coalesce(x.rest, '') END AS text
        FROM pages_ p JOIN totals t ON p.host = t.host LEFT JOIN per x ON p.r = x.r""",
    "op11_format_chats": rf"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, turn, role, '{MARKED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)turn:', '<\\\1turn:', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g') AS body,
                     lag(role) OVER w AS before, row_number() OVER w - 1 AS n, lead(role) OVER w IS NULL AS last
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        m AS (SELECT *, CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN coalesce(before, 'system') IN ('system', 'assistant')
                               WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END AS fits FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn:') + length(role) + length(body) + length('>') + length('</turn>') + 2)::BIGINT AS formatted_chars,
               bool_and(fits) AND bool_or(last AND role = 'assistant') AS valid, min(n) FILTER (WHERE NOT fits)::INT AS broken_at
        FROM m GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT * FROM n WHERE rank <= 5""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
                     + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS fails FROM w),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS v),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS vs FROM x a, x b, x c, x d, x e WHERE a.v + b.v + c.v + d.v + e.v = 31 AND (a.v | b.v | c.v | d.v | e.v) = 31),
        s AS (SELECT filter_order, i AS step, vs[i] AS own, coalesce(list_sum(vs[1:i - 1]), 0)::INT AS before FROM o, unnest([1, 2, 3, 4, 5]) AS t(i)),
        r AS (SELECT part, filter_order, step, own, n, good, toxic, fails, (fails & own) <> 0 AS here, (fails & before) <> 0 AS earlier FROM c, s),
        t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT here AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT earlier), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (WHERE here AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(n) FILTER (WHERE here AND NOT earlier AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE here AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
              FROM r GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t""",
}
