"""Windows, ranking, sampling and set operations (W, O) over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.functions.rules import confidence
from lektura.operators import aggregates as A
from lektura.operators import joins as J
from lektura.operators import ranking as R
from lektura.plans.aggregates import SCORES_SQL, mentions
from lektura.plans.projections import WORDS_SQL
from lektura.plans.registry import query
from lektura.session import Tables


@query("w1_percentile_classes", f"{SCORES_SQL}, r AS (SELECT topic, score, row_number() OVER (ORDER BY score DESC, topic) AS rank, count(*) OVER () AS n FROM s) SELECT topic, score, rank, CASE WHEN rank <= greatest(1, ceil(n * 0.15)) THEN 'HIGH' WHEN rank <= greatest(greatest(1, ceil(n * 0.15)) + 1, ceil(n * 0.5)) THEN 'MEDIUM' ELSE 'LOW' END AS class FROM r")
def w1(t: Tables) -> DataFrame:
    return R.percentile_classes(A.recency_scores(mentions(t)).select("topic", "score"), [F.desc("score"), F.col("topic")])


@query("w2_first_by_hash", "SELECT doc_id, source, h FROM (SELECT doc_id, source, md5(lower(text)) AS h, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def w2(t: Tables) -> DataFrame:
    return J.first_per_key(t.documents.select("doc_id", "source", F.md5(F.lower("text")).alias("h")), ["h"], F.col("source"), F.col("doc_id"))


@query("w3_newest_versions", """WITH e AS (SELECT user_id, event_type, event_id, ts, max(ts) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT * REPLACE (date_trunc('day', ts) AS ts) FROM events))
    SELECT user_id, event_type, arg_min(event_id, (-epoch_us(ts), event_id)) AS event_id, max(ts) AS ts, count(*) FILTER (WHERE ts > best) AS replaced, count(*) - 1 AS collisions FROM e GROUP BY 1, 2""")
def w3(t: Tables) -> DataFrame:
    return R.newest_versions(t.events.withColumn("ts", F.date_trunc("day", "ts")), ["user_id", "event_type"], "ts", "event_id")


@query("w4_newest_by_title", """SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) AS n FROM (SELECT doc_id, CASE WHEN n_chars < 100 THEN '__no_title__::' || sha1(text) ELSE lower(split_part(text, chr(10), 1)) END AS k FROM documents)) WHERE n = 1""")
def w4(t: Tables) -> DataFrame:
    key = F.when(F.col("n_chars") < 100, F.concat(F.lit("__no_title__::"), F.sha1("text"))).otherwise(F.lower(F.split("text", "\n")[0]))
    return J.first_per_key(t.documents.select("doc_id", key.alias("k")), ["k"], F.desc("doc_id"))


@query("w5_top_k", "SELECT l_orderkey, l_partkey, l_linenumber, rank FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS rank FROM lineitem) WHERE rank <= 3")
def w5(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return J.ranked_matches(t.lineitem, "l_orderkey", order, 3).select("l_orderkey", "l_partkey", "l_linenumber", "rank")


@query("w6_budget_prefix", """WITH r AS (SELECT source, doc_id, sum(n_chars) OVER w AS run, max(CAST(n_chars + 2 > 3000 AS INT)) OVER w AS over FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
    SELECT 'cumulative' AS mode, source, doc_id FROM r WHERE run <= 3000 UNION ALL SELECT 'per_block', source, doc_id FROM r WHERE over = 0""")
def w6(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", "n_chars")
    take = lambda mode: R.budget_prefix(d, ["source"], [F.col("doc_id")], F.col("n_chars"), 3000, mode == "per_block").select(F.lit(mode).alias("mode"), "source", "doc_id")
    return take("cumulative").union(take("per_block"))


@query("w7_representative", "SELECT source, lang, doc_id FROM (SELECT d.source, d.lang, d.doc_id, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY coalesce(l.toxic, 2), coalesce(l.quality, -1) DESC, d.n_chars DESC, d.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n = 1")
def w7(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    order = [F.coalesce("toxic", F.lit(2)), F.coalesce("quality", F.lit(-1)).desc(), F.desc("n_chars"), F.col("doc_id")]
    return J.first_per_key(joined, ["source", "lang"], *order).select("source", "lang", "doc_id")


@query("w8_forward_fill", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 2020 + event_id % 6 END AS year FROM events), g AS (SELECT *, count(year) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, event_id, coalesce(max(year) OVER (PARTITION BY user_id, g), 1999) AS filled FROM g""")
def w8(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 6 + 2020).alias("year"))
    return R.forward_filled(e, ["user_id"], "event_id", "year", F.lit(1999)).select("user_id", "event_id", "filled")


@query("w10_line_context", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    c AS (SELECT doc_id, pos, line, string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS context FROM l) SELECT doc_id, pos, context FROM c WHERE contains(line, 'License')""")
def w10(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    near = Window.partitionBy("doc_id").orderBy("p").rowsBetween(-2, 3)
    context = F.array_join(F.collect_list("line").over(near), "|")
    return lines.withColumn("context", context).where(F.contains("line", F.lit("License"))).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "context")


@query("w11_queue_rank", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, coalesce(toxic, 0) DESC, n_chars DESC, d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def w11(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    first = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).otherwise(2)
    order = [first, F.coalesce("toxic", F.lit(0)).desc(), F.desc("n_chars"), F.col("doc_id")]
    return R.ranked(joined, ["source"], order, "place").select("doc_id", "source", "place")


@query("w12_block_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END DESC NULLS LAST, o_orderpriority, o_orderkey) AS place FROM orders")
def w12(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(year.desc_nulls_last(), "o_orderpriority", "o_orderkey")).alias("place"))


@query("w13_ids", "SELECT doc_id, source || printf('_card_%06d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS card_id FROM documents")
def w13(t: Tables) -> DataFrame:
    numbered = R.ranked(t.documents.select("source", "doc_id"), ["source"], [F.col("doc_id")], "n")
    return numbered.select("doc_id", F.concat("source", F.format_string("_card_%06d", "n")).alias("card_id"))


@query("w14_exhausted", "WITH r AS (SELECT event_type, event_id, value, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT event_type, round(sum(value), 6) AS spent, min(event_id) FILTER (WHERE run >= 5000) AS exhausted_at FROM r GROUP BY 1")
def w14(t: Tables) -> DataFrame:
    return R.first_exhausted(t.events, "event_type", ["ts", "event_id"], "value", 5000)


@query("w15_confidence", """WITH s AS (SELECT user_id, event_type, count(*) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
    SELECT user_id, event_type, round(CASE WHEN second IS NULL THEN 1 ELSE least(1, (score - second) / score + least(score / 20, 0.3::DOUBLE)) END, 6) AS confidence FROM r WHERE n = 1""")
def w15(t: Tables) -> DataFrame:
    scores = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    ranked = scores.withColumns({"n": F.row_number().over(order), "second": F.lead("score").over(order)}).where("n = 1")
    return ranked.select("user_id", "event_type", F.round(confidence(F.col("score"), F.col("second")), 6).alias("confidence"))


@query("w16_running_mean", "SELECT event_id, round(avg(event_id % 6) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS mean FROM events")
def w16(t: Tables) -> DataFrame:
    window = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.round(F.avg(F.col("event_id") % 6).over(window), 6).alias("mean"))


@query("w17_review_queue", "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 200000")
def w17(t: Tables) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    queue = t.orders.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 200000))
    return R.ranked(queue, ["o_orderstatus"], [rank, F.col("o_orderkey")], "place").select("o_orderkey", "o_orderstatus", "place")


@query("o1_due_cards", "SELECT user_id, ef, reps FROM (SELECT user_id, avg(event_id % 6) AS ef, count(*) AS reps, max(ts) AS last FROM events GROUP BY 1) WHERE last < TIMESTAMP '2024-01-31' ORDER BY ef, reps, user_id LIMIT 20")
def o1(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id").agg(F.avg(F.col("event_id") % 6).alias("ef"), F.count(F.lit(1)).alias("reps"), F.max("ts").alias("last"))
    return c.where(F.col("last") < F.lit("2024-01-31").cast("timestamp")).orderBy("ef", "reps", "user_id").limit(20).select("user_id", "ef", "reps")


@query("o2_random_order", "SELECT c_custkey FROM customer ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def o2(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy(R.seeded_order(F.col("c_custkey")), "c_custkey").limit(50)


@query("o3_stratified", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents), s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source) AS place, count(*) OVER () AS groups FROM documents GROUP BY source),
    q AS (SELECT source, CASE WHEN groups >= 90 THEN CAST(place <= 90 AS INT) ELSE 90 // groups + CAST(place <= 90 % groups AS INT) END AS quota FROM s)
    SELECT doc_id, r.source FROM r JOIN q ON r.source = q.source ORDER BY CASE WHEN r <= quota THEN 0 ELSE 1 END, CASE WHEN r <= quota THEN NULL ELSE md5('7:' || CAST(doc_id AS VARCHAR)) END, doc_id LIMIT 90""")
def o3(t: Tables) -> DataFrame:
    return R.stratified_sample(t.documents.select("doc_id", "source"), "source", "doc_id", 90)


@query("o4_flagged_fill", """WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), n AS (SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM f)), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f))
    SELECT doc_id, true AS flagged FROM documents WHERE doc_id IN (SELECT doc_id FROM f) UNION ALL SELECT doc_id, false FROM r, n WHERE r <= greatest(100000 - n, 0)""")
def o4(t: Tables) -> DataFrame:
    return R.flagged_and_filled(t.documents.select("doc_id"), t.labels.where("quality = 0"), "doc_id", 100_000)


@query("o5_union", "SELECT doc_id AS id, text, source, NULL AS url FROM documents UNION ALL SELECT page_id, html, NULL, url FROM pages")
def o5(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), "text", "source")
    return d.unionByName(t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url"), allowMissingColumns=True)


@query("o6_token_overlap", f"WITH c AS (SELECT conv_id, turn, {WORDS_SQL.format('text')} AS w FROM conversations) SELECT q.conv_id, q.turn, round(len(list_intersect(q.w, a.w)) / greatest(len(q.w), 1), 6) AS share FROM c q JOIN c a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1")
def o6(t: Tables) -> DataFrame:
    """How much of a turn's words the next turn takes up."""
    said = t.conversations.select("conv_id", "turn", X.words(F.col("text")).alias("a"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return said.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1)), 6).alias("share"))


@query("o7_key_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def o7(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("o8_distinct_triples", "SELECT DISTINCT lower(text) AS text, source, lang FROM documents")
def o8(t: Tables) -> DataFrame:
    return t.documents.select(F.lower("text").alias("text"), "source", "lang").dropDuplicates(["text", "source", "lang"])
