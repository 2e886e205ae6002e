"""Aggregations (A) over the tables; events and orders stand for topic mentions, reviews and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.operators import aggregates as A
from lektura.plans.registry import query
from lektura.session import Tables


@query("a1_most_common", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 20")
def a1(t: Tables) -> DataFrame:
    return A.most_common(t.events, ["event_type", "user_id"], 20)


def mentions(t: Tables) -> DataFrame:
    """Orders as mentions of topics: a priority by a customer group, in its year moved to the weighted ones."""
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate") + 24).cast("int")
    return t.orders.select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("topic"), year.alias("year"), F.col("o_orderstatus").alias("domain"), "o_orderkey")


MENTIONS_SQL = "m AS (SELECT o_orderpriority || '/' || CAST(o_custkey % 40 AS VARCHAR) AS topic, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) + 24 END AS year, o_orderstatus AS domain, o_orderkey FROM orders)"
WEIGHTS_SQL = "w(year, weight) AS (VALUES (2025, 1.0::DOUBLE), (2024, 0.55), (2023, 0.30), (2022, 0.17), (2021, 0.10), (2020, 0.06))"
SCORES_SQL = f"WITH {MENTIONS_SQL}, {WEIGHTS_SQL}, s AS (SELECT topic, round(sum(coalesce(weight, 0)), 6) AS score, count(*) AS mentions, count(m.year) AS dated, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM m LEFT JOIN w ON m.year = w.year GROUP BY topic)"


@query("a2_recency_scores", f"{SCORES_SQL} SELECT * FROM s")
def a2(t: Tables) -> DataFrame:
    return A.recency_scores(mentions(t)).withColumn("domains", F.array_join("domains", ","))


@query("a3_year_pivot", f"WITH {MENTIONS_SQL} SELECT topic, " + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS y{y}" for y in range(2020, 2026)) + " FROM m GROUP BY topic")
def a3(t: Tables) -> DataFrame:
    return A.year_pivot(mentions(t), range(2020, 2026))


GAP_SQL = f"""WITH {MENTIONS_SQL}, {WEIGHTS_SQL}, a AS (SELECT topic, round(sum(coalesce(weight, 0)), 6) AS asked FROM m LEFT JOIN w ON m.year = w.year WHERE domain = 'O' GROUP BY topic),
    c AS (SELECT topic, round(sum(coalesce(weight, 0)), 6) AS covered FROM m LEFT JOIN w ON m.year = w.year WHERE domain = 'F' GROUP BY topic),
    g AS (SELECT topic, asked, coalesce(covered, 0) AS covered, round(asked - coalesce(covered, 0), 6) AS gap FROM a LEFT JOIN c USING (topic) WHERE asked > 0),
    p AS (SELECT *, CASE WHEN gap > asked / 2 THEN 'HIGH' WHEN gap > 0 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM g)"""


def gaps(t: Tables) -> DataFrame:
    m = mentions(t)
    return A.gap_priority(A.recency_scores(m.where("domain = 'O'")), A.recency_scores(m.where("domain = 'F'")))


@query("a4_gap_priority", f"{GAP_SQL} SELECT * FROM p")
def a4(t: Tables) -> DataFrame:
    return gaps(t)


@query("a5_trend", """WITH a AS (SELECT event_type, count(*) AS a FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT event_type, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(b, 0) - coalesce(a, 0) AS delta, round((coalesce(b, 0) + 1) / (coalesce(a, 0) + 1), 6) AS ratio FROM a FULL JOIN b USING (event_type)""")
def a5(t: Tables) -> DataFrame:
    middle = F.lit("2024-01-15").cast("timestamp")
    return A.trend(t.events.where(F.col("ts") < middle), t.events.where(F.col("ts") >= middle), "event_type")


@query("a6_top_per_facet", """WITH c AS (SELECT event_type AS facet, CAST(user_id AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, CAST(user_id % 20 AS VARCHAR), count(*) FROM events WHERE value > 10 GROUP BY 1, 2),
    s AS (SELECT facet, k, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, k) AS rank FROM s) WHERE rank <= 10""")
def a6(t: Tables) -> DataFrame:
    counts = lambda rows, k: rows.groupBy(F.col("event_type").alias("facet"), k.cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return A.top_per_facet([counts(t.events, F.col("user_id")), counts(t.events.where("value > 10"), F.col("user_id") % 20)], "facet", "k", 10)


@query("a7_matrix", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    return A.matrix(t.orders, "o_orderpriority", "o_orderstatus", ("F", "O", "P"))


@query("a8_quality_counters", r"""WITH r AS (SELECT source, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty' WHEN regexp_matches(text, '[0-9]{6}') AND NOT regexp_matches(text, 'License') THEN 'server_error' WHEN length(trim(text, ' ')) < 100 THEN 'short' ELSE 'fine' END AS r FROM documents)
    SELECT source, count(*) AS rows, count(*) FILTER (WHERE r = 'empty') AS empty, count(*) FILTER (WHERE r = 'server_error') AS server_error, count(*) FILTER (WHERE r = 'short') AS short, count(*) FILTER (WHERE r = 'fine') AS fine FROM r GROUP BY ROLLUP (source)""")
def a8(t: Tables) -> DataFrame:
    return A.quality_counters(t.documents, "source", F.col("text"), "[0-9]{6}", "License", 100)


@query("a9_inventory", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS answered FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def a9(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("answered"))


@query("a10_question_index", """SELECT lower(text) AS key, arg_min(text, doc_id) AS display, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS occurrences FROM documents GROUP BY 1""")
def a10(t: Tables) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return t.documents.groupBy(F.lower("text").alias("key")).agg(F.min_by("text", "doc_id").alias("display"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.array_join(ids, ",").alias("occurrences"))


@query("a11_merged_contexts", """WITH e AS (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS p, CAST(o_totalprice AS VARCHAR) AS excerpt FROM orders)
    SELECT o_custkey, arg_min(status, o_orderkey) FILTER (WHERE status IS NOT NULL) AS status, arg_max(o_orderpriority_, o) AS longest, n FROM (SELECT *, p AS o_orderpriority_, (length(p), -o_orderkey) AS o, count(DISTINCT p) OVER (PARTITION BY o_custkey) AS n FROM e) GROUP BY o_custkey, n""")
def a11(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.array("o_orderpriority").alias("items"), F.col("o_orderpriority").alias("longest"))
    return A.merged_contexts(rows, "o_custkey", "o_orderkey", ["status"], ["items"], "longest").select("o_custkey", "status", "longest", F.size("items").cast("long").alias("n"))


@query("a12_inverted_index", r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{2,}'))) AS token FROM documents) SELECT token, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w GROUP BY token")
def a12(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.explode(X.words(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("a13_kb_counts", "SELECT source, lang, count(DISTINCT md5(text)) AS n FROM documents GROUP BY GROUPING SETS ((), (source), (lang))")
def a13(t: Tables) -> DataFrame:
    return t.documents.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.countDistinct(F.md5("text")).alias("n"))


@query("a14_validation_rates", """SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS valid, round(100.0 * count(*) FILTER (WHERE toxic = 0) / count(*), 1) AS valid_pct,
    count(*) FILTER (WHERE quality = 0) AS quarantine, round(100.0 * count(*) FILTER (WHERE quality = 0) / count(*), 1) AS quarantine_pct FROM labels""")
def a14(t: Tables) -> DataFrame:
    return A.rates(t.labels, valid=F.col("toxic") == 0, quarantine=F.col("quality") == 0)


@query("a15_card_statistics", """WITH c AS (SELECT user_id, count(*) AS reps, avg(event_id % 6) AS ef, max(ts) AS last FROM events GROUP BY 1)
    SELECT count(*) AS cards, count(*) FILTER (WHERE reps >= 5 AND ef > 2) AS mastered, count(*) FILTER (WHERE reps < 5) AS learning, count(*) FILTER (WHERE last < TIMESTAMP '2024-01-30') AS due, round(avg(ef), 6) AS mean_ef FROM c""")
def a15(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("reps"), F.avg(F.col("event_id") % 6).alias("ef"), F.max("ts").alias("last"))
    due = F.col("last") < F.lit("2024-01-30").cast("timestamp")
    return c.agg(F.count(F.lit(1)).alias("cards"), F.count(F.when((F.col("reps") >= 5) & (F.col("ef") > 2), 1)).alias("mastered"), F.count(F.when(F.col("reps") < 5, 1)).alias("learning"), F.count(F.when(due, 1)).alias("due"), F.round(F.avg("ef"), 6).alias("mean_ef"))


@query("a16_due_forecast", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS due FROM events WHERE event_type = 'click' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-02-07', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT CAST(s.day AS VARCHAR) AS day, coalesce(due, 0) AS due FROM s LEFT JOIN d ON s.day = d.day""")
def a16(t: Tables) -> DataFrame:
    return A.due_forecast(t.events.where("event_type = 'click'"), F.col("ts"), "2024-01-25", 14).withColumn("day", F.col("day").cast("string"))


@query("a17_usage_totals", """SELECT event_type AS provider, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id % 500) AS BIGINT) AS output_tokens,
    round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE user_id / 1000 * 0.5 + event_id % 500 / 1000 * 1.5 END), 4) AS cost FROM events GROUP BY ROLLUP (event_type)""")
def a17(t: Tables) -> DataFrame:
    usage = t.events.select(F.col("event_type").alias("provider"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 500).alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("cost"))
    return A.usage_totals(usage, 0.5, 1.5)


@query("a18_rollup_names", "SELECT s_nationkey, count(*) AS exports, string_agg(DISTINCT substr(s_name, 1, 12), ',' ORDER BY substr(s_name, 1, 12)) AS names FROM supplier GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("exports"), F.array_join(F.sort_array(F.collect_set(F.substring("s_name", 1, 12))), ",").alias("names"))


@query("a19_tag_depth", "WITH g AS (SELECT string_split(p_brand || '::' || p_type || CASE WHEN p_size > 25 THEN '::big' ELSE '' END, '::') AS g FROM part) SELECT g[1] AS root, len(g) AS depth, count(*) AS n FROM g GROUP BY 1, 2")
def a19(t: Tables) -> DataFrame:
    parts = F.split(F.concat("p_brand", F.lit("::"), "p_type", F.when(F.col("p_size") > 25, F.lit("::big")).otherwise(F.lit(""))), "::")
    return t.part.select(parts.alias("g")).groupBy(F.col("g")[0].alias("root"), F.size("g").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("a20_tag_totals", "WITH g AS (SELECT p_partkey, unnest([p_brand, p_type]) AS tag FROM part) SELECT count(*) AS tags, count(DISTINCT p_partkey) AS notes, count(DISTINCT tag) AS different FROM g")
def a20(t: Tables) -> DataFrame:
    g = t.part.select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("tag"))
    return g.agg(F.count(F.lit(1)).alias("tags"), F.countDistinct("p_partkey").alias("notes"), F.countDistinct("tag").alias("different"))


BUCKET_SQL = r"CASE WHEN regexp_matches(url, 'blog') THEN 'blog' WHEN regexp_matches(url, 'www') THEN 'web' WHEN regexp_matches(url, '//m\.') THEN 'mobile' ELSE 'other' END"


@query("a21_first_match_buckets", rf"SELECT {BUCKET_SQL} AS bucket, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'high' WHEN count(*) >= 30 THEN 'medium' ELSE 'low' END AS priority FROM pages GROUP BY 1")
def a21(t: Tables) -> DataFrame:
    from lektura.functions.rules import first_match

    counts = t.pages.groupBy(first_match(F.col("url"), (("blog", "blog"), ("www", "web"), (r"//m\.", "mobile")), "other").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("priority", F.when(F.col("n") >= 60, "high").when(F.col("n") >= 30, "medium").otherwise("low"))


@query("a22_batch_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars >= 200) AS success, round(count(*) FILTER (WHERE n_chars >= 200) / count(*), 6) AS rate, round(avg(n_chars) FILTER (WHERE n_chars >= 200), 6) AS mean_score FROM documents")
def a22(t: Tables) -> DataFrame:
    ok = F.when(F.col("n_chars") >= 200, F.col("n_chars"))
    return t.documents.agg(F.count(F.lit(1)).alias("total"), F.count(ok).alias("success"), F.round(F.count(ok) / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg(ok), 6).alias("mean_score"))


@query("a23_queue_counts", "SELECT source AS tag, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'flag:' || f, count(*) FROM (SELECT unnest([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN contains(text, 'License') THEN 'license' END]) AS f FROM documents) WHERE f IS NOT NULL GROUP BY 1")
def a23(t: Tables) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, F.lit("flag:long")), F.when(F.contains("text", F.lit("License")), F.lit("flag:license"))))
    return t.documents.select(F.explode(F.array_append(flags, F.col("source"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("a24_theme_society", """WITH k(word, society) AS (VALUES ('ther', 's1'), ('tion', 's1'), ('tion', 's2'), ('reau', 's3')), n AS (SELECT word, count(*) AS c FROM k GROUP BY word),
    s AS (SELECT doc_id, society, sum(0.5 / n.c) AS score FROM documents JOIN k ON contains(lower(text), k.word) JOIN n ON k.word = n.word GROUP BY 1, 2) SELECT doc_id, society, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS score FROM s""")
def a24(t: Tables) -> DataFrame:
    k = t.spark.createDataFrame([("ther", "s1"), ("tion", "s1"), ("tion", "s2"), ("reau", "s3")], "word string, society string")
    share = k.join(k.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "word")
    hits = t.documents.join(F.broadcast(share), F.contains(F.lower("text"), F.col("word"))).groupBy("doc_id", "society").agg(F.sum(0.5 / F.col("c")).alias("score"))
    return hits.select("doc_id", "society", F.round(F.col("score") / F.max("score").over(Window.partitionBy("doc_id")), 6).alias("score"))


@query("a25_priority_lists", f"{GAP_SQL} SELECT priority, count(*) AS n, string_agg(topic, ',' ORDER BY gap DESC, topic) AS topics FROM p GROUP BY 1")
def a25(t: Tables) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("gap")).alias("g"), "topic"))), lambda x: x["topic"])
    return gaps(t).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, ",").alias("topics"))


@query("a26_filter_report", """WITH m AS (SELECT p_partkey, p_type AS tag, p_size / 50.0 AS confidence FROM part WHERE p_size >= 10), top AS (SELECT 'top' AS part, tag || '/' || CAST(p_partkey AS VARCHAR) AS name, round(confidence, 6) AS value FROM m ORDER BY confidence DESC, p_partkey LIMIT 50)
    SELECT * FROM top UNION ALL SELECT 'category', tag, CAST(count(*) AS DOUBLE) FROM m GROUP BY tag UNION ALL SELECT 'before', '', CAST(count(*) AS DOUBLE) FROM part UNION ALL SELECT 'after', '', CAST(count(*) AS DOUBLE) FROM m""")
def a26(t: Tables) -> DataFrame:
    m = t.part.where("p_size >= 10").select("p_partkey", F.col("p_type").alias("tag"), (F.col("p_size") / 50).alias("confidence"))
    top = m.orderBy(F.desc("confidence"), "p_partkey").limit(50).select(F.lit("top").alias("part"), F.concat("tag", F.lit("/"), F.col("p_partkey").cast("string")).alias("name"), F.round("confidence", 6).alias("value"))
    total = lambda rows, part: rows.agg(F.lit(part).alias("part"), F.lit("").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    by = m.groupBy(F.lit("category").alias("part"), F.col("tag").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return top.union(by).union(total(t.part, "before")).union(total(m, "after"))


@query("a28_repair_counters", "SELECT o_orderpriority AS priority, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'P') AS missing_before, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice < 100000) AS missing_after FROM orders GROUP BY ROLLUP (o_orderpriority)")
def a28(t: Tables) -> DataFrame:
    missing = F.col("o_orderstatus") == "P"
    return t.orders.rollup(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(missing, 1)).alias("missing_before"), F.count(F.when(missing & (F.col("o_totalprice") < 100000), 1)).alias("missing_after"))
