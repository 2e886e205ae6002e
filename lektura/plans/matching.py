"""Fuzzy matches, tag and topic matches, and composed record queries (J, K, V, R, X)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.functions.rules import any_match, first_match
from lektura.operators import extract as E
from lektura.operators import joins as J
from lektura.operators import similarity as S
from lektura.operators import validate as V
from lektura.operators.facts import checked
from lektura.operators.filters import followup_reason
from lektura.plans.checks import DOSE_ISSUES_SQL, DOSES_SQL, DRUGS, doses
from lektura.plans.projections import FOLLOW_SQL, TURN_SQL, WORDS_SQL, turns
from lektura.plans.registry import query
from lektura.session import Tables, cut


@query("j11_three_tiers")  # the ratio is no SQL function; tests hold it against all pairs
def j11(t: Tables) -> DataFrame:
    """Exact key, plain key, then the best ratio of .92 or more."""
    keys = [X.question_key(F.col("text")).alias("k"), X.question_key(F.col("text"), True).alias("p")]
    asked = cut(t.benchmark.select(F.col("item_id").alias("qid"), *keys))
    longest = asked.agg(F.max(F.greatest(F.length("k"), F.length("p")))).first()[0] or 0
    # A text whose keys are longer than any that some ratio allows is left at the scan; the others' keys are made once.
    within = X.question_key_within(F.col("text"), math.floor(longest * (2 - 0.92) / 0.92 + 1e-6))
    held = cut(t.documents.where(within).select(F.col("doc_id").alias("bid"), *keys))
    by_key = held.groupBy("k").agg(F.min("bid").alias("b1"))
    plain = asked.join(by_key, "k", "left").join(held.groupBy("p").agg(F.min("bid").alias("b2")), "p", "left")
    rest = plain.where("b1 is null and b2 is null").select(F.col("qid").alias("lid"), F.col("k").alias("ltext"), F.lit(0.92).alias("least"))
    near = S.similar_pairs(rest, by_key.select(F.col("k").alias("rtext")), 0.92).join(by_key.select(F.col("k").alias("rtext"), F.col("b1").alias("bid")), "rtext")
    best = near.groupBy(F.col("lid").alias("qid")).agg(F.min_by("bid", F.struct(-F.col("score"), "bid")).alias("b3"))
    found = plain.join(best, "qid", "left")
    method = F.when(F.col("b1").isNotNull(), "exact").when(F.col("b2").isNotNull(), "plain").when(F.col("b3").isNotNull(), "fuzzy").otherwise("none")
    return found.select("qid", F.coalesce("b1", "b2", "b3").alias("bid"), method.alias("method"))


@query("j13_substring_or_ratio")  # the ratio is no SQL function; tests hold it against all pairs
def j13(t: Tables) -> DataFrame:
    """Different first lines: each with the best other one of a smaller id, by containment either way, else by ratio."""
    first = t.documents.select("doc_id", X.ws_lower(F.split("text", "\n")[0]).alias("x")).where(F.length("x") >= 20).groupBy("x").agg(F.min("doc_id").alias("id"))
    within = S.contained_pairs(first.select(F.col("id").alias("sid"), F.col("x").alias("stext")), first.select(F.col("id").alias("lid"), F.col("x").alias("ltext"))).where("sid <> lid")
    within = within.select(F.greatest("sid", "lid").alias("qid"), F.least("sid", "lid").alias("bid"), F.lit(1.0).alias("score"))
    near = S.similar_pairs(first.select(F.col("id").alias("lid"), F.col("x").alias("ltext"), F.lit(0.75).alias("least")), first.select(F.col("x").alias("rtext")), 0.75)
    near = near.join(first.select(F.col("x").alias("rtext"), F.col("id").alias("bid")), "rtext").where("bid < lid").select(F.col("lid").alias("qid"), "bid", "score")
    best = within.unionByName(near).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("n"), "bid")).alias("b"))
    return best.select("qid", "b.bid", F.round(-F.col("b.n"), 6).alias("score"))


#: The second word of a topic, and one of three that stand for it.
VARIANTS = (("brushed", "ring"), ("small", "widget"), ("red", "gear"))


@query("j15_topic_tags", f"""WITH t AS (SELECT DISTINCT lower(p_type) AS tag FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) FROM part), q AS (SELECT DISTINCT lower(p_name) AS topic FROM part),
    v(word, variant) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in VARIANTS)}), x AS (SELECT topic, topic AS said, 1.0 AS worth, 0.9 AS part FROM q UNION ALL SELECT topic, replace(topic, word, variant), 0.95, 0.85 FROM q JOIN v ON contains(topic, word)),
    s AS (SELECT topic, tag, CASE WHEN said = tag THEN worth WHEN contains(said, tag) OR contains(tag, said) THEN part ELSE 0 END AS score FROM x, t) SELECT topic, arg_max(tag, (score, tag)) AS tag, CAST(max(score) AS DOUBLE) AS score FROM s WHERE score >= 0.6 GROUP BY topic""")
def j15(t: Tables) -> DataFrame:
    """Topics with the best tag: equal 1, containing or contained .9; by a variant of a word .95 and .85; else by ratio, its
    value, from .6 on (of which the tables have none between .67 and .85)."""
    word = lambda n: F.lower(F.get(F.split("p_name", " "), F.lit(n)))
    tags = t.part.select(F.lower("p_type").alias("tag")).union(t.part.select(word(0))).union(t.part.select(word(1))).where("tag is not null").distinct()
    topics = t.part.select(F.lower("p_name").alias("topic")).distinct()
    said = topics.select("topic", F.col("topic").alias("said"), F.lit(1.0).alias("worth"), F.lit(0.9).alias("part"))
    for old, new in VARIANTS:
        said = said.unionByName(topics.where(F.contains("topic", F.lit(old))).select("topic", F.replace("topic", F.lit(old), F.lit(new)).alias("said"), F.lit(0.95).alias("worth"), F.lit(0.85).alias("part")))
    of_said, of_tag = said.select(F.col("said").alias("lid"), F.col("said").alias("ltext")).distinct(), tags.select(F.col("tag").alias("sid"), F.col("tag").alias("stext"))
    within = S.contained_pairs(of_tag, of_said).select(F.col("sid").alias("tag"), F.col("lid").alias("said"))
    around = S.contained_pairs(of_said.toDF("sid", "stext"), of_tag.toDF("lid", "ltext")).select(F.col("lid").alias("tag"), F.col("sid").alias("said"))
    hits = within.union(around).distinct().join(said, "said").withColumn("score", F.when(F.col("said") == F.col("tag"), F.col("worth")).otherwise(F.col("part")))
    return hits.groupBy("topic").agg(F.max_by("tag", F.struct("score", "tag")).alias("tag"), F.max("score").alias("score"))


@query("j16_tag_terms", """WITH t AS (SELECT DISTINCT p_brand || '::' || lower(p_type) || '::' || lower(p_name) AS tag FROM part), p AS (SELECT tag, unnest(string_split(tag, '::')) AS part FROM t), k(term, ord) AS (VALUES ('economy', 0), ('small ring', 1), ('widget', 2)),
    m AS (SELECT tag, term, ord, CASE WHEN part = term THEN 1.0 WHEN length(term) >= 5 AND contains(part, term) THEN 0.95 ELSE 0 END AS score FROM p, k) SELECT tag, arg_min(term, (-score, ord)) AS term, CAST(max(score) AS DOUBLE) AS score FROM m WHERE score >= 0.9 GROUP BY tag""")
def j16(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("economy", 0), ("small ring", 1), ("widget", 2)], "term string, ord int")
    tags = t.part.select(F.concat_ws("::", "p_brand", F.lower("p_type"), F.lower("p_name")).alias("tag")).distinct()
    parts = tags.select("tag", F.explode(X.tag_parts(F.array("tag"))).alias("part"))
    score = F.when(F.col("part") == F.col("term"), 1.0).when((F.length("term") >= 5) & F.contains("part", F.col("term")), 0.95).otherwise(0.0)
    hits = parts.crossJoin(F.broadcast(terms)).withColumn("score", score).where("score >= 0.9")
    return hits.groupBy("tag").agg(F.min_by("term", F.struct(-F.col("score"), "ord")).alias("term"), F.max("score").alias("score"))


@query("j25_reference_ranges", f"{DOSE_ISSUES_SQL} SELECT name, count(*) AS n, min(value) AS least, max(value) AS most FROM j GROUP BY name")
def j25(t: Tables) -> DataFrame:
    return doses(t).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("j29_review_record", "SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'P' THEN c.c_mktsegment END AS context, x.n AS lines, CASE WHEN o.o_totalprice > 300000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS complexity FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) x ON o.o_orderkey = x.l_orderkey")
def j29(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    joined = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left").join(lines, "o_orderkey", "left")
    price = F.col("o_totalprice")
    return joined.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("c_mktsegment")).alias("context"), "lines", F.when(price > 300000, "high").when(price > 100000, "medium").otherwise("low").alias("complexity"))


@query("j30_backfill", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN coalesce(nullif(o_orderstatus, 'P'), f.s) ELSE nullif(o_orderstatus, 'P') END AS status FROM orders o LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) f ON o.o_custkey = f.o_custkey")
def j30(t: Tables) -> DataFrame:
    own = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    known = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("s")).withColumnRenamed("o_orderkey", "k")
    joined = J.lookup(t.orders, known, "o_custkey", F.col("k"), "s")
    return joined.select("o_orderkey", F.when(F.col("o_totalprice") > 50000, F.coalesce(own, F.col("s"))).otherwise(own).alias("status"))


@query("k6_theme_guidelines", """WITH k(word, society) AS (VALUES ('ther', 's1'), ('tion', 's2'), ('reau', 's3')), g(society, guideline) AS (VALUES ('s1', 'g1'), ('s1', 'g2'), ('s2', 'g3'), ('s3', 'g4')), m AS (SELECT doc_id, word, society, row_number() OVER (PARTITION BY doc_id ORDER BY word) AS n FROM documents, k WHERE contains(lower(text), word))
    SELECT DISTINCT doc_id, guideline FROM m JOIN g USING (society) WHERE n <= 2""")
def k6(t: Tables) -> DataFrame:
    k = t.spark.createDataFrame([("ther", "s1"), ("tion", "s2"), ("reau", "s3")], "word string, society string")
    g = t.spark.createDataFrame([("s1", "g1"), ("s1", "g2"), ("s2", "g3"), ("s3", "g4")], "society string, guideline string")
    hits = t.documents.join(F.broadcast(k), F.contains(F.lower("text"), F.col("word"))).select("doc_id", "word", "society")
    return J.ranked_matches(hits, "doc_id", [F.col("word")], 2).join(F.broadcast(g), "society").select("doc_id", "guideline").distinct()


@query("k12_question_kind", rf"WITH q AS ({TURN_SQL}) SELECT conv_id, turn, CASE WHEN regexp_matches(lower(frage), '^(?:the|der|le|el) ') THEN 'definition' WHEN regexp_matches(frage, '\?') THEN 'open' ELSE 'statement' END AS kind FROM q")
def k12(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", first_match(F.col("frage"), (("(?i)^(?:the|der|le|el) ", "definition"), (r"\?", "open")), "statement").alias("kind"))


@query("k15_context_tags", rf"WITH q AS ({TURN_SQL}), f AS (SELECT conv_id, turn, {FOLLOW_SQL} IS NOT NULL AS f FROM q), c AS (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'user') SELECT CASE WHEN NOT f THEN 'none' WHEN c.conv_id IS NULL THEN 'context_not_found' ELSE 'context_found' END AS tag, count(*) AS n FROM f LEFT JOIN c ON f.conv_id = c.conv_id GROUP BY 1")
def k15(t: Tables) -> DataFrame:
    reason = followup_reason(F.col("frage"), conjunctions=("and", "et", "und", "y"), pronouns=("this", "das", "esta", "cette"))
    said = t.conversations.where("role <> 'user'").select("conv_id").distinct().withColumn("c", F.lit(True))
    tagged = turns(t).withColumn("f", reason.isNotNull()).join(said, "conv_id", "left")
    tag = F.when(~F.col("f"), "none").when(F.col("c").isNull(), "context_not_found").otherwise("context_found")
    return tagged.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("k19_issue_hint", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'check the source' WHEN event_type LIKE '%click%' THEN 'add context' ELSE '' END AS hint FROM events")
def k19(t: Tables) -> DataFrame:
    return t.events.select("event_id", first_match(F.col("event_type"), (("^error$", "check the source"), ("click", "add context")), "").alias("hint"))


@query("v6_implausible", r"WITH x AS (SELECT doc_id, CAST(regexp_extract(text, '(\d{3,9})', 1) AS VARCHAR) AS n, regexp_matches(text, '\[\.\.\.\]|TODO|XXX') AS placeholder FROM documents) SELECT doc_id, placeholder, n <> '' AND CAST(nullif(n, '') AS BIGINT) > 300 AS implausible FROM x")
def v6(t: Tables) -> DataFrame:
    number = F.nullif(F.regexp_extract("text", r"(\d{3,9})", 1), F.lit("")).cast("long")
    return t.documents.select("doc_id", any_match(F.col("text"), [r"\[\.\.\.\]", "TODO", "XXX"]).alias("placeholder"), F.coalesce(number > 300, F.lit(False)).alias("implausible"))


@query("v14_fact_check", rf"""WITH {DOSES_SQL}, g AS (SELECT DISTINCT lower(name) AS name, CASE WHEN l_suppkey % 5 = 0 THEN 'g' ELSE 'mg' END AS unit, value::DOUBLE AS value, l_orderkey % 3 AS part FROM d),
    rd AS (SELECT name, unit, value FROM g WHERE part = 0 AND name <> 'morphin' AND NOT (name = 'heparin' AND unit = 'g') AND value < 500),
    rn AS (SELECT DISTINCT TRY_CAST(unnest(regexp_extract_all(text || ' ' || CAST(item_id * 37 AS VARCHAR), '\d{{1,9}}')) AS DOUBLE) AS value FROM benchmark), rt AS (SELECT lower(text) AS text FROM benchmark),
    f AS (SELECT DISTINCT 'dose' AS type, name, unit, value, NULL AS text FROM g WHERE part > 0 UNION ALL SELECT DISTINCT 'number', NULL, NULL, n::DOUBLE, NULL FROM (SELECT unnest(regexp_extract_all(text, '\d{{3,9}}')) AS n FROM documents)
          UNION ALL SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'interval' END, NULL, NULL, NULL, lower(substr(text, 1, 30)) FROM documents WHERE length(text) > 0),
    c AS (SELECT *, CASE type WHEN 'dose' THEN CASE WHEN EXISTS (SELECT 1 FROM rd WHERE rd.name = f.name AND rd.unit = f.unit AND abs(rd.value - f.value) / greatest(rd.value, f.value, 1) < 0.2) THEN 0.9 WHEN EXISTS (SELECT 1 FROM rd WHERE rd.name = f.name AND rd.unit = f.unit) THEN 0.3 WHEN EXISTS (SELECT 1 FROM rd WHERE rd.name = f.name) THEN 0.6 ELSE 0.5 END
            WHEN 'number' THEN CASE WHEN EXISTS (SELECT 1 FROM rn WHERE abs(rn.value - f.value) / greatest(rn.value, f.value, 1) < 0.15) THEN 0.85 ELSE 0.4 END
            WHEN 'class' THEN CASE WHEN EXISTS (SELECT 1 FROM rt WHERE contains(rt.text, f.text)) THEN 0.95 ELSE 0.4 END ELSE CASE WHEN EXISTS (SELECT 1 FROM rt WHERE contains(rt.text, f.text)) THEN 0.75 ELSE 0.5 END END::DOUBLE AS confidence FROM f)
    SELECT type, name, unit, value, text, confidence, CASE WHEN type = 'dose' AND confidence <> 0.9 THEN (SELECT min(value) FROM rd WHERE rd.name = c.name AND rd.unit = c.unit) END AS correct, CASE WHEN confidence >= 0.8 THEN 'verified' WHEN confidence >= 0.5 THEN 'uncertain' ELSE 'incorrect' END AS status FROM c""")
def v14(t: Tables) -> DataFrame:
    """Doses of line items, numbers and openings of documents against a third of the doses and the benchmark."""
    name = F.lower(F.element_at(F.array(*map(F.lit, DRUGS)), (F.col("l_partkey") % 12 + 1).cast("int")))
    factor = F.when(F.col("l_suppkey") % 3 == 0, 1).when(F.col("l_suppkey") % 3 == 1, 40).otherwise(400)
    given = t.lineitem.select(name.alias("name"), F.when(F.col("l_suppkey") % 5 == 0, "g").otherwise("mg").alias("unit"), (F.col("l_quantity").cast("int") * factor).cast("double").alias("value"), (F.col("l_orderkey") % 3).alias("part")).distinct()
    known = given.where("part = 0 and name <> 'morphin' and not (name = 'heparin' and unit = 'g') and value < 500").select("name", "unit", "value")
    digits = lambda c, pattern: F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).cast("array<double>")).alias("value")
    none = F.lit(None).cast("string")
    said = given.where("part > 0").select(F.lit("dose").alias("type"), "name", "unit", "value", none.alias("text"))
    counted = t.documents.select(digits(F.col("text"), r"\d{3,9}")).select(F.lit("number"), none, none, "value", none)
    opening = t.documents.where("length(text) > 0").select(F.when(F.col("doc_id") % 2 == 0, "class").otherwise("interval"), none, none, F.lit(None).cast("double"), F.lower(F.substring("text", 1, 30)))
    facts = said.union(counted).union(opening).distinct().withColumn("fid", F.xxhash64("type", "name", "unit", "value", "text"))
    numbers = t.benchmark.select(digits(F.concat_ws(" ", "text", (F.col("item_id") * 37).cast("string")), r"\d{1,9}")).distinct()
    return checked(facts, known, numbers, t.benchmark.select("text")).drop("fid")


@query("v11_light_pipeline", f"WITH d AS (SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS n, CAST(len({WORDS_SQL.format('text')}) AS DOUBLE) AS w FROM documents), r AS (SELECT *, round(least(1, 0.3 + 0.3 * (1 - least(1, w / 100))), 6) AS risk FROM d) SELECT doc_id, risk, n >= 60 AND risk <= 0.45 AS valid FROM r")
def v11(t: Tables) -> DataFrame:
    n, w = F.length(F.trim(X.filled(F.col("text")))), F.size(X.words(F.col("text"))).cast("double")
    risk = F.round(V.risk(F.lit(1), F.lit(0), F.least(F.lit(1.0), w / 100)), 6)
    return t.documents.select("doc_id", n.alias("n"), risk.alias("risk")).select("doc_id", "risk", ((F.col("n") >= 60) & (F.col("risk") <= 0.45)).alias("valid"))


@query("r5_keyword_ratio")  # a fifth of the score is the ratio, of the first 2,000 characters: its cost grows with the square
def r5(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("q"), X.words(F.col("text"), 4).alias("ws"))
    keys = asked.select("qid", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    held = t.documents.select(F.col("doc_id").alias("id"), F.explode(X.words(F.col("text"), 4)).alias("w"))
    side = F.broadcast(keys) if keys.limit(100_001).count() <= 100_000 else keys
    hits = held.join(side, "w").groupBy("qid", "id", "n").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    # The ratio adds a fifth at most, so what lies a quarter below the third share cannot come third.
    shares = hits.withColumn("s", F.col("c") / F.col("n"))
    floor = J.ranked_matches(shares, "qid", [F.desc("s"), F.col("id")], 3).groupBy("qid").agg(F.min("s").alias("floor"))
    share = shares.join(floor, "qid").where(F.col("s") >= F.col("floor") - 0.25)
    texts = share.join(asked.select("qid", "q"), "qid").join(t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 2000).alias("d")), "id")
    scored = texts.withColumn("score", F.round(0.8 * F.col("s") + 0.2 * J.ratio("q", "d"), 6))
    return J.ranked_matches(scored, "qid", [F.desc("score"), F.col("id")], 3).select("qid", "id", "score", "rank")


#: Exam texts from documents: a question, and sentences as an answer that is numbered, marked, parted or plain.
EXAM_SQL = r"""p AS (SELECT doc_id, lang, list_transform(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D;]+', ' ', 'g'), '. '), lambda x: trim(x, ' ')) AS s FROM documents),
    e AS (SELECT doc_id, lang, s[1] || CASE WHEN doc_id % 3 = 0 THEN ' (2023)?' ELSE '?' END AS question, coalesce(s[2], '') AS a, coalesce(s[3], '') AS b, coalesce(s[4], '') AS c FROM p),
    x AS (SELECT doc_id, question, CASE doc_id % 4 WHEN 0 THEN '1) ' || a || chr(10) || '2. ' || b || chr(10) || 'c) ' || c WHEN 1 THEN '• ' || a || chr(10) || '* ' || b WHEN 2 THEN a || '; ' || b || '; ' || a ELSE a END AS answer FROM e)"""


@query("x7_exam_parse", rf"""WITH {EXAM_SQL}, l AS (SELECT doc_id, question, coalesce(nullif(trim(regexp_replace(answer, '^[:\s-]+', ''), ' ' || chr(10)), ''), 'Erwartete Antwort:') AS answer FROM x), m AS (SELECT *, string_split(answer, chr(10)) AS ls FROM l),
    n AS (SELECT *, list_filter(ls, lambda z: regexp_matches(z, '^\s*(?:[0-9]+|[a-z]|[IVX]+)[).:]\s*\S')) AS nu, list_filter(ls, lambda z: regexp_matches(z, '^\s*[-•*►▪]\s+\S')) AS bu FROM m),
    i AS (SELECT doc_id, question, CASE WHEN len(nu) >= 2 THEN list_transform(nu, lambda z: trim(regexp_replace(z, '^\s*(?:[0-9]+|[a-z]|[IVX]+)[).:]\s*', ''), ' ')) WHEN len(bu) >= 2 THEN list_transform(bu, lambda z: trim(regexp_replace(z, '^\s*[-•*►▪]\s+', ''), ' ')) ELSE list_transform(regexp_split_to_array(answer, ';\s+'), lambda z: trim(z, ' ')) END AS raw FROM n),
    f AS (SELECT doc_id, question, list_filter(raw, lambda z: length(z) > 3 AND NOT regexp_matches(z, '^\d+$')) AS items FROM i),
    u AS (SELECT doc_id, question, list_filter(items, lambda z, k: list_position(list_transform(items, lambda y: lower(y)), lower(z)) = k)[1:10] AS items FROM f)
    SELECT doc_id, question, array_to_string(items, '|') AS answers, round(((length(question) > 10)::INT + (len(items) > 0)::INT + 0.5::DOUBLE * (len(items) >= 3)::INT + 0.5 * coalesce(len(items) > 0 AND list_sum(list_transform(items, lambda z: length(z))) / len(items) > 20, false)::INT + 0.5 * regexp_matches(question, '\b20\d\d\b')::INT + 0.5 * regexp_matches(lower(question), '^(?:the|der|le|el) ')::INT + (length(question) > 50 AND length(question) < 1000)::INT) / 5, 6) AS score FROM u""")
def x7(t: Tables) -> DataFrame:
    said = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D;]+", " "), r"\. "), lambda p: F.trim(p))
    a, b, c = (F.coalesce(F.get(said, F.lit(k)), F.lit("")) for k in (1, 2, 3))
    kind = F.col("doc_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("1) "), a, F.lit("\n2. "), b, F.lit("\nc) "), c)).when(kind == 1, F.concat(F.lit("• "), a, F.lit("\n* "), b)).when(kind == 2, F.concat(a, F.lit("; "), b, F.lit("; "), a)).otherwise(a)
    asked = F.concat(said[0], F.when(F.col("doc_id") % 3 == 0, " (2023)?").otherwise("?"))
    texts = t.documents.select("doc_id", asked.alias("q"), F.concat(asked, F.lit("\n\nErwartete Antwort: "), answer).alias("text"))
    parsed = texts.select("doc_id", F.split("text", "\n\n")[0].alias("question"), E.exam_items(E.exam_answer(F.col("text"))).alias("items"))
    data, named = F.regexp_like("question", F.lit(r"\b20\d\d\b")), F.regexp_like(F.lower("question"), F.lit("^(?:the|der|le|el) "))
    return parsed.select("doc_id", "question", F.array_join("items", "|").alias("answers"), F.round(E.exam_score(F.col("question"), F.col("items"), data, named), 6).alias("score"))


@query("s14_not_done", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def s14(t: Tables) -> DataFrame:
    from lektura.sources.readers import not_done

    return not_done(t.events.select("event_id"), t.events.where("event_type = 'click'"), "event_id")


@query("k17_context_fix", rf"""WITH q AS ({TURN_SQL}), f AS (SELECT *, {FOLLOW_SQL} IS NOT NULL AS f FROM q), c AS (SELECT conv_id, min_by(text, turn) AS c FROM conversations WHERE role <> 'user' GROUP BY 1)
    SELECT f.conv_id, turn, CASE WHEN f THEN 'missing_context' WHEN c IS NULL THEN 'not_found' ELSE 'found' END AS tag, CASE WHEN NOT f AND c IS NOT NULL THEN '[' || c || '] ' || frage ELSE frage END AS frage FROM f LEFT JOIN c ON f.conv_id = c.conv_id""")
def k17(t: Tables) -> DataFrame:
    reason = followup_reason(F.col("frage"), conjunctions=("and", "et", "und", "y"), pronouns=("this", "das", "esta", "cette"))
    first = t.conversations.where("role <> 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("c"))
    joined = turns(t).withColumn("f", reason.isNotNull()).join(first, "conv_id", "left")
    tag = F.when(F.col("f"), "missing_context").when(F.col("c").isNull(), "not_found").otherwise("found")
    return joined.select("conv_id", "turn", tag.alias("tag"), F.when(tag == "found", F.concat(F.lit("["), "c", F.lit("] "), "frage")).otherwise(F.col("frage")).alias("frage"))
