"""Extraction (X) over the tables; prose holds no question marks or empty lines, so separators are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.functions.rules import first_match
from lektura.operators import extract as E
from lektura.plans.registry import query
from lektura.session import Tables

LINES_SQL = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents)"


@query("x1_questions", r"""WITH p AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(text, '\.\s*')), ' ') AS question FROM conversations)
    SELECT conv_id, turn, question FROM p WHERE length(question) >= 8 AND regexp_matches(lower(question), '^(?:the|de|la|der|is)(?: |$)')""")
def x1(t: Tables) -> DataFrame:
    return E.questions(t.conversations, F.col("text"), r"\.\s*", ("the", "de", "la", "der", "is")).select("conv_id", "turn", "question")


def dialog_lines(t: Tables) -> DataFrame:
    """Conversations as lines: every fifth turn is an empty line."""
    c = t.conversations
    return c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("line"), (F.col("role") == "user").alias("q"))


@query("x2_dialog_blocks", """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS line, role = 'user' AND turn % 5 <> 4 AS q, turn % 5 = 4 AS e FROM conversations),
    m AS (SELECT *, max(CASE WHEN q THEN turn END) OVER w AS last_q, max(CASE WHEN e THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_e, sum(CAST(NOT q AND trim(line, ' ') <> '' AS INT)) OVER w AS n FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, coalesce(sum(CAST(e AND last_q IS NOT NULL AND coalesce(last_e, -1) < last_q AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM m),
    a AS (SELECT conv_id, block, arg_min(n, turn) AS n, string_agg(line, '|' ORDER BY turn) AS questions FROM b WHERE q GROUP BY 1, 2)
    SELECT a.conv_id, CAST(a.block AS BIGINT) AS block, a.questions, coalesce((SELECT string_agg(line, '|' ORDER BY turn) FROM b WHERE b.conv_id = a.conv_id AND NOT b.q AND trim(b.line, ' ') <> '' AND b.n <= a.n AND b.n > a.n - 6), '') AS context FROM a""")
def x2(t: Tables) -> DataFrame:
    found = E.dialog_blocks(dialog_lines(t), "conv_id", "turn", "line", F.col("q"))
    return found.select("conv_id", F.col("block").cast("long").alias("block"), F.array_join("questions", "|").alias("questions"), F.array_join("context", "|").alias("context"))


@query("x3_chunks")  # the fold over paragraphs is held against a loop in the tests
def x3(t: Tables) -> DataFrame:
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return E.chunks(t.documents.select("doc_id", paragraphs.alias("text")), F.col("text")).select("doc_id", "chunk", "piece")


@query("x4_topic_phrases", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]{3,}') AS ws FROM documents), r AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i, n FROM w, (VALUES (1), (2), (3)) v(n)),
    p AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM r WHERE i + n - 1 <= len(ws) AND (list_contains(ws[i:i + n - 1], 'from') OR list_contains(ws[i:i + n - 1], 'pour')))
    SELECT phrase, count(*) AS n FROM p GROUP BY phrase""")
def x4(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))
    found = t.documents.select(words.alias("ws")).select(F.explode(E.phrases(F.col("ws"), ("from", "pour"))).alias("phrase"))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query("x5_question_patterns", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), p AS (SELECT doc_id, regexp_extract(t, '^([^.]{8,180})\.', 1) AS pattern FROM l) SELECT lower(pattern) AS k, arg_min(pattern, (doc_id, pattern)) AS pattern, count(*) AS n FROM p WHERE pattern <> '' GROUP BY 1""")
def x5(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    found = lines.select("doc_id", F.regexp_extract("t", r"^([^.]{8,180})\.", 1).alias("pattern")).where("pattern <> ''")
    return found.groupBy(F.lower("pattern").alias("k")).agg(F.min_by("pattern", F.struct("doc_id", "pattern")).alias("pattern"), F.count(F.lit(1)).alias("n"))


@query("x6_years", r"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'am ' || strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN 'vom ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'Jahr ' || CAST(2015 + o_orderkey % 13 AS VARCHAR) END AS t FROM orders)
    SELECT o_orderkey, coalesce(CAST(nullif(regexp_extract(t, '\b\d{1,2}\.\d{1,2}\.(\d{4})\b', 1), '') AS INT), CAST(nullif(regexp_extract(t, '\b(\d{4})-\d{2}-\d{2}\b', 1), '') AS INT), CAST(nullif(regexp_extract(t, '\b(2020|2021|2022|2023|2024|2025)\b', 1), '') AS INT)) AS year FROM o""")
def x6(t: Tables) -> DataFrame:
    third = F.col("o_orderkey") % 3
    text = F.when(third == 0, F.concat(F.lit("am "), F.date_format("o_orderdate", "dd.MM.yyyy"))).when(third == 1, F.concat(F.lit("vom "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.concat(F.lit("Jahr "), (F.col("o_orderkey") % 13 + 2015).cast("string")))
    return t.orders.select("o_orderkey", E.detected_year(text).alias("year"))


SECTIONS = (("^Befund", "befund"), ("^Therapie", "therapie"), ("^Verlauf", "verlauf"))
SECTION_TEXT_SQL = "c_name || chr(10) || 'Befund: ' || c_mktsegment || chr(10) || CAST(c_nationkey AS VARCHAR) || chr(10) || 'Therapie' || chr(10) || CASE WHEN c_acctbal < 0 THEN 'Verlauf: debit' ELSE 'rest' END"


@query("x8_sections", f"""WITH x AS (SELECT c_custkey, string_split({SECTION_TEXT_SQL}, chr(10)) AS ls FROM customer), l AS (SELECT c_custkey, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM x),
    m AS (SELECT *, CASE WHEN line LIKE 'Befund%' THEN 1 WHEN line LIKE 'Therapie%' THEN 2 WHEN line LIKE 'Verlauf%' THEN 3 END AS s FROM l), f AS (SELECT *, coalesce(max(s) OVER (PARTITION BY c_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS k FROM m)
    SELECT c_custkey, ['frage', 'befund', 'therapie', 'verlauf'][k + 1] AS section, trim(string_agg(line, chr(10) ORDER BY pos), ' ') AS body FROM f GROUP BY c_custkey, k""")
def x8(t: Tables) -> DataFrame:
    last = F.when(F.col("c_acctbal") < 0, F.lit("Verlauf: debit")).otherwise(F.lit("rest"))
    text = F.concat_ws("\n", "c_name", F.concat(F.lit("Befund: "), "c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("Therapie"), last)
    return E.sections(t.customer, "c_custkey", text, SECTIONS, "frage")


@query("x9_media", r"""WITH p AS (SELECT page_id, html || '<img src="a' || CAST(page_id % 7 AS VARCHAR) || '.png">[sound:b.mp3]' AS h FROM pages) SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(h, '<img[^>]*src=["'']([^"'']+)["'']', 1), regexp_extract_all(h, '\[sound:([^\]]+)\]', 1)))) AS ref FROM p""")
def x9(t: Tables) -> DataFrame:
    html = F.concat("html", F.lit('<img src="a'), (F.col("page_id") % 7).cast("string"), F.lit('.png">[sound:b.mp3]'))
    return t.pages.select("page_id", F.explode(E.media(html)).alias("ref"))


@query("x10_splice", "SELECT doc_id, CASE WHEN instr(text, 'Licensed') = 0 THEN text || chr(10) || '[media]' ELSE substr(text, 1, instr(text, 'Licensed') - 1) || '[media]' || chr(10) || substr(text, instr(text, 'Licensed')) END AS text FROM documents")
def x10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", E.spliced(F.col("text"), F.lit("[media]"), "Licensed").alias("text"))


SOURCE_RULES = ((r"^https?://", ""), (r"^(?:www|blog|m)\.", ""), (r"\.example\.(?:com|net|org)", ""), (r"[?#].*$", ""), ("/+$", ""))


@query("x11_normalised_sources", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '', 'g'), '^(?:www|blog|m)\.', '', 'g'), '\.example\.(?:com|net|org)', '', 'g'), '[?#].*$', '', 'g'), '/+$', '', 'g') AS source FROM pages")
def x11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", E.replaced(F.col("url"), SOURCE_RULES).alias("source"))


@query("x12_reference", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(Licensed under [^.]*)', 1), ''), nullif(regexp_extract(text, '(\d{9,})', 1), ''), source) AS reference FROM documents")
def x12(t: Tables) -> DataFrame:
    found = [F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"(Licensed under [^.]*)", r"(\d{9,})")]
    return t.documents.select("doc_id", F.coalesce(*found, "source").alias("reference"))


@query("x13_structured_context", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN json_object('patient', c_name, 'diagnosis', c_mktsegment) ELSE json_object('name', c_name, 'diagnose', c_mktsegment) END AS j FROM customer)
    SELECT c_custkey, coalesce(j->>'$.patient', j->>'$.name') AS patient, coalesce(j->>'$.diagnosis', j->>'$.diagnose') AS diagnosis FROM c""")
def x13(t: Tables) -> DataFrame:
    even = F.to_json(F.struct(F.col("c_name").alias("patient"), F.col("c_mktsegment").alias("diagnosis")))
    odd = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("diagnose")))
    parsed = t.customer.select("c_custkey", F.from_json(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd), "patient string, name string, diagnosis string, diagnose string").alias("j"))
    return parsed.select("c_custkey", F.coalesce("j.patient", "j.name").alias("patient"), F.coalesce("j.diagnosis", "j.diagnose").alias("diagnosis"))


@query("x14_context_quality", """WITH s AS (SELECT p_partkey, CAST(p_name LIKE '%ring%' AS INT) + CAST(p_size > 20 AS INT) + CAST(p_retailprice > 1000 AS INT) AS filled, p_size / 100.0 AS score FROM part)
    SELECT p_partkey, CASE WHEN filled >= 2 AND score >= 0.18 THEN 'high' WHEN filled >= 1 AND score >= 0.10 THEN 'medium' ELSE 'low' END AS quality FROM s""")
def x14(t: Tables) -> DataFrame:
    filled = F.contains("p_name", F.lit("ring")).cast("int") + (F.col("p_size") > 20).cast("int") + (F.col("p_retailprice") > 1000).cast("int")
    score = F.col("p_size") / 100
    return t.part.select("p_partkey", F.when((filled >= 2) & (score >= 0.18), "high").when((filled >= 1) & (score >= 0.10), "medium").otherwise("low").alias("quality"))


@query("x15_tree_paths", """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey < 10 THEN NULL ELSE c_custkey // 10 END AS parent, c_name AS name FROM customer),
    p AS (SELECT id, 0 AS depth, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.depth + 1, p.path || ' > ' || n.name FROM n JOIN p ON n.parent = p.id) SELECT id, depth, path FROM p""")
def x15(t: Tables) -> DataFrame:
    parent = F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10))
    nodes = t.customer.select(F.col("c_custkey").alias("id"), parent.alias("parent"), F.col("c_name").alias("name"), (F.col("c_custkey") % 10).alias("nth"))
    return E.tree_paths(nodes).select("id", "depth", "path")


@query("x16_model_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'ok' AS state FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL, 'bad' FROM events WHERE event_id % 4 = 3""")
def x16(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Antwort: "), "props")).when(kind == 2, F.col("props")).otherwise(F.lit("{broken"))
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = t.events.select("event_id", F.from_json(F.nullif(body, F.lit("")), "k long").alias("j"))
    return parsed.select("event_id", F.col("j.k").alias("k"), F.when(F.col("j.k").isNotNull(), "ok").otherwise("bad").alias("state"))


FACT_RULES = (("number", r"\d{3,}(?:[.,]\d+)?"), ("license", r"Licensed under [^.]*"), ("mail", r"[a-z0-9]+@[a-z0-9.]+"))


@query("x17_facts", rf"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS type, fact FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '{p}')) AS fact FROM l) WHERE length(fact) >= 3" for k, p in FACT_RULES))
def x17(t: Tables) -> DataFrame:
    return E.facts(t.documents, "doc_id", F.col("text"), FACT_RULES)


@query("x18_claims", r"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '.{0,100}Licensed.{0,100}')) AS claim FROM documents) SELECT doc_id, claim FROM c WHERE length(claim) > 10")
def x18(t: Tables) -> DataFrame:
    held = t.documents.where(F.contains("text", F.lit("Licensed")))
    return held.select("doc_id", F.explode(E.around(F.col("text"), "Licensed", 100)).alias("claim")).where(F.length("claim") > 10)


@query("x19_image_query", r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring') THEN 'xray' WHEN regexp_matches(p_name, 'widget|gear') THEN 'ct' ELSE 'photo' END AS kind, substr(p_name, 1, 20) || ' ' || lower(p_type) AS search FROM part")
def x19(t: Tables) -> DataFrame:
    kind = first_match(F.col("p_name"), (("ring", "xray"), ("widget|gear", "ct")), "photo")
    return t.part.select("p_partkey", kind.alias("kind"), F.concat(F.substring("p_name", 1, 20), F.lit(" "), F.lower("p_type")).alias("search"))


@query("x20_headings", """WITH x AS (SELECT s_suppkey, ['# ' || s_name, '- a' || CAST(s_nationkey AS VARCHAR), '- [ ] b', '## Rest', '- c'] AS ls FROM supplier), l AS (SELECT s_suppkey, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM x)
    SELECT s_suppkey, CASE WHEN pos < 4 THEN s_name ELSE 'Rest' END AS heading, count(*) FILTER (WHERE line LIKE '- %') AS items, count(*) FILTER (WHERE line LIKE '- [ ]%') AS open FROM l JOIN supplier USING (s_suppkey) GROUP BY 1, 2""")
def x20(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# "), "s_name", F.lit("\n- a"), F.col("s_nationkey").cast("string"), F.lit("\n- [ ] b\n## Rest\n- c"))
    lines = t.supplier.select("s_suppkey", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    heading = F.last(F.nullif(F.regexp_extract("line", "^#+ (.*)$", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("s_suppkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("heading", heading)
    return lines.groupBy("s_suppkey", "heading").agg(F.count(F.when(F.startswith("line", F.lit("- ")), 1)).alias("items"), F.count(F.when(F.startswith("line", F.lit("- [ ]")), 1)).alias("open"))

