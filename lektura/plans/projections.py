"""Projections, normal forms and predicates (P) over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.functions.rules import first_match, hit_count
from lektura.operators import filters
from lektura.plans.registry import query
from lektura.session import Tables

ENTITIES_SQL = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
WS_LOWER_SQL = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'), ' '))"
STOP = ("the", "and", "of", "der", "die", "und", "la", "le", "de", "el")
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
WORDS_SQL = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]{{2,}}'))"


@query("p1_ws_lower", f"SELECT doc_id, {WS_LOWER_SQL.format('text')} AS key FROM documents")
def p1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.ws_lower(F.col("text")).alias("key"))


@query("p2_nfkc_key")  # SQL has no full case folding
def p2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.nfkc_key(F.col("text")).alias("key"))


@query(
    "p3_question_key",
    rf"""WITH a AS (SELECT page_id, regexp_replace({ENTITIES_SQL.format("coalesce(html, '')")}, '<[^>]*>', ' ', 'g') AS t FROM pages),
         b AS (SELECT page_id, lower(regexp_replace(t, '^\s*(?:[Ff]rage\s*\d*\s*[:.)]|\d+\s*[.):])\s*', '')) AS t FROM a)
         SELECT page_id, trim(regexp_replace(t, '[^a-z0-9äöüß]+', ' ', 'g'), ' ') AS key,
                trim(regexp_replace(translate(t, '{X.MARKED}', '{X.PLAIN}'), '[^a-z0-9]+', ' ', 'g'), ' ') AS ascii_key FROM b""",
)
def p3(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.question_key(F.col("html")).alias("key"), X.question_key(F.col("html"), True).alias("ascii_key"))


@query(
    "p4_alnum_key",
    r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
               '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ')) AS key FROM pages""",
)
def p4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.alnum_key(F.col("html")).alias("key"))


@query(
    "p5_context_key",
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace('[Kontext: <img src="a.png"> ' || text, '<img[^>]*>', ' ', 'g'),
               '^\s*\[?(?:[Kk]ontext|[Cc]ontext)\s*:?\]?\s*', ''), '\s+', ' ', 'g'), ' ')) AS key FROM documents""",
)
def p5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.context_key(F.concat(F.lit('[Kontext: <img src="a.png"> '), "text")).alias("key"))


@query(
    "p6_tag_key",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(replace('#' || p_type || '::Größe ' || p_name, '#', ''), ' ')),
               'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9:_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS tag FROM part""",
)
def p6(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.tag_key(F.concat(F.lit("#"), "p_type", F.lit("::Größe "), "p_name")).alias("tag"))


@query(
    "p7_file_key",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '([^/?#]*)(?:[?#].*)?$', 1)),
               '\(\d+\)', '', 'g'), '(_\d+)+$| \d+$', '', 'g'), '[\s_-]+', '', 'g') AS key FROM pages""",
)
def p7(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.file_key(F.col("url")).alias("key"))


@query(
    "p8_tag_parts",
    r"""SELECT p_partkey, unnest(string_split(lower(p_brand) || '::' || lower(p_type), '::')) AS part FROM part
        UNION SELECT p_partkey, lower(p_name) FROM part WHERE p_name NOT LIKE '% %'
        UNION SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) FROM part""",
)
def p8(t: Tables) -> DataFrame:
    tags = X.split_tags(F.concat_ws(" ", F.concat(F.lower("p_brand"), F.lit("::"), F.lower("p_type")), F.lower("p_name")))
    return t.part.select("p_partkey", F.explode(X.tag_parts(tags)).alias("part"))


@query(
    "p9_tag_edit",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'has_context checked ' ELSE 'needs_context ' END || lower(o_orderstatus) ||
              CASE o_orderstatus WHEN 'F' THEN '' ELSE ' checked' END AS tags FROM orders""",
)
def p9(t: Tables) -> DataFrame:
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("needs_context"), F.lit("checked"), F.lower("o_orderstatus"))).otherwise(F.array(F.lit("needs_context"), F.lower("o_orderstatus")))
    edited = F.when(F.col("o_orderstatus") == "F", X.replaced_tag(tags, "needs_context", "has_context")).otherwise(tags)
    return t.orders.select("o_orderkey", F.array_join(X.with_tag(edited, "checked"), " ").alias("tags"))


@query(
    "p10_tag_build",
    """SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN '' ELSE 'lang:' || lang || ' ' END ||
              CASE WHEN n_chars < 500 THEN 'size:short ' ELSE '' END || 'source:' || source AS tags FROM documents""",
)
def p10(t: Tables) -> DataFrame:
    tags = X.built_tags(source=F.col("source"), lang=F.col("lang"), size=F.when(F.col("n_chars") < 500, F.lit("short")))
    return t.documents.select("doc_id", F.array_join(tags, " ").alias("tags"))


@query("p11_content_ids", r"SELECT doc_id, coalesce(source, '') || '_' || substr(md5(coalesce(text, '')), 1, 12) AS content_id, sha1(lower(coalesce(source, '')) || chr(10) || lower(coalesce(text, ''))) AS card_id FROM documents")
def p11(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", X.content_id(d.source, d.text).alias("content_id"), X.card_id(d.source, d.text).alias("card_id"))


@query(
    "p12_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 197), ' ') || '...' END AS short,
              CASE WHEN length(text) <= 207 THEN text ELSE substr(text, 1, 140) || ' [...] ' || right(text, 60) END AS ends FROM documents""",
)
def p12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.ellipsis(F.col("text"), 200).alias("short"), X.middle_cut(F.col("text"), 207).alias("ends"))


@query("p13_clean_unicode", "SELECT doc_id, 'a b c' || coalesce(text, '') AS text FROM documents")
def p13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_unicode(F.concat(F.lit("\ufeffa\u2028b\u00a0c"), X.filled(F.col("text")))).alias("text"))


@query("p14_tokens", "SELECT doc_id, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, CAST(floor(length(coalesce(text, '')) / 4.0) AS BIGINT) AS whole FROM documents")
def p14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"), X.approx_tokens(F.col("text"), whole=True).alias("whole"))


TURN_SQL = r"SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') || CASE WHEN turn % 3 = 0 THEN '?' ELSE '' END AS frage FROM conversations"


def turns(t: Tables) -> DataFrame:
    """Conversation turns as questions; every third gets a question mark, as the texts have none."""
    mark = F.when(F.col("turn") % 3 == 0, F.lit("?")).otherwise(F.lit(""))
    return t.conversations.select("conv_id", "turn", "role", F.concat(X.single_spaced(F.col("text")), mark).alias("frage"))


@query(
    "p15_answerable",
    rf"""WITH q AS ({TURN_SQL}) SELECT conv_id, turn FROM q
         WHERE length(frage) >= 15 AND (regexp_matches(frage, '\?') OR regexp_matches(lower(frage), '^(?:what|the|que|der|la) '))
           AND (NOT regexp_matches(frage, '[,.]$') OR role = 'assistant')""",
)
def p15(t: Tables) -> DataFrame:
    q = turns(t)
    return filters.answerable(q, F.col("frage"), has_context=F.col("role") == "assistant", starters=("what", "the", "que", "der", "la")).select("conv_id", "turn")


SKIP_CASE_SQL = r"""CASE WHEN role = 'assistant' THEN 'answered' WHEN length(frage) < 60 AND NOT regexp_matches(frage, '\?') THEN 'fragment'
    WHEN length(frage) < 200 AND NOT regexp_matches(lower(frage), 'tion|ment') THEN 'too_short'
    WHEN regexp_matches(lower(frage), '^(?:the|le|der|la) ') AND NOT regexp_matches(lower(frage), 'ther|reau') THEN 'generic' ELSE 'keep' END"""


@query("p16_skip_cascade", rf"WITH q AS ({TURN_SQL}) SELECT {SKIP_CASE_SQL} AS category, count(*) AS n, min(conv_id) AS first_conv FROM q GROUP BY 1")
def p16(t: Tables) -> DataFrame:
    marked = filters.skip_category(turns(t), F.col("frage"), answered=F.col("role") == "assistant", fragment=60, short=200, keywords="tion|ment", generic="^(?:the|le|der|la) ", specific="ther|reau")
    return marked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))


FOLLOW_SQL = r"CASE WHEN length(frage) < 40 THEN 'short' WHEN regexp_matches(lower(frage), '^(?:and|et|und|y)[ ,]') THEN 'conjunction' WHEN regexp_matches(lower(frage), '(?:^| )(?:this|das|esta|cette)(?: |$)') THEN 'pronoun' END"


@query("p17_followup", rf"WITH q AS ({TURN_SQL}) SELECT conv_id, turn, {FOLLOW_SQL} AS reason, {FOLLOW_SQL} IS NOT NULL AS followup FROM q")
def p17(t: Tables) -> DataFrame:
    reason = filters.followup_reason(F.col("frage"), conjunctions=("and", "et", "und", "y"), pronouns=("this", "das", "esta", "cette"))
    return turns(t).select("conv_id", "turn", reason.alias("reason"), reason.isNotNull().alias("followup"))


@query("p18_placeholder", "SELECT doc_id, length(trim(coalesce(text, ''), ' ')) < 30 AS empty FROM documents")
def p18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.is_placeholder(F.col("text")).alias("empty"))


@query("p19_drop_missing", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND trim(o_orderpriority) <> ''")
def p19(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderpriority")
    return filters.with_all(o, "status", "o_orderpriority").select("o_orderkey", "status")


@query("p20_exclude_deck", "SELECT p_partkey, p_type LIKE '%ECONOMY%' OR p_name LIKE '%ring%' AS excluded, CASE WHEN p_type LIKE '%ECONOMY%' THEN 'tag' WHEN p_name LIKE '%ring%' THEN 'source' ELSE '' END AS reason FROM part")
def p20(t: Tables) -> DataFrame:
    return filters.excluded(t.part, tags=F.col("p_type"), source=F.col("p_name"), tag_words=("ECONOMY",), source_words=("ring",)).select("p_partkey", "excluded", "reason")


@query("p21_ready_cards", "SELECT o_orderkey AS id, 2.5 AS easiness_factor, 1 AS interval, 0 AS repetitions FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def p21(t: Tables) -> DataFrame:
    return filters.ready_cards(t.orders, ready=(F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 1000), id=F.col("o_orderkey"))


@query("p22_words", f"SELECT doc_id, CAST(len(list_filter({WORDS_SQL.format('text')}, lambda x: NOT list_contains({STOP_SQL}, x))) AS INTEGER) AS n FROM documents")
def p22(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.words(F.col("text"), stop=STOP)).alias("n"))


@query(
    "p23_front",
    """SELECT c_custkey, concat_ws(', ', 'Patient ' || CAST(c_nationkey + 20 AS VARCHAR), nullif(lower(c_mktsegment), 'machinery'), CASE WHEN c_acctbal < 0 THEN 'debit' END) || ': ' || c_name AS front,
              CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'trauma' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'internal' ELSE 'general' END AS specialty FROM customer""",
)
def p23(t: Tables) -> DataFrame:
    c = t.customer
    front = filters.case_front(c.c_name, age=c.c_nationkey + 20, gender=F.nullif(F.lower("c_mktsegment"), F.lit("machinery")), findings=F.array_compact(F.array(F.when(c.c_acctbal < 0, F.lit("debit")))))
    guess = first_match(c.c_mktsegment, (("AUTOMOBILE|MACHINERY", "trauma"), ("HOUSEHOLD", "internal")), "general")
    return c.select("c_custkey", front.alias("front"), guess.alias("specialty"))


@query("p24_class_text", "SELECT doc_id, lower(source || ' ' || lang || CASE WHEN n_chars > 1000 THEN ' ' || substr(text, 1, 50) ELSE '' END) AS t FROM documents")
def p24(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", filters.joined_text([d.source, d.lang], more=[F.substring("text", 1, 50)], repaired=d.n_chars > 1000).alias("t"))


@query("p25_compact", "SELECT o_orderkey, concat_ws(' | ', nullif(nullif(o_orderstatus, 'P'), ''), o_orderpriority) AS parts FROM orders")
def p25(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.compact_list(F.array(F.nullif(F.col("o_orderstatus"), F.lit("P")), "o_orderpriority", F.lit(" ")), 3).alias("parts"))


@query("k8_risk_flags", r"""SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(text, '\d{9,}') THEN 'number' END, CASE WHEN regexp_matches(text, '[A-Z]{5,}') THEN 'shouting' END,
        CASE WHEN regexp_matches(text, 'License') THEN 'license' END) AS flags, (regexp_matches(text, '\d{9,}')::INT + regexp_matches(text, '[A-Z]{5,}')::INT + regexp_matches(text, 'License')::INT) AS n FROM documents""")
def k8(t: Tables) -> DataFrame:
    from lektura.functions.rules import all_matches

    rules = ((r"\d{9,}", "number"), ("[A-Z]{5,}", "shouting"), ("License", "license"))
    return t.documents.select("doc_id", F.array_join(all_matches(F.col("text"), rules), " ").alias("flags"), hit_count(F.col("text"), [p for p, _ in rules]).alias("n"))
