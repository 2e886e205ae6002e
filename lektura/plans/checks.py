"""Classification by rule tables (K) and validation (V) over the tables, with dose and laboratory texts from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.functions.rules import any_match, confidence, first_match, weighted_scores
from lektura.operators import classify as C
from lektura.operators import validate as V
from lektura.operators.classify import Rules
from lektura.plans.projections import STOP, STOP_SQL, WORDS_SQL
from lektura.plans.registry import query
from lektura.session import Tables

KEYWORDS = (("law", "the", 1.0), ("law", "from", 2.5), ("study", "tion", 2.0), ("study", "is", 0.5), ("care", "pour", 3.0), ("care", "de", 1.5), ("trade", "que", 2.0), ("trade", "der", 1.0))
KEYWORDS_SQL = "k(category, keyword, weight) AS (VALUES " + ", ".join(f"('{c}', '{w}', {x}::DOUBLE)" for c, w, x in KEYWORDS) + ")"


@query("k1_weighted_words", f"""WITH {KEYWORDS_SQL}, w AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS keyword FROM documents), s AS (SELECT doc_id, category, sum(weight) AS score, string_agg(w.keyword, ',' ORDER BY w.keyword) AS keywords FROM w JOIN k ON w.keyword = k.keyword GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER o AS n, lead(score) OVER o AS second FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, category))
    SELECT doc_id, category, score, keywords, round(CASE WHEN second IS NULL THEN 1 ELSE least(1, (score - second) / score + least(score / 20, 0.3::DOUBLE)) END, 6) AS confidence FROM r WHERE n = 1""")
def k1_words(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame(KEYWORDS, "category string, keyword string, weight double")
    scores = weighted_scores(t.documents, "doc_id", X.words(F.col("text")), weights)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "category")
    best = scores.withColumns({"n": F.row_number().over(order), "second": F.lead("score").over(order)}).where("n = 1")
    return best.select("doc_id", "category", "score", F.array_join("keywords", ",").alias("keywords"), F.round(confidence(F.col("score"), F.col("second")), 6).alias("confidence"))


#: Rules over the corpus's languages: phrases that decide, weighted keywords, codes, word groups, words against.
RULES = Rules(
    exclusive=(("licensed under", "law"), ("terms of use", "law")),
    keywords=(("law", "license", 2.5), ("law", "the", 1.0), ("study", "tion", 0.5), ("study", "est", 1.0), ("care", "pour", 3.0), ("care", "avec", 1.5), ("trade", "que", 2.0), ("trade", "der", 1.0), ("trade", "handel", 2.0)),
    codes=(("AB", "care"), ("C", "study")),
    other_codes="general",
    groups=((("erthe", "oreau"), "care", 1.5), (("schen", "keit"), "study", 1.5)),
    against=(("law", ("etre", "ung ")), ("trade", ("this", "that"))),
    default="general",
)
SOURCES = (("src11", "care"), ("src7", "law"))


def _there(keyword: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(low, '(^|{edge}){keyword}($|{edge})')" if len(keyword) <= 4 else f"contains(low, '{keyword}')"


def rules_sql(rules: Rules, text: str) -> str:
    """``category_scores`` as SQL: rows doc_id, source, category, score over the table d(doc_id, source, text)."""
    any_of = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
    known, made = "".join(x for x, _ in rules.codes), []
    for category in rules.categories:
        parts = [f"CASE WHEN {_there(w)} THEN {x}::DOUBLE ELSE 0 END" for c, w, x in rules.keywords if c == category]
        parts += [f"2.0::DOUBLE * len(list_filter(codes, lambda x: contains('{letters}', x)))" for letters, c in rules.codes if c == category]
        parts += [f"2.0::DOUBLE * len(list_filter(codes, lambda x: NOT contains('{known}', x)))"] if category == rules.other_codes else []
        for k, (words, c, points) in enumerate(rules.groups):
            if c == category:
                parts.append(f"CASE WHEN {' AND '.join([any_of(words)] + ['NOT ' + any_of(w) for w, _, _ in rules.groups[:k]])} THEN {points}::DOUBLE ELSE 0 END")
        half = "".join(f" * CASE WHEN {any_of(words)} THEN 0.5::DOUBLE ELSE 1 END" for c, words in rules.against if c == category)
        made.append(f"SELECT doc_id, source, low, '{category}' AS category, ({' + '.join(parts)}){half} AS score FROM c")
    return rf"c AS (SELECT doc_id, source, lower(coalesce({text}, '')) AS low, list_transform(regexp_extract_all(upper(coalesce({text}, '')), '\b([A-TV-Z]\d{{2}}(?:\.\d{{1,2}})?)\b', 1), lambda x: x[1]) AS codes FROM d), s AS ({' UNION ALL '.join(made)})"


def choice_sql(rules: Rules, sources: tuple = ()) -> str:
    phrase = "CASE " + " ".join(f"WHEN contains(low, '{p}') THEN '{c}'" for p, c in rules.exclusive) + " END"
    source = "CASE " + " ".join(f"WHEN contains(lower(coalesce(source, '')), '{p}') THEN '{c}'" for p, c in sources) + " END" if sources else "NULL::VARCHAR"
    return f"""r AS (SELECT *, row_number() OVER o AS n, lead(score) OVER o AS second, {phrase} AS phrase, {source} AS given FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, category))
    SELECT doc_id, coalesce(given, phrase, CASE WHEN score > 0 THEN category END, '{rules.default}') AS category, CASE WHEN given IS NOT NULL OR phrase IS NOT NULL THEN 10 ELSE score END AS score,
           round(CASE WHEN given IS NOT NULL OR phrase IS NOT NULL THEN 1 WHEN score = 0 THEN 0 WHEN second = 0 THEN 1 ELSE least(1, (score - second) / score + least(score / 20, 0.3::DOUBLE)) END, 6) AS confidence,
           CASE WHEN given IS NOT NULL THEN 'source' WHEN phrase IS NOT NULL THEN 'phrase' WHEN score > 0 THEN 'score' ELSE 'none' END AS method FROM r WHERE n = 1"""


CODED_SQL = "d AS (SELECT doc_id, source, coalesce(text, '') || CASE doc_id % 6 WHEN 1 THEN ' A12.3' WHEN 2 THEN ' C50, x77' ELSE '' END AS text FROM documents)"


def coded(t: Tables) -> DataFrame:
    """Documents with diagnosis codes after every third text."""
    code = F.when(F.col("doc_id") % 6 == 1, " A12.3").when(F.col("doc_id") % 6 == 2, " C50, x77").otherwise("")
    return t.documents.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), code).alias("text"))


@query("k1_weighted_category", f"WITH {CODED_SQL}, {rules_sql(RULES, 'text')}, {choice_sql(RULES)}")
def k1(t: Tables) -> DataFrame:
    return C.categorised(coded(t), F.col("text"), RULES).select("doc_id", "category", "score", "confidence", "method")


@query("k2_source_override", f"WITH {CODED_SQL}, {rules_sql(RULES, 'text')}, {choice_sql(RULES, SOURCES)}")
def k2(t: Tables) -> DataFrame:
    return C.categorised(coded(t), F.col("text"), RULES, F.col("source"), SOURCES).select("doc_id", "category", "score", "confidence", "method")


CASCADE = ((r"^\w+ (?:the|and) ", "english"), ("(?i)license", "legal"), (r"\d{9,}", "number"), ("[éè]", "french"))


@query("k7_first_match", r"SELECT doc_id, CASE WHEN regexp_matches(text, '^\w+ (?:the|and) ') THEN 'english' WHEN regexp_matches(text, '(?i)license') THEN 'legal' WHEN regexp_matches(text, '\d{9,}') THEN 'number' WHEN regexp_matches(text, '[éè]') THEN 'french' ELSE 'other' END AS category FROM documents")
def k7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", first_match(F.col("text"), CASCADE, "other").alias("category"))


@query("k10_study_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'needs_review' WHEN event_type = 'click' AND value > 20 THEN 'needs_context' ELSE 'ready' END AS status, CASE WHEN event_type <> 'error' THEN 'none' WHEN value > 20 THEN 'high' WHEN value > 10 THEN 'medium' ELSE 'low' END AS priority FROM events")
def k10(t: Tables) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", "needs_review").when((kind == "click") & (v > 20), "needs_context").otherwise("ready")
    return t.events.select("event_id", status.alias("status"), F.when(kind != "error", "none").when(v > 20, "high").when(v > 10, "medium").otherwise("low").alias("priority"))


@query("k11_queue_routing", r"SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '\d{9,}') THEN 'numbers' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL)) AS queue FROM documents")
def k11(t: Tables) -> DataFrame:
    queues = F.array_compact(F.array(F.when(any_match(F.col("text"), [r"\d{9,}"]), F.lit("numbers")), F.when(F.col("n_chars") < 200, F.lit("short"))))
    return t.documents.select("doc_id", F.explode(queues).alias("queue"))


DRUGS = [r[0] for r in V.DOSE_RANGES]
LABS = [r[0] for r in V.LAB_RANGES]
LIST_SQL = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
DOSES_SQL = f"d AS (SELECT l_orderkey, l_linenumber, l_suppkey, {LIST_SQL(DRUGS)}[1 + l_partkey % 12] AS name, CAST(l_quantity AS INT) * CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 40 ELSE 400 END AS value FROM lineitem)"
DOSE_RANGE_SQL = "r(name, min_dose, max_dose, max_daily, fatal) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, _, a, b, c, d in V.DOSE_RANGES) + ")"
DOSE_ISSUES_SQL = f"""WITH {DOSES_SQL}, {DOSE_RANGE_SQL}, i AS (SELECT l_orderkey, name, value, CASE WHEN value > fatal THEN 'DOSAGE_FATAL' WHEN value > max_dose AND value <= max_daily THEN 'DOSAGE_HIGH' WHEN value > max_dose THEN 'DOSAGE_OVERDOSE' WHEN value < min_dose THEN 'DOSAGE_LOW' END AS code FROM d JOIN r USING (name)),
    j AS (SELECT l_orderkey, name, CAST(value AS DOUBLE) AS value, code, CASE code WHEN 'DOSAGE_FATAL' THEN 'critical' WHEN 'DOSAGE_OVERDOSE' THEN 'error' ELSE 'warning' END AS severity FROM i WHERE code IS NOT NULL)"""


def dose_texts(t: Tables) -> DataFrame:
    """Texts such as ``Gabe Metformin 400 mg`` from line items."""
    name = F.element_at(F.array(*map(F.lit, DRUGS)), (F.col("l_partkey") % 12 + 1).cast("int"))
    factor = F.when(F.col("l_suppkey") % 3 == 0, 1).when(F.col("l_suppkey") % 3 == 1, 40).otherwise(400)
    return t.lineitem.select("l_orderkey", F.concat_ws(" ", F.lit("Es folgt"), name, (F.col("l_quantity").cast("int") * factor).cast("string"), F.lit("mg")).alias("text"))


def doses(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame(V.DOSE_RANGES, V.DOSE_SCHEMA)
    return V.dose_issues(V.numbers_with_names(dose_texts(t), "l_orderkey", F.col("text"), "mg|IE"), "l_orderkey", ranges)


@query("v1_dose_issues", f"{DOSE_ISSUES_SQL} SELECT * FROM j")
def v1(t: Tables) -> DataFrame:
    return doses(t)


@query("v2_codes", r"""WITH c AS (SELECT c_custkey, chr(65 + c_nationkey % 26) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS code, CASE WHEN c_acctbal < 0 THEN 'male' ELSE 'female' END AS gender FROM customer)
    SELECT c_custkey, code, gender = 'female' AND (code = 'C61' OR code BETWEEN 'N40' AND 'N50') OR gender = 'male' AND (code BETWEEN 'C50' AND 'C58' OR code BETWEEN 'N70' AND 'N77') AS mismatch FROM c""")
def v2(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Code "), F.expr("chr(65 + c_nationkey % 26)"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" gesichert"))
    rows = t.customer.select("c_custkey", F.regexp_extract(text, r"\b([A-Z]\d\d(?:\.\d{1,2})?)\b", 1).alias("code"), F.when(F.col("c_acctbal") < 0, "male").otherwise("female").alias("gender"))
    head = F.substring("code", 1, 3)
    male_only, female_only = (head == "C61") | head.between("N40", "N50"), head.between("C50", "C58") | head.between("N70", "N77")
    return rows.select("c_custkey", "code", (((F.col("gender") == "female") & male_only) | ((F.col("gender") == "male") & female_only)).alias("mismatch"))


LAB_RANGE_SQL = "r(name, lo, hi, clo, chi) AS (VALUES " + ", ".join("('{}', {})".format(r[0], ", ".join("NULL::DOUBLE" if x is None else f"{x}::DOUBLE" for x in r[2:])) for r in V.LAB_RANGES) + ")"


@query("v3_lab_issues", f"""WITH d AS (SELECT l_orderkey, {LIST_SQL(LABS)}[1 + l_partkey % 12] AS name, CAST(l_quantity AS INT) / 4.0::DOUBLE AS value FROM lineitem), {LAB_RANGE_SQL}, i AS (SELECT l_orderkey, name, value, CASE WHEN value < clo THEN 'LAB_CRITICAL_LOW' WHEN value > chi THEN 'LAB_CRITICAL_HIGH' WHEN value < lo THEN 'LAB_LOW' WHEN value > hi THEN 'LAB_HIGH' END AS code FROM d JOIN r USING (name))
    SELECT l_orderkey, name, value, code, CASE WHEN code LIKE 'LAB_CRITICAL%' THEN 'critical' ELSE 'warning' END AS severity FROM i WHERE code IS NOT NULL""")
def v3(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, LABS)), (F.col("l_partkey") % 12 + 1).cast("int"))
    number = F.replace((F.col("l_quantity").cast("int") / 4).cast("string"), F.lit("."), F.lit(","))
    texts = t.lineitem.select("l_orderkey", F.concat(name, F.lit(": "), number, F.lit(" mmol/l")).alias("text"))
    ranges = t.spark.createDataFrame(V.LAB_RANGES, V.LAB_SCHEMA)
    return V.lab_issues(V.numbers_with_names(texts, "l_orderkey", F.col("text"), "mmol/l"), "l_orderkey", ranges)


@query("v4_contraindications", "SELECT p_partkey, drug, condition, severity FROM part, (VALUES ('ring', 'ECONOMY', 'critical'), ('gear', 'PROMO', 'warning'), ('red', 'ECONOMY', 'warning')) v(drug, condition, severity) WHERE contains(p_name, drug) AND contains(p_type, condition)")
def v4(t: Tables) -> DataFrame:
    return V.contraindications(t.part, "p_partkey", F.col("p_name"), F.col("p_type"), (("ring", "ECONOMY", "critical"), ("gear", "PROMO", "warning"), ("red", "ECONOMY", "warning")))


VERDICTS_SQL = f"""{DOSE_ISSUES_SQL}, c AS (SELECT l_orderkey, count(*) FILTER (WHERE severity IN ('error', 'critical')) AS errors, count(*) FILTER (WHERE severity = 'critical') AS criticals, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM j GROUP BY 1),
    o AS (SELECT o_orderkey AS l_orderkey, coalesce(errors, 0) AS errors, coalesce(criticals, 0) AS criticals, coalesce(warnings, 0) AS warnings, o_totalprice > 100000 AS d, o_orderstatus = 'F' AS k FROM orders LEFT JOIN c ON o_orderkey = c.l_orderkey),
    v AS (SELECT l_orderkey, errors, warnings, errors = 0 AS is_valid, criticals > 0 AS quarantine, round(0.2::DOUBLE + CASE WHEN d THEN 0.3::DOUBLE ELSE 0.15 END + CASE WHEN k THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN errors = 0 AND warnings = 0 THEN 0.3::DOUBLE WHEN errors = 0 THEN 0.15 ELSE 0 END, 6) AS confidence FROM o)"""


def all_verdicts(t: Tables) -> DataFrame:
    rows = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return V.verdicts(rows, doses(t), "l_orderkey", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F")


@query("v5_verdicts", f"{VERDICTS_SQL} SELECT * FROM v")
def v5(t: Tables) -> DataFrame:
    return all_verdicts(t)


@query("a27_issue_counts", f"{DOSE_ISSUES_SQL} SELECT code, count(*) AS n FROM j GROUP BY 1")
def a27(t: Tables) -> DataFrame:
    return doses(t).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


#: A question and the turn after it, which answers it; sections and references are what the answer's own text has.
COVER_SQL = rf"""WITH t AS (SELECT conv_id, turn, text, list_filter({WORDS_SQL.format('text')}, lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM conversations),
    d AS (SELECT a.conv_id, a.turn, a.text, length(coalesce(a.text, '')) AS n, a.w AS a, q.w AS b FROM t q JOIN t a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1),
    c AS (SELECT *, CASE WHEN len(b) = 0 THEN 0.3 WHEN len(a) = 0 THEN 0.7 ELSE greatest(0.3, len(list_intersect(a, b)) / greatest(len(a), 1)) END AS covered,
          len(regexp_extract_all(coalesce(text, ''), '[0-9]{{5,}}')) AS errors, len(regexp_extract_all(coalesce(text, ''), '[?]')) AS warnings,
          least(5, len(regexp_extract_all(coalesce(text, ''), '\n')) + 1) AS sections, regexp_matches(coalesce(text, ''), 'https?://|[0-9]{{4}}') AS refs FROM d)"""


def covered(t: Tables) -> DataFrame:
    said = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), X.words(F.col("text"), stop=STOP).alias("a"))
    asked = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return said.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.length("text").alias("n"), V.coverage(F.col("a"), F.col("b")).alias("covered"), F.regexp_count("text", F.lit("[0-9]{5,}")).alias("errors"), F.regexp_count("text", F.lit("[?]")).alias("warnings"),
        F.least(F.lit(5), F.regexp_count("text", F.lit("\n")) + 1).alias("sections"), F.regexp_like("text", F.lit("https?://|[0-9]{4}")).alias("refs"),
    )


@query("v7_coverage", f"{COVER_SQL} SELECT conv_id, turn, round(covered, 6) AS covered FROM c")
def v7(t: Tables) -> DataFrame:
    return covered(t).select("conv_id", "turn", F.round("covered", 6).alias("covered"))


@query("v8_risk", f"{COVER_SQL} SELECT conv_id, turn, round(least(1, 0.3 * errors + 0.1 * warnings + 0.3 * (1 - covered)), 6) AS risk FROM c")
def v8(t: Tables) -> DataFrame:
    return covered(t).select("conv_id", "turn", F.round(V.risk(F.col("errors"), F.col("warnings"), F.col("covered")), 6).alias("risk"))


@query("v9_quality", f"{COVER_SQL} SELECT conv_id, turn, round(sections / 5 * 0.3 + CASE WHEN refs THEN 0.2 ELSE 0.1 END + 0.5 * CASE WHEN n < 200 THEN 0.3 ELSE least(1, n / 500 * 0.5 + covered * 0.5) END, 6) AS quality FROM c")
def v9(t: Tables) -> DataFrame:
    return covered(t).select("conv_id", "turn", F.round(V.quality(F.col("sections"), F.col("refs"), F.col("n"), F.col("covered")), 6).alias("quality"))


@query("v10_decision", f"{VERDICTS_SQL}, s AS (SELECT l_orderkey, round(0.4 * confidence + 0.3 * (l_orderkey % 10) / 10 + 0.3 * (l_orderkey % 7) / 7, 9) AS c, is_valid FROM v) SELECT l_orderkey, CASE WHEN is_valid AND c >= 0.7 THEN 'ACCEPT' WHEN c > 0.5 THEN 'REVIEW' ELSE 'REJECT' END AS decision FROM s")
def v10(t: Tables) -> DataFrame:
    safe, good = (F.col("l_orderkey") % 10) / 10, (F.col("l_orderkey") % 7) / 7
    return all_verdicts(t).select("l_orderkey", V.decision(F.col("confidence"), safe, good, F.col("is_valid")).alias("decision"))


@query("v13_line_cleaner", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches(t, 'Licensed|\d{9,}')) AS text, count(*) FILTER (WHERE regexp_matches(t, 'Licensed|\d{9,}')) AS removed FROM l GROUP BY 1""")
def v13(t: Tables) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: ~any_match(x, ["Licensed", r"\d{9,}"]))
    rows = t.documents.where("text is not null").select("doc_id", kept.alias("k"), F.size(F.split("text", "\n")).alias("n"))
    return rows.select("doc_id", F.when(F.size("k") > 0, F.array_join("k", "\n")).alias("text"), (F.col("n") - F.size("k")).cast("long").alias("removed"))


@query("v15_claim_evidence", f"WITH d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), b AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark) SELECT item_id, max(round(len(list_intersect(b.w, d.w)) / greatest(len(b.w), 1), 6)) AS support, max(round(len(list_intersect(b.w, d.w)) / greatest(len(b.w), 1), 6)) > 0.7 AS verified FROM b, d GROUP BY 1")
def v15(t: Tables) -> DataFrame:
    claim = t.benchmark.select("item_id", X.words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    held = t.documents.select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    small = F.broadcast(claim) if claim.limit(100_001).count() <= 100_000 else claim
    shared = held.join(small, "word").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("item_id").agg(F.max(F.round(F.col("c") / F.greatest("n", F.lit(1)), 6)).alias("s"))
    found = t.benchmark.select("item_id").join(best, "item_id", "left")
    return found.select("item_id", F.coalesce("s", F.lit(0.0)).alias("support"), (F.coalesce("s", F.lit(0.0)) > 0.7).alias("verified"))


@query("v16_answer_reasons", r"SELECT doc_id, trim(coalesce(text, ''), ' ') = '' AS empty, regexp_matches(coalesce(text, ''), '[0-9]{6}') AND NOT regexp_matches(coalesce(text, ''), 'License') AS server_error, length(trim(coalesce(text, ''), ' ')) < 30 AS short FROM documents")
def v16(t: Tables) -> DataFrame:
    c = X.filled(F.col("text"))
    return t.documents.select("doc_id", (F.trim(c) == "").alias("empty"), (F.regexp_like(c, F.lit("[0-9]{6}")) & ~F.regexp_like(c, F.lit("License"))).alias("server_error"), X.is_placeholder(c).alias("short"))


@query("v17_status_gate", f"{VERDICTS_SQL} SELECT l_orderkey, CASE WHEN errors > 0 OR l_orderkey % 11 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM v")
def v17(t: Tables) -> DataFrame:
    return all_verdicts(t).select("l_orderkey", F.when((F.col("errors") > 0) | (F.col("l_orderkey") % 11 == 0), "needs_review").otherwise("ok").alias("status"))


@query("v18_change_score", r"WITH d AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(trim(text, ' ')), '\s+')) AS a, list_distinct(regexp_split_to_array(lower(trim(replace(text, 'the', 'a'), ' ')), '\s+')) AS b FROM documents) SELECT doc_id, round(1 - len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS score FROM d")
def v18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.change_score(F.col("text"), F.replace("text", F.lit("the"), F.lit("a"))).alias("score"))


@query("v19_structure_gate", "SELECT doc_id FROM documents WHERE length(text) >= 100 AND contains(text, chr(10))")
def v19(t: Tables) -> DataFrame:
    return t.documents.where((F.length("text") >= 100) & F.contains("text", F.lit("\n"))).select("doc_id")


@query("v20_batch_split", f"{VERDICTS_SQL} SELECT CASE WHEN errors > 0 THEN 'quarantine' ELSE 'valid' END AS output, count(*) AS n, round(avg(confidence), 6) AS confidence FROM v GROUP BY 1")
def v20(t: Tables) -> DataFrame:
    return all_verdicts(t).groupBy(F.when(F.col("errors") > 0, "quarantine").otherwise("valid").alias("output")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
