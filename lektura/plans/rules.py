"""Classification by large rule tables (K, V12): the rules are rows that Spark derives from the benchmark's words, hundreds of
patterns, all found in one scan of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.functions.automaton import label_hits
from lektura.functions.rules import rule_rows
from lektura.operators import classify as C
from lektura.operators import validate as V
from lektura.operators.joins import ranked_matches
from lektura.plans.checks import choice_sql
from lektura.plans.registry import query
from lektura.session import Tables

#: Words of the benchmark (w, by their first item) and patterns that begin them, 4 to 6 letters long.
WORD_SQL = r"b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{8,}'))) AS w FROM benchmark), w AS (SELECT w, min(item_id) AS i FROM b GROUP BY w)"
RULE_SQL = f"{WORD_SQL}, rt AS (SELECT substr(w, 1, 4 + (i % 3)::INT) AS pattern, min(i) AS i FROM w GROUP BY 1), d AS (SELECT *, lower(text) AS low FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, rt.*, (length(low) - length(replace(low, pattern, ''))) // length(pattern) AS n FROM d JOIN rt ON contains(low, pattern))"


def words(t: Tables) -> DataFrame:
    found = t.benchmark.select("item_id", F.explode(X.words(F.col("text"), 8)).alias("w"))
    return found.groupBy("w").agg(F.min("item_id").alias("i"))


def patterns(t: Tables) -> DataFrame:
    """pattern, i: what begins the words, with the first item that has it."""
    cut = F.substr("w", F.lit(1), (4 + F.col("i") % 3).cast("int")).alias("pattern")
    return words(t).select(cut, "i").groupBy("pattern").agg(F.min("i").alias("i"))


def low(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").withColumn("low", F.lower("text"))


def labelled(t: Tables, labels: int, weight=lambda i: 1.0) -> DataFrame:
    """Documents with ``hits``: a label for each remainder of a pattern's item."""
    rules = [(i % labels, pattern, weight(i)) for pattern, i in rule_rows(patterns(t).orderBy("i", "pattern"), "pattern", "i")]
    return low(t).withColumn("hits", label_hits(F.col("low"), rules))


CATEGORY = "'t' || (i % 6)"
KIND_SQL = "CASE WHEN i % 20 = 7 THEN 'phrase' WHEN i % 10 = 3 THEN 'group' WHEN i % 10 = 5 THEN 'context' WHEN i % 10 = 9 THEN 'against' ELSE 'keyword' END"
TABLE_SQL = rf"""{RULE_SQL}, ru AS (SELECT *, {KIND_SQL} AS kind, CASE WHEN i % 20 = 7 THEN i WHEN i % 10 = 3 THEN i % 3 WHEN i % 10 = 5 THEN i % 2 ELSE 0 END AS ord, {CATEGORY} AS category, 1 + (i % 4) * 0.5::DOUBLE AS weight FROM rt),
    f AS (SELECT d.doc_id, ru.* FROM d JOIN ru ON contains(low, pattern) AND (kind <> 'keyword' OR length(pattern) > 4 OR regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])' || pattern || '($|[^\p{{L}}\p{{N}}_])'))),
    kw AS (SELECT doc_id, category, sum(weight) AS score FROM f WHERE kind = 'keyword' GROUP BY ALL),
    pt AS (SELECT kind, ord, category, max(weight) AS points FROM ru WHERE kind IN ('group', 'context') GROUP BY ALL),
    gr AS (SELECT doc_id, category, points AS score FROM (SELECT doc_id, ord, category, row_number() OVER (PARTITION BY doc_id ORDER BY ord, category) AS n FROM f WHERE kind = 'group') JOIN pt USING (ord, category) WHERE n = 1 AND kind = 'group'),
    cx AS (SELECT doc_id, category, points AS score FROM (SELECT doc_id, ord, category FROM f WHERE kind = 'context' GROUP BY ALL HAVING count(*) >= 2) JOIN pt USING (ord, category) WHERE kind = 'context'),
    al AS (SELECT doc_id, category, sum(score) AS score FROM (FROM kw UNION ALL FROM gr UNION ALL FROM cx) GROUP BY ALL),
    ag AS (SELECT DISTINCT doc_id, category, 0.5::DOUBLE AS half FROM f WHERE kind = 'against'),
    cs AS (SELECT DISTINCT category FROM ru WHERE kind <> 'against' AND kind <> 'phrase'), ph AS (SELECT doc_id, arg_min(category, (ord, category, pattern)) AS phrase_category FROM f WHERE kind = 'phrase' GROUP BY 1),
    s AS (SELECT d.doc_id, source, low, cs.category, coalesce(al.score, 0) * coalesce(half, 1) AS score, phrase_category FROM d CROSS JOIN cs LEFT JOIN al ON al.doc_id = d.doc_id AND al.category = cs.category LEFT JOIN ag ON ag.doc_id = d.doc_id AND ag.category = cs.category LEFT JOIN ph ON ph.doc_id = d.doc_id)"""


def rule_table(t: Tables) -> DataFrame:
    i = F.col("i")
    kind = F.when(i % 20 == 7, "phrase").when(i % 10 == 3, "group").when(i % 10 == 5, "context").when(i % 10 == 9, "against").otherwise("keyword")
    place = F.when(i % 20 == 7, i).when(i % 10 == 3, i % 3).when(i % 10 == 5, i % 2).otherwise(0)
    return patterns(t).select(kind.alias("kind"), place.alias("ord"), F.concat(F.lit("t"), (i % 6).cast("string")).alias("category"), "pattern", (1 + (i % 4) * 0.5).alias("weight"), F.lit(2).alias("least"))


@query("k1_rule_table", f"""WITH {TABLE_SQL}, {choice_sql(C.Rules(exclusive=(("x", "x"),), default="general")).replace("CASE WHEN contains(low, 'x') THEN 'x' END", "phrase_category")}""")
def k1_rules(t: Tables) -> DataFrame:
    rules = C.Rules.read(rule_table(t), default="general")
    return C.categorised(low(t), F.col("text"), rules).select("doc_id", "category", "score", "confidence", "method")


TEMPLATES = ("structured", "law", "ethics", "flexible")


@query("k3_content_type", rf"""WITH {RULE_SQL}, c AS (SELECT doc_id, i % 3 AS type, sum(CASE WHEN i % 5 = 0 THEN 2 ELSE 1 END) AS score FROM h GROUP BY ALL),
    r AS (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type) AS n FROM c),
    x AS (SELECT d.doc_id, CASE WHEN r.type IS NOT NULL THEN r.type WHEN regexp_matches(low, '^(?:the|der|le|el) ') THEN 0 ELSE 3 END AS type, round(CASE WHEN r.type IS NOT NULL THEN score / total WHEN regexp_matches(low, '^(?:the|der|le|el) ') THEN 0.5 ELSE 0.3 END, 6) AS share FROM d LEFT JOIN r ON d.doc_id = r.doc_id AND n = 1)
    SELECT doc_id, type::INT AS type, share, ['{"', '".join(TEMPLATES)}'][type + 1] AS template FROM x""")
def k3(t: Tables) -> DataFrame:
    """Keywords count one, patterns (every fifth item) two; without any, the text's beginning decides."""
    found = labelled(t, 3, lambda i: 2.0 if i % 5 == 0 else 1.0)
    best = F.array_sort(F.transform("hits", lambda x: F.struct((-x["score"]).alias("n"), x["label"].alias("label"))))
    total = F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["score"])
    opening = F.regexp_like("low", F.lit("^(?:the|der|le|el) "))
    made = found.select("doc_id", F.get(best, F.lit(0)).alias("best"), total.alias("total"), opening.alias("opening"))
    kind = F.coalesce("best.label", F.when(F.col("opening"), 0).otherwise(3))
    share = F.coalesce(-F.col("best.n") / F.nullif("total", F.lit(0.0)), F.when(F.col("opening"), 0.5).otherwise(0.3))
    return made.select("doc_id", kind.alias("type"), F.round(share, 6).alias("share"), F.get(F.lit(list(TEMPLATES)), kind).alias("template"))


@query("k4_multi_label", rf"""WITH {WORD_SQL}, d AS (SELECT doc_id, lower(text) AS low, len(string_split_regex(trim(text, ' ' || chr(10)), '\s+')) AS size, lower(coalesce(source, '') || '/' || coalesce(regexp_extract(text, '[\p{{L}}\p{{N}}]{{8,}}'), '')) AS path FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+')) AS w FROM d), n AS (SELECT doc_id, i % 5 AS subject, count(*) * 2 AS score, 0 AS path FROM u JOIN w USING (w) GROUP BY ALL),
    p AS (SELECT doc_id, i % 5 AS subject, 10 * count(*) AS score, count(*) AS path FROM d JOIN w ON contains(path, w.w) GROUP BY ALL),
    s AS (SELECT doc_id, subject, 0.7::DOUBLE * least(1, sum(score) / (any_value(size) * 0.01::DOUBLE)) + 0.3 * sum(a.path) * 0.5 AS score FROM (FROM n UNION ALL FROM p) a JOIN d USING (doc_id) GROUP BY doc_id, subject),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, subject) AS r FROM s WHERE score >= 0.1)
    SELECT d.doc_id, coalesce(string_agg('t' || subject, ',' ORDER BY r), 'general') AS subjects, round(coalesce(max(score), 0), 6) AS best FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND r <= 3 GROUP BY d.doc_id""")
def k4(t: Tables) -> DataFrame:
    """Whole words of the text count two each, a word in the path ten; normed by the text's length, 0.7 of it and 0.3 of
    half a point for each word of the path; the three best subjects of 0.1 and more."""
    known = rule_rows(words(t).orderBy("i", "w"), "w", "i")
    rules = [(i % 5, w, 1.0) for w, i in known]
    path = F.lower(F.concat(X.filled(F.col("source")), F.lit("/"), F.regexp_extract("text", r"[\p{L}\p{N}]{8,}", 0)))
    size = F.size(F.split(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", ""), r"\s+")) * 0.01
    rows = low(t).select("doc_id", size.alias("size"), label_hits(F.col("low"), rules, [True] * len(rules)).alias("text"), label_hits(path, rules).alias("path"))
    of = lambda hits, label, field: F.coalesce(F.get(F.filter(hits, lambda x: x["label"] == label), F.lit(0))[field], F.lit(0))
    score = lambda s: F.lit(0.7) * F.least(F.lit(1.0), (2 * of("text", s, "n") + 10 * of("path", s, "kinds")) / F.col("size")) + F.lit(0.3) * of("path", s, "kinds") * 0.5
    scored = rows.withColumn("s", F.array(*[F.struct(score(s).alias("score"), F.lit(s).alias("subject")) for s in range(5)]))
    kept = F.slice(F.array_sort(F.transform(F.filter("s", lambda x: x["score"] >= 0.1), lambda x: F.struct((-F.round(x["score"], 9)).alias("n"), x["subject"].alias("subject"), x["score"].alias("score")))), 1, 3)
    named = F.array_join(F.transform("k", lambda x: F.concat(F.lit("t"), x["subject"].cast("string"))), ",")
    return scored.select("doc_id", kept.alias("k")).select("doc_id", F.when(F.size("k") == 0, "general").otherwise(named).alias("subjects"), F.round(F.coalesce(F.get("k", F.lit(0))["score"], F.lit(0.0)), 6).alias("best"))


@query("k5_theme_score", rf"""WITH {RULE_SQL}, c AS (SELECT doc_id, 't' || (i % 7) AS theme, least(1, sum(n) * 1000.0::DOUBLE / any_value(length(low)) / 10) AS score FROM h JOIN d USING (doc_id) WHERE length(low) >= 50 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, theme) AS n FROM c) SELECT doc_id, theme, round(score, 6) AS score, score >= 0.5 AS direct FROM r WHERE n <= 3""")
def k5(t: Tables) -> DataFrame:
    """Themes by occurrences in 1,000 characters, the three best; from 50 characters."""
    score = lambda x: F.least(F.lit(1.0), x["n"] * F.lit(1000.0) / F.length("low") / 10)
    ranked = F.slice(F.array_sort(F.transform("hits", lambda x: F.struct((-F.round(score(x), 9)).alias("o"), F.concat(F.lit("t"), x["label"].cast("string")).alias("theme"), score(x).alias("score")))), 1, 3)
    rows = labelled(t, 7).where(F.length("low") >= 50).select("doc_id", F.explode(ranked).alias("x"))
    return rows.select("doc_id", "x.theme", F.round("x.score", 6).alias("score"), (F.col("x.score") >= 0.5).alias("direct"))


@query("k9_priority", rf"""WITH {WORD_SQL}, rt AS (SELECT substr(w, 1, 4 + (i % 3)::INT) AS pattern, min(i) AS i FROM w GROUP BY 1), q AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE text IS NOT NULL),
    h AS (SELECT conv_id, turn, count(*) FILTER (WHERE i % 4 = 0) AS high, count(*) FILTER (WHERE i % 4 = 1) AS medium, count(*) FILTER (WHERE i % 4 = 2) AS points FROM q JOIN rt ON contains(low, pattern) GROUP BY ALL)
    SELECT q.conv_id, q.turn, CASE WHEN coalesce(high, 0) >= 2 THEN 'high' WHEN coalesce(high, 0) = 1 OR coalesce(medium, 0) >= 1 OR length(low) > 500 THEN 'medium' ELSE 'low' END AS priority, (coalesce(points, 0) * 2 + CASE WHEN length(low) > 300 THEN 1 ELSE 0 END)::INT AS complexity
    FROM q LEFT JOIN h ON q.conv_id = h.conv_id AND q.turn = h.turn""")
def k9(t: Tables) -> DataFrame:
    rules = [(i % 4, pattern, 1.0) for pattern, i in rule_rows(patterns(t).orderBy("i", "pattern"), "pattern", "i")]
    rows = t.conversations.where("text is not null").withColumn("hits", label_hits(F.lower("text"), rules))
    kinds = lambda label: F.coalesce(F.get(F.filter("hits", lambda x: x["label"] == label), F.lit(0))["kinds"], F.lit(0))
    n = F.length("text")
    priority = F.when(kinds(0) >= 2, "high").when((kinds(0) == 1) | (kinds(1) >= 1) | (n > 500), "medium").otherwise("low")
    return rows.select("conv_id", "turn", priority.alias("priority"), (kinds(2) * 2 + (n > 300).cast("int")).alias("complexity"))


@query("k13_domains", f"WITH {RULE_SQL}, l AS (SELECT DISTINCT doc_id, i % 8 AS k FROM h) SELECT d.doc_id, coalesce(string_agg('t' || k, ',' ORDER BY k), 'unknown') AS domains FROM d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY 1")
def k13(t: Tables) -> DataFrame:
    named = F.array_join(F.transform("hits", lambda x: F.concat(F.lit("t"), x["label"].cast("string"))), ",")
    return labelled(t, 8).select("doc_id", F.when(F.size("hits") == 0, "unknown").otherwise(named).alias("domains"))


@query("k14_facets", rf"""WITH {WORD_SQL}, rt AS (SELECT substr(w, 1, 4 + (i % 3)::INT) AS pattern, min(i) AS i FROM w GROUP BY 1), q AS (SELECT 'chunk' AS kind, text FROM documents UNION ALL SELECT 'question', text FROM benchmark),
    h AS (SELECT kind, i % 5 AS facet, pattern, count(*) AS n FROM q JOIN rt ON contains(lower(text), pattern) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, facet ORDER BY n DESC, pattern) AS rank FROM h) SELECT kind, facet::INT AS facet, pattern AS term, n, rank::INT AS rank FROM r WHERE rank <= 10""")
def k14(t: Tables) -> DataFrame:
    """The ten terms of each of five facets that most questions and most chunks name."""
    known = rule_rows(patterns(t).orderBy("i", "pattern"), "pattern", "i")
    both = t.documents.select(F.lit("chunk").alias("kind"), "text").union(t.benchmark.select(F.lit("question"), "text"))
    hits = both.where("text is not null").select("kind", F.explode(label_hits(F.lower("text"), [(k, p, 1.0) for k, (p, _) in enumerate(known)])["label"]).alias("k"))
    terms = F.lit([p for p, _ in known])
    counts = hits.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n")).select("kind", F.get(F.lit([i % 5 for _, i in known]), F.col("k")).alias("facet"), F.get(terms, F.col("k")).alias("term"), "n")
    return ranked_matches(counts.withColumn("of", F.struct("kind", "facet")), "of", [F.desc("n"), F.col("term")], 10).drop("of")


@query("k16_emergency", f"WITH {RULE_SQL}, e AS (SELECT doc_id, count(*) AS n FROM h WHERE i % 6 = 1 GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) >= 2 AS emergency FROM d LEFT JOIN e ON d.doc_id = e.doc_id")
def k16(t: Tables) -> DataFrame:
    return labelled(t, 6).select("doc_id", F.exists("hits", lambda x: (x["label"] == 1) & (x["kinds"] >= 2)).alias("emergency"))


@query("k18_image_flag", rf"WITH {RULE_SQL}, g AS (SELECT DISTINCT doc_id FROM h WHERE i % 4 < 2) SELECT d.doc_id, g.doc_id IS NOT NULL OR regexp_matches(low, '\d+ (?:mm|cm|kv)\b') AS relevant FROM d LEFT JOIN g ON d.doc_id = g.doc_id")
def k18(t: Tables) -> DataFrame:
    """Whether a pattern group or a measure says that an image helps."""
    grouped = F.exists("hits", lambda x: x["label"] < 2)
    return labelled(t, 4).select("doc_id", (grouped | F.regexp_like("low", F.lit(r"\d+ (?:mm|cm|kv)\b"))).alias("relevant"))


SEVERITY = ("low", "medium", "high")
COST_SQL = "sum(n * CASE i % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.1 ELSE 0.2 END)"


@query("v12_phrase_score", f"""WITH {RULE_SQL}, c AS (SELECT doc_id, greatest(0, 1 - {COST_SQL}) AS score, sum(n)::BIGINT AS hits, string_agg(DISTINCT 't' || (i % 5), ',' ORDER BY 't' || (i % 5)) AS types FROM h GROUP BY 1)
    SELECT d.doc_id, round(coalesce(score, 1), 6) AS score, coalesce(hits, 0) AS hits, coalesce(types, '') AS types, round(coalesce(score, 1), 6) >= 0.7 AS valid FROM d LEFT JOIN c ON d.doc_id = c.doc_id""")
def v12(t: Tables) -> DataFrame:
    """Phrases of five types and three severities: each occurrence costs by its severity."""
    table = patterns(t).select(F.concat(F.lit("t"), (F.col("i") % 5).cast("string")).alias("type"), "pattern", F.get(F.lit(list(SEVERITY)), (F.col("i") % 3).cast("int")).alias("severity"))
    return V.phrase_check(low(t), F.col("low"), table).select("doc_id", F.col("phrase_score").alias("score"), F.col("phrase_hits").alias("hits"), F.array_join("phrase_types", ",").alias("types"), F.col("phrase_valid").alias("valid"))


@query("v12_without_sentences", rf"""WITH {RULE_SQL}, s AS (SELECT doc_id, unnest(regexp_extract_all(low, '[^.!?\n]*[.!?\n]|[^.!?\n]+')) AS s, generate_subscripts(regexp_extract_all(low, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), 1) AS pos FROM d),
    g AS (SELECT DISTINCT doc_id, pos FROM s JOIN rt ON contains(s, pattern) WHERE i % 3 >= 1),
    k AS (SELECT s.doc_id, string_agg(s, '' ORDER BY s.pos) AS t FROM s ANTI JOIN g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY 1)
    SELECT d.doc_id, trim(regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10)) AS text FROM d LEFT JOIN k ON d.doc_id = k.doc_id""")
def v12b(t: Tables) -> DataFrame:
    """Whole sentences go that hold a phrase of medium or high severity."""
    table = patterns(t).select(F.lit("t").alias("type"), "pattern", F.get(F.lit(list(SEVERITY)), (F.col("i") % 3).cast("int")).alias("severity"))
    return low(t).select("doc_id", V.without_phrases(F.col("low"), table, "medium").alias("text"))
