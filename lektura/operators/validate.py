"""Checks of doses, laboratory values, codes, phrases and answers: issue rows first, verdicts from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.functions.automaton import elements_hit, label_hits
from lektura.functions.rules import rule_rows
from lektura.functions.text import filled

#: Single dose from and to, daily dose, fatal above; units are not converted.
DOSE_RANGES = (
    ("Metformin", "mg", 500.0, 1000.0, 3000.0, 10000.0),
    ("Ramipril", "mg", 1.25, 10.0, 10.0, 50.0),
    ("Metoprolol", "mg", 25.0, 200.0, 400.0, 1000.0),
    ("Amiodaron", "mg", 100.0, 400.0, 800.0, 2000.0),
    ("Methylphenidat", "mg", 5.0, 60.0, 80.0, 200.0),
    ("Ibuprofen", "mg", 200.0, 800.0, 2400.0, 10000.0),
    ("Paracetamol", "mg", 500.0, 1000.0, 4000.0, 15000.0),
    ("Prednisolon", "mg", 5.0, 100.0, 250.0, 1000.0),
    ("Aspirin", "mg", 75.0, 500.0, 3000.0, 20000.0),
    ("Heparin", "IE", 5000.0, 35000.0, 35000.0, 100000.0),
    ("Insulin", "IE", 2.0, 100.0, 200.0, 500.0),
    ("Morphin", "mg", 5.0, 30.0, 200.0, 500.0),
)
#: Normal from and to, critical below and above.
LAB_RANGES = (
    ("Kalium", "mmol/l", 3.5, 5.0, 2.5, 6.5),
    ("Natrium", "mmol/l", 135.0, 145.0, 120.0, 160.0),
    ("Kreatinin", "mg/dl", 0.7, 1.3, None, 10.0),
    ("Hämoglobin", "g/dl", 12.0, 17.0, 6.0, None),
    ("Leukozyten", "/µl", 4000.0, 11000.0, 1000.0, 50000.0),
    ("Thrombozyten", "/µl", 150000.0, 400000.0, 20000.0, None),
    ("Glukose", "mg/dl", 70.0, 100.0, 40.0, 500.0),
    ("HbA1c", "%", 4.0, 6.0, None, 15.0),
    ("Troponin", "ng/ml", None, 0.04, None, 10.0),
    ("CRP", "mg/l", None, 5.0, None, 200.0),
    ("Lipase", "U/l", None, 60.0, None, 1000.0),
    ("TSH", "mU/l", 0.4, 4.0, 0.01, 100.0),
)
DOSE_SCHEMA = "name string, unit string, min_dose double, max_dose double, max_daily double, fatal_above double"
LAB_SCHEMA = "name string, unit string, normal_min double, normal_max double, critical_low double, critical_high double"
#: Words before a number that name a way of giving, not a drug.
ROUTE_WORDS = ("oral", "tgl", "max", "min", "bis", "von", "mit", "und")


def numbers_with_names(rows: DataFrame, key: str, text: Column, units: str) -> DataFrame:
    """key, name, value: each ``name: 1,5 unit`` of the text; names of three letters and more that are no route words."""
    hit = r"([\p{L}][\p{L}\p{N}-]{2,}):?\s+(\d+(?:[.,]\d+)?)\s*(?:" + units + ")"
    found = rows.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(filled(text), F.lit(hit), F.lit(1)).alias("n"), F.regexp_extract_all(filled(text), F.lit(hit), F.lit(2)).alias("v"))).alias("x"))
    value = F.replace("x.v", F.lit(","), F.lit(".")).cast("double")
    return found.select(key, F.col("x.n").alias("name"), value.alias("value")).where(~F.lower("name").isin(*ROUTE_WORDS))


def dose_issues(doses: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """key, name, value, code, severity: an unknown drug; else a fatal dose, and only that; else a dose over the single
    one (a warning while within the daily one) or under it. Ranges are looked up by lower-cased name."""
    joined = doses.withColumn("_k", F.lower("name")).join(ranges.select(F.lower("name").alias("_k"), "min_dose", "max_dose", "max_daily", "fatal_above"), "_k", "left")
    v = F.col("value")
    code = (
        F.when(F.col("max_dose").isNull(), "DRUG_UNKNOWN")
        .when(v > F.col("fatal_above"), "DOSAGE_FATAL")
        .when((v > F.col("max_dose")) & (v <= F.col("max_daily")), "DOSAGE_HIGH")
        .when(v > F.col("max_dose"), "DOSAGE_OVERDOSE")
        .when(v < F.col("min_dose"), "DOSAGE_LOW")
    )
    return _issues(joined, key, code, DOSE_SEVERITY)


DOSE_SEVERITY = {"DRUG_UNKNOWN": "info", "DOSAGE_FATAL": "critical", "DOSAGE_HIGH": "warning", "DOSAGE_OVERDOSE": "error", "DOSAGE_LOW": "warning"}
LAB_SEVERITY = {"LAB_CRITICAL_LOW": "critical", "LAB_CRITICAL_HIGH": "critical", "LAB_LOW": "warning", "LAB_HIGH": "warning"}


def lab_issues(values: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """key, name, value, code, severity: values beyond the critical range, else beyond the normal one."""
    joined = values.withColumn("_k", F.lower("name")).join(ranges.select(F.lower("name").alias("_k"), "normal_min", "normal_max", "critical_low", "critical_high"), "_k")
    v = F.col("value")
    code = F.when(v < F.col("critical_low"), "LAB_CRITICAL_LOW").when(v > F.col("critical_high"), "LAB_CRITICAL_HIGH").when(v < F.col("normal_min"), "LAB_LOW").when(v > F.col("normal_max"), "LAB_HIGH")
    return _issues(joined, key, code, LAB_SEVERITY)


def _issues(rows: DataFrame, key: str, code: Column, severities: dict[str, str]) -> DataFrame:
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in severities.items() for x in pair]), F.col("code"))
    return rows.withColumn("code", code).where("code is not null").select(key, "name", "value", "code", severity.alias("severity"))


def contraindications(rows: DataFrame, key: str, drugs: Column, conditions: Column, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """key, drug, condition, severity for each (drug, condition, severity) rule whose words both lists' texts hold."""
    hits = [F.when(F.contains(filled(drugs), F.lit(d)) & F.contains(filled(conditions), F.lit(c)), F.struct(F.lit(d).alias("drug"), F.lit(c).alias("condition"), F.lit(s).alias("severity"))) for d, c, s in rules]
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("x")).select(key, "x.*")


def verdicts(rows: DataFrame, issues: DataFrame, key: str, has_drug: Column, has_code: Column) -> DataFrame:
    """key, errors, warnings, is_valid, quarantine, confidence. Confidence: 0.2, 0.3 with a checked dose or 0.15
    without, 0.2 with a code, and 0.3 without issues, 0.15 with warnings only."""
    counts = issues.groupBy(key).agg(
        F.count(F.when(F.col("severity").isin("error", "critical"), 1)).alias("errors"), F.count(F.when(F.col("severity") == "critical", 1)).alias("criticals"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings")
    )
    joined = rows.select(key, has_drug.alias("_d"), has_code.alias("_c")).join(counts, key, "left").fillna(0, ["errors", "criticals", "warnings"])
    clean = F.when((F.col("errors") == 0) & (F.col("warnings") == 0), 0.3).when(F.col("errors") == 0, 0.15).otherwise(0.0)
    score = F.lit(0.2) + F.when(F.col("_d"), 0.3).otherwise(0.15) + F.when(F.col("_c"), 0.2).otherwise(0.0) + clean
    return joined.select(key, "errors", "warnings", (F.col("errors") == 0).alias("is_valid"), (F.col("criticals") > 0).alias("quarantine"), F.round(score, 6).alias("confidence"))


def coverage(terms: Column, context_terms: Column) -> Column:
    """Share of the answer's terms that the context has, at least .3; .3 without context, .7 without terms."""
    share = F.size(F.array_intersect(terms, context_terms)) / F.greatest(F.size(terms), F.lit(1))
    return F.when(F.size(context_terms) == 0, 0.3).when(F.size(terms) == 0, 0.7).otherwise(F.greatest(F.lit(0.3), share))


def risk(errors: Column, warnings: Column, covered: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * errors + 0.1 * warnings + 0.3 * (1 - covered))


def quality(sections: Column, has_references: Column, length: Column, overlap: Column) -> Column:
    """A third by sections of five, a fifth by references, half by completeness (short answers: .3)."""
    complete = F.when(length < 200, 0.3).otherwise(F.least(F.lit(1.0), length / 500 * 0.5 + overlap * 0.5))
    return sections / 5 * 0.3 + F.when(has_references, 0.2).otherwise(0.1) + 0.5 * complete


def decision(confidence: Column, safe: Column, good: Column, is_valid: Column, least: float = 0.7) -> Column:
    """ACCEPT where the combined score reaches ``least`` and the row is valid, REVIEW over .5, else REJECT. The score is
    rounded, so that a row on a border does not hang on the last bit."""
    combined = F.round(0.4 * confidence + 0.3 * safe + 0.3 * good, 9)
    return F.when(is_valid & (combined >= least), "ACCEPT").when(combined > 0.5, "REVIEW").otherwise("REJECT")


#: Fixed values of what a phrase of a severity takes from the score.
PHRASE_COST = {"high": 0.2, "medium": 0.1, "low": 0.05}


def phrase_check(rows: DataFrame, text: Column, table: DataFrame, valid_from: float = 0.7) -> DataFrame:
    """rows with phrase_score, phrase_hits, phrase_types and phrase_valid: one less the costs of all occurrences of the
    phrases of ``table`` (type, pattern, severity), at least 0; how many there are, and of which types, sorted."""
    known, costs = sorted(rule_rows(table, "type", "pattern", "severity")), list(PHRASE_COST.values())
    types = sorted({t for t, _, _ in known})
    rules = [(types.index(t) * len(costs) + list(PHRASE_COST).index(severity), pattern, 1.0) for t, pattern, severity in known]
    cost = lambda x: x["n"] * F.get(F.lit(costs), x["label"] % len(costs))
    found = rows.withColumn("_hits", label_hits(filled(text), rules))
    named = F.transform("_hits", lambda x: F.get(F.lit(types), F.floor(x["label"] / len(costs)).cast("int"))) if types else F.array().cast("array<string>")
    found = found.withColumns({
        "phrase_score": F.round(F.greatest(F.lit(0.0), 1 - F.aggregate("_hits", F.lit(0.0), lambda s, x: s + cost(x))), 6),
        "phrase_hits": F.aggregate("_hits", F.lit(0).cast("long"), lambda s, x: s + x["n"]),
        "phrase_types": F.array_distinct(named),
    })
    return found.withColumn("phrase_valid", F.col("phrase_score") >= valid_from).drop("_hits")


def without_phrases(text: Column, table: DataFrame, least: str = "medium") -> Column:
    """The text without the sentences, each up to its ``.``, ``!``, ``?`` or line end, that hold a phrase of at least the severity
    ``least``; then at most one empty line and single spaces, none outside."""
    severities = list(PHRASE_COST)  # the gravest first
    patterns = sorted(p for p, severity in rule_rows(table, "pattern", "severity") if severities.index(severity) <= severities.index(least))
    sentences = F.regexp_extract_all(filled(text), F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), F.lit(0))
    held = F.zip_with(sentences, elements_hit(sentences, patterns), lambda s, hit: F.when(~hit, s))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.array_compact(held), ""), r"\n{3,}", "\n\n"), " {2,}", " "), F.lit(" \n"))


def change_score(before: Column, after: Column) -> Column:
    """How far a text changed: the share of words that only one of the two has."""
    a, b = (F.array_distinct(F.split(F.lower(F.trim(filled(c))), r"\s+")) for c in (before, after))
    return F.round(1 - F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)
