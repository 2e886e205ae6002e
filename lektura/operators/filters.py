"""Row filters and derived text of question and card records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.functions.text import filled


def answerable(rows: DataFrame, question: Column, has_context: Column, starters: Sequence[str], least: int = 15) -> DataFrame:
    """Questions long enough, with a question mark or a question word first, that do not break off unless context follows."""
    asks = F.contains(question, F.lit("?")) | F.regexp_like(F.lower(question), F.lit(f"^(?:{'|'.join(starters)}) "))
    return rows.where((F.length(question) >= least) & asks & (~F.regexp_like(question, F.lit("[,.]$")) | has_context))


def skip_category(rows: DataFrame, question: Column, answered: Column, fragment: int, short: int, keywords: str, generic: str, specific: str) -> DataFrame:
    """Adds ``category``: answered, fragment, too_short, generic or keep, the first that holds."""
    lower = F.lower(question)
    category = (
        F.when(answered, "answered")
        .when((F.length(question) < fragment) & ~F.contains(question, F.lit("?")), "fragment")
        .when((F.length(question) < short) & ~F.regexp_like(lower, F.lit(keywords)), "too_short")
        .when(F.regexp_like(lower, F.lit(generic)) & ~F.regexp_like(lower, F.lit(specific)), "generic")
        .otherwise("keep")
    )
    return rows.withColumn("category", category)


def followup_reason(question: Column, conjunctions: Sequence[str], pronouns: Sequence[str], short: int = 40) -> Column:
    """Why a question needs the one before it: short, conjunction or pronoun; null if it does not."""
    lower = F.lower(question)
    return (
        F.when(F.length(question) < short, "short")
        .when(F.regexp_like(lower, F.lit(f"^(?:{'|'.join(conjunctions)})[ ,]")), "conjunction")
        .when(F.regexp_like(lower, F.lit(f"(?:^| )(?:{'|'.join(pronouns)})(?: |$)")), "pronoun")
    )


def with_all(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have something in every column."""
    for c in columns:
        rows = rows.where(F.trim(filled(F.col(c))) != "")
    return rows


def excluded(rows: DataFrame, tags: Column, source: Column, tag_words: Sequence[str], source_words: Sequence[str]) -> DataFrame:
    """Adds excluded and reason (tag, source or empty)."""
    by_tag = F.exists(F.array(*map(F.lit, tag_words)), lambda w: F.contains(filled(tags), w))
    by_source = F.exists(F.array(*map(F.lit, source_words)), lambda w: F.contains(filled(source), w))
    return rows.withColumns({"excluded": by_tag | by_source, "reason": F.when(by_tag, "tag").when(by_source, "source").otherwise("")})


def ready_cards(rows: DataFrame, ready: Column, **columns: Column) -> DataFrame:
    """Cards in their first state, of the rows that are ready."""
    state = {"easiness_factor": F.lit(2.5), "interval": F.lit(1), "repetitions": F.lit(0)}
    return rows.where(ready).select(*[c.alias(n) for n, c in (columns | state).items()])


def case_front(question: Column, age: Column, gender: Column, findings: Column, shown: int = 3) -> Column:
    """The question led by its case: age, gender, the first findings and how many more there are."""
    more = F.when(F.size(findings) > shown, F.concat(F.lit("+"), (F.size(findings) - shown).cast("string")))
    seen = F.nullif(F.array_join(F.slice(findings, 1, shown), ", "), F.lit(""))
    case = F.concat_ws(", ", F.concat(F.lit("Patient "), age.cast("string")), gender, seen, more)
    return F.when(case == "", question).otherwise(F.concat(case, F.lit(": "), question))


def joined_text(always: Sequence[Column], more: Sequence[Column], repaired: Column) -> Column:
    """Lower-cased text to classify; further fields count for repaired rows only."""
    return F.lower(F.concat_ws(" ", *always, *[F.when(repaired, c) for c in more]))
