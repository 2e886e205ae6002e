"""Rules as data: pattern tables unrolled into literals, so that patterns are compiled once and evaluation is lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 2_000


def _checked(rules: Sequence) -> Sequence:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a table of over {MOST_RULES} is to be joined")
    return rules


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (pattern, label) whose pattern is found."""
    made = [F.when(F.regexp_like(text, F.lit(p)), F.lit(label)) for p, label in _checked(rules)]
    return F.coalesce(*made, F.lit(default))


def all_matches(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The labels of all patterns found, in order, once each; ``default`` alone if none is."""
    made = F.array_distinct(F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(label)) for p, label in _checked(rules)])))
    return made if default is None else F.when(F.size(made) == 0, F.array(F.lit(default))).otherwise(made)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return F.regexp_like(text, F.lit("|".join(f"(?:{p})" for p in _checked(patterns))))


def hit_count(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns are found."""
    return sum((F.regexp_like(text, F.lit(p)).cast("int") for p in _checked(patterns)), F.lit(0))


def rule_rows(table: DataFrame, *columns: str) -> list[tuple]:
    """A rule table's rows, for the functions above; refuses a table that is too long to be one."""
    rows = [tuple(r) for r in table.select(*columns).limit(MOST_RULES + 1).collect()]
    return list(_checked(rows))


def weighted_scores(docs: DataFrame, id_col: str, tokens: Column, weights: DataFrame) -> DataFrame:
    """id, category, score, keywords: weights of the keywords (columns category, keyword, weight) among a row's tokens."""
    exploded = docs.select(F.col(id_col), F.explode(F.array_distinct(tokens)).alias("keyword"))
    joined = exploded.join(F.broadcast(weights) if weights.limit(MOST_RULES + 1).count() <= MOST_RULES else weights, "keyword")
    return joined.groupBy(id_col, "category").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_set("keyword")).alias("keywords"))


def confidence(best: Column, second: Column) -> Column:
    """From the distance of the best score to the runner-up: (best - second) / best + min(best / 20, 0.3), at most 1;
    a single class has 1."""
    return F.when(second.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), (best - second) / best + F.least(best / 20, F.lit(0.3))))
