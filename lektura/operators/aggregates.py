"""Counts, weighted scores, gaps, trends, roll-ups and quality counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the years, from the most recent.
YEAR_WEIGHTS = {2025: 1.0, 2024: 0.55, 2023: 0.30, 2022: 0.17, 2021: 0.10, 2020: 0.06}


def most_common(rows: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Counts by key, most common first, ties by key; the sort keeps n rows a task where n is given."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), *keys).limit(n)


def recency_scores(mentions: DataFrame, weights: dict[int, float] | DataFrame = YEAR_WEIGHTS) -> DataFrame:
    """topic, score, mentions, dated, domains of mentions (topic, year, domain): the sum of the years' weights; no
    year, or one without a weight, weighs nothing. Topics are pre-aggregated by year before they meet the weights."""
    if isinstance(weights, dict):
        weights = mentions.sparkSession.createDataFrame(list(weights.items()), "year int, weight double")
    by_year = mentions.groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"), F.collect_set("domain").alias("domains"))
    joined = by_year.join(F.broadcast(weights) if weights.limit(1001).count() <= 1000 else weights, "year", "left")
    domains = F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains"))))
    return joined.groupBy("topic").agg(
        F.round(F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))), 6).alias("score"),
        F.sum("n").alias("mentions"),
        F.coalesce(F.sum(F.when(F.col("year").isNotNull(), F.col("n"))), F.lit(0)).alias("dated"),
        domains.alias("domains"),
    )


def year_pivot(mentions: DataFrame, years: Sequence[int]) -> DataFrame:
    """topic and a count for each year; the years are given, so no pass finds them."""
    counts = [F.count(F.when(F.col("year") == y, 1)).alias(f"y{y}") for y in years]
    return mentions.groupBy("topic").agg(*counts)


def gap_priority(asked: DataFrame, covered: DataFrame) -> DataFrame:
    """topic, asked, covered, gap, priority for topics asked for: HIGH if the gap is over half of what is asked,
    MEDIUM if there is one, else LOW."""
    both = asked.select("topic", F.col("score").alias("asked")).where("asked > 0").join(covered.select("topic", F.col("score").alias("covered")), "topic", "left")
    gap = F.col("asked") - F.coalesce("covered", F.lit(0.0))
    named = F.when(F.col("gap") > F.col("asked") / 2, "HIGH").when(F.col("gap") > 0, "MEDIUM").otherwise("LOW")
    return both.select("topic", "asked", F.coalesce("covered", F.lit(0.0)).alias("covered"), F.round(gap, 6).alias("gap")).withColumn("priority", named)


def trend(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, a, b, delta, ratio = (b + 1) / (a + 1) over the keys of either period."""
    a = before.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    a_n, b_n = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, key, "full_outer").select(key, a_n.alias("a"), b_n.alias("b"), (b_n - a_n).alias("delta"), F.round((b_n + 1) / (a_n + 1), 6).alias("ratio"))


def top_per_facet(counts: Sequence[DataFrame], facet: str, key: str, n: int) -> DataFrame:
    """Sums of the sources' counts (columns facet, key, n), the n largest of each facet with rank."""
    united = counts[0]
    for more in counts[1:]:
        united = united.unionByName(more)
    sums = united.groupBy(facet, key).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(facet).orderBy(F.desc("n"), key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def matrix(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row, a column for each value, and the total."""
    cells = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    return rows.groupBy(row).agg(*cells, F.count(F.lit(1)).alias("total"))


def quality_counters(rows: DataFrame, by: str, text: Column, server_error: str, error_not: str, short: int) -> DataFrame:
    """By group and overall (null): rows, empty, server_error, short and fine answers; the first reason counts."""
    kept = rows.select(F.col(by), F.coalesce(text, F.lit("")).alias("_t"))
    trimmed = F.trim("_t")
    failed = F.regexp_like("_t", F.lit(server_error)) & ~F.regexp_like("_t", F.lit(error_not))
    reason = F.when(trimmed == "", "empty").when(failed, "server_error").when(F.length(trimmed) < short, "short").otherwise("fine")
    reasons = ("empty", "server_error", "short", "fine")
    cells = [F.count(F.when(F.col("_r") == r, 1)).alias(r) for r in reasons]
    return kept.withColumn("_r", reason).rollup(by).agg(F.count(F.lit(1)).alias("rows"), *cells)


def rates(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and for each condition its count and percentage, to one decimal."""
    cells = []
    for name, holds in conditions.items():
        cells += [F.count(F.when(holds, 1)).alias(name), F.round(100.0 * F.count(F.when(holds, 1)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias(f"{name}_pct")]
    return rows.agg(F.count(F.lit(1)).alias("total"), *cells)


def due_forecast(cards: DataFrame, due: Column, today: str, days: int) -> DataFrame:
    """day, due: cards due on each of the next days, days without any included."""
    spine = cards.sparkSession.range(days).select(F.date_add(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    counts = cards.groupBy(F.to_date(due).alias("day")).agg(F.count(F.lit(1)).alias("due"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("due", F.lit(0)).alias("due"))


def usage_totals(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """By provider and overall (null): requests, tokens and cost; the cost of an event is what it says, or its
    thousands of tokens at the prices."""
    priced = F.coalesce("cost", F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out)
    return usage.rollup("provider").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(priced), 4).alias("cost")
    )


def merged_contexts(rows: DataFrame, key: str, order: str, scalars: Sequence[str], lists: Sequence[str], longest: str) -> DataFrame:
    """One row a key: the first non-null of each scalar, the different items of each list in order, the longest text."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    joined = [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*firsts, *joined, F.max_by(F.col(longest), F.struct(F.length(longest), -F.col(order))).alias(longest))
