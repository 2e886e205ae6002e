"""Mixing sources to target weights by hash-threshold histograms.

A source's target, over its size, gives whole repeats of all its documents and a rest. The rest takes the documents
whose hash is under a threshold: words are summed by source and leading hash digits, the digit where the sums pass the
budget is the boundary, and only its documents are summed again by their next digits. Nothing is sorted, and a smaller
budget takes a subset of a larger one's documents. At last one document more is taken where that brings a source nearer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.llm.common import WORDS, cut

DIGITS = (3, 7, 12)  # hex digits at each level: 4096 buckets, then 16,384 in the boundary bucket, then what is left
SOURCES_TO_BROADCAST = 100_000


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``cycle`` repeating and share all words by weight. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight, until none is above. That ends where
    the capped sources are the first by size over weight, so one pass over the sources' sums finds it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.row_number().over(order) - 1) % len(cycle) + 1)
    per = per.select("source", "source_size", weight.cast("long").alias("w"))
    ratio = [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("t"),
        F.sum("w").over(every).alias("tw"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("c"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("cw"),
    )
    # A share of what the sources before it, all capped, leave; the first source that its share suits sets all later ones.
    share = (F.col("t") - most * F.col("c")) / (F.col("tw") - F.col("cw")).cast("double")
    per = per.select("*", share.alias("share"), (share * F.col("w") <= most * F.col("source_size")).alias("fits"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "share"))).over(every)
    target = F.least(level["share"] * F.col("w"), (most * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, rounds: int = 3) -> DataFrame:
    """All columns of docs and ``_size``, ``_source_size``, ``_target``, ``_taken``, ``_copies``.

    _size is the number of words (null text: 0); _taken = _copies x _size, _copies from 0 to ``most``, whole documents.
    In each of ``rounds`` rounds, the documents not yet taken again that fit what is left of the budget are taken in
    hash order up to the first that does not fit; so a long document costs no more than what remains after short ones.
    Then the document whose size is nearest to what is left, the first by hash of equals, is taken if the source then
    is nearer to its target, above or below it.
    The hash is of the id's text (null: empty), so reruns agree; rows of one id have one hash and go together.
    A source without words has target 0; an empty table gives an empty result. Columns of docs may have any names that
    do not begin with an underscore.
    """
    hashed = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, DIGITS[-1])
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(source_col).alias("source"), size.alias("size"), hashed.alias("h")))
    goal = targets(rows, cycle, most).withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size")))
    small = goal.count() <= SOURCES_TO_BROADCAST

    def with_source(left: DataFrame, per: DataFrame) -> DataFrame:
        """Rows of left with what ``per`` has for their source; a null source is a source."""
        per = per.withColumnRenamed("source", "_k")
        return left.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("_k"))).drop("_k")

    extra = F.lit(False)
    for turn in range(rounds):
        gap, under = f"gap{turn}", f"under{turn}"
        goal = goal.withColumn(gap, F.col("rest")).withColumn("prefix", F.lit("")).withColumn("open", F.lit(True))
        fit = with_source(rows.where("size > 0"), goal.drop("source_size", "target", "repeats", "rest", "prefix", "open")).where((F.col("size") <= F.col(gap)) & ~extra).select("source", "size", "h")
        for digits in DIGITS:
            goal = cut(_refined(fit, goal, digits, small))  # each level reads it twice
        # A boundary at the last level is the first hash left out; without one everything that fits is taken.
        goal = goal.withColumn(under, F.when(F.col("open"), F.col("prefix")).otherwise(F.lit("g"))).drop("prefix", "open")
        extra = extra | ((F.col("size") <= F.col(gap)) & (F.col("h") < F.col(under)))
    goal = _nearest_more(with_source(rows.where("size > 0"), goal.drop("source_size", "target", "repeats")).where((F.col("rest") > 0) & ~extra), goal, small)
    bounds = [F.struct(F.col(f"gap{turn}").alias("gap"), F.col(f"under{turn}").alias("under")) for turn in range(rounds)]
    state = goal.select(F.col("source").alias("_k"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("repeats").alias("_repeats"), F.array(*bounds).alias("_bounds"), F.col("more").alias("_more"))
    found = docs.withColumns({"_size": size, "_h": hashed}).join(F.broadcast(state) if small else state, F.col(source_col).eqNullSafe(F.col("_k")))
    again = (F.col("_size") > 0) & (F.exists("_bounds", lambda b: (F.col("_size") <= b["gap"]) & (F.col("_h") < b["under"])) | F.col("_h").eqNullSafe(F.col("_more")))
    found = found.withColumn("_copies", (F.col("_repeats") + again.cast("long")).cast("long"))
    return found.withColumn("_taken", F.col("_copies") * F.col("_size")).drop("_k", "_h", "_repeats", "_bounds", "_more")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, size, source_size, target, taken, copies of each row, as ``mixed`` finds them."""
    names = ("size", "source_size", "target", "taken", "copies")
    return mixed(docs, id_col, **options).select(id_col, *[F.col(f"_{n}").alias(n) for n in names])


def _nearest_more(left: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """goal with ``more``, the hash of the documents left (source, size, h, rest) that one source takes besides, or null.
    Rows that repeat an id have one hash and come together, so what they sum to is looked at again."""
    off = F.abs(F.col("size") - F.col("rest"))
    best = left.groupBy(F.col("source").alias("_k")).agg(F.min(F.struct(off.alias("d"), "h"))["h"].alias("more"))
    chosen = left.join(F.broadcast(best) if small else best, F.col("source").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("more")))
    sums = chosen.groupBy("_k", "more").agg(F.sum("size").alias("n"), F.max("rest").alias("r")).where(F.abs(F.col("n") - F.col("r")) < F.col("r")).select("_k", "more")
    return cut(goal.join(F.broadcast(sums) if small else sums, F.col("source").eqNullSafe(F.col("_k")), "left").drop("_k"))


def _refined(fit: DataFrame, goal: DataFrame, digits: int, small: bool) -> DataFrame:
    """goal with the boundary found to so many digits: ``prefix`` is the bucket where the sums of the level pass
    ``rest``, and rest loses what lies before it. A source whose documents all fit is no longer open."""
    state = goal.where("open").select(F.col("source").alias("_k"), F.col("prefix").alias("_p"), F.col("rest").alias("was"))
    inside = fit.join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("_k")) & F.col("h").startswith(F.col("_p")))
    sums = inside.groupBy("source", "was", F.substring("h", 1, digits).alias("b")).agg(F.sum("size").alias("n"))
    passed = sums.withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
    edge = passed.groupBy(F.col("source").alias("_k")).agg(
        F.min(F.when(F.col("run") > F.col("was"), F.col("b"))).alias("edge"),
        F.coalesce(F.max(F.when(F.col("run") <= F.col("was"), F.col("run"))), F.lit(0)).alias("used"),
    )
    found = goal.join(F.broadcast(edge) if small else edge, F.col("source").eqNullSafe(F.col("_k")), "left").drop("_k")
    more = F.col("open") & F.col("edge").isNotNull()
    rest = F.when(F.col("open"), F.col("rest") - F.coalesce("used", F.lit(0))).otherwise(F.col("rest"))
    return found.withColumns({"prefix": F.when(more, F.col("edge")).otherwise(F.col("prefix")), "rest": rest, "open": more}).drop("edge", "used")
