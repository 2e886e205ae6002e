"""Facts of texts against what a reference says: doses, numbers within a tolerance, words as they stand."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.operators.similarity import contained_pairs

#: Confidences of the ladder, and from where a fact is verified or uncertain.
DOSE, OTHER_DOSE, NAMED, UNNAMED = 0.9, 0.3, 0.6, 0.5
NUMBER, NO_NUMBER = 0.85, 0.4
CLASS, NO_CLASS, LITERAL, NO_LITERAL = 0.95, 0.4, 0.75, 0.5
VERIFIED, UNCERTAIN = 0.8, 0.5


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers from 0 on differ by less than the share ``tolerance`` of the larger, or of 1 if that is more."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1.0)) < tolerance


def band(x: Column, tolerance: float) -> Column:
    """A number's band: those that are ``close`` lie in one band or in neighbours. Bands are even up to 1, then grow with the
    value, since from 1 on a share of the larger is a distance of logarithms."""
    return F.floor(F.when(x <= 1, x).otherwise(1 + F.log(F.greatest(x, F.lit(1.0)))) / -math.log(1 - tolerance)).cast("long")


def close_values(left: DataFrame, right: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """keys, value: the different values of ``left`` to which one of ``right`` of equal keys is close: a join on bands, not of all
    with all."""
    a = left.select(*keys, "value").where("value >= 0").distinct().withColumn("_band", band(F.col("value"), tolerance))
    b = right.select(*keys, F.col("value").alias("_to")).where("_to >= 0").distinct()
    b = b.withColumn("_band", F.explode(F.array(*[band(F.col("_to"), tolerance) + k for k in (-1, 0, 1)])))
    return a.join(b, [*keys, "_band"]).where(close(F.col("value"), F.col("_to"), tolerance)).select(*keys, "value").distinct()


def checked(facts: DataFrame, doses: DataFrame, numbers: DataFrame, texts: DataFrame, dose_share: float = 0.2, number_share: float = 0.15) -> DataFrame:
    """facts (fid, type, name, unit, value, text) with ``confidence``, ``correct`` and ``status``.

    type ``dose``: a dose of the reference (name, unit, value) of that name and unit is close; else the first of them is the
    correct one; else the reference names the drug (any unit), or does not. ``number``: one of the reference's numbers (value) is close;
    without any number, uncertain. ``class``: the text stands in one of the reference's texts (text); other types alike, with less
    confidence either way. Names and texts are compared in lower case.
    """
    low = facts.withColumns({"_name": F.lower("name"), "_text": F.lower("text")})
    held = doses.select(F.lower("name").alias("_name"), "unit", "value")
    near_dose = close_values(low.where("type = 'dose'").select("_name", "unit", "value"), held, dose_share, "_name", "unit").withColumn("_dose", F.lit(True))
    first = held.groupBy("_name", "unit").agg(F.min("value").alias("_first"))
    named = held.select("_name").distinct().withColumn("_named", F.lit(True))
    near = close_values(low.where("type = 'number'"), numbers, number_share).withColumn("_near", F.lit(True))
    some = numbers.limit(1).count() > 0
    asked = low.where("type not in ('dose', 'number')").select(F.col("_text").alias("sid"), F.col("_text").alias("stext")).distinct()
    stands = contained_pairs(asked, texts.select(F.lower("text").alias("ltext")).distinct().withColumn("lid", F.col("ltext"))).select(F.col("sid").alias("_text")).distinct().withColumn("_stands", F.lit(True))
    found = low.join(near_dose, ["_name", "unit", "value"], "left").join(first, ["_name", "unit"], "left").join(named, "_name", "left").join(near, "value", "left").join(stands, "_text", "left")
    there = lambda c: F.coalesce(c, F.lit(False))
    kind = F.col("type")
    dose = F.when(there("_dose"), DOSE).when(F.col("_first").isNotNull(), OTHER_DOSE).when(there("_named"), NAMED).otherwise(UNNAMED)
    number = F.when(there("_near"), NUMBER).otherwise(NO_NUMBER if some else UNNAMED)
    literal = F.when(kind == "class", F.when(there("_stands"), CLASS).otherwise(NO_CLASS)).otherwise(F.when(there("_stands"), LITERAL).otherwise(NO_LITERAL))
    confidence = F.when(kind == "dose", dose).when(kind == "number", number).otherwise(literal)
    found = found.withColumns({"confidence": confidence, "correct": F.when((kind == "dose") & ~there("_dose"), F.col("_first"))})
    status = F.when(F.col("confidence") >= VERIFIED, "verified").when(F.col("confidence") >= UNCERTAIN, "uncertain").otherwise("incorrect")
    return found.select("fid", "type", "name", "unit", "value", "text", "confidence", "correct", status.alias("status"))
