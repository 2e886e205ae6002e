"""Texts whose question keys are too long to match are known by their beginnings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.plans import QUERIES


def test_no_short_key_is_left_out(spark):
    rng = random.Random(9)
    parts = ["<b", ">", "<", "&lt;", "&amp;lt;", "&gt;", "Frage ", "frage 12", "12345", ". ", ":", "ß", "ßß", "é", "Ä", "İ", "wort ", "a b c ", "\n", "  ", "&nbsp;", "!?", "x" * 30, "7" * 90]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(3000)]
    texts += ["Frage " + "1" * 500 + ": kurz", "1" * 500 + ") kurz", "<" + "wort " * 200 + "> kurz", "ß" * 300, "wort " * 200, "&lt;" + "wort " * 200 + "&gt; kurz", None, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    keys = [F.length(X.question_key(F.col("text"), ascii_only)) for ascii_only in (False, True)]
    rows = rows.select("text", X.question_key_within(F.col("text"), 60).alias("within"), F.least(*keys).alias("size")).collect()
    assert all(r["within"] for r in rows if r["size"] <= 60)
    assert sum(not r["within"] for r in rows) > 500


def test_three_tiers_makes_keys_once(spark):
    """Each comparison of a key's length made the key again, of whole texts."""
    result = QUERIES["j11_three_tiers"](spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in result._jdf.queryExecution().executedPlan().toString()
