"""Classification by rule tables: branches of the rules by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lektura.operators import classify as C
from lektura.operators import validate as V

TABLE = [
    ("phrase", 1, "law", "terms of use", 0.0, 0), ("phrase", 2, "care", "informed consent", 0.0, 0),
    ("keyword", 0, "care", "ward", 2.0, 0), ("keyword", 0, "care", "nurse", 3.0, 0), ("keyword", 0, "law", "court", 2.0, 0), ("keyword", 0, "law", "lawsuit", 1.0, 0),
    ("group", 0, "care", "aspirin", 1.5, 0), ("group", 1, "law", "contract", 1.5, 0),
    ("context", 0, "rescue", "siren", 3.0, 2), ("context", 0, "rescue", "shock", 3.0, 2), ("context", 0, "rescue", "acute", 3.0, 2),
    ("against", 0, "law", "moot", 0.0, 0),
]


def rules(spark):
    return C.Rules.read(spark.createDataFrame(TABLE, "kind string, ord int, category string, pattern string, weight double, least int"), default="general")


def found(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r["category"], r["topic"], r["score"], r["method"]) for r in C.categorised(rows, F.col("text"), rules(spark), **more).orderBy("id").collect()]


def test_each_rule_counts(spark):
    texts = ["Nurse, nurse and WARD", "forward", "the court", "a moot court", "court and aspirin, by contract", "contract", "siren and shock", "siren, siren", "informed consent; terms of use", None, "court nurse"]
    assert found(spark, texts) == [
        ("care", "nurse", 5.0, "score"), ("general", "general", 0.0, "none"), ("law", "court", 2.0, "score"), ("law", "court", 1.0, "score"), ("law", "court", 2.0, "score"), ("law", "law", 1.5, "score"),
        ("rescue", "rescue", 3.0, "score"), ("general", "general", 0.0, "none"), ("law", "terms of use", 10.0, "phrase"), ("general", "general", 0.0, "none"), ("care", "nurse", 3.0, "score"),
    ]


def test_little_confidence_is_the_default(spark):
    # 3 against 2: a third, and 3/20.
    assert found(spark, ["court nurse", "nurse"], least_confidence=0.6) == [("general", "general", 3.0, "unsure"), ("care", "nurse", 3.0, "score")]
    assert found(spark, ["court nurse"], least_confidence=0.4) == [("care", "nurse", 3.0, "score")]


def test_source_decides_first(spark):
    rows = spark.createDataFrame([(1, "informed consent", "old/LAW1.txt"), (2, "informed consent", None)], "id long, text string, source string")
    got = C.categorised(rows, F.col("text"), rules(spark), F.col("source"), (("law", "law"),)).orderBy("id").collect()
    assert [(r["category"], r["method"]) for r in got] == [("law", "source"), ("care", "phrase")]


def test_a_rule_less_changes_the_result(spark):
    rows = spark.createDataFrame([(0, "siren and shock, terms of use, moot court, aspirin")], "id long, text string")
    whole = C.categorised(rows, F.col("text"), rules(spark)).drop("text").first()
    for kind in ("phrase",):
        less = C.Rules.read(spark.createDataFrame([r for r in TABLE if r[0] != kind], "kind string, ord int, category string, pattern string, weight double, least int"), default="general")
        assert C.categorised(rows, F.col("text"), less).drop("text").first() != whole


def test_phrases_by_type_and_severity(spark):
    table = spark.createDataFrame([("hedge", "maybe", "low"), ("gap", "i do not know", "high"), ("hedge", "i guess", "medium")], "type string, pattern string, severity string")
    rows = spark.createDataFrame([(1, "maybe. maybe! fine."), (2, "i do not know.\n\n\n\nfine  i guess so. good"), (3, None), (4, "i do not know i do not know")], "id long, text string")
    got = {r["id"]: (r["phrase_score"], r["phrase_hits"], r["phrase_types"], r["phrase_valid"]) for r in V.phrase_check(rows, F.col("text"), table).collect()}
    assert got == {1: (0.9, 2, ["hedge"], True), 2: (0.7, 2, ["gap", "hedge"], True), 3: (1.0, 0, [], True), 4: (0.6, 2, ["gap"], False)}
    clean = lambda least: {r["id"]: r["c"] for r in rows.select("id", V.without_phrases(F.col("text"), table, least).alias("c")).collect()}
    assert clean("low") == {1: "fine.", 2: "good", 3: "", 4: ""} and clean("high") == {1: "maybe. maybe! fine.", 2: "fine i guess so. good", 3: "", 4: ""}
