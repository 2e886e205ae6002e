"""Every query that SQL can express, against DuckDB over the driver's small tables, and fixtures with known results."""

from __future__ import annotations

import difflib
import json
import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lektura import plans
from lektura.functions import text as X
from lektura.functions.rules import confidence, first_match
from lektura.operators import aggregates, extract, joins, ranking, retrieval, similarity, validate
from lektura.sources import readers
from lektura.streaming import reviews

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda x: sorted(tuple(map(plain, r)) for r in x[columns].itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_review_fold_by_hand(spark):
    for (ef, reps, interval, q), want in {(2.5, 0, 1, 3): (1, 1, 2.36), (2.5, 1, 1, 4): (6, 2, 2.5), (2.5, 2, 1, 5): (2, 3, 2.6), (2.6, 3, 10, 4): (26, 4, 2.6), (2.5, 5, 20, 0): (1, 0, 1.7)}.items():
        state = F.struct(F.lit(ef).alias("ef"), F.lit(interval).cast("long").alias("interval"), F.lit(reps).alias("reps"))
        s = spark.range(1).select(reviews.review_step(state, F.lit(q)).alias("s")).first()["s"]
        assert (s["interval"], s["reps"], round(s["ef"], 6)) == want
        new_ef, new_interval, new_reps = reviews.python_step(ef, interval, reps, q)
        assert (new_interval, new_reps, round(new_ef, 6)) == want


def test_review_stream_equals_fold(spark):
    rows = lambda name: {r["card"]: (round(r["ef"], 5), r["interval"], r["reps"], r["reviews"]) for r in plans.QUERIES[name](spark, DATA).collect()}
    assert rows("t2_review_stream") == rows("t2_review_fold")


def test_dose_issues_by_hand(spark):
    texts = spark.createDataFrame([(1, "Metformin 20000 mg"), (2, "Ibuprofen 1000 mg"), (3, "Ramipril 20 mg"), (4, "oral 5 mg"), (5, "Unbekanntin 5 mg"), (6, None)], "id long, text string")
    ranges = spark.createDataFrame(validate.DOSE_RANGES, validate.DOSE_SCHEMA)
    found = {r["id"]: (r["code"], r["severity"]) for r in validate.dose_issues(validate.numbers_with_names(texts, "id", F.col("text"), "mg|IE"), "id", ranges).collect()}
    assert found == {1: ("DOSAGE_FATAL", "critical"), 2: ("DOSAGE_HIGH", "warning"), 3: ("DOSAGE_OVERDOSE", "error"), 5: ("DRUG_UNKNOWN", "info")}
    labs = spark.createDataFrame([(1, "Kalium: 7.0 mmol/l")], "id long, text string")
    r = validate.lab_issues(validate.numbers_with_names(labs, "id", F.col("text"), "mmol/l"), "id", spark.createDataFrame(validate.LAB_RANGES, validate.LAB_SCHEMA)).first()
    assert r["code"] == "LAB_CRITICAL_HIGH"


def test_classes_gaps_budget_and_confidence(spark):
    topics = spark.range(10)
    classes = [r["class"] for r in ranking.percentile_classes(topics, [F.col("id")]).orderBy("rank").collect()]
    assert classes == ["HIGH"] * 2 + ["MEDIUM"] * 3 + ["LOW"] * 5
    assert ranking.percentile_classes(topics.limit(1), [F.col("id")]).first()["class"] == "HIGH"
    asked = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", 0.0)], "topic string, score double")
    covered = spark.createDataFrame([("a", 0.5), ("b", 1.5), ("c", 3.0)], "topic string, score double")
    assert {r["topic"]: r["priority"] for r in aggregates.gap_priority(asked, covered).collect()} == {"a": "HIGH", "b": "MEDIUM", "c": "LOW"}
    mentions = spark.createDataFrame([("t", 2025, "x"), ("t", 2024, "y"), ("t", None, "x")], "topic string, year int, domain string")
    assert aggregates.recency_scores(mentions).first()["score"] == 1.55
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate((1000, 1500, 900, 100))], "k string, i int, n int")
    assert [r["i"] for r in ranking.budget_prefix(rows, ["k"], [F.col("i")], F.col("n"), 3000).collect()] == [0, 1]
    assert [r["i"] for r in ranking.budget_prefix(rows, ["k"], [F.col("i")], F.col("n"), 1400, per_block=True).collect()] == [0]
    assert round(spark.range(1).select(confidence(F.lit(6.0), F.lit(3.0)).alias("c")).first()["c"], 6) == 0.8


def test_chunks_by_hand(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    rows = [r["piece"] for r in extract.chunks(spark.createDataFrame([(text,)], "text string"), F.col("text")).orderBy("chunk").collect()]
    assert rows == [text[:400], text[300:700], text[600:]]
    few = "\n\n".join(["p" * 200, "q" * 200, "r" * 200])
    assert [r["piece"] for r in extract.chunks(spark.createDataFrame([(few,)], "text string"), F.col("text")).orderBy("chunk").collect()] == ["p" * 200 + "\n\n" + "q" * 200, "r" * 200]


def test_running_numbers_of_a_key_with_all_rows(spark):
    rows = spark.range(5000).selectExpr("id", "cast(null as string) as k", "pmod(id * 7919, 5000) as o", "if(id % 5 = 0, null, id % 11) as v")
    dealt = ranking.dealt_in_order(rows, ["k"], [F.col("o")])
    assert dealt.select("_part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r["o"], r["n"], r["run"]) for r in ranking.running(rows, ["k"], [F.col("o")], "n", {"run": F.col("v")}).collect())
    by_order = sorted((r["o"], r["v"] or 0) for r in rows.collect())
    total, want = 0, []
    for n, (o, v) in enumerate(by_order, 1):
        total += v
        want.append((o, n, total))
    assert got == want
    few = spark.createDataFrame([("a", 2, 1.5), ("b", 1, 2.5), ("a", 1, None), (None, 1, 1.0)], "k string, o int, v double")
    got = {(r["k"], r["o"]): (r["n"], r["run"]) for r in ranking.running(few, ["k"], [F.desc("o")], "n", {"run": F.col("v")}).collect()}
    assert got == {("a", 2): (1, 1.5), ("a", 1): (2, 1.5), ("b", 1): (1, 2.5), (None, 1): (1, 1.0)}
    assert ranking.running(few.limit(0), ["k"], [F.col("o")], "n").count() == 0


def test_tiered_match_loses_nothing(spark):
    blocks = [(i, f"k{i % 3}", f"what is the meaning of entry number {i} in the {'longer ' * (i % 5)}list?") for i in range(60)]
    asked = [(i, f"k{i % 3}", t.replace("meaning", "meanings") if i % 4 else t) for i, _, t in blocks] + [(100, "k0", "short?"), (101, "k1", "nothing of this kind is here at all")]
    found = {r["qid"]: (r["bid"], r["method"]) for r in similarity.tiered_match(spark.createDataFrame(asked, "qid int, k string, qtext string"), spark.createDataFrame(blocks, "bid int, k string, btext string"), ["k"], ["bid"]).collect()}
    for qid, k, q in asked:
        same = [b for b, bk, t in blocks if bk == k and t == q]
        if same:
            want = (min(same), "exact")
        elif len(q) < 20:
            want = (None, "too short")
        else:
            needed = 0.95 if len(q) < 50 else 0.92 if len(q) < 120 else 0.90
            scores = sorted(((difflib.SequenceMatcher(None, q, t).ratio(), -b) for b, bk, t in blocks if bk == k), reverse=True)
            want = (None, "none") if scores[0][0] < needed else (None, "ambiguous") if len(scores) > 1 and scores[0][0] - scores[1][0] < 0.02 else (-scores[0][1], "fuzzy")
        assert found[qid] == want


def test_consume_once(spark):
    left = spark.createDataFrame([("q", 1), ("q", 2)], "k string, l int")
    right = spark.createDataFrame([("q", 1, "x")], "k string, r int, v string")
    rows = {r["l"]: (r["v"], r["matched"]) for r in joins.consume_once(left, right, ["k"], "l", "r", "v").collect()}
    assert rows == {1: ("x", True), 2: (None, False)}


def test_cosine_raises_tier_one_first(spark):
    kb = spark.createDataFrame([(1, [0.29, (1 - 0.29**2) ** 0.5], 1), (2, [0.29, (1 - 0.29**2) ** 0.5], 2), (3, [0.0, 0.0], 1), (4, [1.0], 1), (5, None, 1)], "id long, embedding array<double>, tier int")
    rows = retrieval.cosine_top_k(spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>"), kb).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(1, 0.319)]


def test_tree_skips_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "a", 0), (2, 1, "b", 0), (3, 2, "c", 1), (4, 5, "x", 0), (5, 4, "y", 0)], "id long, parent long, name string, nth int")
    assert {r["id"]: r["path"] for r in extract.tree_paths(nodes).collect()} == {1: "a", 2: "a > b", 3: "a > b > c"}


def test_texts(spark):
    row = spark.createDataFrame([("  Größe #Tag  ", "x" * 29, None)], "a string, b string, n string")
    r = row.select(X.tag_key(F.col("a")).alias("t"), X.is_placeholder(F.col("b")).alias("p"), X.is_placeholder(F.concat("b", F.lit("y"))).alias("q"), X.ws_lower(F.col("n")).alias("n"), X.clean_unicode(F.lit("a b c﻿")).alias("c"), X.nfkc_key(F.lit("1) ﬁne­ Straße?")).alias("k"), first_match(F.col("n"), [("a", "b")], "none").alias("m")).first()
    assert tuple(r) == ("groesse_tag", True, False, "", "a b c", "fine strasse", "none")


def test_readers(spark, tmp_path):
    write = lambda name, text: (Path(tmp_path, name).write_text(text, encoding="utf-8"), f"file://{tmp_path}/{name}")[1]
    qa = write("qa.json", json.dumps({"qa_pairs": [{"frage": "A?", "antwort": ""}, {"question": "B?", "answer": "yes"}]}))
    assert [r["question"] for r in readers.read_qa(spark, qa).collect()] == ["A?"]
    blocks = write("blocks.json", json.dumps([{"block_id": "b", "source_file": "f", "context": ["c"], "questions": ["Q1?", " ", "Q2?"]}, {"frage": "Q3?"}]))
    assert sorted(r["question"] for r in readers.read_qa(spark, blocks).collect()) == ["Q1?", "Q2?", "Q3?"]
    cards = readers.read_cards(spark, write("cards.tsv", 'a\tb\tt1\tt2\nonly\n"q ""x"""\ty\n')).collect()
    assert [(r["front"], r["back"], r["tags"]) for r in cards][0] == ("a", "b", "t1 t2") and len(cards) == 2
    out = f"file://{tmp_path}/out"
    readers.write_cards(spark.createDataFrame([("a\tb\nc", "d")], "front string, back string"), out, "front", "back")
    assert spark.read.text(out).first()["value"] == "a    b<br>c\td"
    inventory = readers.read_inventory(spark, write("i.csv", "index,fachgebiet,source_file,frage,issues,sources\n1,a,f,q,i,s\nx,a,f,q,i,s\n")).collect()
    assert [r["index"] for r in inventory] == [1]
    long = "w" * 250
    found = readers.read_blocks(spark, write("t2023.txt", f"{long} am 3.4.2022\n\nshort\n\n{long}")).orderBy("pos").collect()
    assert [r["year"] for r in found] == [2022, 2023]
    md = readers.read_markdown_cards(spark, write("c.md", "# x\n## Frage 1\n**What?**\n### Antwort\nThis\nthat\n### Quelle\nno\n## Frage 2\n**Empty?**\n")).collect()
    assert [(r["number"], r["question"], r["answer"]) for r in md] == [(1, "What?", "This\nthat")]
    report = readers.read_report(spark, write("r.json", json.dumps({"text": " ", "messages": ["a", {"text": "b"}]}))).first()
    assert report["text"] == "a\nb"
    files = readers.file_inventory(spark, f"file://{tmp_path}")
    assert files.where("suffix = '.tsv'").count() == 1 and readers.newest_file(files, r"\.json$").count() == 1
    place = readers.write_version(spark.range(3), f"file://{tmp_path}/v", "1")
    assert spark.read.parquet(place).count() == 3
    with pytest.raises(Exception, match="exists"):
        readers.write_version(spark.range(3), f"file://{tmp_path}/v", "1")
    assert readers.not_done(spark.range(5), spark.range(3), "id").count() == 2
    assert readers.guard_loss(10, 9) == "ok" and readers.guard_loss(10, 3) == "warn"
    with pytest.raises(readers.Lost):
        readers.guard_loss(100, 5)


def test_categories(spark):
    from lektura.operators import classify

    rules = classify.Rules(
        exclusive=(("totenschein ausstellen", "forensic"),),
        keywords=(("cardio", "ekg", 2.0), ("cardio", "herz", 1.0), ("surgery", "operation", 3.0), ("law", "arzthaftung", 2.5)),
        codes=(("I", "cardio"), ("ST", "surgery")),
        other_codes="general",
        groups=((("betablocker", "nitrat"), "cardio", 1.5), (("propofol",), "anaesthesia", 1.5)),
        against=(("surgery", ("chronisch", "ambulant")),),
        default="general",
    )
    cases = {
        "Wie soll man einen Totenschein ausstellen? EKG Operation": ("forensic", 10.0, 1.0, "phrase"),
        "EKG beim Herzinfarkt": ("cardio", 2.0, 1.0, "score"),  # herz has four letters and is no whole word here
        "Das EKG, das Herz": ("cardio", 3.0, 1.0, "score"),
        "Operation bei S72.0": ("surgery", 5.0, 1.0, "score"),
        "Chronisch: Operation bei S72.0 und EKG": ("surgery", 2.5, 0.325, "score"),
        "Diagnose J18.9": ("general", 2.0, 1.0, "score"),
        "Propofol und Nitrat": ("cardio", 1.5, 1.0, "score"),  # the first group counts
        "": ("general", 0.0, 0.0, "none"),
        None: ("general", 0.0, 0.0, "none"),
    }
    rows = spark.createDataFrame([(t, "x_Forensik.pdf" if t == "" else None) for t in cases], "text string, source string")
    found = {r["text"]: (r["category"], r["score"], r["confidence"], r["method"]) for r in classify.categorised(rows, F.col("text"), rules).collect()}
    assert found == cases
    named = classify.categorised(rows, F.col("text"), rules, F.col("source"), (("forensik", "forensic"),)).where("source is not null").first()
    assert (named["category"], named["method"]) == ("forensic", "source")


def test_deep_trees_and_wide_cards(spark, tmp_path):
    from lektura.operators import extract

    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", 0) for i in range(33)] + [(90, 91, "loop", 0), (91, 90, "loop", 0)], "id long, parent long, name string, nth int")
    paths = extract.tree_paths(nodes).collect()
    assert len(paths) == 33 and max(r["depth"] for r in paths) == 32
    Path(tmp_path, "wide.tsv").write_text("a\tb" + "".join(f"\tt{i}" for i in range(30)) + "\n")
    assert readers.read_cards(spark, f"file://{tmp_path}/wide.tsv").first()["tags"].split() == [f"t{i}" for i in range(30)]


def test_cosine_by_blocks(spark, monkeypatch):
    from lektura.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "KB_BLOCK", 30)
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    kb = e.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") < 3, 1).otherwise(2).alias("tier"))
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "embedding").union(spark.createDataFrame([(-1, [0.0, 0.0]), (-2, None)], "qid long, embedding array<float>"))
    rows = lambda few: sorted(map(tuple, retrieval.cosine_top_k(asked, kb, k=4, few=few).collect()))
    assert rows(0) == rows(5_000) != []


def test_review_stream_of_files_out_of_order(spark, tmp_path):
    """Files that come in another order than their reviews were made leave the same states as the fold."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    place = f"file://{tmp_path}/events.parquet"
    for k in (2, 0, 3, 1):  # by time, but written out of order; more files than one batch takes
        for half in (1, 0):
            events.where((F.col("event_id") * 4 / events.count()).cast("int") == k).where(f"event_id % 2 = {half}").coalesce(1).write.mode("append").parquet(place)
    got = plans.QUERIES["t2_review_stream"](spark, f"file://{tmp_path}")
    want = plans.QUERIES["t2_review_fold"](spark, f"file://{tmp_path}")
    rows = lambda df: sorted(map(tuple, df.select("card", "ef", "interval", "reps", "reviews").collect()))
    assert rows(got) == rows(want)


def test_weights_of_a_file(spark, tmp_path):
    Path(tmp_path, "weights.json").write_text(json.dumps({"cardio": {"ekg": 2.5, "herz": 1}, "none": {}}))
    weights = readers.read_weights(spark, f"file://{tmp_path}/weights.json")
    assert sorted(map(tuple, weights.collect())) == [("cardio", "ekg", 2.5), ("cardio", "herz", 1.0)]
    from lektura.functions.rules import weighted_scores

    rows = spark.createDataFrame([(1, ["ekg", "herz", "ekg"])], "id long, w array<string>")
    assert [(r["category"], r["score"]) for r in weighted_scores(rows, "id", F.col("w"), weights).collect()] == [("cardio", 3.5)]


def test_exam_items_and_trimmed_chunks(spark):
    from lektura.operators import extract

    cases = {
        "Frage?\nAntwort: 1) Aspirin geben\n2. EKG schreiben\n3) aspirin geben": ["Aspirin geben", "EKG schreiben"],
        "Frage?\nTherapie:\n• Ruhe halten\n• 42\n* Wasser trinken": ["Ruhe halten", "Wasser trinken"],
        "Frage?\n\nBlut abnehmen; Labor rufen;Rest": ["Blut abnehmen", "Labor rufen;Rest"],
        "Frage ohne Antwort": [],
        None: [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    found = {r["text"]: r["x"] for r in rows.select("text", extract.exam_items(extract.exam_answer(F.col("text"))).alias("x")).collect()}
    assert found == cases
    long = "0 " + "w" * 300
    pieces = [r["piece"] for r in extract.chunks(spark.createDataFrame([(f" {long} \n\n{long}1 ",)], "text string"), F.col("text")).orderBy("chunk").collect()]
    assert pieces == [long, long + "1"]


def test_two_sided_difference_reduces_keys_before_any_shuffle(spark):
    from lektura.operators.joins import two_sided_difference

    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "k string")
    b = spark.createDataFrame([("y",), ("z",), ("z",), (None,)], "k string")
    got = two_sided_difference(a, b, "k")
    assert sorted(map(tuple, got.collect()), key=str) == [("x", "left"), ("z", "right"), (None, "left"), (None, "right")]
    assert two_sided_difference(a.limit(0), b, "k").count() == 3 and two_sided_difference(a, b.limit(0), "k").count() == 3
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_of_rows_sorts_in_little_memory():
    import tracemalloc

    import numpy as np

    from lektura.operators.retrieval import first_of_rows

    rng = np.random.default_rng(4)
    score, ids = np.round(rng.random((512, 2048)), 2), rng.permutation(2048)
    want = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=-1)[:, :10]
    tracemalloc.start()
    assert (first_of_rows(score, ids, 10) == want).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak, score.nbytes)
    assert peak < score.nbytes / 2
