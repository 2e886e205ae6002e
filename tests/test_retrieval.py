"""Lexical retrieval against all pairs."""

from __future__ import annotations

import numpy as np

from lektura import plans
from lektura.operators import retrieval as R


def tables(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_topic_knowledge_against_all_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    some = ["Alpha", "beta", "gam", "gamma", "Öl", "x", "dé"]
    rows = [(i, " ".join(rng.choice(some, rng.integers(0, 6)))) for i in range(300)] + [(900, None)]
    items = [(i, " ".join(rng.choice(some, rng.integers(1, 5)))) for i in range(30)] + [(50, "beta"), (51, ""), (52, None), (53, "zzz  gam")]
    tables(spark, tmp_path, rows, items)
    want = set()
    for q, text in items:
        if text is not None:
            words = [*text.lower().split(" "), "", ""][:3]
            scored = sorted((-round(sum(x * (w in t.lower()) for w, x in zip(words, (0.5, 0.2, 0.15))), 6), i) for i, t in rows if t is not None)
            want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:3]) if -s > 0.1}
    run = lambda: plans.QUERIES["r6_topic_knowledge"](spark, str(tmp_path))
    assert {tuple(r) for r in run().collect()} == want
    assert "NestedLoop" not in run()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "PATTERNS", 3)  # the form for many queries
    assert {tuple(r) for r in run().collect()} == want


def test_shared_words_against_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(7)
    some = [f"w{x}" for x in range(12)]
    text = lambda: " ".join(rng.choice(some, rng.integers(0, 8)))
    rows, items = [(int(rng.integers(0, 250)), text()) for _ in range(300)] + [(900, None)], [(i, text()) for i in range(30)] + [(50, None)]
    tables(spark, tmp_path, rows, items)
    want = set()
    for q, asked in items:
        count = {}
        for i, t in rows:
            count[i] = count.get(i, 0) + len(set((asked or "").split()) & set((t or "").split()))
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted((-s, i) for i, s in count.items())[:5]) if -s >= 2}
    run = plans.QUERIES["r4_lexical_top_k"](spark, str(tmp_path))
    assert {tuple(r) for r in run.select("qid", "id", "score", "rank").collect()} == want
    few = R.shared_words(run.select("qid", "id").limit(0).selectExpr("qid", "'w1 w2' text"), run.selectExpr("id", "'w1 w2' text").distinct())
    assert few.count() == 0
    alone = spark.createDataFrame([(i, "w1 w2 w3") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "qid long, text string")
    plan = R.shared_words(asked, alone)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Generate" not in plan  # no row for each word that a document and a query have
