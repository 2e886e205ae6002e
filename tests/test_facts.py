"""Fact checks and trees by hand and against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lektura import plans
from lektura.operators import extract as E
from lektura.operators import facts


@pytest.mark.parametrize("tolerance", [0.15, 0.2])
def test_no_close_value_is_lost(spark, tolerance):
    rng = np.random.default_rng(3)
    a = [0.0, 1.0, 1 - tolerance, 1 / (1 - tolerance)] + [float(x) for x in np.concatenate([rng.random(150) * 3, np.exp(rng.normal(size=150) * 6)])]
    b = [0.0, 1.0] + [float(x) for x in np.concatenate([rng.random(20) * 3, np.exp(rng.normal(size=40) * 6)])]
    frame = lambda xs: spark.createDataFrame([(k % 2, x) for k, x in enumerate(xs)], "k int, value double")
    got = {(r["k"], r["value"]) for r in facts.close_values(frame(a), frame(b), tolerance, "k").collect()}
    want = {(k % 2, x) for k, x in enumerate(a) for n, y in enumerate(b) if n % 2 == k % 2 and abs(x - y) / max(x, y, 1) < tolerance}
    assert got == want and 0 < len(want) < len(a)


def test_ladder(spark):
    rows = [(1, "dose", "Aspirin", "mg", 100.0, None), (2, "dose", "aspirin", "mg", 119.0, None), (3, "dose", "Aspirin", "mg", 300.0, None), (4, "dose", "Aspirin", "g", 1.0, None), (5, "dose", "Unknown", "mg", 1.0, None)]
    rows += [(6, "number", None, None, 8.6, None), (7, "number", None, None, 90.0, None), (8, "class", None, None, None, "Weber B"), (9, "class", None, None, None, "Weber C"), (10, "interval", None, None, None, "alle 8 Stunden"), (11, "interval", None, None, None, "alle 9 Stunden")]
    asked = spark.createDataFrame(rows, "fid long, type string, name string, unit string, value double, text string")
    doses = spark.createDataFrame([("ASPIRIN", "mg", 100.0), ("ASPIRIN", "mg", 50.0)], "name string, unit string, value double")
    numbers, texts = spark.createDataFrame([(10.0,)], "value double"), spark.createDataFrame([("Eine weber b Fraktur, alle 8 stunden",), (None,)], "text string")
    got = {r["fid"]: (r["confidence"], r["correct"], r["status"]) for r in facts.checked(asked, doses, numbers, texts).collect()}
    assert got == {
        1: (0.9, None, "verified"), 2: (0.9, None, "verified"), 3: (0.3, 50.0, "incorrect"), 4: (0.6, None, "uncertain"), 5: (0.5, None, "uncertain"), 6: (0.85, None, "verified"), 7: (0.4, None, "incorrect"),
        8: (0.95, None, "verified"), 9: (0.4, None, "incorrect"), 10: (0.75, None, "uncertain"), 11: (0.5, None, "uncertain"),
    }
    none = facts.checked(asked, doses, numbers.limit(0), texts).where("fid = 6").first()
    assert none["confidence"] == 0.5


def test_paths_of_a_chain_with_cycles_beside(spark):
    chain = [(k, k - 1 if k else None, f"n{k}", k % 3) for k in range(600)]
    odd = [(1000, 1001, "a", 0), (1001, 1002, "b", 0), (1002, 1000, "c", 0), (1003, 1002, "under a cycle", 0), (1004, 1004, "own parent", 0), (1005, 9999, "no parent", 0), (2000, 3, "side", 7)]
    got = {r["id"]: r for r in E.tree_paths(spark.createDataFrame(chain + odd, "id long, parent long, name string, nth int")).collect()}
    assert set(got) == {*range(600), 2000}
    assert got[599]["depth"] == 599 and got[599]["path"] == " > ".join(f"n{k}" for k in range(600)) and got[599]["place"] == [k % 3 for k in range(600)]
    assert got[2000]["path"] == "n0 > n1 > n2 > n3 > side" and got[2000]["place"] == [0, 1, 2, 0, 7]


def test_stretches_around_a_word(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(["Licensed", "x", "\r", " ", "\n", "é", "y" * 45, "z" * 250], 30)) for _ in range(200)] + ["", "Licensed", "LicensedLicensed", None]
    got = [r["x"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", E.around(F.col("t"), "Licensed", 100).alias("x")).orderBy("k").collect()]
    assert got == [None if t is None else re.findall(r"[^\n]{0,100}Licensed[^\n]{0,100}", t) for t in texts]


def test_claims_go_over_all_but_line_feeds(spark, tmp_path):
    spark.createDataFrame([(1, "by\rLicensed under terms\nno")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in plans.QUERIES["x18_claims"](spark, str(tmp_path)).collect()] == [(1, "by\rLicensed under terms")]
