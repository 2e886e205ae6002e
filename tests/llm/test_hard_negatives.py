"""Hard negatives against brute force in whole numbers of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lektura.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string, anchor string, _label string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def brute(rows, every=10, positives=5, negatives=5, least=(80, 100)):
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        usable[i] = min(usable.get(i, one), one)
    out = set()
    for a, (label, v) in usable.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in usable.items() if i != a and len(w) == len(v)}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if usable[i][0] == label][:positives]:
            inside = [i for i in ranked if usable[i][0] != label and least[0] * score[p] <= least[1] * score[i] and score[i] <= score[p]]
            out |= {(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:negatives])}
    return out


def found(rows_df, **more):
    rows = H.hard_negatives(rows_df, F.col("vec_id") % more.pop("every", 10) == 0, **more).collect()
    assert len(rows) == len(set(rows))
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}


@pytest.mark.parametrize("seed,blocks", [(1, (8192, 1024)), (2, (37, 5)), (3, (11, 3))])
def test_against_brute_force(spark, seed, blocks):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=6) * 0.4], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[0][1], int(rng.integers(0, 2))) for i in range(120)]  # a crowd of equal vectors: ties
    rows += [(1000, None, 1), (1010, [1.0] * 6, None), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1030, [float("nan")] * 6, 1), (1040, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [1.0, 2.0], 0), (2010, [], 1), (7, rows[7][1], 0), (7, rows[7][1], 0)]
    want = brute(rows)
    assert want and found(table(spark, rows), vector_block=blocks[0], anchor_block=blocks[1]) == want


def test_windows_overlap_and_ends_count(spark):
    # Positives at 100, 90 and 90; negatives at the limits of windows, one over all of them.
    rows = [(0, [1.0], 0), (1, [100 / 256], 0), (2, [90 / 256], 0), (3, [90 / 256], 0)]
    rows += [(10 + k, [x / 256], 1) for k, x in enumerate((101, 100, 95, 90, 80, 79, 72, 71))]
    assert found(table(spark, rows), every=1000) == brute(rows, every=1000)
    got = found(table(spark, rows), every=1000)
    assert {(p, n) for _, p, _, n, _, _ in got} == {(1, 11), (1, 12), (1, 13), (1, 14), (2, 13), (2, 14), (2, 15), (2, 16), (3, 13), (3, 14), (3, 15), (3, 16)}


def test_few_kinds_and_negative_scores(spark):
    assert found(table(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.9], 1)])) == set()
    assert found(table(spark, [(0, [1.0], 0), (1, [1.0], 1)])) == set()  # no positive
    assert found(table(spark, [(0, [0.0], 0), (1, [1.0], 0), (2, [1.0], 1)])) == {(0, 1, 1, 2, 0, 0)}
    assert H.hard_negatives(table(spark, [(0, [0.0], 0)]).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(spark):
    rows = [(0, [3e5, 7.0], 0), (1, [2e5 + 1, -3.0], 0), (2, [2e5, 5.0], 1), (3, [1.9e5, 1e5], 1)]
    assert found(table(spark, rows)) == brute(rows)
    huge = found(table(spark, [(0, [1e300], 0), (1, [1e300], 0), (2, [1e300], 1)]))
    assert huge == {(0, 1, 1, 2, H.HIGH, H.HIGH)}  # held at the limit of 64 bits


def test_best_of_either_form():
    rng = np.random.default_rng(3)
    score = rng.integers(-9, 9, size=(40, 200))
    allowed = rng.random(size=score.shape) < 0.1
    for big in (1, 1 << 55):
        row, column = H.best(score * big, allowed, 5)
        want = [(r, c) for r in range(40) for c in sorted(np.flatnonzero(allowed[r]), key=lambda c: (-score[r, c], c))[:5]]
        assert list(zip(row, column)) == want


def test_nothing_that_grows_goes_through_the_driver(spark):
    """Packed blocks shrink in a shuffle, by whose bytes they were broadcast."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)], int(rng.integers(0, 3))) for i in range(60)]
    result = H.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, vector_block=20, anchor_block=3)
    result.collect()
    assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
    vectors = spark.createDataFrame([(2, 0, b"x"), (2, 1, b"y")], "dim int, block int, packed binary")
    met = H._met(vectors, vectors, 2, lambda a, v: None, "n int")
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
