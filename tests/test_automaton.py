"""The automaton against plain searches."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lektura.functions.automaton import Automaton, pattern_hits


def slow(text, patterns, whole):
    if text is None:
        return None
    out = []
    for rule, (p, w) in enumerate(zip(patterns, whole)):
        at = [m.start() for m in re.finditer(rf"\b{re.escape(p)}\b" if w else re.escape(p), text)]
        if at:
            out.append({"rule": rule, "n": len(at), "at": at[0]})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_searches(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "ä", "ß", " ", "_", "-", "日", "😀", "\n"][: rng.choice([2, 4, 7, 10])]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    patterns = sorted({word(rng.randint(1, 6)) for _ in range(rng.choice([1, 10, 150]))} | {word(700)})
    whole = [rng.random() < 0.5 for _ in patterns]
    texts = [None, "", patterns[0], word(5000) + patterns[-1] + word(600), patterns[-1]] + [word(rng.choice([0, 3, 40, 511, 512, 513, 1500])) for _ in range(40)] + [None]
    automaton = Automaton(patterns, whole)
    assert automaton.hits(pa.array(texts)).to_pylist() == [slow(t, patterns, whole) for t in texts]
    assert automaton.hits(pa.array(texts).slice(3, 9)).to_pylist() == [slow(t, patterns, whole) for t in texts[3:12]]
    assert automaton.hits(pa.array(texts[:0], pa.string())).to_pylist() == []


def test_equal_and_contained_patterns():
    patterns = ["she", "he", "hers", "he", "s"]
    assert Automaton(patterns).hits(pa.array(["ushers"])).to_pylist() == [slow("ushers", patterns, [False] * 5)]
    with pytest.raises(ValueError):
        Automaton(["a", ""])


def test_labels_sum_weights_of_different_patterns():
    rules = [(3, "ab", 1.0), (1, "b", 0.5), (3, "bc", 2.5), (1, "zz", 9.0), (3, "c", 2.5)]
    automaton = Automaton([r[1] for r in rules])
    got = automaton.labels(pa.array(["abcb", None, "", "ab"]), np.array([r[0] for r in rules]), np.array([r[2] for r in rules])).to_pylist()
    a, b = dict(label=1, score=0.5, kinds=1, n=2, at=1, best=1), dict(label=3, score=6.0, kinds=3, n=3, at=0, best=2)
    assert got == [[a, b], None, [], [dict(a, n=1), dict(label=3, score=1.0, kinds=1, n=1, at=0, best=0)]]


def test_column(spark):
    rows = spark.createDataFrame([(1, "the others"), (2, None), (3, ""), (4, "other the")], "id long, text string")
    found = {r["id"]: r["h"] and [tuple(x) for x in r["h"]] for r in rows.select("id", pattern_hits(rows["text"], ["the", "other"], [True, False]).alias("h")).collect()}
    assert found == {1: [(0, 1, 0), (1, 1, 4)], 2: None, 3: [], 4: [(0, 1, 6), (1, 1, 0)]}
    assert rows.select(pattern_hits(rows["text"], []).alias("h")).where("size(h) = 0").count() == 3


def test_a_batch_is_scanned_in_parts(spark):
    from lektura.functions import automaton as A

    texts = pa.array(["ab" * 300_000, None, "", "x ab", *["abc " * 100] * 9000])
    parts = A._parts(texts)
    assert len(parts) >= 3 and [b for b, _ in parts[1:]] == [e for _, e in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == len(texts)
    made = A.Automaton(["ab", "bc", "c a"])
    assert pa.concat_arrays([made.hits(texts.slice(b, e - b)) for b, e in parts]).equals(made.hits(texts))
    assert A._parts(pa.array([], pa.string())) == [(0, 0)] and A._parts(pa.array([["a"], None, []])) == [(0, 3)]
