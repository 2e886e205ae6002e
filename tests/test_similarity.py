"""The similarity and containment joins against all pairs."""

from __future__ import annotations

import difflib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lektura import plans
from lektura.functions import text as X
from lektura.operators import joins as J
from lektura.operators import similarity as S


def corpus(seed, letters="abcdé 日", n=70):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    texts = [word(rng.choice([1, 2, 5, 9, 20, 60, 150, 260])) for _ in range(n)]
    for t in list(texts):  # edits, in the first words above all
        c = list(t)
        for _ in range(rng.randint(0, max(1, len(c) // 12))):
            at = rng.randrange(len(c) + 1) if rng.random() < 0.5 else rng.randrange(min(len(c), 4) + 1)
            c[at : at + rng.randint(0, 1)] = word(rng.randint(0, 2))
        texts.append("".join(c))
    return texts + ["", None, texts[0], texts[0]]


@pytest.mark.parametrize("seed,least,few", [(1, 0.75, 0), (2, 0.9, 0), (3, 0.68, 2000), (4, 0.95, 2000), (2, 0.9, 2000)])
def test_no_similar_pair_is_lost(spark, monkeypatch, seed, least, few):
    monkeypatch.setattr(S, "FEW", few)  # both forms
    left, right = corpus(seed), corpus(seed)[::-1] + corpus(seed + 10)
    rows = spark.createDataFrame([(i, t, least) for i, t in enumerate(left)], "lid long, ltext string, least double")
    got = {(r["lid"], r["rtext"]): r["score"] for r in S.similar_pairs(rows, spark.createDataFrame([(t,) for t in right], "rtext string"), least).collect()}
    want = {(i, b): r for i, a in enumerate(left) if a for b in set(right) if b and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= least}
    assert got == want and len(want) > len(left)


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "xy")
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for k, y in enumerate(b):
                row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
        assert S.common_length(a, b) == row[-1]


def test_ratios_of_one_join_may_differ(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox", 0.95), (2, "the quick brown fox", 0.7)], "lid long, ltext string, least double")
    got = S.similar_pairs(rows, spark.createDataFrame([("a quick brown fax",)], "rtext string"), 0.7).collect()
    assert [r["lid"] for r in got] == [2]
    with pytest.raises(ValueError):
        S.similar_pairs(rows, spark.createDataFrame([("a",)], "rtext string"), 0.6)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_contained_pair_is_lost(spark, seed):
    rng = random.Random(seed)
    large = corpus(seed, "ab cé")
    small = [t[(k := rng.randrange(len(t))) : k + rng.randint(1, 80)] for t in large if t] + [t for t in large if t][:20] + corpus(seed + 5, "ab") + ["", None]
    a = spark.createDataFrame(list(enumerate(small)), "sid long, stext string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(large)], "lid long, ltext string")
    got = S.contained_pairs(a, b).collect()
    want = {(i, k) for i, s in enumerate(small) if s for k, t in enumerate(large) if t and s in t}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > len(small)


def test_lengths_that_allow_a_ratio(spark):
    rows = spark.createDataFrame([(10, 0.8), (11, 0.8), (100, 0.9), (None, 0.9)], "n int, least double").where("n is not null")
    texts = spark.createDataFrame([("a" * n,) for n in range(1, 200)] + [(None,)], "t string")
    got = {len(r["t"]) for r in texts.where(S.like_length("t", rows, "n", "least")).collect()}
    assert got == {m for m in range(1, 200) for n, x in ((10, 0.8), (11, 0.8), (100, 0.9)) if 2 * min(m, n) >= x * (m + n) - 1e-9}
    assert texts.where(S.like_length("t", rows.limit(0), "n", "least")).count() == 0


def test_keys_of_long_contained_texts_are_few():
    rng = random.Random(3)
    text = "".join(rng.choice(("ab", "the ", "ion", "re", "in ", "at")) for _ in range(2000))
    for k, (size, _) in enumerate(S.SIZES):
        held = set(S.minimizers(text, [k]).tolist())
        at = rng.randrange(len(text) - size)
        own = S.minimizers(text[at : at + size], [k])
        assert len(own) and set(own.tolist()) <= held and (size < 48 or len(held) < len(text) / 12)
    for size in (1, 3, 10):
        assert len(S._all_stretches(text, [size])) == len({text[i : i + size] for i in range(len(text) - size + 1)})


def test_no_key_is_constant(spark):
    rows = spark.createDataFrame([(1, "some text of length", 0.9)], "lid long, ltext string, least double")
    for plan in (S.similar_pairs(rows, rows.select(F.col("ltext").alias("rtext")), 0.9), S.contained_pairs(rows.select(F.col("lid").alias("sid"), F.col("ltext").alias("stext")), rows.select("lid", "ltext"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def ratio(a, b, least):
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def lowered(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_best_lines_against_all_pairs(spark):
    got = {r["qid"]: (r["bid"], r["method"]) for r in plans.QUERIES["j12_tiered_match"](spark, DATA).collect()}
    lines = [(r["doc_id"], pos, lowered(x)) for r in table(spark, "documents").collect() if r["text"] is not None for pos, x in enumerate(r["text"].split("\n"))]
    for r in table(spark, "benchmark").collect():
        q = lowered(r["text"])
        same = sorted((d, pos) for d, pos, x in lines if x == q)
        needed = 0.95 if len(q) < 50 else 0.92 if len(q) < 120 else 0.90
        scored = sorted(((-ratio(q, x, needed - 0.02), d, pos) for d, pos, x in lines if x), key=lambda s: s)
        if same:
            want = (same[0][0], "exact")
        elif len(q) < 20 or -scored[0][0] < needed:
            want = (None, "too short" if len(q) < 20 else "none")
        else:
            want = (None, "ambiguous") if -scored[0][0] + scored[1][0] < 0.02 else (scored[0][1], "fuzzy")
        assert got[r["item_id"]] == want


def test_first_lines_against_all_pairs(spark):
    got = {r["qid"]: (r["bid"], r["score"]) for r in plans.QUERIES["j13_substring_or_ratio"](spark, DATA).collect()}
    first = {}
    for r in table(spark, "documents").collect():
        x = lowered((r["text"] or "").split("\n")[0])
        if len(x) >= 20:
            first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    want = {}
    for a, i in first.items():
        scored = [(1.0 if a in b or b in a else ratio(a, b, 0.75), -k) for b, k in first.items() if k < i]
        if scored and max(scored)[0] >= 0.75:
            want[i] = (-max(scored)[1], round(max(scored)[0], 6))
    assert got == want


def test_three_tiers_against_all_pairs(spark):
    key = lambda name, id_col: table(spark, name).select(id_col, X.question_key(F.col("text")).alias("k"), X.question_key(F.col("text"), True).alias("p")).collect()
    held = key("documents", "doc_id")
    got = {r["qid"]: (r["bid"], r["method"]) for r in plans.QUERIES["j11_three_tiers"](spark, DATA).collect()}
    for q in key("benchmark", "item_id"):
        exact, plain = ([d["doc_id"] for d in held if d[c] == q[c]] for c in "kp")
        near = [(-r, d["doc_id"]) for d in held if d["k"] and (r := ratio(q["k"], d["k"], 0.92)) >= 0.92]
        want = (min(exact), "exact") if exact else (min(plain), "plain") if plain else (min(near)[1], "fuzzy") if near else (None, "none")
        assert got[q["item_id"]] == want


@pytest.mark.parametrize("patterns", [0, 5_000])
def test_contained_texts_by_keys_and_by_one_scan(spark, monkeypatch, patterns):
    monkeypatch.setattr(S, "PATTERNS", patterns)
    large = corpus(7, "ab cé")
    small = [t[3 : 3 + n] for n, t in enumerate(large) if t] + ["", None, "日a", large[0]]
    a = spark.createDataFrame(list(enumerate(small)), "sid long, stext string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(large)], "lid long, ltext string")
    got = [tuple(r) for r in S.contained_pairs(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, s in enumerate(small) if s for k, t in enumerate(large) if t and s in t}
    assert S.contained_pairs(a.limit(0), b).collect() == []


@pytest.mark.parametrize("parts", [0, 100_000])
def test_shared_parts_of_repeated_ids(spark, monkeypatch, parts):
    monkeypatch.setattr(J, "PARTS", parts)
    left = [(1, "alpha beta, gamma"), (1, "alpha delta"), (2, "beta abc"), (None, "gamma delta"), (3, None), (4, "")]
    right = [(10, "Alpha"), (10, "BETA alpha"), (11, "gamma-delta-gamma"), (None, "gamma"), (None, "delta"), (12, None)]
    got = sorted(map(tuple, J.shared_parts(spark.createDataFrame(left, "lid long, lname string"), spark.createDataFrame(right, "rid long, rname string")).collect()), key=str)
    words = lambda rows, x: {w for k, t in rows if k == x and t for w in re.split("[^a-z]+", t.lower()) if len(w) > 3}
    ids = [(a, b, len(words(left, a) & words(right, b))) for a in (1, 2, None, 3, 4) for b in (10, 11, None, 12)]
    assert got == sorted((x for x in ids if x[2] >= 2), key=str) and len(got) == 5
