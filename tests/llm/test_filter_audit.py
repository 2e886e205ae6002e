"""The filter audit against brute force: words, flags, matrix, all orders."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lektura.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fails string, good string"
LABELS = "doc_id long, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash", "clash", "clash") for i, t, lang in rows], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, None, "en") for i in range(2)] + [(2, "", None), (3, " \t ", "de"), (4, "Ä" * 10 + "A", "de"), (5, "x" * 97 + "ABC", "de"), (6, "x" * 96 + "ABCD", "de")]
    vocabulary = ["alpha", "Alpha", "ünï", "b#", "c\xa0d", "e", "f\x1cg", "h\vi", "TOXIC"]
    for i in range(10, 130):
        words = [rng.choice(vocabulary) if rng.random() < rng.choice([0.1, 0.9]) else f"w{rng.randint(0, 900)}" for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 500]))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["en", "de", "", None])))
    rows += [(200 + k, "the same text of many", rng.choice(["en", "de"])) for k in range(60)]
    rows += [(1, "the same text of many", "en"), (400, "a " * 100 + "b " * 100, "en"), (401, " ".join(f"k{i}" for i in range(50_000)), "en"), (None, "the same text of many", "en"), (None, "lonely", "fr"), (300, "twice", "en"), (300, "twice", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260)] + [(20, 1, 0), (20, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def slow_failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i)
        out.append((i, lang or "", "".join(x for x, failed in zip("ABCDE", tests) if failed)))
    return out


def slow_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = slow_failures(rows)
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                fits = lambda f: not set(f) & set(order[: step - 1])
                gone = [i for i, f in own if x in f and fits(f)]
                out[part, order, step] = [sum(x not in f and fits(f) for _, f in own), len(gone), sum(x in f and not fits(f) for _, f in own), sum(f == x for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, labels = corpus(seed)
    found = A.filter_audit(table(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in found} == slow_audit(rows, labels)
    assert len(found) == 600 * len({lang or "" for _, _, lang in rows})


def test_failures_of_each_document(spark):
    rows, _ = corpus(3)
    found = Counter((r["id"], r["part"], "".join(x for k, x in enumerate("ABCDE") if r["fails"] >> k & 1)) for r in A.failures(table(spark, rows)).collect())
    assert found == Counter(slow_failures(rows))


@pytest.mark.parametrize("bits", [32, 7])  # few bits: words share hashes
def test_matrix_is_of_the_corpus_words(spark, bits):
    rows, _ = corpus(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        shards = A.cut(A.term_shards(table(spark, rows).coalesce(2)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    numbers = A.cut(A.dictionary(shards, bits))
    pairs = {(r["number"], bytes(r["word"]).decode()) for r in numbers.collect()}
    known = dict(pairs)
    want = {w for _, t, _ in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert len(pairs) == len(known) == len(want) and set(known.values()) == want
    matrix, got = A.term_matrix(shards, numbers).collect(), defaultdict(list)
    assert len(matrix) > 3
    for r in matrix:
        starts, words, counts = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["words"], np.int64), np.frombuffer(r["counts"], np.int32)
        for k, i in enumerate(r["ids"]):
            own = Counter({known[w]: int(n) for w, n in zip(words[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]])})
            got[i].append(own)
            assert r["sums"][k] == sum(own.values()) and r["kinds"][k] == len(own)
    key = lambda c: sorted(c.items())
    for i in {i for i, _, _ in rows}:
        assert sorted(got[i], key=key) == sorted((Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for j, t, _ in rows if j == i), key=key)


def test_no_rows_and_no_labels(spark):
    rows, _ = corpus(5)
    none = spark.createDataFrame([], LABELS)
    assert A.filter_audit(table(spark, rows).limit(0), none).count() == 0
    found = A.filter_audit(table(spark, rows[:9]), none)
    assert {(r["good_lost"], r["toxic_lost"]) for r in found.collect()} == {(0, 0)}
