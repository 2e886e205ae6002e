"""The pipeline's stages against brute force, with nulls, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lektura.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).withColumn("size", F.lit("clash"))


def kept(df):
    assert df.columns == pipeline.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_are_the_five():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "packing"]


def test_empty_table_goes_through_all_stages(spark):
    docs = documents(spark, [(1, "a", "s")]).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_language_id_stage(spark):
    rng = np.random.default_rng(1)
    words = ["lorem", "ipsum", "dolor", "amet", "elit"]
    rows = [(i, " ".join(rng.choice(words, 25)), "s") for i in range(200)]
    odd = [(300, None, "s"), (301, "", "s"), (302, "12 34", None), (303, "xqz wvk jjq zzx qkw vvq " * 9, "s"), (304, "日本語 " * 30, "s")]
    docs = documents(spark, rows + odd[:3] + rows[:2] + [(None, rows[0][1], None)])
    got = kept(pipeline.language_id(spark, docs, ""))
    assert got == sorted([(i, t) for i, t, _ in rows + rows[:2]] + [(None, rows[0][1])], key=str)
    strange = docs.union(documents(spark, odd[3:]).withColumn("lang", F.lit(None).cast("string")).select(docs.columns))
    assert kept(pipeline.language_id(spark, strange, "")) == got


def test_line_dedup_stage(spark):
    rows = [(i, f"header\nbody {i}\n\n header \nfooter {i % 2}", "s" if i % 3 else None) for i in range(30)]
    rows += [(90, "header\nheader", "s"), (91, None, "s"), (92, "", None), (5, rows[5][1], "s"), (None, "header\nown", "s"), (93, "header\nalone", "t")]
    pages, seen = Counter(s for *_, s in rows), defaultdict(Counter)
    for _, t, s in rows:
        seen[s].update({x.strip() for x in (t or "").split("\n")} - {""})
    want = []
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if not (x.strip() and seen[s][x.strip()] >= 3 and seen[s][x.strip()] > 0.1 * pages[s])]
        want.append((i, t if t is None or not any(x.strip() for x in left) else "\n".join(left)))
    assert kept(pipeline.line_dedup_stage(spark, documents(spark, rows), "")) == sorted(want, key=str)


def test_near_dedup_stage(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]

    def edited(words, edits):
        words = list(words)
        for at in rng.choice(len(words), edits, replace=False):
            words[at] = fresh(1)[0]
        return words

    texts = [" ".join(fresh(12)) for _ in range(5)] + [None, "", "Two words", "two  words", "three short words", " ".join(fresh(30_000))]
    for edits in (1, 2, 3, 4, 5, 6, 8):  # from 0.95 down to 0.7
        for _ in range(8):
            words = fresh(200)
            texts += [" ".join(words), " ".join(edited(words, edits)).upper()]
    crowd = fresh(200)
    texts += [" ".join(edited(crowd, int(rng.integers(0, 5)))) for _ in range(60)]
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or (x and len(x & sets[j]) >= 0.8 * len(x | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = kept(pipeline.near_dedup(spark, documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), ""))
    assert got == sorted([(i, texts[i]) for i in set(root)], key=str)


def test_near_dedup_takes_simhash_first_and_few_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
    edited = lambda n: " ".join("x" + str(rng.integers(10**9)) if i in at else w for at in [set(rng.choice(400, n, replace=False).tolist())] for i, w in enumerate(own))
    texts = [" ".join(own)] + [edited(1 + i % 3) for i in range(249)]
    asked, verify = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, *rest: asked.append(pairs.count()) or verify(pairs, *rest))
    assert kept(pipeline.near_dedup(spark, documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), "")) == [(0, texts[0])]
    assert 100 < asked[0] < 250  # of SimHash: a comparison a member
    assert sum(asked) < 6 * len(texts)


@pytest.mark.parametrize("source", ["s", None])
def test_near_dedup_stage_decides_by_row(spark, source):
    rows = [(1, "T t", source), (2, "T t", source), (None, "T t", source), (None, "U", source), (2, "W", source), (3, "W", "other"), (4, "X", source), (4, "X", "other"), (4, "X", source), (None, None, None), (None, "", None)]
    got = pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["text"]), key=str) == sorted([(1, "T t"), (None, "U"), (2, "W"), (4, "X")], key=str)
    assert len(got) == 5  # and one of those without words


def test_mix_stage(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 20))), ["a", "b", None][int(i % 10 > 3) + int(i % 10 > 8)]) for i in range(300)] + [(7, "w w", "a"), (None, None, "b")]
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in pipeline.mix(spark, documents(spark, rows), "").collect())
    had = Counter(rows)
    assert all(n <= 3 * had[row] for row, n in got.items())
    size = lambda t: len((t or "").split())
    total, own = sum(size(t) for _, t, _ in rows), Counter()
    for _, t, s in rows:
        own[s] += size(t)
    want, open_ = {}, {"a": 1, "b": 2, None: 3}
    while True:
        share = (total - sum(want.values())) / sum(open_.values())
        over = {s for s, w in open_.items() if share * w > 3 * own[s]}
        if not over:
            break
        want |= {s: 3 * own[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    want |= {s: share * w for s, w in open_.items()}
    for s, goal in want.items():
        assert abs(sum(n * size(t) for (_, t, x), n in got.items() if x == s) - goal) <= 20


def test_packing_stage(spark):
    rows = [(i, "word " * (i * 7), "s") for i in range(60)] + [(3, "word " * 21, "s"), (None, None, None), (80, "long text " * 3000, "s")]
    got = pipeline.packing(spark, documents(spark, rows), "").collect()
    lengths = defaultdict(int)
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    from lektura.llm.tokens import byte_bpe

    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len(byte_bpe().encode(t or "")) + 1
    assert lengths == want
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(fill) <= -(-sum(want.values()) // 1024) + 1
