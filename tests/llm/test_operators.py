"""The operators against brute force on small inputs with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lektura.llm import langid, line_dedup, mixing, packing, simhash, tokens, toxicity, vptree
from lektura.llm.exact_dedup import exact_dedup
from lektura.llm.token_rollup import TokenRollup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, h string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


def documents(spark, texts, **columns):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = ["a b", "a  b", "a\tb", None, "", "  ", "A b", LONG, LONG + " ", LONG + " end", "x" * 20_000, "x" * 20_000, "ümlaut ß", "a b"]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    docs = documents(spark, TEXTS)
    found = {r["doc_id"]: r for r in exact_dedup(docs, hash_bits=bits).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[normal(t)].append(i)
    for ids in groups.values():
        for i in ids:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(normal(TEXTS[i]).encode()).hexdigest()
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "t"), (5, "t"), (5, "t"), (None, "u")], "doc_id long, text string")
    found = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()), key=str)
    assert found == sorted([("5", 5, 3, True), ("5", 5, 3, True), ("None", 5, 3, False), ("None", None, 1, True)], key=str)


def slow_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, radius):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {v: root(v) for v in vs}


def test_simhash_against_brute_force(spark):
    texts = TEXTS + [LONG.replace("word5x", "other5x"), LONG.replace("word7x7", "z"), "one two three", "ONE two three", "one two three four five"]
    found = {r["doc_id"]: r for r in simhash.simhash_near_dups(documents(spark, texts)).collect()}
    prints = [slow_fingerprint(t, 4) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    roots = classes(set(prints), 4)
    for i, p in enumerate(prints):
        assert found[i]["component_id"] == min(j for j, q in enumerate(prints) if roots[q] == roots[p])
    assert simhash.simhash_near_dups(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("largest", [4096, 3])
def test_simhash_links_lose_none(spark, largest):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            fps.add(b ^ sum(1 << int(f) for f in flips))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps]
    from lektura.llm.components import components

    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, largest)
    roots = {r["node"] % 2**64: r["root"] for r in components(edges).collect()}
    want = classes(fps, 4)
    groups = defaultdict(set)
    for v, r in want.items():
        groups[r].add(v)
    for members in groups.values():
        assert len({roots.get(v, v) for v in members}) == 1
    assert len({roots.get(v, v - (1 << 64) if v >> 63 else v) for v in fps}) == len(groups)


def test_covering_masks_cover_every_pair():
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks(4, list(range(64)))
    for _ in range(300):
        x = sum(1 << int(f) for f in rng.choice(64, 4, replace=False))
        assert any(not x & m for m in masks)


def test_mixing(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 400)] + [None, "", " ".join(["w"] * 3000)]
    docs = documents(spark, texts)
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    want, open_, total = {}, set(order), float(sum(sizes.values()))
    while True:
        share = (total - sum(want.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        if not over:
            want |= {s: share * weights[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    for s in order:
        got = {r["target"] for r in rows if r["source"] == s}
        assert len(got) == 1 and abs(got.pop() - want[s]) < 1e-6
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(want[s] - taken) <= 60
        repeats = want[s] // sizes[s] if sizes[s] else 0
        spare = [r["size"] for r in rows if r["source"] == s and r["size"] and r["copies"] == repeats < 3]
        assert all(abs(want[s] - taken - n) >= abs(want[s] - taken) - 1e-6 for n in spare)  # no other brings it nearer
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_caps(spark):
    docs = spark.createDataFrame([(1, "a b", "s1"), (2, "c " * 100, "s2"), (3, "d", "s3"), (4, None, None)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert found[1]["target"] == 6 and found[3]["target"] == 3 and found[4]["target"] == 0 and found[2]["target"] == 94
    assert found[1]["taken"] == 6 and found[3]["taken"] == 3 and found[2]["taken"] == 100


def test_packing_round_trip(spark):
    texts = [*TEXTS[:7], LONG, "Hello <|endoftext|> there", "naïve café\n\n  two", *[f"number {i} " * (i % 90) for i in range(120)]]
    docs = documents(spark, texts).union(documents(spark, texts[:3]))
    rows = packing.pack(docs).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    total = 0
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        total += r["length"]
    for i, code in enumerate(ids):
        lengths = packing.pieces_of(len(code), 1024)
        found = sorted(by_doc[i], key=lambda r: r["piece"])
        copies = 2 if i < 3 else 1
        assert [r["length"] for r in found] == [n for n in lengths for _ in range(copies)]
        for r in found:
            part = code[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_tokens_equal_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.byte_bpe()
    for t in ["", " ", "a", "It's we'll  x\n\n y \t", "ñandú 12345 %%%$$$", "日本語 テスト", "﻿x y", "é" * 500, "x" * 3000]:
        assert encoder.encode(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_configurations_hold_every_piece():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 1025, 5000), minlength=1025)
    used = np.zeros(1025, np.int64)
    n = 0
    for config, times in packing.configurations(counts, 1024):
        assert sum(length * m for length, m in config.items()) <= 1024
        for length, m in config.items():
            used[length] += m * times
        n += times
    assert (used == counts).all()
    assert n <= 1.02 * -(-(counts * np.arange(1025)).sum() // 1024)


def test_language_id(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["quick", "brown", "jumps", "lazy"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 ?!", "bb"), (1003, "LOREM Ipsum", None), (None, "quick brown", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_x", F.lit(1)).withColumn("score", F.lit("clash"))
    found = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert len(found) == len(rows)
    for i, text, lang in rows[:120]:
        assert found[i]["lang_pred"] == lang and 0 <= found[i]["score"] <= 1 and not found[i]["rejected"]
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "aa" and found[None]["lang_pred"] == "bb"
    assert {r["lang_pred"] for r in langid.language_id(docs.where("lang is null")).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


def slow_kneser_ney(texts, order):
    """p(character | context) by dictionaries, one language; as the model pads and folds its texts."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        x = langid.PAD * (order - 1) + t
        counts[order].update(x[i - order + 1 : i + 1] for i in range(order - 1, len(x)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    once, twice = ({k: sum(n == m for n in c.values()) for k, c in counts.items()} for m in (1, 2))
    discount = {k: min(max(once[k] / max(once[k] + 2 * twice[k], 1), 0.1), 0.9) for k in counts}

    def p(context, char):
        k = len(context) + 1
        own = {g: n for g, n in counts[k].items() if g[:-1] == context}
        total, n = sum(own.values()), own.get(context + char, 0)
        if k == 1:
            return max(n - discount[1], 0) / total + discount[1] * len(own) / total / (len(own) + 1)
        if not own:
            return p(context[1:], char)
        return max(n - discount[k], 0) / total + discount[k] * len(own) / total * p(context[1:], char)

    return p


@pytest.mark.parametrize("room", [4_000_000, 3])
def test_kneser_ney_against_brute_force(spark, room):
    texts = ["abab abba", "baab", "aabb b", "ab ab ab ab"] * 3 + ["cab"]
    model = langid.train(spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string"), order=3, room=room)
    p, letters = slow_kneser_ney(texts, 3), "abc "
    for context in [x + y for x in letters for y in letters] + [langid.PAD * 2, langid.PAD + "a"]:
        got = [float(np.exp(model.log_probability(np.array([ord(c) for c in context + x], np.uint64), np.array([2]))[0, 0])) for x in letters]
        if room > 3:  # else only the most frequent grams are their own
            assert got == pytest.approx([p(context, x) for x in letters], rel=1e-5)
        assert 0.3 < sum(got) <= 1 + 1e-6


def test_language_id_rejects_what_it_never_learned(spark):
    rng = np.random.default_rng(14)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet", "elit"], "bb": ["quick", "brown", "jumps", "lazy", "over"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(i, " ".join(rng.choice(words["aa"], 20_000)), "aa") for i in (500, 500)]  # long, and repeated
    strange = ["xqz wvk jjq zzx qkw vvq xkz qqj " * 5, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 9]
    rows += [(900 + i, t, None) for i, t in enumerate(strange)]
    found = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows) and {r["doc_id"] for r in found if r["rejected"]} == {900, 901}


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}plain" for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghij"]
    insult = ["blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 30))
        toxic = i % 5 == 0
        if toxic:
            text[7:7] = [insult[i // 5 % 2], insult[i // 7 % 2]]
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, "you are such a blokhead and a nitwitt", "en"), (901, "", "en"), (902, None, "en"), (903, 'they wrote "blockhead" in the word list', "en"), (904, "anaplain bocplain", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(found[i]["predicted"] == int(i % 5 == 0) for i in range(400))
    assert found[901]["predicted"] == found[902]["predicted"] == found[904]["predicted"] == 0
    assert found[903]["quoted"] == 1 and found[903]["score"] < found[0]["score"]
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(rows)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_levenshtein_automaton_against_brute_force(distance):
    rng = np.random.default_rng(distance)
    word_of = lambda n: "".join(rng.choice(list("abc"), n))
    terms = {word_of(int(rng.integers(5, 9)) * distance) + ("$" if rng.random() < 0.5 else "") for _ in range(25)}
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), distance=distance)
    for _ in range(400):
        word = word_of(int(rng.integers(0, 10 * distance)))
        want = []
        for term in terms:
            row = edit_distance(term.rstrip("$"), word)
            edits = row[-1] if term.endswith("$") else min(row)
            if edits <= distance:
                want.append((edits, term))
        assert lexicon.nearest(word) == (min(want)[::-1] if want else None)
        assert bool(lexicon.match(word)) == bool(want)


def test_toxicity_of_empty_tables_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a nitwit"), (1, "a nitwit"), (None, "x"), (2, LONG)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_levenshtein_walk():
    lexicon = toxicity.Lexicon({"blockhead": 1.0, "nitwit$": 1.0, "scum": 1.0})
    assert toxicity.Lexicon({"blockheaded": 1.0}, distance=2).match("bockheded") == ("blockheaded", 2)
    for word, want in (("blockhead", ("blockhead", 0)), ("blockheads", ("blockhead", 0)), ("blokhead", ("blockhead", 1)), ("bl0ckhead", ("blockhead", 1)), ("nitwit", ("nitwit$", 0)), ("nitwitt", ("nitwit$", 1)), ("nitwits", ("nitwit$", 1)), ("nitwitty", None), ("skum", None), ("scummy", ("scum", 0)), ("bokhed", None)):
        assert lexicon.match(word) == want, word


@pytest.mark.parametrize("many", [200_000, 0])
def test_line_dedup(spark, many):
    pages = [(i, "http://A.example/x" if i < 20 else "http://b.example/", f"menu\nbody {i}\n\n  menu  " if i % 2 else f"menu\nother {i}") for i in range(40)]
    pages += [(90, None, "menu"), (91, "http://a.example/", None), (92, "http://a.example/", ""), (93, "http://a.example/", "menu\nmenu"), (1, "http://A.example/x", "menu\nbody 1\n\n  menu  ")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("k", F.lit("clash"))
    found = line_dedup.line_dedup(rows, line_dedup.host_of(F.col("url")), F.col("html"), broadcast_lines=many).collect()
    assert len(found) == len(pages)
    kept = defaultdict(list)
    for r in found:
        kept[r["page_id"]].append((r["_host"], r["_lines"], r["_dropped"], r["_kept"]))
    assert kept[3] == [("a.example", 3, 2, "body 3\n")] and kept[1] == [("a.example", 3, 2, "body 1\n")] * 2
    assert kept[22] == [("b.example", 2, 1, "other 22")]
    assert kept[90] == [("", 1, 0, "menu")] and kept[91] == [("a.example", 0, 0, None)] and kept[92] == [("a.example", 0, 0, "")]
    assert kept[93] == [("a.example", 2, 2, "")]
    spared = line_dedup.line_dedup(rows, line_dedup.host_of(F.col("url")), F.col("html"), spare_whole=True, broadcast_lines=many)
    assert [(r["_dropped"], r["_kept"]) for r in spared.where("page_id = 93").collect()] == [(0, "menu\nmenu")]
    long_page = spark.createDataFrame([(i, "http://c.example/", "\n".join(["same", *(f"l{i}-{k}" for k in range(30_000))])) for i in range(4)], "page_id long, url string, html string")
    assert [r["_dropped"] for r in line_dedup.line_dedup(long_page, line_dedup.host_of(F.col("url")), F.col("html"), broadcast_lines=many).collect()] == [1] * 4
    assert line_dedup.line_dedup(rows.limit(0), line_dedup.host_of(F.col("url")), F.col("html")).count() == 0


def test_html_lines(spark):
    row = spark.createDataFrame([('<p>a &amp; b<br/>c</p><script>var t="</p>";</script><!-- x --><B>d</B>&lt;e&gt;',)], "html string")
    assert [x for x in row.select(line_dedup.html_lines(F.col("html")).alias("t")).first()["t"].split("\n") if x] == ["a & b", "c", "d<e>"]


def test_rollup(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    columns = "op string, doc_id long, source string, lang string, version string, tokens long"
    make = lambda *rows: spark.createDataFrame(rows, columns)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", make(("insert", 1, "s", "en", "v1", 10), ("insert", 2, "s", None, "v1", 5), ("insert", 3, None, "en", "v1", None), ("insert", 4, "s", "en", "v2", 7)))
    assert rollup.commit("b", make(("delete", 2, None, None, "v1", None), ("revise", 1, "t", "en", "v1", 12), ("delete", 99, None, None, "v1", None)))
    want = {("t", "en", "v1"): (1, 12), (None, "en", "v1"): (1, 0), ("s", "en", "v2"): (1, 7)}
    totals = lambda: {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert totals() == want
    assert not rollup.commit("b", make(("revise", 1, "t", "en", "v1", 99)))
    assert totals() == want
    # A batch that broke off before its commit counts nothing, and its folder is written anew.
    make(("insert", 7, "s", "en", "v1", 1000)).write.parquet(f"file://{tmp_path}/rollup/ledger/c")
    assert totals() == want
    assert rollup.commit("c", make(("delete", 1, None, None, "v1", None)))
    assert totals() == {k: v for k, v in want.items() if k[0] != "t"}


def test_rollup_refuses_unknown_changes(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    rows = spark.createDataFrame([("upsert", 1, "s", "en", "v1", 1)], "op string, doc_id long, source string, lang string, version string, tokens long")
    with pytest.raises(ValueError, match="op"):
        rollup.commit("a", rows)
    assert rollup.totals().count() == 0


def test_documents_rollup_against_brute_force(spark, tmp_path):
    from lektura.llm.token_rollup import documents_rollup

    rows = [(1, "a  b c", "s", "en"), (2, "a  b c", "s", "en"), (3, None, None, "de"), (4, "", "s", None), (5, LONG, "t", "en"), (6, "one two", "t", "de"), (7, None, "t", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit("clash")).withColumn("version", F.lit("clash"))
    want, seen = defaultdict(lambda: [0, 0]), set()
    for _, text, source, lang in rows:
        if (text or "") in seen:
            continue
        seen.add(text or "")
        text = None if text is None else " ".join(text.split())
        for version, n in (("words", len((text or "").split())), ("byte_bpe_50k", len(tokens.byte_bpe().encode(text)) if text else 0)):
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
    got = {(r["source"], r["lang"], r["version"]): [r["docs"], r["tokens"]] for r in documents_rollup(docs, f"file://{tmp_path}/a").collect()}
    assert got == dict(want)
    assert documents_rollup(docs.limit(0), f"file://{tmp_path}/b").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(900, 16))
    vectors[100:300] = vectors[100]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (2004, [1.0, 2.0]), (2005, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    asked = table.where("vec_id % 20 = 0")
    for factor, least in ((1.0, 1.0), (1.3, 0.9), (1.5, 0.9)):
        found = defaultdict(list)
        for r in vptree.nearest(table, asked, k=10, factor=factor, shard_rows=200, block_rows=16).collect():
            found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        right = total = 0
        for q in range(0, 900, 20):
            score = vectors @ vectors[q]
            want = sorted((i for i in range(900) if i != q), key=lambda i: (-round(score[i], 9), i))[:10]
            got = [i for _, i, _ in sorted(found[q])]
            assert len(got) == 10 and [r for r, _, _ in sorted(found[q])] == list(range(1, 11))
            assert all(abs(s - score[i]) < 1e-12 for _, i, s in found[q])
            right += len(set(got) & set(want))
            total += 10
        assert right / total >= least
    assert 2004 not in {k for k in found if k >= 2000} or found[2004] == []
    # Huge values, an id with two vectors, ties at the last place across shards.
    odd = [(20, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (4, [3.0, 0.0]), (5, [1.0, 5.0]), (6, [1.0, -5.0])]
    odd = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = vptree.nearest(odd, odd.where("vec_id = 20"), k=4, factor=1.0, shard_rows=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, float("inf")), (4, 2e200), (3, 1e200), (5, 1e200)]
    assert vptree.nearest(odd, odd.where("vec_id = 20"), k=9).count() == 6
    assert vptree.nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.5, 1.0, None])
def test_tree_recall_where_lengths_spread_or_cluster(sigma):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(vptree.SHARD, 64))
    if sigma is None:
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, len(x))] + 0.3 * x
    else:
        x *= np.exp(sigma * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    asked = ids[ids % 40 == 0]
    tree, score = vptree.VpTree(ids, x, 21), x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    for factor, least in ((1.0, 1.0), (1.3, 0.95)):
        found, _ = tree.search(asked, x[asked], 20, factor)
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) >= least


def test_tree_of_tiny_zero_band_and_huge_lengths():
    """Lengths whose squares underflow beside the longest share a last band; each is still found."""
    rng = np.random.default_rng(32)
    x = rng.normal(size=(600, 8)) * 10.0 ** rng.integers(-250, 150, size=(600, 1))
    ids = np.arange(600)
    tree = vptree.VpTree(ids, x, 600)
    found, best = tree.search(ids[:20], x[:20], 599, 1.0)
    for i in range(20):
        assert sorted(found[i]) == [j for j in range(600) if j != i] and (np.diff(best[i]) <= 0).all()


def test_nearest_misses_nothing_in_tight_clusters(spark):
    rng = np.random.default_rng(33)
    for clusters, spread in ((10, 0.05), (3, 1e-7)):
        x = rng.normal(size=(clusters, 16))[np.arange(3000) % clusters] + spread * rng.normal(size=(3000, 16))
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        asked = np.arange(0, 3000, 20)
        score = np.einsum("qd,xd->qx", x[asked], x)
        score[np.arange(len(asked)), asked] = -np.inf
        want = np.lexsort((np.broadcast_to(np.arange(3000), score.shape), -score), axis=-1)[:, :20]
        got = vptree.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").toPandas()
        assert (got["vec_id"].to_numpy().reshape(-1, 20) == want).all()


def test_rejects_nothing_by_name_only():
    assert packing.pieces_of(0, 1024) == [] and packing.pieces_of(1024, 1024) == [1024] and packing.pieces_of(2050, 1024) == [2, 1024, 1024]
