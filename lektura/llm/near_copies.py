"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, joined into groups.

SimHash comes first: fingerprints of the shingles that 4 or fewer differing bits link, by covering masks, make groups, and
each member is compared with one of its group, which settles close copies in a comparison each. SimHash within few bits
finds few of the pairs near 0.8, so what it leaves apart goes on: further candidates share one of 16 keys, each made of 4
min-hashes; a pair at similarity 0.8 shares one with a probability of 0.9998, a closer one with more. Every link is verified
on the sets themselves. Within a key all pairs that could still join two groups are compared: at once where they are few,
else members in turn, one first and then more, are compared with all the others, until those left are few or of one
group. So a large group of near copies takes about as many comparisons as it has members and keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import bounded, cut, small_batches
from lektura.llm.components import components, lot_of
from lektura.llm.passages import _in_parts, _mixed, shingles, word_hashes
from lektura.llm.simhash import links as fingerprint_links
from lektura.llm.simhash import majority

BANDS, ROWS = 16, 4
SALTS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
AT_ONCE = 2  # pairs a member that are compared at once in the first turn; in each later one four times as many


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's different shingles of five words; fewer words are one shingle, no words none."""
    found = []
    for part in _in_parts(texts):
        for words in word_hashes(texts[part]):
            whole = np.array([xxhash.xxh64_intdigest(words.tobytes())][: len(words)], np.uint64)
            found.append(np.unique(shingles(words)) if len(words) >= 5 else whole)
    return found


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of sets that are not empty, a row each."""
    found = np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.array([len(x) for x in sets])
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sets):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + 200_000)))
        own, first = np.concatenate(sets[begin:end]), ends[begin:end] - sizes[begin:end] - (ends[begin] - sizes[begin])
        for k in range(BANDS):
            key = np.full(end - begin, k, np.uint64)
            for salt in SALTS[k * ROWS : (k + 1) * ROWS]:
                key = _mixed(key * np.uint64(0x100000001B3) ^ np.minimum.reduceat(_mixed(own ^ salt), first))
            found[begin:end, k] = key
        begin = end
    return found


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst: those of the pairs a, b that reach the similarity."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right = []
            for x, y in zip(batch["sa"], batch["sb"]):
                both = len(np.intersect1d(x, y, assume_unique=True))
                right.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pd.DataFrame({"src": batch["a"], "dst": batch["b"]})[np.array(right, bool)]

    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb").mapInPandas(each, "src long, dst long"))


def _close(nodes: DataFrame) -> DataFrame:
    """a, b: each node (node, n, fp) of a group that links of fingerprints make, with the group's least. Empty sets take no part."""
    prints = nodes.where("n > 0").select("node", "n", "fp")
    groups = components(fingerprint_links(prints.select("fp").distinct())).toDF("fp", "root")
    placed = prints.join(groups.hint("merge"), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min_by("n", "node").alias("nb"), F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return placed.join(least.hint("merge"), "root").where("node <> b").select(F.col("node").alias("a"), "b", "n", "nb")


def _linkable(members: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those members (key, node, n) of whose shingles enough are also in a member of another group, with their number
    ``reach``: no two sets have more in common. So what shares a key for a frequent passage, and no more, is not compared."""
    rooted = members.select("node", "n").distinct().join(groups.hint("merge"), "node")
    held = cut(rooted.join(sets.hint("merge"), "node").select("node", "n", "root", F.explode("shingles").alias("shingle")))
    both = held.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    kept = held.join(both.hint("merge"), "shingle", "left_semi").groupBy("node", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= similarity * F.col("n") - 1e-9)
    return members.select("key", "node", "n").join(cut(kept.select("node", F.col("c").alias("reach"))).hint("merge"), "node")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id, component_id (the smallest id of the group that verified links make, its own
    included), mark (a hash of the text) and stays: true for the rows of one id and mark in each group, the smallest.
    Joins are by merging: broadcasts of many small tables would fill the driver.

    Words are lower-cased and parted by white space. Documents without words are copies of each other. Rows that repeat
    an id are documents of their own with the same id; a null id is never the smallest unless all are null. Rows that
    repeat id and text have the same result: of them ``one_of_each`` keeps one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("node long, n long, fp long, keys array<long>")
    def marks(text: pd.Series) -> pd.DataFrame:
        sets = shingle_sets(text.tolist())
        keys = iter(band_keys([x for x in sets if len(x)]).view(np.int64).tolist())
        nodes = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
        prints = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "n": [len(x) for x in sets], "fp": prints, "keys": [next(keys) if len(x) else [] for x in sets]})

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist())
            yield pd.DataFrame({"node": np.array([node_of(x) for x in sets], np.uint64).view(np.int64), "shingles": [x.view(np.int64) for x in sets]})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(base.select("id", text_mark("text").alias("mark"), marks("text").alias("x")).select("id", "mark", "x.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "mark"))  # nulls last
    nodes = cut(rows.groupBy("node").agg(first.alias("least"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")))
    close = cut(_close(nodes).where(_alike("n", "nb", similarity)).select("a", "b"))
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    members = cut(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key").hint("merge"), "key"))
    involved = cut(members.select("node").union(close.select("a")).union(close.select("b")).distinct())
    # One row stands for its copies; rows that merely repeat its id go by their own set.
    wanted = bounded(cut(nodes.join(involved.hint("merge"), "node", "left_semi").select(F.col("least.id").alias("_id")).distinct()), 1_000_000)
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.select("text").mapInPandas(contents, "node long, shingles array<long>").join(involved.hint("merge"), "node", "left_semi")
    sets = cut(found.groupBy("node").agg(F.any_value("shingles").alias("shingles")))

    links, turn, members = _linked(close, sets, similarity), 0, members.withColumn("reach", F.col("n"))
    while True:
        groups = cut(involved.join(components(links).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        if turn:
            members = _linkable(members, groups, sets, similarity)
        placed = members.join(groups.hint("merge"), "node").withColumn("lot", lot_of("node"))
        each = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.min("lot").alias("lot")).groupBy("key")
        each = each.agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.max_by("root", "c").alias("most"), F.min("lot").alias("first")).where("q < m * m")
        placed = cut(placed.join(each.hint("merge"), "key"))
        if placed.isEmpty():
            break
        # At once where that takes no more pairs a member than the turn itself. Else in turn: four times as many each time,
        # the same ones for all keys as far as that goes.
        few = (F.col("m") * F.col("m") - F.col("q")) / 2 <= AT_ONCE * 4.0**turn * F.col("m")
        in_turn = (F.col("lot") == F.col("first")) | (F.col("lot") * F.col("m") < (4.0**turn if turn else 0.0))
        placed = placed.withColumn("asks", F.when(few, F.col("root") != F.col("most")).otherwise(in_turn))
        a, b = (placed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "reach", "root", "asks")]) for x in "ab")
        met = a.where("asks_a").join(b.hint("merge"), "key").where("root_a <> root_b and (not asks_b or node_a < node_b)")
        met = met.where(_alike("n_a", "n_b", similarity))
        met = met.where((1 + similarity) * F.least("reach_a", "reach_b") >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6)
        new = _linked(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), sets, similarity)
        links, turn = links.union(new), turn + 1
        members = placed.where(~few & ~F.col("asks")).select("key", "node", "n")
        if members.isEmpty():
            break
    groups = components(links)
    rooted = nodes.select("node", "least").join(groups.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")).hint("merge"), "root").select("node", "first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    return rows.select("id", "mark", "node").join(of.hint("merge"), "node").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"), "mark", stays.alias("stays"))


def text_mark(text: str) -> Column:
    """A hash of the text; a null text is not an empty one."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which ``near_copies`` says that they stay: one of each group. Of rows that repeat its id and
    text, the one stays whose other columns are the smallest."""
    groups = near_copies(docs, id_col, text_col, **options).where("stays")
    stay = cut(groups.groupBy(F.col(id_col).alias("_id"), F.col("mark").alias("_mark")).agg(F.count(F.lit(1)).alias("_rows")))
    here = F.col(id_col).eqNullSafe(F.col("_id")) & (text_mark(text_col) == F.col("_mark"))
    kept = docs.join(stay.where("_rows = 1"), here, "left_semi")
    again = stay.where("_rows > 1")
    if again.isEmpty():
        return kept
    rows = docs.join(again, here).groupBy("_id", "_mark").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.union(rows)
