"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero vector of r + 1 bits; for each of the 2^(r+1) - 1 non-zero vectors v, a mask
keeps the positions whose vector has an odd product with v. For two fingerprints that differ in at most r positions
there are r equations in r + 1 unknowns, so some v has an even product with all of them: its mask drops every differing
position and the two meet in its table. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import cut, small_batches
from lektura.llm.components import components

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """Lower-cases A-Z, takes words between ASCII white space and their shingles of ``width`` words, repeats included
    (fewer words: the whole sequence; none: zero). A bit is 1 if it is set in over half the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths) + np.arange(n)
    starts = (ends - lengths)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):  # bounded memory for very long texts
        part = hashes[at : at + 16384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (the 64 bits as a signed long); one row per row of docs."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def each(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in text), np.uint64, len(text)).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), each(F.col(text_col)).alias("fp"))


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over the given bit positions; their vectors are dealt evenly, so each mask keeps about half of them."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(len(positions))]
    return [sum(1 << p for p, x in zip(positions, vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(values: np.ndarray, radius: int) -> list[np.ndarray]:
    """Edges of a spanning forest of the links within the radius, among distinct unsigned fingerprints."""
    edges, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges.append(np.stack([np.full(len(found), x), found], axis=1))
                queue += list(found)
                left = left[~near]
    return edges


def links(fps: DataFrame, radius: int = 4, largest: int = 4096) -> DataFrame:
    """src, dst: links within the radius that join each component of the distinct column fp of ``fps``; pairs of one
    bucket that others already join are left out.

    A bucket over ``largest`` is dealt out again: its members agree on the mask's bits, and a second covering of the
    other 32 bits puts at most 2^16 distinct fingerprints into a bucket, a bound that holds at every size.
    """
    spark = fps.sparkSession
    masks = covering_masks(radius, list(range(64)))

    def tables(rows: DataFrame) -> DataFrame:
        return rows.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("v", "key"))

    first = tables(fps)
    shared = cut(first.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(first.join(shared, ["v", "key"]))
    edges = _edges(members.where(F.col("n") <= largest), ["v", "key"], radius)
    large = members.where(F.col("n") > largest)
    if not large.isEmpty():
        rest = [(v, _signed(m | x)) for v, m in enumerate(masks) for x in covering_masks(radius, [p for p in range(64) if not m >> p & 1])]
        second = F.broadcast(spark.createDataFrame(rest, "v int, mask long"))  # (2^(r+1) - 1)^2 rows
        dealt = large.join(second, "v").select("v", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        again = dealt.groupBy("v", "mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = edges.union(_edges(dealt.join(again, ["v", "mask", "key"]), ["v", "mask", "key"], radius))
    return edges.distinct()


def _edges(members: DataFrame, bucket: list[str], radius: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Unsigned: of a negative number numpy counts the bits of its absolute value.
            found = [e for x in batch["fps"] for e in _linked(np.asarray(x, np.int64).view(np.uint64), radius)]
            pairs = np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return members.groupBy(*bucket).agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(each, "src long, dst long")


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, largest: int = 4096) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lowercase hex digits), component_id (the smallest id that links of
    at most ``radius`` differing bits reach, its own included).

    Documents without words, null texts included, have fingerprint zero and link like any other. Rows that repeat an
    id are documents of their own with the same id; a null id is never the smallest unless all are null. Other
    columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), radius, largest))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(rooted.join(of, "root").select("fp", "component_id"))
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
