"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text, its white space normalised, is cut into chunks where its own characters say so. Chunks are deduplicated to
identifiers, each verified to stand for one chunk text alone, and a document becomes the ordered list of its chunks'
identifiers. Equal lists mean equal texts, so only lists are grouped and joined; a text's bytes move once, when chunks
are deduplicated, and a chunk that many documents share moves once per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import SPACES, cut


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column, shortest: int, longest: int) -> Column:
    """Cuts after the first sentence end, or vowel and n, r, s or t, before a space that lies beyond ``shortest``
    characters, and at ``longest`` in any case. An edit moves no boundary but those next to it."""
    pattern = f"(?s).{{{shortest},{longest - 2}}}?(?:[.!?]|[aeiou][nrst]) |.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 512, longest: int = 8192, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text is an empty one,
    and empty texts form one group. Of equal texts the row with the smallest id stays; rows that repeat one id and
    text count as that many members and are the same document, so they are kept or dropped together. A null id never
    stays against another id. Other columns of ``docs`` are ignored, whatever their names. ``hash_bits`` under 64
    makes hashes of chunks collide, for tests.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))

    def hashed(chunk: Column) -> Column:
        return F.xxhash64(chunk) if hash_bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(2**hash_bits))

    cutting = chunks(F.col("norm"), shortest, longest)
    recipes = cut(base.select("id", F.sha2("norm", 256).alias("sha"), F.transform(cutting, hashed).alias("ids")))
    # Identifiers are verified on the chunks' own text: a hash that two texts share is a collision.
    distinct = base.select(F.explode(cutting).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    collided = cut(distinct.groupBy("h").count().where("count > 1").select("h"))
    if collided.isEmpty():
        recipes = recipes.withColumn("variants", F.array().cast("array<string>"))
    else:
        recipes = _with_variants(base, recipes, collided, cutting, hashed)
    groups = recipes.groupBy("ids", "variants").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # One row per list on the right, so Spark can split a list that a third of the documents share.
    joined = recipes.join(groups, ["ids", "variants"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, keep.isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _with_variants(base: DataFrame, recipes: DataFrame, collided: DataFrame, cutting: Column, hashed) -> DataFrame:
    """Adds, for the documents that hold a chunk of a collided hash, the strong digests of those chunks by position."""
    at = base.select("id", F.sha2("norm", 256).alias("sha"), F.posexplode(cutting).alias("pos", "chunk"))
    at = at.withColumn("h", hashed(F.col("chunk"))).join(collided, "h", "left_semi")
    strong = at.select("id", "sha", F.struct("pos", F.sha2("chunk", 256).alias("d")).alias("v")).distinct()
    lists = strong.groupBy("id", "sha").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["d"]).alias("variants"))
    both = (recipes["id"].eqNullSafe(lists["id"])) & (recipes["sha"] == lists["sha"])
    return recipes.join(lists, both, "left").select(
        recipes["id"], recipes["sha"], "ids", F.coalesce("variants", F.array().cast("array<string>")).alias("variants")
    )
