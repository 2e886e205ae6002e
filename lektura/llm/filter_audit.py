"""Filter interaction audit over a sparse document-term matrix.

Tasks read documents in batches; a batch is a shard: its own word list, and rows in compressed sparse form (CSR) over it.
Only each shard's different words are shuffled to be numbered for the whole corpus; the numbers go back to the shard and
replace its own, so no pair of a document and a word is shuffled by itself. A row's sum is the document's number of words, its
number of entries that of different words. With the flags of the other filters, documents become a handful of counts
for each part and set of failed filters, from which all orders of the filters are answered.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektura.llm.common import cut, small_batches, written

FILTERS = "ABCDE"
ODD = (b"#", b"$", b"%", b"&", b"*", b"|")
NOT_CAPITAL = bytes(x for x in range(256) if not 65 <= x <= 90)

_SHARDS = "shard long, words array<binary>, ids array<long>, parts array<string>, flags binary, texts array<binary>, starts binary, codes binary, counts binary"
_MATRIX = "shard long, ids array<long>, parts array<string>, flags binary, texts array<binary>, sums array<long>, kinds array<long>, starts binary, words binary, counts binary"
_types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _row(schema: str, **values) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], _types[kind]) for name, kind in fields], [name for name, _ in fields])


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed: first all lowest bytes, then the next."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def term_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each batch of documents: its different words, ids and parts, flags (bit 0: more than 3 in 100 characters are
    ``A-Z``; bit 1: one of ``#$%&*|``), SHA-256 of the texts, and the CSR arrays over the shard's own words, compressed."""
    small_batches(docs.sparkSession, rows=5000)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("at"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            known: defaultdict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            codes, counts, starts, flags, texts = [], [], [0], bytearray(), []
            column = batch.column("text")
            for text, characters in zip(column.cast(pa.binary()).to_pylist(), pc.utf8_length(column).to_pylist()):
                own = Counter(text.split())  # bytes are parted at ASCII white space
                codes.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                counts.append(np.fromiter(own.values(), np.int32, len(own)))
                starts.append(starts[-1] + len(own))
                flags.append((100 * len(text.translate(None, NOT_CAPITAL)) > 3 * characters) + 2 * any(x in text for x in ODD))
                texts.append(hashlib.sha256(text).digest())
            if texts:
                yield _row(
                    _SHARDS, shard=(batch.column("at")[0].as_py() << 32) + k, words=list(known), ids=batch.column("id").to_pylist(), parts=batch.column("part").to_pylist(), flags=bytes(flags),
                    texts=texts, starts=np.array(starts, np.int64).tobytes(), codes=_packed(np.concatenate(codes)), counts=_packed(np.concatenate(counts)),
                )

    return rows.mapInArrow(shards, _SHARDS)


def dictionary(shards: DataFrame, bits: int = 32) -> DataFrame:
    """shard, code, word, number: the words of the shards with a number that no other word of the corpus has: ``bits`` of its
    hash, and its place in order among the words that share them. A frequent word has a row for each shard at most."""
    words = shards.select("shard", F.posexplode("words").alias("code", "word"))
    words = words.withColumn("h", F.shiftrightunsigned(F.xxhash64("word"), 64 - bits))
    place = F.dense_rank().over(Window.partitionBy("h").orderBy("word")) - 1
    numbered = words.withColumn("place", place)
    number = F.when(F.col("place") < 1 << (64 - bits), F.shiftleft("h", 64 - bits) + F.col("place")).otherwise(F.raise_error(F.lit("more words share a hash than have room")).cast("long"))
    return numbered.select("shard", "code", "word", number.alias("number"))


def term_matrix(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """The shards with the corpus's word numbers in place of their own (``words``, 64 bits each), row sums and the number of
    entries of each row."""

    def numbered(shard: pa.Table, known: pa.Table) -> pa.Table:
        number = np.zeros(known.num_rows, np.int64)
        number[known["code"].to_numpy()] = known["number"].to_numpy()
        x = {name: shard[name][0].as_py() for name in shard.column_names}
        starts = np.frombuffer(x["starts"], np.int64)
        counts, words = (_unpacked(x[c], int(starts[-1])) for c in ("counts", "codes"))
        totals = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        row = _row(_MATRIX, **{c: x[c] for c in ("shard", "ids", "parts", "flags", "texts", "starts")}, sums=totals[starts[1:]] - totals[starts[:-1]], kinds=np.diff(starts), words=number[words].tobytes(), counts=counts.tobytes())
        return pa.Table.from_batches([row])

    return shards.drop("words").groupBy("shard").cogroup(numbers.select("shard", "code", "number").groupBy("shard")).applyInArrow(numbered, _MATRIX)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", few_words: int = 200, kinds_share: int = 50) -> DataFrame:
    """id, part, fails: a row a document, with the filters it fails as bits from A, the lowest, to E.

    A: under ``few_words`` words; B: different words under ``kinds_share`` in 100; C: ``A-Z`` over 3 in 100 characters; D: one
    of ``#$%&*|``; E: the text of a smaller id, whatever becomes of that document. Words are parted by ASCII white space,
    case counts. Null texts and parts are empty ones. Rows of a null id fail E never and make no other row fail it;
    rows that repeat an id and text pass or fail together. Other columns are ignored, whatever their names.
    """
    shards = written(term_shards(docs, id_col, text_col, part_col))
    matrix = term_matrix(shards, dictionary(shards))
    at = F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("at")
    rows = matrix.select("ids", "parts", "flags", "texts", "sums", "kinds", at).select(
        F.get("ids", F.col("at")).alias("id"), F.get("parts", F.col("at")).alias("part"), F.get("texts", F.col("at")).alias("text"), F.get("sums", F.col("at")).alias("words"),
        F.get("kinds", F.col("at")).alias("kinds"), F.conv(F.hex(F.substring("flags", F.col("at") + 1, 1)), 16, 10).cast("int").alias("flags"),
    )
    bit = lambda fails, n: fails.cast("int") * (1 << n)
    own = bit(F.col("words") < few_words, 0) + bit(100 * F.col("kinds") < kinds_share * F.col("words"), 1) + F.col("flags") * 4
    rows = cut(rows.select("id", "part", "text", own.alias("own")))
    firsts = rows.groupBy("text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text", "first")
    return rows.join(firsts, "text", "left").select("id", "part", (F.col("own") + bit(F.coalesce(F.col("first") < F.col("id"), F.lit(False)), 4)).alias("fails"))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """From counts (part, fails, good, toxic, n) a row for each part, order of the filters and step: documents kept after
    the step, removed in it, redundant (failing its filter, removed before), unique_fails (failing it alone), good and
    toxic ones lost in it, and what its filter removes summed over all orders."""
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("cells"))  # 128 cells at most
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    steps = gathered.select("part", "cells", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(filters), letter) - 1).cast("int")
    before = sum((F.when(F.lit(k) < F.col("step"), bit(F.substr("filter_order", F.lit(k), F.lit(1)))).otherwise(0) for k in range(1, len(filters))), F.lit(0))
    made = steps.select("*", bit(F.substr("filter_order", F.col("step"), F.lit(1))).alias("own"), before.alias("before"))

    def total(which) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    here = lambda x: x["fails"].bitwiseAND(F.col("own")) != 0
    earlier = lambda x: x["fails"].bitwiseAND(F.col("before")) != 0
    counted = made.select(
        "part", "filter_order", "step", "own",
        total(lambda x: ~here(x) & ~earlier(x)).alias("kept"), total(lambda x: here(x) & ~earlier(x)).alias("removed"), total(lambda x: here(x) & earlier(x)).alias("redundant"),
        total(lambda x: x["fails"] == F.col("own")).alias("unique_fails"), total(lambda x: here(x) & ~earlier(x) & x["good"]).alias("good_lost"), total(lambda x: here(x) & ~earlier(x) & x["toxic"]).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", few_words: int = 200, kinds_share: int = 50) -> DataFrame:
    """``interactions`` of the five filters of ``failures``, by part. ``labels`` (id, quality, toxic) may miss documents and
    repeat them; one row that says 1 is enough. Tables without rows give none."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marked = marked.where("id is not null and (good or toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = failures(docs, id_col, text_col, part_col, few_words, kinds_share).join(marked, "id", "left")
    cells = joined.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    return interactions(cut(cells))
