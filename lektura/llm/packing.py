"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program covers every length's count with as few
configurations as it can. Multiplicative weights give each length a price, which falls as its count gets covered; a
knapsack dynamic program finds the configuration of the highest price. The solution is rounded under the last prices:
the best configuration among the pieces left is used as often as their counts allow, until none is left.

The histogram has at most ``capacity`` rows at any size of the input; only it reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektura.llm.common import cut, small_batches
from lektura.llm.tokens import byte_bpe

END = 2
CAPACITY = 1024


def pieces_of(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than the capacity."""
    whole, first = divmod(total, capacity)
    return [first] * (first > 0) + [capacity] * whole


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None) -> DataFrame:
    """id, piece, start, length, crc, part, nth: the pieces, each with its place among those of its length in a task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seen = byte_bpe(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].tolist(), batch["text"]):
                codes = np.append(encoder.encode(text or ""), end)
                start = 0
                for piece, length in enumerate(pieces_of(len(codes), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(codes[start : start + length]), part, int(seen[length])))
                    seen[length] += 1
                    start += length
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "crc", "part", "nth"])

    small_batches(docs.sparkSession)
    columns = F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")  # pandas has no long with nulls
    return docs.select(*columns).mapInPandas(each, "id string, piece int, start long, length long, crc long, part int, nth long")


def prices(counts: np.ndarray, capacity: int, grain: int = 4, rounds: int = 1500, rate: float = 0.2) -> np.ndarray:
    """A price for each length 0 to capacity, from multiplicative weights on the program with lengths rounded up to ``grain``."""
    units = capacity // grain
    need = np.bincount(-(-np.arange(capacity + 1) // grain), counts, units + 1)
    sizes = np.flatnonzero(need[: units + 1])
    sizes = sizes[sizes > 0]
    weight = sizes / units
    covered, best, pick = np.zeros(len(sizes)), np.zeros(units + 1), np.zeros(units + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(units + 1), "right")
    for _ in range(rounds):
        for c in range(1, units + 1):
            n = upto[c]
            best[c], pick[c] = best[c - 1], -1
            if n:
                value = best[c - sizes[:n]] + weight[:n]
                k = value.argmax()
                if value[k] > best[c]:
                    best[c], pick[c] = value[k], k
        used, c = np.zeros(len(sizes)), units
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                used[pick[c]] += 1
                c -= sizes[pick[c]]
        share = used / need[sizes]
        share /= share.max()
        covered += rate * share
        weight = sizes / units * np.exp(-0.5 * (covered - covered.mean()))
        weight /= weight.max()
    price = np.zeros(capacity + 1)
    price[1:] = np.interp(np.arange(1, capacity + 1) / grain, sizes, weight) if len(sizes) else np.arange(1, capacity + 1) / capacity
    return price


def best_filling(lengths: np.ndarray, left: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the highest price among the pieces left, by dynamic programming over the room."""
    best, items = np.zeros(capacity + 1), []
    for length, n, p in zip(lengths.tolist(), left.tolist(), price.tolist()):
        n, times = min(n, capacity // length), 1
        while n > 0:  # multiplicities in binary
            times = min(times, n)
            w = length * times
            value = best[:-w] + p * times
            took = value > best[w:]
            best[w:] = np.where(took, value, best[w:])
            items.append((length, times, w, took))
            n, times = n - times, times * 2
    found: dict[int, int] = {}
    room = int(best.argmax())
    for length, times, w, took in reversed(items):
        if room >= w and took[room - w]:
            found[length] = found.get(length, 0) + times
            room -= w
    return found


def configurations(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used; together they hold every piece exactly once."""
    left = counts.astype(np.int64).copy()
    found = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if left.any():
        priced = prices(left, capacity)
    while left.any():
        lengths = np.flatnonzero(left)[::-1]
        # The longest piece left is placed now, with the filling that the prices favour; so no long ones are stranded.
        longest = int(lengths[0])
        left[longest] -= 1
        room = capacity - longest
        fit = lengths[(lengths <= room) & (left[lengths] > 0)]
        used = best_filling(fit, left[fit], fit * (1 + 0.1 * priced[fit]), room) if len(fit) else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(left[length]) // m for length, m in used.items())
        for length, m in used.items():
            left[length] -= m * times
        found.append((used, times))
    return found


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: empty text) and then id 2; one of more than ``capacity`` ids is cut, its first
    piece being the shorter one. Sequences are filled without gaps from 0. Rows that repeat an id or a text are packed
    each for itself; an empty table gives an empty result; other columns are ignored.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, tokenizer))
    tallies = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in tallies.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    placed, sequences = np.zeros(capacity + 1, np.int64), 0
    for used, times in configurations(counts, capacity):
        offset = 0
        for length, m in sorted(used.items(), reverse=True):
            runs.setdefault(length, []).append((int(placed[length]), m, sequences, offset))
            placed[length] += m * times
            offset += m * length
        sequences += times
    tables = {length: np.array(x, np.int64) for length, x in runs.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
            length, rank = batch["length"].to_numpy(), batch["before"].to_numpy() + batch["nth"].to_numpy()
            for x in np.unique(length):
                at = length == x
                run = tables[x][np.searchsorted(tables[x][:, 0], rank[at], "right") - 1]
                copy, slot = np.divmod(rank[at] - run[:, 0], run[:, 1])
                sequence[at], offset[at] = run[:, 2] + copy, run[:, 3] + slot * x
            yield batch[["id", "piece", "start", "length", "crc"]].assign(sequence_id=sequence, offset=offset)

    # The pieces of a length are numbered by task and place in it: no rows of one length meet in one task.
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tallies.select("part", "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    found = pieces.join(before, ["part", "length"]).mapInPandas(place, "id string, piece int, start long, length long, crc long, sequence_id long, offset long")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
