"""Many fixed patterns in one scan of a text: an automaton with failure links, run over Arrow batches.

The automaton is a dense table, states by classes of bytes, so a step is one lookup. A batch's texts are one buffer; it is
cut into lanes of equal length that begin one pattern earlier than they report, and all lanes take a step at once in
numpy. Cost grows with the bytes of the texts, not with the number of patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LANE = 512
AT_ONCE = 2 << 20  # bytes of texts scanned together
HITS = "array<struct<rule:int,n:int,at:int>>"
LABELS = "array<struct<label:int,score:double,kinds:int,n:int,at:int,best:int>>"
_WORD: list[np.ndarray] = []  # per worker: whether a code point is part of a word


class Automaton:
    """Finds which of ``patterns`` stand in texts. Where ``whole`` says so, a pattern counts only between word borders."""

    def __init__(self, patterns: Sequence[str], whole: Sequence[bool] | None = None):
        made = [p.encode() for p in patterns]
        if not all(made):
            raise ValueError("a pattern must not be empty")
        self.length = np.array([len(p) for p in made], np.int64)
        self.whole = np.array(whole if whole is not None else [False] * len(made), bool)
        used = sorted({b for p in made for b in p})
        self.classes = np.zeros(256, np.int32)  # class 0 is every byte of no pattern
        self.classes[used] = np.arange(1, len(used) + 1)
        self._build([[int(self.classes[b]) for b in p] for p in made], len(used) + 1)

    def _build(self, patterns: list[list[int]], width: int) -> None:
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for rule, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    own.append([])
                state = children[state][c]
            own[state].append(rule)
        self.table = np.zeros((len(children), width), np.int32)
        fail, outputs, order = [0] * len(children), [list(x) for x in own], [0]
        for state in order:  # by depth, so that what a failure link leads to is ready
            row = self.table[fail[state]].copy() if state else self.table[0].copy()
            for c, child in children[state].items():
                fail[child] = int(row[c]) if state else 0
                row[c] = child
                order.append(child)
            self.table[state] = row
            outputs[state] = own[state] + outputs[fail[state]] if state else own[state]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in outputs])])
        self.rules = np.array([r for x in outputs for r in x], np.int64)
        self.ends = np.diff(self.first) > 0
        self.table = (self.table * width).ravel()  # a state is its row's place
        self.width = width

    def scan(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, rule and first byte of every occurrence in the texts that begin at ``starts``; the last one ends there."""
        begin, end = starts[:-1], starts[1:]
        lanes = -(-(end - begin) // LANE)
        row = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        report = begin[row] + nth * LANE
        at = np.maximum(report - int(self.length.max(initial=1)) + 1, begin[row])
        steps = np.minimum(report + LANE, end[row]) - at
        order = np.argsort(-steps, kind="stable")
        row, report, at, steps = row[order], report[order], at[order], steps[order]
        active = len(row) - np.searchsorted(steps[::-1], np.arange(int(steps.max(initial=0))), side="right")
        state, found = np.zeros(len(row), np.int32), []
        for step, n in enumerate(active):
            here = at[:n] + step
            state[:n] = self.table[state[:n] + self.classes[data[here]]]
            hit = np.flatnonzero(self.ends[state[:n] // self.width])
            if len(hit):
                hit = hit[here[hit] >= report[hit]]
                found.append((hit, here[hit], state[hit] // self.width))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        lane, last, state = (np.concatenate(x) for x in zip(*found))
        times = (self.first[state + 1] - self.first[state]).astype(np.int64)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rule = self.rules[np.repeat(self.first[state], times) + place]
        row, first = np.repeat(row[lane], times), np.repeat(last, times) - self.length[rule] + 1
        asked = np.flatnonzero(self.whole[rule])
        inside = np.zeros(len(rule), bool)
        if len(asked):
            a, b = first[asked], first[asked] + self.length[rule[asked]]
            inside[asked] = ~(self._border(data, a, begin[row[asked]], end[row[asked]]) & self._border(data, b, begin[row[asked]], end[row[asked]]))
        return row[~inside], rule[~inside], first[~inside]

    def _border(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a word begins or ends before the byte ``at`` of a text."""
        before = at - 1
        for _ in range(3):
            before = np.where((before > begin) & (data[np.maximum(before, 0)] & 0xC0 == 0x80), before - 1, before)
        left = (at > begin) & _in_word(data, np.maximum(before, 0))
        return left != ((at < end) & _in_word(data, np.minimum(at, len(data) - 1)))

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, rule, how often, first character: one entry for each rule found in a text, in order. Occurrences of one rule that
        overlap count from the left, as a search that goes on behind each would find them."""
        texts = texts.cast(pa.large_binary()) if texts.offset == 0 else pa.concat_arrays([texts]).cast(pa.large_binary())
        _, offsets, values = texts.buffers()
        starts = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(1, np.uint8)
        row, rule, first = self.scan(data, starts)
        order = np.lexsort((first, rule, row))
        row, rule, first = row[order], rule[order], first[order]
        keep = _apart(row, rule, first, self.length[rule])
        row, rule, first = row[keep], rule[keep], first[keep]
        new = _changes(row, rule)
        character = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        return row[new], rule[new], np.diff(np.append(new, len(row))), character[first[new]] - character[starts[row[new]]]

    def hits(self, texts: pa.Array) -> pa.Array:
        """For each text its rules found, in order: rule, how often, first character; null for null."""
        row, *entries = self.found(texts)
        return _lists(texts, row, dict(zip(("rule", "n", "at"), entries)))

    def labels(self, texts: pa.Array, label: np.ndarray, weight: np.ndarray) -> pa.Array:
        """For each text the labels of the rules found, in order: the sum of the rules' weights, how many rules, how often, the first
        character, and the rule of the greatest weight, the first of equal ones."""
        row, rule, n, at = self.found(texts)
        order = np.lexsort((rule, -weight[rule], label[rule], row))
        row, rule, n, at = row[order], rule[order], n[order], at[order]
        new = _changes(row, label[rule])
        total = lambda x, by=np.add: by.reduceat(x, new) if len(new) else x[:0]
        columns = {"label": label[rule[new]], "score": total(weight[rule]), "kinds": np.diff(np.append(new, len(row))), "n": total(n), "at": total(at, np.minimum), "best": rule[new]}
        return _lists(texts, row[new], columns)


def _apart(row: np.ndarray, rule: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Marks the occurrences, sorted, that overlap no marked one before them of their text and rule."""
    keep = np.ones(len(row), bool)
    close = np.flatnonzero((np.diff(row) == 0) & (np.diff(rule) == 0) & (np.diff(first) < length[1:])) + 1 if len(row) else np.zeros(0, np.int64)
    last = before = -1
    for at in close.tolist():  # few patterns overlap themselves
        if before != at - 1:
            last = at - 1
        before, keep[at] = at, first[at] - first[last] >= length[at]
        if keep[at]:
            last = at
    return keep


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which a row of the columns differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _lists(texts: pa.Array, row: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]) if len(texts) else np.zeros(1)
    entries = pa.StructArray.from_arrays([pa.array(c if c.dtype == float else c.astype(np.int32)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries, mask=texts.is_null() if texts.null_count else None)


def _in_word(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether the character whose first byte stands at ``lead`` is a letter, digit or ``_``."""
    if not _WORD:
        _WORD.append(np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)]))
    byte = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F
    x = data[lead].astype(np.int64)
    code = np.where(x < 0x80, x, np.where(x < 0xE0, (x & 0x1F) << 6 | byte(1), np.where(x < 0xF0, (x & 0x0F) << 12 | byte(1) << 6 | byte(2), (x & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3))))
    return _WORD[0][np.minimum(code, 0x10FFFF)]


def pattern_hits(text: Column, patterns: Sequence[str], whole: Sequence[bool] | None = None) -> Column:
    """An array of (rule, n, at): the patterns that stand in the text, by place in ``patterns``, how often, and the first
    character (from 0) of the first occurrence. A pattern with ``whole`` counts only between word borders. Case counts."""
    return _column(text, patterns, whole, HITS, lambda automaton, texts: automaton.hits(texts))


def label_hits(text: Column, rules: Sequence[tuple[int, str, float]], whole: Sequence[bool] | None = None) -> Column:
    """An array of (label, score, kinds, n, at, best) in order of label, for rules (label, pattern, weight): of the different
    patterns of a label that stand in the text the weights' sum and number, how often they stand there, the first
    character, and the heaviest of them, by place in ``rules``."""
    label, weight = np.array([r[0] for r in rules], np.int64), np.array([r[2] for r in rules], float)
    return _column(text, [r[1] for r in rules], whole, LABELS, lambda automaton, texts: automaton.labels(texts, label, weight))


def elements_hit(texts: Column, patterns: Sequence[str], whole: Sequence[bool] | None = None) -> Column:
    """For an array of texts an array of booleans: whether one of the patterns stands in each."""

    def look(automaton: Automaton, lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        hit = np.zeros(len(flat), bool)
        hit[automaton.found(flat)[0]] = True
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hit), mask=lists.is_null() if lists.null_count else None)

    if not patterns:
        return F.transform(texts, lambda x: F.lit(False))
    return _column(texts, patterns, whole, "array<boolean>", look)


def _parts(texts: pa.Array) -> list[tuple[int, int]]:
    """Stretches of a batch of about ``AT_ONCE`` bytes, one at least: a scan holds many times the bytes of its texts."""
    if pa.types.is_list(texts.type) or pa.types.is_large_list(texts.type):
        size = np.full(len(texts), texts.nbytes / max(len(texts), 1))
    else:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // AT_ONCE
    begins = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), len(texts)]))


def _column(text: Column, patterns: Sequence[str], whole: Sequence[bool] | None, kind: str, look: Callable[[Automaton, pa.Array], pa.Array]) -> Column:
    if not patterns:
        return F.when(text.isNotNull(), F.array().cast(kind))
    automaton = Automaton(patterns, whole)

    def find(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([look(automaton, texts.slice(begin, end - begin)) for begin, end in _parts(texts)])

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, kind)(text)
