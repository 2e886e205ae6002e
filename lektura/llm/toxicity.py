"""Toxicity by Levenshtein automata intersected with a lexicon trie, with scores of the context of each match.

The lexicon is learned: word beginnings and whole words that toxic training texts hold far more often than clean ones,
one text of each group of near copies counting once. A text's words are matched by walking the trie and the word's
Levenshtein automaton together, so one walk tries every term within the distance; a branch ends where the automaton dies.
Each match is weighed by its surroundings: between quotation marks or near a word of reporting, and not near an
address, it is a quotation; several within a few words are abuse. A logistic regression over these sums scores a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import bounded, cut, held_out, small_batches

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 8
EDITED_FROM = 5  # for each edit a term must have so many letters; shorter ones match without edits only
QUOTES = "\"“”„«»‹›‘’"
#: Words of reporting and of address, in the corpus's languages.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word words term insult insults slur slurs sagte schrieb nannte wort begriff dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
FEATURES = 7


class Levenshtein:
    """The automaton of the strings within ``distance`` edits of a word, made state by state.

    A state is the set of (letters of the word used, edits made) that reading a string can lead to, without those that
    another of the state makes needless. Seen from its first place, a state's step depends only on which of the word's
    next letters are the letter read, so steps are kept in one table for all words."""

    steps: dict[tuple, tuple[int, tuple] | None] = {}

    def __init__(self, word: str, distance: int):
        self.n, self.distance, self.places = len(word), distance, {}
        for i, letter in enumerate(word):
            self.places[letter] = self.places.get(letter, 0) | 1 << i
        self.start = 0, ((0, 0),)

    def step(self, state: tuple[int, tuple], letter: str) -> tuple[int, tuple] | None:
        """The state after one letter more; None if no string that begins so is near enough."""
        base, own = state
        width = min(self.n - base, 2 * self.distance + 1)
        key = self.distance, own, width, self.places.get(letter, 0) >> base & (1 << width) - 1
        if key not in self.steps:
            self.steps[key] = self._step(*key)
        found = self.steps[key]
        return found and (base + found[0], found[1])

    @staticmethod
    def _step(distance: int, own: tuple, width: int, same: int) -> tuple[int, tuple] | None:
        after = set()
        for at, edits in own:
            for skipped in range(min(distance - edits, width - at - 1) + 1):  # letters of the word left out
                if same >> at + skipped & 1:
                    after.add((at + skipped + 1, edits + skipped))
            if edits < distance:
                after.add((at, edits + 1))  # a letter too many
                if at < width:
                    after.add((at + 1, edits + 1))  # another letter
        kept = sorted(x for x in after if not any(y != x and x[1] - y[1] >= abs(x[0] - y[0]) and y[1] < x[1] for y in after))
        return (kept[0][0], tuple((at - kept[0][0], edits) for at, edits in kept)) if kept else None

    def edits(self, state: tuple[int, tuple], whole: bool) -> int:
        """The fewest edits between the string read and the word, or a beginning of the word if not ``whole``."""
        return min(edits + (self.n - state[0] - at) * whole for at, edits in state[1])


@dataclass
class Lexicon:
    """Terms: beginnings of words, or whole words marked by a last ``$``; by term its strength and whether edits count."""

    terms: dict[str, float]
    strict: frozenset[str] = frozenset()
    distance: int = 1
    memo: dict[str, tuple[str, int] | None] = field(default_factory=dict, repr=False)
    trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.whole = {t[:-1] for t in self.terms if t.endswith("$")}
        self.begins = {t for t in self.terms if not t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.begins})
        self.parts: dict[tuple[int, int], set[str]] = {}  # of a term cut into one part more than there are edits, one stays as it is
        for term in self.terms:
            letters = term.rstrip("$")
            if len(letters) < EDITED_FROM * self.distance or term in self.strict:
                continue
            node = self.trie
            for c in letters:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(term)
            cuts = [len(letters) * k // (self.distance + 1) for k in range(self.distance + 2)]
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                for at in range(lo - self.distance, lo + self.distance + 1) if k else (0,):
                    if at >= 0:
                        self.parts.setdefault((at, hi - lo), set()).add(letters[lo:hi])

    def __getstate__(self):
        return {"terms": self.terms, "strict": self.strict, "distance": self.distance}

    def __setstate__(self, state):
        self.__init__(**state)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the lower-case word matches, and by how many edits."""
        try:
            return self.memo[word]
        except KeyError:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[word] = self._match(word)
            return found

    def _match(self, word: str) -> tuple[str, int] | None:
        for n in self.lengths:
            if word[:n] in self.begins:
                return word[:n], 0
        if word in self.whole:
            return word + "$", 0
        if any(word[at : at + n] in known for (at, n), known in self.parts.items()):
            return self.nearest(word)
        return None

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term of the fewest edits from the word, the first by name of equals, by walking trie and automaton."""
        automaton, best = Levenshtein(word, self.distance), None
        stack = [(self.trie, automaton.start)]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    for term in child:
                        edits = automaton.edits(state, term.endswith("$"))
                        if edits <= self.distance and (best is None or (edits, term) < best):
                            best = edits, term
                elif after := automaton.step(state, letter):
                    stack.append((child, after))
        return best and (best[1], best[0])

    def hits(self, text: str) -> list[tuple[str, int, int, bool]]:
        """Term, edits, word number and whether quoted, of each match in the lower-cased text."""
        match = self.match
        if not any(map(match, set(WORD.findall(text)))):
            return []
        words = [(m.group(), m.start()) for m in WORD.finditer(text)]
        marks = np.array([m.start() for m in re.finditer(f"[{QUOTES}\\n]", text)] or [-1])
        found = []
        for i, (word, at) in enumerate(words):
            if hit := match(word):
                near = {w for w, _ in words[max(0, i - WINDOW) : i + WINDOW + 1]}
                found.append((*hit, i, (self._inside(text, marks, at) or bool(near & REPORTING)) and not near & ADDRESS))
        return found

    @staticmethod
    def _inside(text: str, marks: np.ndarray, at: int) -> bool:
        """Whether an odd number of quotation marks stand before it in its line, and another follows in it."""
        k, before = int(np.searchsorted(marks, at)), 0
        after = k < len(marks) and marks[k] >= 0 and text[marks[k]] != "\n"
        while k > 0 and marks[k - 1] >= 0 and text[marks[k - 1]] != "\n":
            before, k = before + 1, k - 1
        return after and before % 2 == 1

    def features(self, text: str | None) -> tuple[np.ndarray, list[tuple[str, int, int, bool]]]:
        hits = self.hits((text or "").lower())
        x = np.zeros(FEATURES)
        if hits:
            abusive = [h for h in hits if not h[3]]
            x[0] = np.log1p(sum(1 for h in abusive if not h[1]))
            x[1] = np.log1p(sum(1 for h in abusive if h[1]))
            x[2] = np.log1p(len(hits) - len(abusive))
            x[3] = max((self.terms[h[0]] for h in abusive if not h[1]), default=0)
            at = np.array([h[2] for h in abusive])
            x[4] = np.log1p((np.searchsorted(at, at + WINDOW, "right") - np.arange(len(at))).max()) if len(at) else 0
            x[5] = np.log1p(len({h[0] for h in abusive}))
            x[6] = bool(len([h for h in abusive if not h[1]]))
        return x, hits


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def candidates(texts: Iterator[str]) -> Counter:
    """By word beginning of 4 to 10 letters, and by whole word: in how many texts it stands."""
    found: Counter = Counter()
    for text in texts:
        words = set(WORD.findall(text.lower()))
        begins = {w[:n] for w in words for n in range(4, min(len(w), 10) + 1)}
        found.update(begins)
        found.update(w + "$" for w in words if len(w) > 2)
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 20_000, times: float = 20.0) -> Model:
    """Fits on a bounded sample: ``rows`` labelled rows at most, drawn by hash of the id; rows that have several labels
    are toxic if one says so; of rows that repeat an id the smallest text counts. A term stands in ``times`` times the
    share of toxic texts as of clean ones; of a term and its own beginnings the shortest that qualifies counts, drawn out
    as far as its texts agree. The sample bounds the number of terms. Null ids and labels teach nothing."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    drawn = cut(known.orderBy(F.xxhash64(id_col), id_col).limit(rows))
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(bounded(drawn, rows), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("y").alias("y"))
    # Near copies mostly share the smallest hash of three words in a row, which others hardly do.
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, 3), " ")))
    sample = cut(texts.withColumn("ws", F.split(F.lower("text"), r"\s+")).withColumn("near", F.array_min(three)).groupBy("near", "y").agg(F.min("text").alias("text")).select("text", "y"))
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sum(c for y, c in n.items() if y), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(Lexicon({}), np.append(np.zeros(FEATURES), np.log((n_toxic + 0.5) / (n_clean + 0.5) / 10)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                for y, part in batch[at : at + 500].groupby("y"):
                    found = candidates(part["text"])
                    yield pd.DataFrame({"term": list(found), "y": y, "n": list(found.values())})

    split = sample.repartition(64).mapInPandas(count, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    best = split.where(F.col("t") >= max(3, min(8, n_toxic // 10), n_toxic // 50)).withColumn("strength", ratio).where(F.col("strength") >= float(np.log(times)))
    found = best.collect()  # terms of several texts of the sample, which ``rows`` bounds
    by_term = {r["term"]: r for r in found}
    kept: dict[str, float] = {}
    shortest: set[str] = set()
    for term in sorted(by_term, key=lambda t: (len(t.rstrip("$")), t)):
        letters = term.rstrip("$")
        if not any(letters[:k] in shortest for k in range(4, len(letters) + 1)):
            shortest.add(term)
            # As long as nearly all its texts have one longer form, that is the term.
            longer = [t for t in by_term if t.startswith(term) and not t.endswith("$") and by_term[t]["t"] >= 0.9 * by_term[term]["t"]]
            kept[max(longer, key=lambda t: (len(t), t), default=term)] = by_term[term]["strength"]
    lexicon = Lexicon(kept)
    seen = _features(sample, lexicon).collect()  # bounded by ``rows``
    edited: dict[str, list[int]] = {}
    for r in seen:
        for term in set(r["edited"]):
            edited.setdefault(term, [0, 0])[r["y"] > 0] += 1
    # Edits stop to count for a term whose edited forms are no sign of toxic texts.
    strict = frozenset(t for t, (c, x) in edited.items() if (x + 0.5) / n_toxic < 5 * (c + 0.5) / n_clean)
    if strict:
        lexicon = Lexicon(kept, strict)
        seen = _features(sample, lexicon).collect()
    return Model(lexicon, _regression(np.array([r["x"] for r in seen]), np.array([r["y"] > 0 for r in seen], float)))


def _features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "x": [x.tolist() for x, _ in found], "edited": [[h[0] for h in hits if h[1]] for _, hits in found]})

    return sample.mapInPandas(each, "y int, x array<double>, edited array<string>")


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of docs and ``_toxic``, a struct of score, predicted, hits (matches), quoted (those that are
    quotations) and terms. Null and empty texts have no matches and the score of such texts. Whole texts are read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's size

    @F.pandas_udf("score double, predicted int, hits int, quoted int, terms array<string>")
    def each(text: pd.Series) -> pd.DataFrame:
        model = shared.value
        found = [model.lexicon.features(t) for t in text]
        p = model.score(np.array([x for x, _ in found]).reshape(-1, FEATURES))
        hits = [h for _, h in found]
        return pd.DataFrame({"score": p, "predicted": (p >= threshold).astype(int), "hits": list(map(len, hits)), "quoted": [sum(x[3] for x in h) for h in hits], "terms": [sorted({x[0] for x in h}) for h in hits]})

    return docs.withColumn("_toxic", each(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every row: id, held_out, score, predicted, hits, quoted.

    Null and empty texts have the score of texts without matches; whole texts are read, long ones too. Rows that repeat an
    id are scored each for itself; a null id is not held out. Without labels of both kinds all rows have one low score; an
    empty table gives an empty result; other columns are ignored.
    """
    found = scored(docs, learn(docs, labels, id_col))
    return found.select(id_col, held_out(id_col).alias("held_out"), "_toxic.score", "_toxic.predicted", "_toxic.hits", "_toxic.quoted")
