"""Classification of texts into one category by phrases, weighted keywords, codes, word groups and words against it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.functions.automaton import label_hits
from lektura.functions.rules import confidence, rule_rows
from lektura.functions.text import filled

CODE = r"\b([A-TV-Z]\d{2}(?:\.\d{1,2})?)\b"


@dataclass(frozen=True)
class Rules:
    """exclusive: (phrase, category), the first found decides alone. keywords: (category, keyword, weight); keywords of up
    to four letters must be whole words. codes: (letters that a diagnosis code begins with, category), each code two
    points; other codes count for ``other_codes``. groups: (words, category, points), the first group of which a word is
    found counts. contexts: (words, least, category, points), each of which ``least`` different words are found counts.
    against: (category, words), one of which halves the category's score."""

    exclusive: Sequence[tuple[str, str]] = ()
    keywords: Sequence[tuple[str, str, float]] = ()
    codes: Sequence[tuple[str, str]] = ()
    other_codes: str | None = None
    groups: Sequence[tuple[Sequence[str], str, float]] = ()
    contexts: Sequence[tuple[Sequence[str], int, str, float]] = ()
    against: Sequence[tuple[str, Sequence[str]]] = ()
    default: str = "other"
    categories: list[str] = field(init=False)

    def __post_init__(self):
        found = dict.fromkeys([c for c, *_ in self.keywords] + [c for _, c in self.codes] + ([self.other_codes] if self.other_codes else []) + [c for _, c, _ in self.groups] + [c for _, _, c, _ in self.contexts])
        object.__setattr__(self, "categories", list(found))

    @classmethod
    def read(cls, table: DataFrame, **more) -> Rules:
        """The rules of a table (kind, ord, category, pattern, weight, least): kind ``phrase``, ``keyword``, ``group``, ``context``
        or ``against``; rows of one kind, ord and category of the last three are one rule, its points the greatest weight."""
        rows = sorted(rule_rows(table, "kind", "ord", "category", "pattern", "weight", "least"), key=lambda r: (r[0], r[1], r[2], r[3]))
        of = lambda kind: [r[1:] for r in rows if r[0] == kind]
        sets: dict[str, dict] = {kind: {} for kind in ("group", "context", "against")}
        for kind, made in sets.items():
            for place, category, pattern, weight, least in of(kind):
                words = made.setdefault((place, category), ([], weight, least))
                made[place, category] = ([*words[0], pattern], max(words[1] or 0, weight or 0), least)
        return cls(
            exclusive=[(p, c) for _, c, p, *_ in of("phrase")], keywords=[(c, p, float(w)) for _, c, p, w, _ in of("keyword")], groups=[(ws, c, w) for (_, c), (ws, w, _) in sets["group"].items()],
            contexts=[(ws, least, c, w) for (_, c), (ws, w, least) in sets["context"].items()], against=[(c, ws) for (_, c), (ws, _, _) in sets["against"].items()], **more,
        )

    def patterns(self) -> tuple[list[tuple[int, str, float]], list[bool]]:
        """Every pattern with a label: phrases first, each its own, then a label for the keywords of each category, the
        words of each group, of each context and those against each category; and which must be whole words."""
        sets = [[(k, w) for c, k, w in self.keywords if c == category] for category in self.categories]
        sets += [[(w, 0.0) for w in words] for words in [*(g[0] for g in self.groups), *(c[0] for c in self.contexts), *(self.words_against(c) for c in self.categories)]]
        made = [(label, phrase, 0.0) for label, (phrase, _) in enumerate(self.exclusive)]
        made += [(len(self.exclusive) + k, word, float(weight)) for k, words in enumerate(sets) for word, weight in words]
        first, last = len(self.exclusive), len(self.exclusive) + len(self.categories)
        return made, [first <= label < last and len(word) <= 4 for label, word, _ in made]

    def words_against(self, category: str) -> list[str]:
        return [w for of, words in self.against if of == category for w in words]


def category_scores(labels: Column, codes: Column, rules: Rules) -> Column:
    """An array of (category, score, best) for each category of the rules, 0 where nothing is found; best: its heaviest keyword,
    by place in the rules' patterns. ``labels``: the text's label_hits by label; ``codes``: the first letters of its codes."""
    known, made = "".join(letters for letters, _ in rules.codes), []
    keywords = len(rules.exclusive)
    groups = keywords + len(rules.categories)
    contexts = groups + len(rules.groups)
    against = contexts + len(rules.contexts)
    there = lambda label: F.try_element_at(labels, F.lit(label))
    group = F.coalesce(*[F.when(there(groups + k).isNotNull(), F.lit(k)) for k in range(len(rules.groups))], F.lit(-1))
    for at, category in enumerate(rules.categories):
        score = F.coalesce(there(keywords + at)["score"], F.lit(0.0))
        letters = "".join(x for x, of in rules.codes if of == category)
        if letters:
            score = score + 2.0 * F.size(F.filter(codes, _one_of(letters)))
        if category == rules.other_codes:
            score = score + 2.0 * (F.size(codes) - F.size(F.filter(codes, _one_of(known))))
        for k, (_, of, points) in enumerate(rules.groups):
            if of == category:
                score = score + F.when(group == k, float(points)).otherwise(0.0)
        for k, (_, least, of, points) in enumerate(rules.contexts):
            if of == category:
                score = score + F.when(there(contexts + k)["kinds"] >= least, float(points)).otherwise(0.0)
        score = score * F.when(there(against + at).isNotNull(), 0.5).otherwise(1.0) if rules.words_against(category) else score
        made.append(F.struct(F.lit(category).alias("category"), score.alias("score"), there(keywords + at)["best"].alias("best")))
    return F.array(*made)


def categorised(rows: DataFrame, text: Column, rules: Rules, source: Column | None = None, sources: Sequence[tuple[str, str]] = (), least_confidence: float = 0.0) -> DataFrame:
    """rows with ``category``, ``topic``, ``score``, ``confidence`` and ``method``: ``source`` where a (part, category) of
    ``sources`` is in the lower-case source, else ``phrase`` for an exclusive phrase, ``score`` for the best category (ties
    to the first by name; under ``least_confidence`` the default, ``unsure``), ``none``. The topic is the phrase or the
    category's heaviest keyword, else the category. One scan of the text finds the patterns of all rules."""
    # Columns of their own, so that each text is lowered, searched for codes and scanned once.
    codes = F.transform(F.regexp_extract_all(F.upper(filled(text)), F.lit(CODE), F.lit(1)), lambda c: F.substring(c, 1, 1))
    patterns, whole = rules.patterns()
    rows = rows.withColumns({"_hits": label_hits(F.lower(filled(text)), patterns, whole), "_codes": codes})
    rows = rows.withColumn("_labels", F.map_from_entries(F.transform("_hits", lambda x: F.struct(x["label"], x))))
    words = F.lit([p for _, p, _ in patterns]) if patterns else F.array().cast("array<string>")
    # Labels are in order, and phrases are the first of them.
    first = F.get("_hits", F.lit(0))
    given = F.coalesce(*[F.when(F.contains(F.lower(filled(source)), F.lit(part)), F.lit(c)) for part, c in sources], F.lit(None)) if sources else F.lit(None).cast("string")
    phrase = F.when(first["label"] < len(rules.exclusive), first["label"])
    ranked = F.array_sort(F.transform(F.filter(category_scores(F.col("_labels"), F.col("_codes"), rules), lambda x: x["score"] > 0), lambda x: F.struct((-x["score"]).alias("n"), x["category"].alias("category"), x["best"].alias("best"))))
    found = rows.withColumns({"_source": given, "_phrase": phrase, "_ranked": ranked})
    top, second = F.get("_ranked", F.lit(0)), -F.get("_ranked", F.lit(1))["n"]
    best = -top["n"]
    sure = F.when(F.col("_source").isNotNull() | F.col("_phrase").isNotNull(), 1.0).when(best.isNull(), 0.0).otherwise(F.round(confidence(best, second), 6))
    unsure = F.col("_source").isNull() & F.col("_phrase").isNull() & best.isNotNull() & (F.col("confidence") < least_confidence)
    by_phrase = F.get(F.lit([c for _, c in rules.exclusive]), F.col("_phrase")) if rules.exclusive else F.lit(None).cast("string")
    found = found.withColumn("confidence", sure).withColumns({
        "category": F.when(unsure, rules.default).otherwise(F.coalesce("_source", by_phrase, top["category"], F.lit(rules.default))),
        "topic": F.when(unsure, rules.default).otherwise(F.coalesce("_source", F.get(words, F.col("_phrase")), F.get(words, top["best"]), F.lower(top["category"]), F.lit(rules.default))),
        "score": F.when(F.col("_source").isNotNull() | F.col("_phrase").isNotNull(), 10.0).otherwise(F.coalesce(best, F.lit(0.0))),
        "method": F.when(F.col("_source").isNotNull(), "source").when(F.col("_phrase").isNotNull(), "phrase").when(unsure, "unsure").when(best.isNotNull(), "score").otherwise("none"),
    })
    return found.drop("_source", "_phrase", "_ranked", "_labels", "_hits", "_codes")


def _one_of(letters: str) -> Callable[[Column], Column]:
    return lambda letter: F.contains(F.lit(letters), letter)
