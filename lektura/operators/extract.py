"""Extraction from text: sentences, blocks, chunks, years, facts, sections, trees."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektura.functions.text import filled
from lektura.session import cut


def questions(rows: DataFrame, text: Column, separator: str, starters: Sequence[str], least: int = 8) -> DataFrame:
    """Adds pos and question: pieces between separators (a regular expression) that start with one of the words."""
    pieces = rows.select("*", F.posexplode(F.split(filled(text), separator)).alias("pos", "_p")).withColumn("question", F.trim("_p")).drop("_p")
    return pieces.where((F.length("question") >= least) & F.regexp_like(F.lower("question"), F.lit(f"^(?:{'|'.join(starters)})(?: |$)")))


def dialog_blocks(lines: DataFrame, key: str, pos: str, line: str, is_question: Column, context: int = 6) -> DataFrame:
    """key, block, questions, context: an empty line ends a block that has questions; the context is the last lines
    before the block's first question that are no questions, across blocks without any."""
    order = Window.partitionBy(key).orderBy(pos)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    empty = F.trim(filled(F.col(line))) == ""
    marked = lines.withColumns({"_q": is_question & ~empty, "_e": empty})
    # A block ends at the first empty line after a question: where the last question is later than the last such end.
    last_q = F.last(F.when(F.col("_q"), F.col(pos)), ignorenulls=True).over(upto)
    last_e = F.last(F.when(F.col("_e"), F.col(pos)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.col("_e") & last_q.isNotNull() & (F.coalesce(last_e, F.lit(-1)) < last_q)
    marked = marked.withColumn("_end", ends)
    marked = marked.withColumn("block", F.coalesce(F.sum(F.col("_end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Other lines are numbered, so the last few before the first question are those of the last few numbers.
    other = ~F.col("_q") & ~F.col("_e")
    marked = marked.withColumn("_n", F.sum(other.cast("int")).over(upto))
    asked = marked.where("_q").groupBy(key, "block").agg(F.min(F.struct(pos, "_n")).alias("_first"), F.sort_array(F.collect_list(F.struct(pos, line))).alias("_qs"))
    before = asked.where("_first._n > 0").select(key, "block", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_first._n") - context + 1), F.col("_first._n"))).alias("_n"))
    said = before.join(marked.where(other).select(key, "_n", F.col(line).alias("_line")), [key, "_n"]).groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("_n", "_line"))).alias("_ls"))
    found = asked.join(said, [key, "block"], "left")
    return found.select(key, "block", F.transform("_qs", lambda x: x[line]).alias("questions"), F.coalesce(F.transform("_ls", lambda x: x["_line"]), F.array().cast("array<string>")).alias("context"))


def chunks(rows: DataFrame, text: Column, size: int = 500, overlap: int = 100) -> DataFrame:
    """Adds chunk and piece: a text under ``size`` whole; else paragraphs put together while they fit, and those that
    do not fit alone cut to size - overlap characters every size - 2 overlap."""
    width, step = size - overlap, size - 2 * overlap
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(p) - width + step - 1) - F.greatest(F.lit(0), F.length(p) - width + step - 1) % step, F.lit(step)), lambda at: F.substr(p, at + 1, F.lit(width)))

    def packed(state: Column, paragraph: Column) -> Column:
        done, open_ = state["done"], state["open"]
        joined = F.when(open_ == "", paragraph).otherwise(F.concat(open_, F.lit("\n\n"), paragraph))
        flushed = F.when(open_ == "", done).otherwise(F.array_append(done, open_))
        fits = F.length(open_) + F.length(paragraph) < size
        alone = F.length(paragraph) >= size
        return F.struct(
            F.when(fits, done).when(alone, F.concat(flushed, cut(paragraph))).otherwise(flushed).alias("done"),
            F.when(fits, joined).when(alone, F.lit("")).otherwise(paragraph).alias("open"),
        )

    paragraphs = F.filter(F.transform(F.split(filled(text), "\n\n+"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    folded = F.aggregate(paragraphs, start, packed, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    whole = F.when(F.length(filled(text)) < size, F.array(filled(text))).otherwise(folded)
    return rows.select("*", F.posexplode(whole).alias("chunk", "piece"))


def detected_year(text: Column, first: int = 2020, last: int = 2025) -> Column:
    """The year of the first d.m.y, else y-m-d, else bare year of the range; null without one."""
    patterns = (r"\b\d{1,2}\.\d{1,2}\.(\d{4})\b", r"\b(\d{4})-\d{2}-\d{2}\b", r"\b(" + "|".join(map(str, range(first, last + 1))) + r")\b")
    return F.coalesce(*[F.nullif(F.regexp_extract(filled(text), p, 1), F.lit("")).cast("int") for p in patterns])


def phrases(words: Column, triggers: Sequence[str], longest: int = 3) -> Column:
    """Runs of one to three words that hold one of the triggers, once each, in order of length and place."""
    hit = F.array(*map(F.lit, triggers))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))

    runs = [of(n) for n in range(1, longest + 1)]
    made = [F.when(F.size(words) >= n, run).otherwise(F.array().cast("array<array<string>>")) for n, run in enumerate(runs, 1)]
    return F.array_distinct(F.transform(F.filter(F.concat(*made), lambda r: F.arrays_overlap(r, hit)), lambda r: F.array_join(r, " ")))


def sections(rows: DataFrame, key: str, text: Column, starts: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """key, section, body: lines after a line that begins with a section's pattern belong to it until the next does."""
    lines = rows.select(key, F.posexplode(F.split(filled(text), "\n")).alias("pos", "line"))
    named = F.coalesce(*[F.when(F.regexp_like("line", F.lit(p)), F.lit(label)) for p, label in starts])
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last(named, ignorenulls=True).over(order), F.lit(default)))
    body = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy(key, "section").agg(F.trim(F.array_join(body, "\n")).alias("body"))


def media(html: Column) -> Column:
    """Sources of images and of ``[sound:...]`` marks, once each."""
    images = F.regexp_extract_all(filled(html), F.lit(r"""<img[^>]*src=["']([^"']+)["']"""), F.lit(1))
    return F.array_union(images, F.regexp_extract_all(filled(html), F.lit(r"\[sound:([^\]]+)\]"), F.lit(1)))


def spliced(text: Column, block: Column, marker: str) -> Column:
    """The text with the block put before the marker, or at the end where there is none."""
    at = F.instr(text, F.lit(marker))
    return F.when(at == 0, F.concat(text, F.lit("\n"), block)).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), block, F.lit("\n"), F.substr(text, at)))


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The text after each (pattern, replacement), in order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def facts(rows: DataFrame, key: str, text: Column, rules: Sequence[tuple[str, str]], least: int = 3) -> DataFrame:
    """key, line, type, fact: what the (type, pattern) rules find in each line; bare percentages and short finds go."""
    lines = rows.select(key, F.posexplode(F.split(filled(text), "\n")).alias("line", "_t"))
    found = F.array(*[F.struct(F.lit(kind).alias("type"), F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias("xs")) for kind, p in rules])
    each = lines.select(key, "line", F.explode(found).alias("f")).select(key, "line", F.col("f.type").alias("type"), F.explode("f.xs").alias("fact"))
    return each.where((F.length("fact") >= least) & ~F.regexp_like("fact", F.lit(r"^\d+(?:[.,]\d+)?\s*%$")))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, depth, path (names joined by `` > ``), place: nodes (id, parent, name, nth) under their roots, which have
    no parent; a node that is its own ancestor, or is under one, has no path, nor has one whose parent is missing.

    Each node holds a stretch of its path and the node above that; a round puts before it the stretch of that node, so
    stretches double, and a path of n nodes takes about log2(n) joins. Each round's lineage is cut.
    """
    state = cut(nodes.select("id", F.col("parent").alias("above"), F.array("name").alias("names"), F.array("nth").alias("place"), F.array("id").alias("seen")))
    while not state.where("above is not null").isEmpty():
        upper = state.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("names").alias("names_"), F.col("place").alias("place_"), F.col("seen").alias("seen_"))
        joined = state.where("above is not null").join(upper, "above").where(~F.arrays_overlap("seen", "seen_"))
        moved = joined.select("id", F.col("next").alias("above"), *[F.concat(f"{c}_", c).alias(c) for c in ("names", "place", "seen")])
        state = cut(state.where("above is null").union(moved))
    return state.select("id", (F.size("names") - 1).alias("depth"), F.array_join("names", " > ").alias("path"), "place")


#: What begins an answer, and how listed answers are marked.
ANSWER = r"(?is)\n\s*(?:erwartete antwort|antwort|therapie|lösung|diagnose)\s*[:\s-]+(.+)"
NUMBERED = r"^\s*(?:[0-9]+|[a-z]|[IVX]+)[).:]\s*"
BULLET = r"^\s*[-•*►▪]\s+"
MOST_ANSWERS = 10


def exam_answer(text: Column) -> Column:
    """The text after the word that begins an answer, else the second paragraph; empty without either."""
    paragraphs = F.filter(F.transform(F.split(filled(text), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.btrim(F.regexp_extract(filled(text), ANSWER, 1), F.lit(" \n"))
    return F.when(named != "", named).otherwise(F.coalesce(F.get(paragraphs, F.lit(1)), F.lit("")))


def exam_items(answer: Column) -> Column:
    """The answers of an answer text: its numbered lines if there are two, else its marked lines if there are two, else
    what stands between semicolons. Short ones and bare numbers go; equal ones count once, whatever their case; ten at most."""
    lines = F.split(answer, "\n")

    def marked(pattern: str) -> Column:
        return F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern + r"\S"))), lambda x: F.trim(F.regexp_replace(x, pattern, "")))

    numbered, bullets = marked(NUMBERED), marked(BULLET)
    items = F.when(F.size(numbered) >= 2, numbered).when(F.size(bullets) >= 2, bullets).otherwise(F.transform(F.split(answer, r";\s+"), lambda p: F.trim(p)))
    items = F.filter(items, lambda x: (F.length(x) > 3) & ~F.regexp_like(x, F.lit(r"^\d+$")))
    first = F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, MOST_ANSWERS)


def exam_score(question: Column, items: Column, has_data: Column, has_kind: Column) -> Column:
    """How complete an exam question is, of 1: a question, answers, three of them, long ones, data, a kind, a fit length."""
    mean = F.aggregate(items, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.size(items), F.lit(1))
    points = F.when(F.length(question) > 10, 1.0).otherwise(0.0) + F.when(F.size(items) > 0, 1.0).otherwise(0.0) + F.when(F.size(items) >= 3, 0.5).otherwise(0.0)
    points = points + F.when((F.size(items) > 0) & (mean > 20), 0.5).otherwise(0.0) + F.when(has_data, 0.5).otherwise(0.0) + F.when(has_kind, 0.5).otherwise(0.0)
    return (points + F.when((F.length(question) > 50) & (F.length(question) < 1000), 1.0).otherwise(0.0)) / 5


def around(text: Column, word: str, reach: int) -> Column:
    """The stretches that ``.{0,reach}word.{0,reach}`` finds from left to right, within lines, which end at a line feed only.
    What lies further from the word than it reaches is taken out first: the pattern tries ``reach`` places at each
    character, so it only runs over as many characters around each word."""
    keep = lambda x: F.when(F.length(x) > 2 * reach, F.concat(F.left(x, F.lit(reach)), F.lit("\n"), F.right(x, F.lit(reach)))).otherwise(x)
    near = F.array_join(F.transform(F.split(text, re.escape(word)), keep), word)
    return F.regexp_extract_all(near, F.lit(rf"[^\n]{{0,{reach}}}{re.escape(word)}[^\n]{{0,{reach}}}"), F.lit(0))
