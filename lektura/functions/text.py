"""Normal forms of text: keys to join on, identifiers, lengths, tag lists. All are columns of columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Umlauts as ASCII for tags, letters with marks for ASCII keys, and typographic quotation marks.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def filled(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c, F.lit(""))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(filled(c), r"\s+", " "))


def ws_lower(c: Column) -> Column:
    return F.lower(single_spaced(c))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(filled(c), "<[^>]*>", " ")


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility form and full case folding, which Spark has no functions for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def nfkc_key(c: Column) -> Column:
    """Compatibility form, no soft hyphens, no leading bullet or number, single spaces, no outer `` ?!.;:``."""
    c = F.regexp_replace(nfkc_casefold(filled(c)), "­", "")
    c = F.regexp_replace(c, r"^\s*(?:[-*•–]+|\d+[.)])\s*", "")
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ?!.;:]+|[ ?!.;:]+$", "")


def question_key(c: Column, ascii_only: bool = False) -> Column:
    """Entities resolved, tags and a leading ``Frage:`` or number gone, lower case, letters and digits only."""
    return _bare(unescaped(filled(c)), ascii_only)


def _bare(c: Column, ascii_only: bool = False) -> Column:
    c = F.regexp_replace(c, "<[^>]*>", " ")
    c = F.lower(F.regexp_replace(c, r"^\s*(?:[Ff]rage\s*\d*\s*[:.)]|\d+\s*[.):])\s*", ""))
    if ascii_only:
        c = F.translate(c, MARKED, PLAIN)
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+" if ascii_only else "[^a-z0-9äöüß]+", " "))


def question_key_within(c: Column, longest: int) -> Column:
    """False only where both question keys are longer than ``longest``, told from the beginning of the text if that suffices.

    Keys grow with what follows, but for a tag that is open there, which is left out, and for a leading number that may go
    on, where the whole text is kept. Of the letters of the one key the other may lack ``ß`` and has the rest."""
    size, whole = longest + longest // 2 + 64, unescaped(filled(c))
    head = F.regexp_replace(F.substring(whole, 1, size), r"<[^>]*\z", "")
    open_ = F.regexp_replace(head, "<[^>]*>", " ").rlike(r"^\s*(?:[Ff]rage)?[\s\d]*\z")
    return (F.length(whole) <= size) | open_ | (F.length(F.replace(_bare(head), F.lit("ß"), F.lit(""))) <= longest)


def alnum_key(c: Column) -> Column:
    """Tags gone, then anything but letters, digits, ``_`` and white space; single spaces, lower case."""
    c = F.regexp_replace(F.regexp_replace(filled(c), "<[^>]+>", ""), r"[^\p{L}\p{N}_\s]", "")
    return ws_lower(c)


def context_key(c: Column, prefix: str = r"^\s*\[?(?:[Kk]ontext|[Cc]ontext)\s*:?\]?\s*") -> Column:
    c = F.regexp_replace(filled(c), "<img[^>]*>", " ")
    return ws_lower(F.regexp_replace(c, prefix, ""))


def tag_key(c: Column) -> Column:
    """``#`` gone, umlauts spelled out, anything but a-z, 0-9, ``_`` and ``:`` as one ``_``."""
    c = F.lower(F.trim(F.replace(filled(c), F.lit("#"), F.lit(""))))
    for umlaut, spelled in UMLAUTS:
        c = F.replace(c, F.lit(umlaut), F.lit(spelled))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9:_]", "_"), "_+", "_"), "^_|_$", "")


def file_key(c: Column) -> Column:
    """A file's name without folder, query, copy number such as `` (1)`` or ``_1_1``, spaces, ``_`` and ``-``."""
    c = F.regexp_extract(filled(c), r"([^/?#]*)(?:[?#].*)?$", 1)
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"\(\d+\)", ""), r"(_\d+)+$| \d+$", "")
    return F.regexp_replace(c, r"[\s_-]+", "")


def split_tags(c: Column) -> Column:
    return F.filter(F.split(F.trim(filled(c)), r"[\s,;]+"), lambda t: t != "")


def tag_parts(tags: Column) -> Column:
    """The parts of hierarchical tags, in order, once each."""
    return F.array_distinct(F.filter(F.flatten(F.transform(tags, lambda t: F.split(t, "::"))), lambda p: p != ""))


def with_tag(tags: Column, tag: str) -> Column:
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))


def replaced_tag(tags: Column, old: str, new: str) -> Column:
    """One tag for another at its place; only one of each stays."""
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


def built_tags(**parts: Column) -> Column:
    """Sorted, different tags ``name:value``; empty values make none."""
    made = [F.when(tag_key(value) != "", F.concat(F.lit(f"{name}:"), tag_key(value))) for name, value in parts.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*made))))


def content_id(module: Column, text: Column) -> Column:
    return F.concat(filled(module), F.lit("_"), F.substring(F.md5(filled(text)), 1, 12))


def card_id(front: Column, back: Column) -> Column:
    return F.sha1(F.concat(F.lower(filled(front)), F.lit("\n"), F.lower(filled(back))))


def ellipsis(c: Column, size: int) -> Column:
    """At most ``size`` characters, with three dots for what is cut."""
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, size - 3)), F.lit("...")))


def middle_cut(c: Column, size: int, head: float = 0.7, mark: str = " [...] ") -> Column:
    """At most ``size`` characters; ``head`` of the room is the beginning, the rest the end."""
    room = size - len(mark)
    first = int(room * head)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, first), F.lit(mark), F.substring(c, first - room, room - first)))


def clean_unicode(c: Column) -> Column:
    """Line and paragraph separators and hard spaces as spaces; no byte order mark."""
    return F.translate(filled(c), "   ﻿", "   ")


def approx_tokens(c: Column, whole: bool = False) -> Column:
    """A quarter of the characters, rounded up and at least 1; ``whole`` rounds down instead."""
    quarter = F.length(filled(c)) / 4
    return (F.floor(quarter) if whole else F.greatest(F.lit(1), F.ceil(quarter))).cast("long")


def words(c: Column, least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    """Different words of letters and digits, lower case, in order, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(filled(c)), F.lit(r"[\p{L}\p{N}]{%d,}" % least), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def compact_list(items: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(items, lambda x: F.trim(filled(x)) != ""), 1, n), " | ")


def is_placeholder(c: Column, least: int = 30) -> Column:
    """An answer shorter than ``least`` characters counts as none; so does null."""
    return F.length(F.trim(filled(c))) < least
