"""Line dedup by site-relative frequency: a line that stands on too large a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.llm.common import cut

LINES_TO_BROADCAST = 200_000

#: Order matters: what is not text, then block tags as line ends, then other tags; entities come last.
HTML_STEPS = (
    (r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|head|header|footer|title|body|html)(?:[\s/][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: What is trimmed from lines.
BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-case host of a url; empty where there is none or the url is null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """Html as text, a line for each block; null stays null."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def line_dedup(docs: DataFrame, host: Column, text: Column, ratio: float = 0.1, min_repeats: int = 3, spare_whole: bool = False, broadcast_lines: int = LINES_TO_BROADCAST) -> DataFrame:
    """All columns of ``docs``, and ``_host``, ``_host_pages``, ``_lines``, ``_dropped`` and ``_kept`` (the text left).

    Lines are trimmed for comparing; empty ones neither count nor go. A line goes where it stands on more than
    ``ratio`` of its host's pages and on ``min_repeats`` at least. A page counts a line once; rows that repeat are pages
    of their own. With ``spare_whole`` a page of which nothing would be left is kept as it is: it is a copy, not a frame
    around something else. A null host is a host; a null text stays null and has no lines.
    Columns of ``docs`` may have any names that do not begin with an underscore.
    """
    split = F.split(text, "\n")
    keyed = F.transform(F.filter(split, _filled), _key)
    pages = docs.withColumns({"_host": host, "_split": split})
    seen = docs.select(host.alias("_host"), F.array_distinct(F.coalesce(keyed, F.array().cast("array<string>"))).alias("ks"))
    totals = seen.groupBy("_host").agg(F.count(F.lit(1)).alias("_host_pages"))
    counts = seen.select("_host", F.explode("ks").alias("k")).groupBy("_host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_repeats)
    totals = cut(totals)
    of = totals.withColumnRenamed("_host", "_h")
    common = counts.join(of, F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("n") > ratio * F.col("_host_pages"))
    gone = cut(common.select("_host", "k"))
    hosts = totals.limit(broadcast_lines + 1).count()
    if hosts <= broadcast_lines and gone.limit(broadcast_lines + 1).count() <= broadcast_lines:
        per = gone.groupBy("_host").agg(F.collect_list("k").alias("_gone")).withColumnRenamed("_host", "_g")
        sites = of.join(per, F.col("_h").eqNullSafe(F.col("_g")), "left").drop("_g")
        joined = pages.join(F.broadcast(sites), F.col("_host").eqNullSafe(F.col("_h")), "left").drop("_h")
    else:
        joined = _by_row(pages, docs, host, text, keyed, gone, of)
    # Only pages of a host with such lines are gone through again; first the host's set is cut down to the page's own lines.
    joined = joined.withColumn("_gone", F.array_intersect("_gone", keyed))
    left = F.when(F.size("_gone") > 0, F.filter("_split", lambda x: ~_filled(x) | ~F.array_contains("_gone", _key(x)))).otherwise(F.col("_split"))
    joined = joined.withColumns({"_left": left, "_lines": F.coalesce(F.size(F.filter("_split", _filled)), F.lit(0))})
    if spare_whole:
        joined = joined.withColumn("_left", F.when((F.size("_gone") > 0) & ~F.exists("_left", _filled), F.col("_split")).otherwise(F.col("_left")))
    dropped = F.when(F.col("_split").isNull(), 0).otherwise(F.size("_split") - F.size("_left")).cast("int")
    return joined.withColumns({"_dropped": dropped, "_kept": F.array_join("_left", "\n")}).drop("_split", "_gone", "_left")


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(BLANKS)))


def _by_row(pages: DataFrame, docs: DataFrame, host: Column, text: Column, keyed: Column, gone: DataFrame, of: DataFrame) -> DataFrame:
    """The lines to drop by row, for more of them than can be sent to each task."""
    row = F.md5(F.to_json(F.struct(host.alias("h"), text.alias("t"))))
    lines = docs.select(row.alias("_row"), host.alias("_host"), keyed.alias("ks")).distinct().select("_row", "_host", F.explode(F.array_distinct("ks")).alias("k"))
    found = lines.join(gone.toDF("_g", "_k"), F.col("_host").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")), "left_semi")
    lists = found.groupBy("_row").agg(F.collect_set("k").alias("_gone"))
    return pages.withColumn("_row", row).join(lists, "_row", "left").drop("_row").join(of, F.col("_host").eqNullSafe(F.col("_h")), "left").drop("_h")
