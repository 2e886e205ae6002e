"""Readers and writers of question, answer and card files; schemas are given, nothing is inferred from all data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lektura.functions.text import filled

ITEM = "struct<frage: string, question: string, antwort: string, answer: string, source_file: string, id: string>"
ENVELOPE = f"qa_pairs array<{ITEM}>, items array<{ITEM}>, questions array<string>, cards array<{ITEM}>, results array<{ITEM}>, frage string, question string, antwort string, answer string, source_file string, id string, block_id string, context array<string>"


def read_qa(spark: SparkSession, path: str, skip_answered: bool = True) -> DataFrame:
    """question, answer, source_file, context: one row a question, from a JSON list of items or of blocks with
    ``questions``, or an object with qa_pairs, items, cards or results. Answered items of ``qa_pairs`` are left out."""
    raw = spark.read.schema(ENVELOPE).json(path, multiLine=True)
    none = F.array().cast(f"array<{ITEM}>")
    items = F.concat(*[F.coalesce(F.col(c), none) for c in ("items", "cards", "results")])
    pairs = F.coalesce("qa_pairs", none)
    if skip_answered:
        pairs = F.filter(pairs, lambda x: F.trim(filled(F.coalesce(x["antwort"], x["answer"]))) == "")
    packed = raw.select(F.explode(F.concat(pairs, items)).alias("x"), "source_file", F.lit(None).cast("array<string>").alias("context")).select(
        F.coalesce("x.frage", "x.question").alias("question"), F.coalesce("x.antwort", "x.answer").alias("answer"), F.coalesce("x.source_file", "source_file").alias("source_file"), "context"
    )
    blocks = raw.select(F.explode("questions").alias("question"), F.lit(None).cast("string").alias("answer"), "source_file", "context")
    single = raw.select(F.coalesce("frage", "question").alias("question"), F.coalesce("antwort", "answer").alias("answer"), "source_file", "context").where("question is not null")
    return packed.union(blocks).union(single).where(F.trim(filled(F.col("question"))) != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; empty lines are skipped, broken ones are null rows of the schema."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line; never over what is there."""
    rows.write.mode("errorifexists").json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """front, back, tags of tab-separated cards: rows of fewer than two columns go, columns after the second are tags.
    The lines are looked at first for how many columns the widest can have."""
    width = spark.read.text(path).agg(F.max(F.regexp_count("value", F.lit("\t")))).first()[0]
    columns = [f"c{i}" for i in range(max(2, (width or 0) + 1))]
    rows = spark.read.csv(path, schema=", ".join(f"{c} string" for c in columns), sep="\t", quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="PERMISSIVE")
    tags = F.concat_ws(" ", *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns[2:]])
    return rows.where("c1 is not null").select(F.col("c0").alias("front"), F.col("c1").alias("back"), tags.alias("tags"))


def card_field(c: Column) -> Column:
    """A field that a tab-separated file can hold: tabs as four spaces, line ends as ``<br>``."""
    return F.regexp_replace(F.replace(filled(c), F.lit("\t"), F.lit("    ")), "\r\n|\r|\n", "<br>")


def write_cards(cards: DataFrame, path: str, *columns: str) -> None:
    """No header, quotation marks where needed; never over what is there."""
    cards.select(*[card_field(F.col(c)).alias(c) for c in columns]).write.mode("errorifexists").csv(path, sep="\t", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_inventory(rows: DataFrame, path: str) -> None:
    """The inventory's columns in their order, with a header."""
    rows.select("index", "fachgebiet", "source_file", "frage", "issues", "sources").write.mode("errorifexists").csv(path, header=True, escape='"')


def read_note_graph(spark: SparkSession, path: str) -> DataFrame:
    """base, version, exported, id, parent, text: the notes (``docs``) of unpacked exports with the export's own data;
    the text is the plain parts of a note's key. An export without notes has no rows."""
    note = "struct<_id: string, parent: string, key: array<string>>"
    raw = spark.read.schema(f"docs array<{note}>, exportDate string, exportVersion long, knowledgebaseId string").json(path, multiLine=True)
    rows = raw.select(F.coalesce("knowledgebaseId", F.lit("")).alias("base"), F.col("exportVersion").alias("version"), F.substring("exportDate", 1, 10).alias("exported"), F.explode("docs").alias("d"))
    plain = F.filter(F.coalesce("d.key", F.array().cast("array<string>")), lambda x: ~F.startswith(x, F.lit("{")))
    return rows.select("base", "version", "exported", F.col("d._id").alias("id"), F.col("d.parent").alias("parent"), F.array_join(plain, "").alias("text"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """category, keyword, weight from a JSON object of categories, each an object of keywords and their weights."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("category", "own"))
    return raw.select("category", F.explode("own").alias("keyword", "weight"))


def read_deck(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Notes and cards of a deck that is kept as two tables."""
    return spark.read.parquet(f"{path}/notes"), spark.read.parquet(f"{path}/cards")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """index, fachgebiet, source_file, frage, issues, sources; rows without a whole number as index go."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="index string, fachgebiet string, source_file string, frage string, issues string, sources string")
    return rows.withColumn("index", F.expr("try_cast(trim(index) as long)")).where("index is not null")


def read_blocks(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """path, pos, text, year: blocks of text files between empty lines, of ``least`` characters; a block's year is that
    of its own date, else of its path."""
    from lektura.operators.extract import detected_year

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    blocks = files.select("path", F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "text")).withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    return blocks.where(F.length("text") >= least).withColumn("year", F.coalesce(detected_year(F.col("text")), F.nullif(F.regexp_extract("path", "(20[0-9]{2})", 1), F.lit("")).cast("int")))


def read_markdown_cards(spark: SparkSession, path: str) -> DataFrame:
    """path, number, question, answer: blocks after ``## Frage N``; the bold line is the question, the lines after
    ``### Antwort`` are the answer."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    order = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.last(F.nullif(F.regexp_extract("line", r"^## Frage (\d+)", 1), F.lit("")), ignorenulls=True).over(order)
    lines = lines.withColumn("number", number.cast("int")).where("number is not null")
    part = F.last(F.when(F.startswith("line", F.lit("### ")), F.trim(F.substring("line", 5, 100))).when(F.startswith("line", F.lit("## ")), F.lit("")), ignorenulls=True).over(Window.partitionBy("path", "number").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("part", part)
    body = F.transform(F.sort_array(F.collect_list(F.when((F.col("part") == "Antwort") & ~F.startswith("line", F.lit("### ")), F.struct("pos", "line")))), lambda x: x["line"])
    bold = F.nullif(F.regexp_extract("line", r"^\*\*(.+?)\*\*\s*$", 1), F.lit(""))
    found = lines.groupBy("path", "number").agg(F.min_by(bold, F.when(bold.isNotNull() & (F.col("part") == ""), F.col("pos"))).alias("question"), F.trim(F.array_join(body, "\n")).alias("answer"))
    return found.where("question is not null and answer <> ''")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """path, text: the first of the text fields that has something, else the messages' texts."""
    fields = ("text", "content", "report", "body", "transcript")
    schema = ", ".join(f"{f} string" for f in fields) + ", messages array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), *fields, "messages")
    said = F.array_join(F.transform(F.coalesce("messages", F.array().cast("array<string>")), lambda m: F.coalesce(F.get_json_object(m, "$.text"), m)), "\n")
    return rows.select("path", F.coalesce(*[F.nullif(F.trim(filled(F.col(f))), F.lit("")) for f in fields], F.nullif(said, F.lit(""))).alias("text"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """name, path, suffix, size, md5, modified of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(name.alias("name"), "path", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.col("modificationTime").alias("modified"))


def newest_file(inventory: DataFrame, pattern: str) -> DataFrame:
    """The file of a name like the pattern that was changed last; ties to the later name."""
    return inventory.where(F.regexp_like("name", F.lit(pattern))).orderBy(F.desc("modified"), F.desc("name")).limit(1)


def write_version(rows: DataFrame, path: str, version: str) -> str:
    """Writes under the version's own folder and fails rather than overwrite one."""
    rows.write.mode("errorifexists").parquet(f"{path}/run_ts={version}")
    return f"{path}/run_ts={version}"


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the log of finished ones does not have."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


class Lost(ValueError):
    """A stage kept too little."""


def guard_loss(before: int, after: int, fail: float = 0.9, warn: float = 0.5) -> str:
    """``ok`` or ``warn`` by the share of rows that a stage dropped; raises where that is over ``fail``."""
    share = 1 - after / before if before else 0.0
    if share > fail:
        raise Lost(f"{share:.0%} of {before} rows were dropped")
    return "warn" if share > warn else "ok"


def guarded_write(rows: DataFrame, kept: Column, path: str, fail: float = 0.9, warn: float = 0.5) -> tuple[int, int, str]:
    """Writes the rows that a stage keeps under ``path`` and returns how many there were, how many stayed, and ``ok`` or
    ``warn``; where over ``fail`` were dropped it raises ``Lost``, and what lies under ``path`` is not to be used. The
    counts come from the pass that writes. A condition that is null drops its row; of no rows none are lost."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after"))
    counted.where(kept).write.mode("errorifexists").parquet(path)
    before, after = seen.get.get("before", 0), seen.get.get("after", 0)
    return before, after, guard_loss(before, after, fail, warn)


def losses(rows: DataFrame, kept: Column, key: str, fail: float = 0.9, warn: float = 0.5) -> DataFrame:
    """key, before, after, level: ``guard_loss`` for a filter's groups, without an error: ``fail``, ``warn`` or ``ok``."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after"))
    share = 1 - F.col("after") / F.col("before")
    return counts.withColumn("level", F.when(share > fail, "fail").when(share > warn, "warn").otherwise("ok"))
