"""Readers and writers (S): each query writes files of a format from the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektura.plans.registry import query
from lektura.plans.streams import shared
from lektura.session import Tables
from lektura.sources import readers as R

MANY = 500  # objects or blocks a file, so that a file that is read whole stays small


def files(rows: DataFrame, number: Column, value: Column, path: str, join: str | None = None) -> str:
    """Text files of at most ``MANY`` values each: a JSON list of objects, or texts joined by ``join``."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), value.alias("v")))), lambda x: x["v"])
    body = F.to_json(listed) if join is None else F.array_join(listed, join)
    rows.groupBy(F.floor(number / MANY).alias("part")).agg(body.alias("value")).repartition("part").write.partitionBy("part").text(path, lineSep="\n")
    return path


ONE_LINE = r"trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


def one_line(text: str = "text") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))


@query("s1_read_qa", "SELECT text AS question, '' AS answer, 'conv' || conv_id AS source_file FROM conversations WHERE turn % 3 = 0 AND trim(text, ' ') <> ''")
def s1(t: Tables) -> DataFrame:
    pair = F.struct(F.col("text").alias("frage"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("antwort"))
    blocks = t.conversations.groupBy("conv_id").agg(F.collect_list(pair).alias("qa_pairs")).withColumn("source_file", F.concat(F.lit("conv"), "conv_id"))
    path = files(blocks, F.col("conv_id"), F.struct("qa_pairs", "source_file"), shared(t))
    return R.read_qa(t.spark, path).select("question", "answer", "source_file")


@query("s2_read_items", "SELECT text AS question, role AS answer, CASE WHEN turn % 2 = 0 THEN 'turn' ELSE 'conv' || conv_id END AS source_file FROM conversations WHERE trim(text, ' ') <> ''")
def s2(t: Tables) -> DataFrame:
    item = F.struct(F.col("text").alias("question"), F.col("role").alias("answer"), F.when(F.col("turn") % 2 == 0, "turn").alias("source_file"))
    blocks = t.conversations.groupBy("conv_id").agg(F.collect_list(item).alias("items")).withColumn("source_file", F.concat(F.lit("conv"), "conv_id"))
    path = files(blocks, F.col("conv_id"), F.struct("items", "source_file", F.lit("2024").alias("exported")), shared(t))
    return R.read_qa(t.spark, path).select("question", "answer", "source_file")


@query("s3_jsonl", "SELECT doc_id, text, lang FROM documents")
def s3(t: Tables) -> DataFrame:
    path = shared(t)
    R.write_jsonl(t.documents.select("doc_id", "text", "lang"), path)
    return R.read_jsonl(t.spark, path, "doc_id long, text string, lang string")


CARD_SQL = "replace(regexp_replace({}, '\r\n|\r|\n', '<br>', 'g'), chr(9), '    ')"


@query("s4_cards", f"SELECT CAST(doc_id AS VARCHAR) AS front, {CARD_SQL.format('text')} AS back, concat_ws(' ', lang, source, CASE WHEN doc_id % 2 = 0 THEN 'even' END) AS tags FROM documents WHERE text <> ''")
def s4(t: Tables) -> DataFrame:
    path = shared(t)
    even = F.when(F.col("doc_id") % 2 == 0, "even")
    R.write_cards(t.documents.where("text <> ''").select("doc_id", "text", "lang", "source", even.alias("even")), path, "doc_id", "text", "lang", "source", "even")
    return R.read_cards(t.spark, path)


@query("s5_write_cards", f"SELECT CAST(p_partkey AS VARCHAR) || chr(9) || p_name || chr(9) || p_type AS value FROM part WHERE p_name <> ''")
def s5(t: Tables) -> DataFrame:
    path = shared(t)
    R.write_cards(t.part.where("p_name <> ''"), path, "p_partkey", "p_name", "p_type")
    return t.spark.read.text(path)


@query("s6_inventory", f"SELECT doc_id AS index, lang AS fachgebiet, source AS source_file, {ONE_LINE} AS frage FROM documents WHERE doc_id % 5 <> 0 AND {ONE_LINE} <> ''")
def s6(t: Tables) -> DataFrame:
    path = shared(t)
    index = F.when(F.col("doc_id") % 5 == 0, "total").otherwise(F.col("doc_id").cast("string"))
    rows = t.documents.where(one_line() != "").select(index.alias("index"), F.col("lang").alias("fachgebiet"), F.col("source").alias("source_file"), one_line().alias("frage"), F.lit("none").alias("issues"), F.lit("none").alias("sources"))
    R.write_inventory(rows, path)
    return R.read_inventory(t.spark, path).select("index", "fachgebiet", "source_file", "frage")


@query("s7_text_blocks", f"WITH d AS (SELECT doc_id, trim('Protokoll vom 03.04.' || CAST(2020 + doc_id % 5 AS VARCHAR) || ' ' || {ONE_LINE}, ' ') AS text FROM documents) SELECT text, CAST(2020 + doc_id % 5 AS INT) AS year FROM d WHERE length(text) >= 200")
def s7(t: Tables) -> DataFrame:
    dated = F.concat(F.lit("Protokoll vom 03.04."), (F.col("doc_id") % 5 + 2020).cast("string"), F.lit(" "), one_line())
    return R.read_blocks(t.spark, files(t.documents, F.col("doc_id"), dated, shared(t), "\n \n")).select("text", "year")


@query("s8_reports", "SELECT CASE WHEN doc_id % 2 = 0 AND trim(text, ' ') <> '' THEN trim(text, ' ') ELSE coalesce(source || chr(10), '') || coalesce(lang, '') END AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
def s8(t: Tables) -> DataFrame:
    rows = t.documents.where("source is not null and lang is not null and text is not null")
    said = F.array(F.col("source"), F.to_json(F.struct(F.col("lang").alias("text"))))
    path = files(rows, F.col("doc_id"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(" ").alias("content"), said.alias("messages")), shared(t))
    return R.read_report(t.spark, path).select("text")


@query("s9_markdown_cards", f"SELECT CAST(doc_id AS INT) AS number, 'What is ' || doc_id || '?' AS question, {ONE_LINE} AS answer FROM documents WHERE {ONE_LINE} <> '' AND NOT starts_with({ONE_LINE}, '#')")
def s9(t: Tables) -> DataFrame:
    rows = t.documents.where((one_line() != "") & ~F.startswith(one_line(), F.lit("#")))
    number = F.col("doc_id").cast("string")
    body = F.concat(F.lit("## Frage "), number, F.lit("\n**What is "), number, F.lit("?**\n### Antwort\n"), one_line(), F.lit("\n### Quelle\nnone"))
    return R.read_markdown_cards(t.spark, files(rows, F.col("doc_id"), body, shared(t), "\n")).select("number", "question", "answer")


@query("s10_note_graph", "SELECT 'kb' || o_custkey AS base, CAST(o_custkey % 4 AS BIGINT) AS version, '2024-05-06' AS exported, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS parent, o_orderpriority || o_orderstatus AS text FROM orders")
def s10(t: Tables) -> DataFrame:
    """Each customer's orders as the notes of one export; a key has plain parts and references."""
    key = F.array(F.col("o_orderpriority"), F.to_json(F.struct(F.col("o_orderkey").alias("q"))), F.col("o_orderstatus"))
    note = F.struct(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_custkey").cast("string").alias("parent"), key.alias("key"))
    exports = t.orders.groupBy("o_custkey").agg(F.collect_list(note).alias("docs"))
    value = F.struct("docs", F.lit("2024-05-06T07:08:09Z").alias("exportDate"), (F.col("o_custkey") % 4).alias("exportVersion"), F.concat(F.lit("kb"), "o_custkey").alias("knowledgebaseId"))
    return R.read_note_graph(t.spark, files(exports, F.col("o_custkey"), value, shared(t)))


@query("s11_deck_tables", "SELECT c_custkey AS note, count(o_orderkey) AS cards, max(o_orderpriority) AS last FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def s11(t: Tables) -> DataFrame:
    """Notes and cards as tables of a deck; suspended notes go with their cards."""
    path = shared(t)
    t.customer.select(F.col("c_custkey").alias("note"), F.col("c_mktsegment").alias("tags")).write.parquet(f"{path}/notes")
    t.orders.select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("note"), F.col("o_orderpriority").alias("queue")).write.parquet(f"{path}/cards")
    notes, cards = R.read_deck(t.spark, path)
    return cards.join(notes.where("tags <> 'BUILDING'"), "note").groupBy("note").agg(F.count("card").alias("cards"), F.max("queue").alias("last"))


@query("s12_file_inventory", "SELECT DISTINCT '.txt' AS suffix, CAST(octet_length(encode(source)) + 1 AS BIGINT) AS size, md5(source || chr(10)) AS md5 FROM documents WHERE source IS NOT NULL")
def s12(t: Tables) -> DataFrame:
    path = shared(t)
    t.documents.where("source is not null").select(F.col("source").alias("value"), F.col("source").alias("part")).distinct().repartition("part").write.partitionBy("part").text(path)
    return R.file_inventory(t.spark, path).where("suffix = '.txt'").select("suffix", "size", "md5").distinct()


@query("s13_newest_snapshot", "SELECT DISTINCT p_type, p_brand FROM part")
def s13(t: Tables) -> DataFrame:
    """Two snapshots of one folder, of which the later one is read."""
    path = shared(t)
    rows = t.part.select("p_type", "p_brand").distinct().coalesce(1)
    rows.where("p_type < 'M'").write.parquet(f"{path}/snapshot_1")
    rows.write.parquet(f"{path}/snapshot_2")
    newest = R.newest_file(R.file_inventory(t.spark, path).where(F.col("path").contains("/snapshot_")), r"\.parquet$").first()
    return t.spark.read.parquet(newest["path"])


@query("s15_version", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s15(t: Tables) -> DataFrame:
    return t.spark.read.parquet(R.write_version(t.orders, shared(t), "1")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("s16_loss_guard", "SELECT source, count(*) AS before, count(*) FILTER (WHERE n_chars >= 2000) AS after, CASE WHEN 1 - count(*) FILTER (WHERE n_chars >= 2000) / count(*) > 0.9 THEN 'fail' WHEN 1 - count(*) FILTER (WHERE n_chars >= 2000) / count(*) > 0.5 THEN 'warn' ELSE 'ok' END AS level FROM documents GROUP BY 1")
def s16(t: Tables) -> DataFrame:
    return R.losses(t.documents, F.col("n_chars") >= 2000, "source")


@query("s16_guarded_write", "SELECT source, count(*) AS docs, sum(n_chars) AS chars, (SELECT count(*) FROM documents) AS before, (SELECT count(*) FROM documents WHERE n_chars >= 200) AS after, (SELECT CASE WHEN count(*) FILTER (WHERE n_chars >= 200) < 0.5 * count(*) THEN 'warn' ELSE 'ok' END FROM documents) AS level FROM documents WHERE n_chars >= 200 GROUP BY 1")
def s16_write(t: Tables) -> DataFrame:
    """A stage that drops short documents, its counts taken as it writes; the next stage reads what was written."""
    path = shared(t)
    before, after, level = R.guarded_write(t.documents.select("source", "n_chars"), F.col("n_chars") >= 200, path)
    kept = t.spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return kept.withColumns({"before": F.lit(before).cast("long"), "after": F.lit(after).cast("long"), "level": F.lit(level)})
