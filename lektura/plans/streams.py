"""Streams and their batch twins (T) over events and documents; every stream reads its table's files to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektura.functions import text as X
from lektura.plans.registry import query
from lektura.session import Tables, shared_dir
from lektura.streaming import reviews as S
from lektura.streaming import running as R

FOLD_SQL = """WITH RECURSIVE r AS (SELECT user_id, event_id % 6 AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, 2.5::DOUBLE AS ef, 1::BIGINT AS interval, 0 AS reps FROM (SELECT DISTINCT user_id FROM events)
          UNION ALL SELECT f.user_id, r.n, greatest(1.3::DOUBLE, f.ef + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)),
                 CASE WHEN q < 3 OR f.reps = 0 THEN 1 WHEN f.reps = 1 THEN 6 ELSE CAST(round_even(f.interval * f.ef, 0) AS BIGINT) END, CASE WHEN q < 3 THEN 0 ELSE f.reps + 1 END
          FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
    SELECT user_id AS card, round(arg_max(ef, n), 6) AS ef, arg_max(interval, n) AS interval, arg_max(reps, n) AS reps, max(n) AS reviews FROM f GROUP BY user_id"""


def shared(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def stream(t: Tables, name: str) -> DataFrame:
    """The table's files as a stream; the pattern lets a table be one file or a folder of them."""
    return t.spark.readStream.schema(getattr(t, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{t.folder}/{name}.parque[t]")


@query("t2_review_fold", FOLD_SQL)
def t2(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("card"), "ts", "event_id", (F.col("event_id") % 6).alias("q"))
    return S.folded_reviews(rows, "card", ["ts", "event_id"], "q")


@query("t2_review_stream", FOLD_SQL)
def t2_stream(t: Tables) -> DataFrame:
    path, columns = shared(t), [F.col("user_id").alias("card"), "ts", F.col("event_id").alias("pos"), (F.col("event_id") % 6).cast("int").alias("q")]
    S.run_to_end(S.review_states(stream(t, "events").select(*columns)), path, mode="update")
    states = S.latest(S.written(t.spark, path), "card", F.col("batch"), "ef", "interval", "reps", "reviews", "late")
    return S.settled(states, t.events.select(*columns), ["ts", "pos"])


@query("t3_review_sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS reviews, count(*) FILTER (WHERE event_id % 6 >= 3) AS correct FROM s GROUP BY user_id, s""")
def t3(t: Tables) -> DataFrame:
    sessions = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("reviews"), F.count(F.when(F.col("event_id") % 6 >= 3, 1)).alias("correct"))
    return sessions.select("user_id", F.col("w.start").alias("started"), "reviews", "correct")


@query("t3_session_stream", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
    f AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS reviews, count(*) FILTER (WHERE event_id % 6 >= 3) AS correct FROM s GROUP BY user_id, s) SELECT * FROM f WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def t3_stream(t: Tables) -> DataFrame:
    """The sessions that ended two days before the newest event, as the stream gives them."""
    path = shared(t)
    found = R.sessions(stream(t, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "6 hours", F.col("event_id") % 6 >= 3, late="2 days")
    R.take(found, path, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/{number}"))
    return S.written(t.spark, path)


@query("t4_usage_stream", "SELECT event_type, count(*) AS requests, round(sum(value), 4) AS cost, sum(value) >= 5000 AS exhausted FROM events GROUP BY 1")
def t4(t: Tables) -> DataFrame:
    """The totals after the last batch; the state forgets the ids of events after 400 days."""
    path = shared(t)
    totals = R.running_totals(stream(t, "events").select("event_type", "value", "event_id", "ts"), "event_type", "value", "event_id", "ts", "400 days")
    R.take(totals, path, lambda batch, number: R.upsert(path, batch.withColumn("batch", F.lit(number).cast("long")), number, ["event_type"], F.col("batch")), mode="update")
    now = R.upserted(t.spark, path, "event_type string, requests long, cost double, batch long")
    return now.select("event_type", "requests", F.round("cost", 4).alias("cost"), (F.col("cost") >= 5000).alias("exhausted"))


@query("t5_newest_stream", "SELECT user_id, event_type, arg_max(event_id, (ts, -event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def t5(t: Tables) -> DataFrame:
    """Each key's newest event, kept up to date by every batch; older and equal ones change nothing."""
    path, events = shared(t), stream(t, "events").select("user_id", "event_type", "event_id", "ts")
    R.take(events, path, lambda batch, number: R.upsert(path, batch, number, ["user_id", "event_type"], F.struct("ts", -F.col("event_id"))))
    return R.upserted(t.spark, path, events.schema)


@query("t1_incremental_index", "SELECT coalesce(source, '') || '_' || substr(md5(text), 1, 12) AS content_id, max(doc_id) AS doc_id FROM documents WHERE length(text) >= 10 GROUP BY 1")
def t1(t: Tables) -> DataFrame:
    """An index by content; a second run finds every file taken and changes nothing."""
    path, docs = shared(t), stream(t, "documents").where(F.length("text") >= 10)
    rows = docs.select(X.content_id(F.col("source"), F.col("text")).alias("content_id"), "doc_id")
    for _ in range(2):
        R.take(rows, path, lambda batch, number: R.upsert(path, batch, number, ["content_id"], F.col("doc_id")))
    return R.upserted(t.spark, path, rows.schema)


@query("t6_session_log", "SELECT conv_id, turn, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) > 500 AS handover FROM conversations WHERE length(text) > 0")
def t6(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    run = F.sum(X.approx_tokens(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return t.conversations.where(F.length("text") > 0).select("conv_id", "turn", run.alias("tokens"), (run > 500).alias("handover"))
