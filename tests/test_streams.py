"""Streams of several files out of order, with restarts between, against the same rows taken at once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lektura.sources import readers
from lektura.streaming import running as R

START = dt.datetime(2025, 3, 1)
USAGE = "id long, provider string, cost double, at timestamp"


def arrive(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{name}")


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_totals_run_on_over_restarts_and_count_repeats_once(spark, folder):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, None]), START + dt.timedelta(minutes=i)) for i in range(60)]
    late = (900, "a", 1000.0, START - dt.timedelta(days=9))
    shuffled = rng.sample(rows, 60)
    rounds = [[shuffled[:25], shuffled[10:40]], [shuffled[35:], rows[:9] + [(None, "a", 7.0, START), (77, "b", 7.0, None)]], [[late]]]
    schema, seen, dropped = "provider string, requests long, cost double, batch long", {}, []

    def keep(batch, number):
        batch = batch.withColumn("batch", F.lit(number).cast("long"))
        for _ in range(2):  # a batch that runs again changes nothing
            R.upsert(folder, batch, number, ["provider"], F.col("batch"))

    for k, files in enumerate(rounds):
        for n, file in enumerate(files):
            arrive(spark, file, USAGE, folder, f"{k}-{n}")
        totals = R.running_totals(read(spark, folder, USAGE), "provider", "cost", "id", "at", "2 days")
        dropped.append(R.take(totals, folder, keep, mode="update"))
        for file in files:
            seen.update({r[0]: r for r in file if r[0] is not None and r[3] is not None and r is not late})
        want = {}
        for _, provider, cost, _ in seen.values():
            n, c = want.get(provider, (0, 0.0))
            want[provider] = (n + 1, c + (cost or 0.0))
        assert {r["provider"]: (r["requests"], r["cost"]) for r in R.upserted(spark, folder, schema).collect()} == want
    assert dropped == [0, 0, 1]


def test_newest_version_stays_whatever_the_order_of_files(spark, folder):
    rng = random.Random(5)
    schema = "card long, version long, text string"
    rows = [(None if c == 0 else c, v, f"{c}/{v}") for c in range(300) for v in rng.sample(range(9), 3)]
    rng.shuffle(rows)
    files = [rows[i : i + 150] for i in range(0, len(rows), 150)] + [rows[:40], [], rows[700:701]]
    for number, file in enumerate(files):
        R.upsert(folder, spark.createDataFrame(file, schema), number, ["card"], F.col("version"))
    want = {}
    for card, version, text in rows:
        want[card] = max(want.get(card, (-1, "")), (version, text))
    got = R.upserted(spark, folder, schema).collect()
    assert {r["card"]: (r["version"], r["text"]) for r in got} == want and len(got) == len(want)
    # An equal version that comes later changes nothing; a batch of one key writes one bucket.
    R.upsert(folder, spark.createDataFrame([(7, want[7][0], "other")], schema), 50, ["card"], F.col("version"))
    assert {r["text"] for r in R.upserted(spark, folder, schema).where("card = 7").collect()} == {want[7][1]}
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/rows/50").where("path like '%.parquet'")
    assert written.count() == 1


def test_a_batch_that_ran_halfway_counts_once_it_ran_again(spark, folder):
    schema = "card long, n long"
    R.upsert(folder, spark.createDataFrame([(i, 1) for i in range(100)], schema), 0, ["card"], F.col("n"))
    # Rows of batch 1 are there, its list is not: readers see batch 0.
    spark.createDataFrame([(0, 5, 9)], "_bucket int, card long, n long").write.partitionBy("_bucket").parquet(f"{folder}/rows/1")
    assert {r["n"] for r in R.upserted(spark, folder, schema).collect()} == {1}
    R.upsert(folder, spark.createDataFrame([(5, 2), (200, 3)], schema), 1, ["card"], F.col("n"))
    assert {r["card"]: r["n"] for r in R.upserted(spark, folder, schema).collect()} == {i: 1 for i in range(100)} | {5: 2, 200: 3}


def test_empty_table_of_no_batches(spark, folder):
    assert R.upserted(spark, folder, "card long, n long").count() == 0
    R.upsert(folder, spark.createDataFrame([], "card long, n long"), 0, ["card"], F.col("n"))
    assert R.upserted(spark, folder, "card long, n long").count() == 0


def test_sessions_over_files_out_of_order_and_a_restart(spark, folder):
    schema, rng = "card long, at timestamp, q int", random.Random(6)
    times = [(c, START + dt.timedelta(minutes=m), rng.randrange(6)) for c in range(4) for m in sorted(rng.sample(range(6000), 60))]
    times.sort(key=lambda r: r[1])
    files = [times[:80], times[120:160], times[80:120], times[160:]]  # within a day of each other
    right, found = F.col("q") >= 3, []

    def out(batch, number):
        found.extend(tuple(r) for r in batch.collect())

    dropped = 0
    for k, file in enumerate(files + [[(9, START + dt.timedelta(days=30), 5)], [(1, START, 5), (9, START + dt.timedelta(days=30), 1)]]):
        arrive(spark, file, schema, folder, str(k))
        dropped += R.take(R.sessions(read(spark, folder, schema), "card", "at", "30 minutes", right, late="2 days"), folder, out)
    want = [tuple(r) for r in R.sessions(spark.createDataFrame(times, schema), "card", "at", "30 minutes", right).collect()]
    assert sorted(found) == sorted(want)  # the session that is still open is not among them, the late review in none
    assert dropped == 1


def test_a_guarded_write_counts_as_it_writes(spark, folder):
    rows = spark.range(0, 100, 1, 3).withColumn("v", F.when(F.col("id") < 99, F.col("id")))
    assert readers.guarded_write(rows, F.col("v") >= 20, f"{folder}/a") == (100, 79, "ok")
    assert spark.read.parquet(f"{folder}/a").count() == 79
    assert readers.guarded_write(rows, F.col("v") >= 89, f"{folder}/b") == (100, 10, "warn")
    with pytest.raises(readers.Lost):
        readers.guarded_write(rows, F.col("v") >= 90, f"{folder}/c")
    assert readers.guarded_write(rows.limit(0), F.col("v") >= 90, f"{folder}/d") == (0, 0, "ok")
    assert readers.guarded_write(spark.createDataFrame([], "v long"), F.col("v") >= 90, f"{folder}/e") == (0, 0, "ok")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.guarded_write(rows, F.col("v") >= 20, f"{folder}/a")
