"""Steps that cut the lineage."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lektura.llm import common


@pytest.mark.parametrize("step", [common.cut, common.written])
def test_no_shuffle_files_stay(spark, step):
    """A loop of many turns would fill the disk with those of the turns before."""

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, setting = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(setting, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    found = step(rows)
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and found.count() == found.join(rows, "k").count() == 7
    assert spark.conf.get(setting, None) == had
