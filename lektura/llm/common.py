"""What the operators of this subpackage share: table reading, lineage cuts, checked broadcasts, the label split."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lektura.session import small_batches  # noqa: F401, for the operators here

#: ASCII white space, and words between it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local master;
    a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files behind; else they stay until the driver happens to collect
    its garbage, and a loop of many turns fills the disk with them. Only for results that are written whole: a plan that
    is run a second time would have to shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Runs df and cuts its lineage by a reliable checkpoint, so lost executors cost no recomputation."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    with shuffles_dropped(spark):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, by a table in the shared folder. For loops that join: the size that Spark expects of a checkpoint is
    the product of the joins before it, which after some turns is a number of millions of digits; a table has its own."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcasting only if it is counted to have at most so many rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; such rows never teach a model. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
