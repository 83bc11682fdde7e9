"""Session helpers: shared scratch tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids (8 bytes each) up to which an id list is broadcast; beyond it the join shuffles.
MOST_IDS = 1_000_000


#: Paths that this process made, for ``release``.
_made: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has none to share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession, kept: int = 0) -> None:
    """Delete what this process has put into the shared folder, but for the first ``kept`` paths. Results that were not written elsewhere can no longer be read."""
    conf = spark._jsc.hadoopConfiguration()
    while len(_made) > kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within are deleted at the end: write results elsewhere before."""
    before = len(_made)
    try:
        yield
    finally:
        release(spark, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, most: int = 200_000) -> DataFrame:
    """The side of a join with a hint: broadcast up to ``most`` counted rows, else merged. ``table`` should be cheap to count."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """left_semi or left_anti join on one id column. ``ids`` is counted: it is broadcast up to MOST_IDS rows and shuffled beyond."""
    small = ids.count() <= MOST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), column, how)
