"""Files: headered CSV, splits, reports, an event store, cached features and models.

Every path must lie in storage that the whole cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered CSV of a given schema: nothing is inferred, so files are read once. Empty fields are null; a field of a wrong type ends the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sink_splits(df: DataFrame, path: str) -> None:
    """Parquet with a folder for each split, so that a filter on split reads no others."""
    df.write.partitionBy("split").parquet(path)


def sink_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; reports have a bounded number of rows. Columns may be nested."""
    df.coalesce(1).write.json(path)


def scan_report_json(spark: SparkSession, path: str, schema: StructType, pretty: bool = False) -> DataFrame:
    """Reports of a given schema; ``pretty`` for files that hold one report over many lines."""
    return spark.read.schema(schema).option("multiLine", pretty).json(path)


def sectioned(spark: SparkSession, path: str, sections: list[str], sweeps: list[str]) -> DataFrame:
    """section, setting, name, metric, value of a report that is one object over many lines, as experiments write it.

    ``sections`` are objects of objects of numbers ({kind: {metric: number}}), ``sweeps``
    arrays of such with the setting as a number beside them ({epsilon: 8, kind: {...}}).
    Names are whatever the file has; what is no number is left out. A setting of null is null.
    """
    fields = [f"`{s}` map<string,string>" for s in sections] + [f"`{s}` array<map<string,string>>" for s in sweeps]
    raw = spark.read.schema(", ".join(fields)).option("multiLine", True).json(path)
    rows = None
    for s in [*sections, *sweeps]:
        each = raw.select(F.explode(s).alias("m")) if s in sweeps else raw.select(F.col(s).alias("m"))
        setting = F.col("m")["epsilon"].cast("double") if s in sweeps else F.lit(None).cast("double")
        parts = each.select(F.lit(s).alias("section"), setting.alias("setting"), F.explode("m").alias("name", "text")).filter("text like '{%'")
        numbers = F.from_json("text", "map<string,string>")
        one = parts.select("section", "setting", "name", F.explode(numbers).alias("metric", "v")).withColumn("value", F.expr("try_cast(v AS double)")).drop("v").filter("value is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def sink_sectioned(lines: DataFrame, path: str, sweeps: list[str]) -> None:
    """Write ``lines`` (section, setting, name, metric, value) as such a report, one object in one file. Reports have a bounded number of lines."""
    metrics = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    per = lines.groupBy("section", "setting", "name").agg(metrics.alias("m"))
    per = per.groupBy("section", "setting").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.to_json("m").alias("m"))))).alias("m"))
    body = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))
    own = F.when(F.col("section").isin(*sweeps), F.concat(F.lit('{"epsilon": '), F.coalesce(F.col("setting").cast("string"), F.lit("null")), F.lit(", "), F.expr("substr(b, 2)"))).otherwise(F.col("b"))
    texts = per.withColumn("b", body(F.col("m"))).select("section", "setting", own.alias("b"))
    joined = texts.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("setting", "b"))), lambda x: x["b"]), ", ").alias("b"))
    line = F.concat(F.lit('"'), F.col("section"), F.lit('": '), F.when(F.col("section").isin(*sweeps), F.concat(F.lit("["), F.col("b"), F.lit("]"))).otherwise(F.col("b")))
    whole = joined.agg(F.array_join(F.sort_array(F.collect_list(line)), ",\n ").alias("t")).select(F.concat(F.lit("{"), F.col("t"), F.lit("}")).alias("value"))
    whole.coalesce(1).write.text(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended: its _SUCCESS file is there."""
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``path`` holds; an empty table if it is not there yet. A folder of batches is there once its first batch is."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def sink_event_store(batch: DataFrame, path: str, key: str = "txn_id") -> None:
    """Append the rows whose key is not stored yet. Of rows that repeat a key in the batch, one is kept.

    The committer moves files into the store when a job ends, so that a job that
    died leaves none of its rows, and delivering its batch again stores them once.
    """
    old = stored(batch.sparkSession, path, batch.schema).select(key)
    batch.dropDuplicates([key]).join(old.hint("merge"), key, "left_anti").write.mode("append").parquet(path)


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cache_features(spark: SparkSession, root: str, version: int, schema: StructType, build: Callable[[], DataFrame]) -> DataFrame:
    """Features of a version: read if they are there, else built and written under v=<version>."""
    path = f"{root}/v={version}"
    if not written(spark, path):  # absent, or left by a job that died
        build().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
