"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.session import by_ids, staged, workspace  # noqa: F401

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, whose lambdas may refer to it freely."""
    return F.element_at(F.transform(F.array(value), body), 1)
