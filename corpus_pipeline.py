"""A corpus pipeline over documents: quality rules, language ID, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.bpe import default_path
from ringsight.llm.common import by_ids, read, staged
from ringsight.llm.jaccard import jaccard_components
from ringsight.llm.langid import UNKNOWN, fit, predict
from ringsight.llm.packing import pack_documents
from ringsight.llm.quality import quality_filter

#: Language ID rejects what has no letters, and texts whose first language leads by less than a tenth.
LEAST_SCORE = 0.55
#: Near duplicates: sets of five-word shingles with a similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:  # nothing was learned: only what has no letters goes
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the least doc_id stays."""
    found = jaccard_components(docs, WORDS, NUM, DEN)
    gone = staged(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
