"""Importance resampling towards a target corpus, on hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, ``bytes.split``
yields the words, and the CRC of a word is the seed for the next word's, so that a
run of words costs one CRC a word. Each task reduces its texts to one Counter of at
most BUCKETS counts before anything is shuffled. Gains are a table of BUCKETS
numbers; a second pass over the texts sums them. Ranks come from sorted ranges and
their sizes: no task sees all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import read, staged

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, SEED = 20, 42
#: Share of the eligible documents to draw: NUM of DEN.
NUM, DEN = 5, 100
#: Separators are blanks, A-Z become a-z; digits, a-z and all bytes of longer characters stay.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def feature_buckets(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words, joined by one blank: CRC-32 modulo ``buckets``, shorter runs first."""
    spaced = [b" " + w for w in words]
    runs = [list(map(zlib.crc32, words))]
    for n in range(1, longest):  # the run's CRC so far is the seed for its next word
        runs.append(list(map(zlib.crc32, spaced[n:], runs[-1])))
    return np.fromiter(chain(*runs), np.uint32, sum(map(len, runs))) % buckets


def feature_counts(texts: DataFrame, name: str) -> DataFrame:
    """bucket and ``name``, its number of features over all of ``texts`` (text). Null and empty texts have none."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(feature_buckets(word_list(text.as_py())).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen.keys(), pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    per_task = texts.select(F.col("text").cast("binary")).mapInArrow(reduce, "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor of 1000 times the logarithm of its smoothed share in ``target`` over that in ``docs``."""
    both = feature_counts(docs, "s").join(feature_counts(target, "t").hint("merge"), "bucket", "full")
    s, t = [0] * buckets, [0] * buckets
    for row in both.collect():  # a row for a bucket
        s[row["bucket"]], t[row["bucket"]] = row["s"] or 0, row["t"] or 0
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features, of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = [], [], []
            for text in batch.column("text"):
                words = word_list(text.as_py())
                at = feature_buckets(words)
                n_words.append(len(words))
                n.append(len(at))
                total.append(int(gain[at].sum()))
            made = [pa.array(x, pa.int64()) for x in (n_words, n, total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, weight, score and more) with rank: 1 to ``most`` by falling score and rising doc_id, null beyond.

    Rows are dealt by range and sorted within it; a row's place is the size of the
    ranges before plus its place in its own.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("weight")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = staged(dealt.select(*rows.columns, F.shiftright("_m", 33).alias("_range"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_place")), "ranges")
    sizes, before = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}, [0]  # a row for a range
    for i in range(max(sizes, default=-1)):
        before.append(before[-1] + sizes.get(i, 0))
    offset = F.element_at(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("_range").cast("int") + 1)
    place = offset + F.col("_place") + 1
    return dealt.select(*rows.columns, F.when(place <= most, place).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the N rows with at least ``min_words`` words the floor(num * N / den) highest
    scores are drawn, which have a rank from 1; all others have none. A score is the
    weight plus Gumbel noise in thousandths from a hash of seed and doc_id, so that a
    draw is one without replacement by weight and the same however rows are dealt.

    Null and empty texts have no features and weight 0. A null doc_id counts as empty
    text in the hash and comes before all others. Rows of equal doc_id are separate
    documents with the same noise; those of equal weight too have neighbouring ranks in
    any order. Other columns are ignored. An empty table gives no rows, an empty target
    the gains of smoothing alone.
    """
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = staged(weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= min_words
    most = num * rows.filter(fit).count() // den
    return ranked(rows.filter(fit), most).unionByName(rows.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text")
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _grams(table: str, key: str = "") -> str:
    """SQL tables of the words and the features of a table; ``key`` (with a comma) is carried along."""
    run = lambda n: " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    each = " UNION ALL ".join(f"SELECT {key}unnest([{run(n)} FOR i IN range(1, len(w) + {2 - n})]) AS f FROM {table}_w" for n in range(1, LONGEST + 1))
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{table}_w AS (SELECT {key}regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}), {table}_f AS ({each})"


#: CRC-32 of f in SQL: eight steps for each byte, which enters at the first.
_BYTES = "flatten([[('0x' || h[2 * i - 1:2 * i])::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN range(1, len(h) // 2 + 1)])"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
OP11_SQL = f"""
WITH {_grams('documents', 'doc_id, ')}, {_grams('benchmark')},
b AS (SELECT f, {_CRC} % {BUCKETS} AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f))),
s AS (SELECT bucket, count(*) AS s FROM documents_f JOIN b USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM benchmark_f JOIN b USING (f) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents_f) AS sa, (SELECT count(*) FROM benchmark_f) AS ta),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (ta + {BUCKETS})))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n_features FROM documents_f JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1),
c AS (SELECT doc_id, len(w) >= {MIN_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents_w LEFT JOIN w USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {NUM} * (SELECT count(*) FILTER (WHERE fit) FROM c) // {DEN} THEN place END AS rank FROM r
"""
