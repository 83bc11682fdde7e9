"""Bottom-k sketches of word-shingle hashes. Native expressions only.

A sketch is the sorted array of the k least distinct hashes of a text's shingles.
Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.llm.common import bind, read, words

K, SHINGLE = 128, 5
LEAST = -(1 << 63)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; of the whole text if it has fewer; none without words."""

    def of(w):
        some = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, few).otherwise(some)

    return bind(words(text), of)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k least distinct shingle hashes, ascending. Null and empty texts have an empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    share = lambda m: F.size(F.array_intersect(m, F.array_intersect(a, b))) / F.size(m)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(bind(merge(a, b, k), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the k-th hash's place in the range of hashes."""
    full = F.lit(float(k - 1)) / ((F.element_at(a, k).cast("double") + float(1 << 63)) / float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


#: Ids drawn by hash at most, with more rows buckets grow; one in THIN of them starts a bucket, so that buckets are much of a size.
MOST_DRAWN, THIN = 2_000_000, 8


def literal(values: list[int]) -> Column:
    """Integers as one array literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, starts: list[int]) -> Column:
    """The place of the last of the ascending ``starts`` that is not above the key, by binary search."""
    table = literal(starts)
    steps = F.array(*[F.lit(1 << i) for i in range(len(starts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s < len(starts)) & (F.get(table, lo + s) <= key), lo + s).otherwise(lo))


def with_next(docs: DataFrame, rows_per_bucket: int = 250) -> DataFrame:
    """``docs`` (doc_id, text, sketch) with next_text and next_sketch of the row that follows by (doc_id, text), the first after the last.

    Ids are drawn by their hash, and every THIN-th of those drawn starts a bucket, so
    that buckets hold about ``rows_per_bucket`` ids and their number grows with the
    table. The rows of a bucket's first id also go, as strangers at its end, to the
    bucket before, so that a window per bucket sees every successor; texts are shuffled
    once. Null ids come first, and like the rows of one repeated id they are in one bucket,
    in order of text. The drawn ids reach the driver, about MOST_DRAWN at most.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    every = max(1, rows_per_bucket // THIN, docs.count() // MOST_DRAWN)
    ids = docs.select(key.alias("_key"))
    first = ids.agg(F.min("_key")).first()[0]
    drawn = ids.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).distinct().collect()
    starts = sorted({first if first is not None else LEAST, *sorted(r["_key"] for r in drawn)[::THIN]})
    last = len(starts) - 1
    dealt = docs.select("doc_id", "text", "sketch", key.alias("_key")).withColumn("_b", bucket_of(F.col("_key"), starts))
    dealt = dealt.withColumn("_head", F.get(literal(starts), F.col("_b")) == F.col("_key"))
    home = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest"))
    away = F.struct(F.when(F.col("_b") == 0, last).otherwise(F.col("_b") - 1).alias("b"), F.lit(True).alias("guest"))
    spread = dealt.withColumn("_at", F.explode(F.when(F.col("_head"), F.array(home, away)).otherwise(F.array(home))))
    w = Window.partitionBy("_at.b").orderBy("_at.guest", "_key", "text")
    seen = spread.select("*", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return seen.filter(~F.col("_at.guest")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("sketch", sketch(F.col("text"))))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    both = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    made = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
