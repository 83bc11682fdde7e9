"""Sharding by a two-pass external shuffle.

The first pass scatters rows uniformly, by seeded hashes, into buckets that fit in
memory; the second puts each bucket into a fixed order, shuffles it by Fisher and
Yates with a generator of its own, and writes it. The buckets one after another are
one random order of all rows; shards are equal stretches of it. Texts are shuffled
and written once. Sizes of the written buckets make a manifest, from which every
row's shard and slot follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import read, staged, workspace
from ringsight.operators.metrics import prefix_sums
from ringsight.session import sized

SHARDS, SEED = 16, 42
#: Bytes of text that a bucket holds on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 64
#: Buckets, 16 bytes each in the manifest, up to which it is broadcast.
MOST_BUCKETS = 4_000_000
#: Rows of one doc_id from which its rows are scattered one by one.
HOT = 1_000
#: Columns that the operator adds.
MADE = ("bucket", "place")


def scattered(docs: DataFrame, buckets: int, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``docs`` with bucket, a seeded hash of doc_id; the rows of a doc_id (or of none) that repeats over ``hot`` times are dealt by their place in the table too."""
    many = staged(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_id", F.lit(True).alias("_hot")), "hot")
    salt = F.lit(0).cast("long")
    if not many.isEmpty():  # a row for ``hot`` rows of docs at most
        docs = docs.join(sized(many), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        salt = F.when(F.col("_hot"), F.monotonically_increasing_id()).otherwise(salt)
    return docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), salt), F.lit(buckets)).cast("int")).drop("_id", "_hot")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of n places: from the last on, each is swapped with one not above it."""
    order = np.arange(n)
    drawn = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(scattered_rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Each bucket's rows in random order, with place (from 0).

    Rows arrive in any order and are sorted first, so that a task that runs again
    after an executor was lost gives the same.
    """

    def one(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.take(pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))
        rng = np.random.default_rng(list(hashlib.sha256(f"{seed}:{bucket}".encode()).digest()))
        return table.take(pa.array(fisher_yates(len(table), rng))).append_column("place", pa.array(np.arange(len(table)), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered_rows.schema) + ", place long"
    return scattered_rows.groupBy("bucket").applyInArrow(one, schema)


def manifest(written: DataFrame) -> DataFrame:
    """bucket, n and before: a written bucket's rows, and those of the buckets before it."""
    sizes = staged(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return staged(prefix_sums(sizes, "bucket", ["n"], descending=False).select("bucket", "n", (F.col("cum_n") - F.col("n")).alias("before")), "manifest")


def with_shards(written: DataFrame, listed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``written`` (bucket, place and more) with shard and slot: the order of all rows is cut into stretches whose sizes differ by one at most. ``listed``: its manifest."""
    n = listed.agg(F.sum("n")).first()[0] or 1
    before = listed.select("bucket", F.col("before").alias("_before"))
    out = written.join(sized(before, MOST_BUCKETS), "bucket").withColumn("_at", F.col("_before") + F.col("place"))
    out = out.withColumn("shard", F.expr(f"{shards}L * _at div {n}L").cast("int"))
    return out.withColumn("slot", F.expr(f"_at - (shard * {n}L + {shards - 1}L) div {shards}L")).drop("_before", "_at", "bucket", "place")


def read_shard(written: DataFrame, listed: DataFrame, shard: int, shards: int = SHARDS) -> DataFrame:
    """One shard's rows with slot. Only the files of its buckets are read: they are chosen by the manifest."""
    n = listed.agg(F.sum("n")).first()[0] or 1
    own = listed.filter(F.expr(f"{shards}L * before < {n}L * ({shard} + 1) and {shards}L * (before + n) > {n}L * {shard}"))
    low, high = own.agg(F.min("bucket"), F.max("bucket")).first()
    rows = written.filter(F.col("bucket").between(low, high) if low is not None else F.lit(False))
    return with_shards(rows, listed, shards).filter(F.col("shard") == shard).drop("shard")


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, total_bytes: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text and more) in random order under ``path`` and read all back with shard and slot; ``read_shard`` reads one shard.

    Law ``rows``: shards hold as many rows as each other, or one more; slots are gapless
    from 0. The same rows with the same seed give the same shards, but for doc_ids that
    repeat over HOT times, which also depend on their places in the table. The size in
    bytes is measured unless it is given. Copies of a text are separate rows and may lie
    in different shards.

    Null texts count as empty and stay null; null doc_ids are rows like others. Rows of
    equal doc_id and text keep no order of their own. Columns named bucket, place, shard
    or slot are replaced. An empty table gives no rows.
    """
    kept = docs.select(*[c for c in docs.columns if c.lower() not in (*MADE, "shard", "slot", "_id", "_hot", "_before", "_at")])
    if total_bytes is None:
        total_bytes = kept.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total_bytes // bucket_bytes))
    out = shuffled(scattered(kept, buckets, seed), seed)
    out.write.parquet(path)
    written = docs.sparkSession.read.schema(out.schema).parquet(path)
    return with_shards(written, manifest(written), shards)


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the shuffled files. Law ``rows``, so that no shard count but this one is asked for."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = shard_documents(docs, workspace(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
