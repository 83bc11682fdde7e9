"""Streams over the transaction feed: deduplication, scoring, rings and first alerts.

Steps that need more than sums keep keyed state (``state``). Rows later than the
watermark are left to the batch path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringsight.operators import privacy as P
from ringsight.operators import rings as R
from ringsight.session import sized, staged
from ringsight.sources.files import latest
from ringsight.streaming import state

LATE = "1 hour"
#: Unix seconds of t = 0.
EPOCH = 1_704_067_200


def transaction_feed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, late: str = LATE, epoch: int = EPOCH) -> DataFrame:
    """Rows of the feed with event time ``ts`` and a watermark that waits for rows as ``late`` as told."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.timestamp_seconds(F.col("t") + epoch)).withWatermark("ts", late)


def deduplicated(feed: DataFrame) -> DataFrame:
    """Each txn_id once within the watermark."""
    return feed.dropDuplicatesWithinWatermark(["txn_id"])


def scored(feed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``feed`` with flagged, and for flagged rows the text of an alert."""
    hit = F.col("score") >= threshold
    return feed.withColumn("flagged", hit).withColumn("alert", F.when(hit, F.concat(F.lit("payment "), "txn_id", F.lit(" scored "), F.floor(F.col("score") * 1000), F.lit(" of 1000"))))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there as Parquet and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, step, checkpoint: str, mode: str = "append") -> None:
    """Call ``step`` (rows, number) for what is there. A batch may come again after a crash, so a step overwrites what it wrote for that number."""
    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def run_feed(feed: DataFrame, path: str, checkpoint: str) -> None:
    """txn_id, t and the clock, the latest time delivered up to the row's batch."""
    spark = feed.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        clock = tick(spark, batch, checkpoint, number)
        if clock is not None:
            batch.select("txn_id", "t", F.lit(clock).cast("long").alias("clock")).write.mode("overwrite").parquet(numbered(path, number))

    each_batch(feed, step, checkpoint)


def tick(spark: SparkSession, batch: DataFrame, checkpoint: str, number: int) -> int | None:
    """The latest t up to this batch: one row a batch is kept. None before the first row."""
    clocks = f"{checkpoint}-clock"
    batch.agg(F.max("t").alias("t")).write.mode("overwrite").parquet(numbered(clocks, number))
    return spark.read.schema("t long, batch long").parquet(clocks).filter(F.col("batch") <= number).agg(F.max("t")).first()[0]


def run_sliding(feed: DataFrame, path: str, checkpoint: str, epoch: int = EPOCH) -> None:
    """The weeks that a batch changes, under its number; ``last_sliding`` reads what stands."""
    each_batch(state.sliding_weeks(feed, epoch), lambda batch, number: batch.write.mode("overwrite").parquet(numbered(path, number)), checkpoint, "update")


def last_sliding(spark: SparkSession, path: str, threshold: float = 0.35) -> DataFrame:
    """day (the week's first), kind, key, txns, members (up to one more than the cap), score_mean, in_window, flagged of every week as last seen."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("day", "kind", "key").agg(F.max_by(F.struct("txns", "members", "score_mean"), "batch").alias("x")).select("day", "kind", "key", "x.*")
    held = F.col("members").between(R.LOW, R.CAP)
    return last.withColumns({"in_window": held, "flagged": held & (F.col("score_mean") >= threshold)})


def run_rings(feed: DataFrame, path: str, checkpoint: str, threshold: float = 0.35, epoch: int = EPOCH) -> None:
    """Live rings of the week up to the watermark; a ring is written to ``path`` when it becomes flagged."""
    run_available(state.ring_alerts(R.with_source(feed), epoch, threshold), path, checkpoint)


def run_velocity(feed: DataFrame, path: str, checkpoint: str, epoch: int = EPOCH) -> None:
    """Peers of the hour before each row, written once the row's clock hour is complete; ``peers`` reads them."""
    run_available(state.hour_peers(feed, epoch), path, checkpoint)


def peers(spark: SparkSession, path: str) -> DataFrame:
    """txn_id, accounts, merchants, cards of the rows told so far."""
    rows, of = spark.read.parquet(path), lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    return rows.groupBy("txn_id").agg(of("card", "others").alias("accounts"), of("card", "shops").alias("merchants"), of("account", "others").alias("cards"))


def run_disputes(feed: DataFrame, transactions: DataFrame, path: str, checkpoint: str) -> None:
    """Disputes (dispute_id, txn_id, dt, amount_minor, status) joined to stored transactions (txn_id, amount, warned); those of unknown transactions are left out.

    ``warned`` tells whether a transaction was flagged or lay in a flagged ring. Amounts
    are in major units, or the transaction's where the dispute has none.
    ``latest_disputes`` gives the last status of each.
    """
    known = transactions.select("txn_id", F.col("amount").alias("_amount"), F.col("warned").alias("was_flagged"))

    def step(batch: DataFrame, number: int) -> None:
        j = known.join(sized(staged(batch, "disputes")), "txn_id")  # the batch goes to the store, not the store to the batch
        out = j.select("dispute_id", "txn_id", "dt", F.round(F.coalesce(F.col("amount_minor") / 100, "_amount"), 2).alias("amount"), "was_flagged", "status")
        out.write.mode("overwrite").parquet(numbered(path, number))

    each_batch(feed, step, checkpoint)


def latest_disputes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return latest(rows, "dispute_id", ["dt", "status"]).select("dispute_id", "txn_id", "amount", "was_flagged", "status")


#: Columns that ``run_fed_detect`` reads.
DETECTS = ("txn_id", "t", "is_fraud", "card1", "shop", "score")


def run_fed_detect(feed: DataFrame, path: str, checkpoint: str, epsilon: float | None = None, seed: str = "live") -> None:
    """What merchants release of the live cards that a batch touches, under its number; ``fed_detected`` judges what stands.

    A merchant's counts of a card's fingerprint are the state; a batch changes and
    writes those of its own cards and reads nothing that is stored. With ``epsilon`` the
    noise is a merchant's own, and the same whenever it releases a fingerprint again.
    """
    rows = R.with_source(feed).filter("source = 'live' and card1 is not null and shop is not null")
    rows = rows.select(F.col("shop").alias("merchant"), F.lit("card").alias("kind"), F.col("card1").cast("string").alias("key"), "score")
    counts = R.bucket_counts(rows, ["merchant", "kind", "key"])

    def step(batch: DataFrame, number: int) -> None:
        hist = batch.select("merchant", "kind", P.fingerprint(P.LIVE_SECRET, ("key",)).alias("fp"), *P.B)
        (P.dp_release(hist, F.lit(seed), F.lit(epsilon), drop=False) if epsilon else hist).write.mode("overwrite").parquet(numbered(path, number))

    each_batch(counts, step, checkpoint, "update")


def released(spark: SparkSession, path: str) -> DataFrame:
    """merchant, kind, fp, b0..b4 as last released; what sums to less than one is nothing."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("merchant", "kind", "fp").agg(F.max_by(F.struct(*P.B), "batch").alias("x"))
    return last.select("merchant", "kind", "fp", "x.*").filter(P.total() >= 1)


def fed_detected(spark: SparkSession, path: str, threshold: float = 0.35, cap: int = R.CAP) -> DataFrame:
    """kind, fp, merchants, txns, risk_est, flagged of the cards that two merchants or more have seen."""
    hist = staged(released(spark, path), "released")
    return P.fed_rings(hist, staged(P.commitments(hist), "commitments"), threshold, defend=False, cap=cap).filter("merchants >= 2")
