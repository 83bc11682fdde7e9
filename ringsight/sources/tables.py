"""Readers: transactions over the events table, splits, payment events, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators.metrics import quantiles

DAY = 86400
#: Event types, and two email domains for each.
KINDS = ("view", "click", "purchase", "error")
DOMAINS = ("mail.com", "aim.com", "gmail.com", "live.com.mx", "protonmail.com", "outlook.es", "outlook.com", "hotmail.es")
PAYMENT = (
    "struct<id string, amount bigint, currency string, email string, contact string, method string, "
    "card struct<last4 string, network string, issuer string, type string, international string>, created_at double, notes map<string,string>>"
)
DISPUTE = "struct<id string, payment_id string, phase string, reason_code string, amount bigint, status string>"
ENVELOPE = f"event string, payload struct<payment struct<entity {PAYMENT}>, dispute struct<entity {DISPUTE}>, `payment.dispute` struct<entity {DISPUTE}>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; t is seconds since 2024-01-01, shop the merchant that was paid, whichever the card."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("t"))
    k, user = F.col("k"), F.col("user_id")
    email = F.array(*map(F.lit, DOMAINS))
    device = F.array(*map(F.lit, K.GENERIC_DEVICES))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    return e.select(
        F.col("event_id").alias("txn_id"), F.col("t").cast("long").alias("t"), F.col("value").alias("amount"),
        (F.floor(user / 2) + (k % 3) * 100000).cast("long").alias("card1"), user.cast("long").alias("account"),
        F.when(k % 7 != 0, user % 40).cast("long").alias("addr1"), (k % 4).cast("long").alias("addr2"),
        F.when(kind > 0, F.try_element_at(email, 2 * kind - (k % 2).cast("int"))).alias("email_domain"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, F.try_element_at(device, (F.floor(k / 5) % 6 + 1).cast("int"))).otherwise(F.concat(F.lit("D"), k, F.lit(" "), F.col("event_type"))).alias("device_info"),
        F.concat(F.lit("browser "), k % 3).alias("browser"), F.least(F.col("value") / 200, F.lit(0.999)).alias("score"),
        F.when(((F.col("value") > 100) & (F.col("event_id") % 3 != 0)) | (F.col("event_id") % 29 == 0), 1).otherwise(0).alias("is_fraud"),
        (F.col("event_id") % 6).cast("long").alias("shop"),
    )


def identity(txn: DataFrame) -> DataFrame:
    return txn.filter("txn_id % 4 = 0").select("txn_id", "device_info", "browser")


def temporal_split(txn: DataFrame, low: float = 0.7, high: float = 0.85) -> DataFrame:
    """split by the value quantiles of t, interpolated."""
    a, b = quantiles(txn, "t", [low, high])
    return txn.withColumn("split", F.when(F.col("t") <= F.lit(a), "train").when(F.col("t") <= F.lit(b), "val").otherwise("test"))


def payment_events(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """Typed payment rows from webhook bodies; the entity stands under payload.payment."""
    x = json_rows.select(F.from_json(column, ENVELOPE).alias("x"))
    return x.select("x.event", F.col("x.payload.payment.entity").alias("payment"), F.coalesce(F.col("x.payload.dispute.entity"), F.col("x.payload.`payment.dispute`.entity")).alias("dispute"))


def dispute_json(disputes: DataFrame) -> DataFrame:
    """Webhook bodies of disputes (dispute_id, txn_id, amount_minor); odd ones stand under payload.dispute, the others under payload.payment.dispute."""
    entity = F.struct(F.col("dispute_id").alias("id"), F.concat(F.lit("pay_"), "txn_id").alias("payment_id"), F.lit("fraud").alias("phase"), F.lit("10.4").alias("reason_code"), F.col("amount_minor").alias("amount"), F.lit("open").alias("status"))
    held = F.struct(entity.alias("entity"))
    body = lambda name: F.to_json(F.struct(F.lit("payment.dispute.created").alias("event"), F.struct(held.alias(name)).alias("payload")))
    return disputes.select(F.when(F.col("txn_id") % 2 == 1, body("dispute")).otherwise(body("payment.dispute")).alias("value"))


def payment_json(txn: DataFrame) -> DataFrame:
    """Webhook bodies of the transactions, as a feed would deliver them."""
    entity = F.struct(
        F.concat(F.lit("pay_"), "txn_id").alias("id"), F.round(F.col("amount") * 100).cast("long").alias("amount"), F.lit("INR").alias("currency"),
        F.concat(F.lit("u"), "account", F.lit("@"), F.upper("email_domain")).alias("email"), F.concat(F.lit("+91"), "account").alias("contact"),
        F.when(F.col("txn_id") % 3 == 0, "upi").otherwise("card").alias("method"),
        F.struct(F.when(F.col("txn_id") % 3 != 0, F.lpad((F.col("card1") % 10000).cast("string"), 4, "0")).alias("last4"), F.lit("Visa").alias("network"), F.lit("").alias("issuer"), F.lit("credit").alias("type"), F.when(F.col("txn_id") % 2 == 0, "true").otherwise("false").alias("international")).alias("card"),
        F.col("t").cast("double").alias("created_at"), F.create_map(F.lit("merchant"), F.concat(F.lit("m"), F.col("card1") % 8)).alias("notes"),
    )
    return txn.select(F.to_json(F.struct(F.lit("payment.captured").alias("event"), F.struct(F.struct(entity.alias("entity")).alias("payment")).alias("payload"))).alias("value"))
