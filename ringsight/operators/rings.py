"""Rings: groups of rows that share a device or an address, within a day or at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.session import sized, staged

LOW, CAP, HOUR = 2, 25, 3600


def ring_rows(txn: DataFrame, live: bool = False) -> DataFrame:
    """A row per transaction and ring key it has: kind, key, day, member and the columns of txn; merchant is dealt by card. ``live``: as ``live_rows``."""
    key = lambda kind, key, member: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.col(member).alias("member"))
    each = [key("device", F.when(K.specific_device(F.col("device_info")), K.device_key()), "account"), key("address", K.address_key(), "card1")]
    if live:
        each.append(key("card", F.when(F.col("source") == "live", F.col("card1").cast("string")), "account"))
    rows = txn.withColumn("day", K.day()).withColumn("_r", F.explode(F.array(*each)))
    return rows.select("*", "_r.*").drop("_r").filter("key is not null").withColumn("merchant", F.col("shop") if live else K.merchant())


def with_source(txn: DataFrame) -> DataFrame:
    """``txn`` with source, live for every fifth row and else replay, and disputed, true for the even frauds."""
    return txn.withColumn("source", F.when(F.col("txn_id") % 5 == 0, "live").otherwise("replay")).withColumn("disputed", (F.col("is_fraud") == 1) & (F.col("txn_id") % 2 == 0))


def live_rows(txn: DataFrame) -> DataFrame:
    """Ring rows of ``txn`` (with source) without days, and for live rows a ring of each card: replayed card codes stand for thousands of cards. merchant is the shop that was paid."""
    return ring_rows(txn, live=True).drop("day")


#: Different (card, account, merchant) of one ring up to which its sets are made in one row.
CROWDED = 10_000
#: What distinct counts are of.
PEOPLE = ("card1", "account", "merchant")


def grouped(rows: DataFrame, by: tuple[str, ...], told: dict[str, tuple[Column, str]], crowded: int = CROWDED) -> DataFrame:
    """by, ``told`` (name -> aggregate of rows, and the name of the aggregate of such parts), cards, accounts, merchants and members (cards of address rings, else accounts).

    In two levels: first a row for each card, account and merchant of a ring, then a
    ring's sets. Rings with over ``crowded`` of those are counted value by value instead,
    so that no row holds a large set and no row of the input is copied. Nulls are not
    counted. ``by`` contains kind and has no nulls.
    """
    parts = staged(rows.groupBy(*by, *PEOPLE).agg(*[x.alias(n) for n, (x, _) in told.items()]), "parts")
    sums = [getattr(F, again)(n).alias(n) for n, (_, again) in told.items()]
    names = dict(zip(PEOPLE, ("cards", "accounts", "merchants"), strict=True))
    many = staged(parts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select(*by), "crowded")
    few, out = parts, None
    if not many.isEmpty():  # a row for ``crowded`` rows of the input at most
        side = sized(many)
        few, own = parts.join(side, list(by), "left_anti"), parts.join(side, list(by), "left_semi")
        out = own.groupBy(*by).agg(*sums)
        for c, n in names.items():
            out = out.join(own.groupBy(*by, c).agg(F.lit(1)).groupBy(*by).agg(F.count(c).alias(n)).hint("merge"), list(by))
    sets = few.groupBy(*by).agg(*sums, *[F.size(F.collect_set(c)).cast("long").alias(n) for c, n in names.items()])
    out = sets if out is None else sets.unionByName(out)
    return out.withColumn("members", F.when(F.col("kind") == "address", F.col("cards")).otherwise(F.col("accounts")))


def figures() -> dict[str, tuple[Column, str]]:
    return {"txns": (F.count(F.lit(1)), "sum"), "score": (F.sum("score"), "sum"), "score_max": (F.max("score"), "max"), "amount": (F.sum("amount"), "sum"), "t0": (F.min("t"), "min"), "t1": (F.max("t"), "max")}


def live_agg(rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """One row per kind and key: sizes, distinct members, cards and merchants, scores, source (mixed if there are two), frauds, disputes, flagged."""
    more = {"s0": (F.min("source"), "min"), "s1": (F.max("source"), "max"), "frauds": (F.count_if(F.col("is_fraud") == 1), "sum"), "disputed": (F.count_if("disputed"), "sum")}
    g = grouped(rows, ("kind", "key"), figures() | more).withColumnRenamed("txns", "size").withColumn("score_mean", F.col("score") / F.col("size"))
    return g.withColumn("source", F.when(F.col("s0") == F.col("s1"), F.col("s0")).otherwise("mixed")).withColumn("flagged", F.col("score_mean") >= threshold).drop("s0", "s1", "score")


def live_rings(txn: DataFrame, before: int = 0, threshold: float = 0.35) -> DataFrame:
    """Rings of the window over ``txn`` (with source): the week up to its latest row, or up to ``before`` seconds earlier."""
    clock = txn.agg((F.max("t") - before).alias("_m"))
    week = txn.crossJoin(F.broadcast(clock)).filter("t <= _m and t >= _m - 604800").drop("_m")
    return in_window(live_agg(live_rows(week), threshold))


def newly_flagged(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rings flagged in one snapshot and not in the one before."""
    return now.filter("flagged").join(before.filter("flagged").select("kind", "key").hint("merge"), ["kind", "key"], "left_anti")


#: A ring is all rows of a key within a day, or all of a key.
DAILY, WHOLE = ("kind", "key", "day"), ("kind", "key")


def ring_agg(rows: DataFrame, hot: float = 0.5, by: tuple[str, ...] = DAILY) -> DataFrame:
    """One row per ring of ``by``: txns, members, cards, accounts, merchants, mean and greatest score, share of hot rows, amount, time span, frauds."""
    more = {"hot": (F.count_if(F.col("score") >= hot), "sum"), "frauds": (F.sum("is_fraud").cast("long"), "sum")}
    g = grouped(rows, by, figures() | more)
    span = F.greatest((F.col("t1") - F.col("t0")) / HOUR, F.lit(1 / 60))
    return g.select(*by, "txns", "members", "cards", "accounts", "merchants", (F.col("score") / F.col("txns")).alias("score_mean"), "score_max", (F.col("hot") / F.col("txns")).alias("hot_share"), "amount", "t0", "t1", "frauds", span.alias("span_h"))


def in_window(rings: DataFrame, low: int = LOW, cap: int = CAP) -> DataFrame:
    return rings.filter(F.col("members").between(low, cap))


def flagged(rings: DataFrame, threshold: float = 0.35, merchants: int = 1) -> DataFrame:
    return rings.filter((F.col("merchants") >= merchants) & (F.col("score_mean") >= threshold))


def bucket_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the five risk buckets per group: the part of the sum that a merchant makes alone."""
    b = K.risk_bucket(F.col("score"))
    return rows.groupBy(*by).agg(*[F.sum((b == i).cast("int")).cast("double").alias(f"b{i}") for i in range(5)])
