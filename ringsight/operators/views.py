"""Read views with parameters: lists of payments, rings, alerts and disputes, one ring in detail.

Limits are a report's: they cut what is shown, newest or worst first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.operators import rings as R

MOST_ROWS, MOST_RINGS, MOST_ALERTS, MOST_RANKED = 1000, 500, 500, 50


def chosen(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; None is any."""
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    return df


def top(df: DataFrame, order: list[Column], limit: int | None, most: int) -> DataFrame:
    return df.orderBy(*order).limit(most if limit is None else max(0, min(limit, most)))


def transactions(txn: DataFrame, flagged: bool | None = None, source: str | None = None, ring: tuple[str, str] | None = None, limit: int = 100, threshold: float = 0.5) -> DataFrame:
    """Newest payments of ``txn`` (with source), flagged by score, of one ring (kind, key) if wanted; MOST_ROWS at most."""
    rows = txn.withColumn("flagged", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    if ring:
        rows = chosen(R.live_rows(rows), kind=ring[0], key=ring[1]).select(*rows.columns)
    return top(chosen(rows, flagged=flagged, source=source), [F.desc("t"), F.desc("txn_id")], limit, MOST_ROWS)


def rings(table: DataFrame, flagged: bool | None = None, kind: str | None = None, source: str | None = None, limit: int = 100) -> DataFrame:
    """Rings of ``table`` by falling mean score; MOST_RINGS at most."""
    return top(chosen(table, flagged=flagged, kind=kind, source=source), worst(table), limit, MOST_RINGS)


def worst(table: DataFrame) -> list[Column]:
    return [F.desc(F.round("score_mean", 9)), *[c for c in ("kind", "key", "day") if c in table.columns]]


def ranked_rings(table: DataFrame, limit: int = 12) -> DataFrame:
    """The flagged rings with rank from 1, the worst first; from one to MOST_RANKED."""
    few = top(chosen(table, flagged=True), worst(table), max(1, limit), MOST_RANKED)
    rows = F.sort_array(F.collect_list(F.struct((-F.round("score_mean", 9)).alias("_s"), "kind", "key", F.struct(*few.columns).alias("r"))))  # fifty at most
    return few.agg(rows.alias("x")).select(F.posexplode("x").alias("i", "x")).select((F.col("i") + 1).cast("long").alias("rank"), "x.r.*")


def ring_detail(table: DataFrame, rows: DataFrame, ring: tuple[str, str], most: int = 40) -> DataFrame:
    """The first ``most`` payments of one ring (kind, key) by time, with n (from 1) and the ring's hours; none if ``table`` does not have the ring."""
    held = chosen(table, kind=ring[0], key=ring[1]).select("kind", "key", (F.greatest((F.col("t1") - F.col("t0")) / 3600, F.lit(1 / 60))).alias("window_hours"))
    few = chosen(rows, kind=ring[0], key=ring[1]).orderBy("t", "txn_id").limit(most).select("kind", "key", "t", "txn_id", "score")
    n = F.sort_array(F.collect_list(F.struct("t", "txn_id", "score")))  # ``most`` at most
    each = few.groupBy("kind", "key").agg(n.alias("x")).select("kind", "key", F.posexplode("x").alias("i", "x"))
    return each.join(F.broadcast(held), ["kind", "key"]).select("kind", "key", (F.col("i") + 1).cast("long").alias("n"), "x.*", "window_hours")  # one ring


def alert_table(txn: DataFrame, ring_alerts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """t, kind (txn or ring), subject, score: flagged payments, and rings (kind, key, t, score_mean) when they became flagged."""
    one = txn.filter(F.col("score") >= threshold).select("t", F.lit("txn").alias("kind"), F.col("txn_id").cast("string").alias("subject"), "score")
    return one.unionByName(ring_alerts.select("t", F.lit("ring").alias("kind"), F.concat_ws("|", "kind", "key").alias("subject"), F.col("score_mean").alias("score")))


def alerts(table: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    return top(chosen(table, kind=kind), [F.desc("t"), F.desc("kind"), "subject"], limit, MOST_ALERTS)


def disputes(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest disputes: all in order, or so many."""
    out = table.orderBy(F.desc("dt"), "txn_id")
    return out if limit is None else out.limit(limit)
