"""Classification metrics and thresholds, on distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.session import sized, staged

REVIEW = 3.0


def prefix_sums(df: DataFrame, order: str, values: list[str], descending: bool = True, parts: int | None = None) -> DataFrame:
    """``df`` plus cum_<value>: sums over all rows up to and with this one by ``order``, whose values are distinct.

    Rows are dealt by range and summed within each range; the totals of the ranges
    before are added from a table with one row per range. No task sees all rows.
    """
    key = F.desc(order) if descending else F.asc(order)
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_p").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    w = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_p")  # one row per range
    return out.select(*df.columns, *[(F.sum(v).over(w) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values])


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = 1_000_000) -> list[float | None]:
    """Exact interpolated quantiles of a column's values; null without any.

    Up to ``most`` counted rows one aggregate finds them. Beyond it values are counted,
    running counts are dealt by range, and only the values at the wanted places come
    back: two a share.
    """
    rows = df.select(F.col(column).cast("double").alias("_v")).filter("_v is not null")
    n = rows.count()
    if n == 0:
        return [None] * len(shares)
    if n <= most:
        return list(rows.agg(F.percentile("_v", F.array(*map(F.lit, shares)))).first()[0])
    at = [s * (n - 1) for s in shares]
    places = sorted({p for x in at for p in (int(x), min(int(x) + 1, n - 1))})
    c = prefix_sums(rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")), "_v", ["_n"], descending=False).filter(F.col("cum__n") > places[0])
    held = F.filter(F.array(*map(F.lit, places)), lambda p: (p < F.col("cum__n")) & (p >= F.col("cum__n") - F.col("_n")))
    found = {r["p"]: r["_v"] for r in c.select("_v", F.explode(held).alias("p")).collect()}
    return [found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x)) for x in at]


def by_score(df: DataFrame) -> DataFrame:
    """One row per distinct score: positives, negatives."""
    return df.groupBy("score").agg(F.sum("is_fraud").cast("long").alias("pos"), F.sum(1 - F.col("is_fraud")).cast("long").alias("neg"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def pr_auc(df: DataFrame) -> DataFrame:
    return pr_auc_of(by_score(df))


def pr_auc_of(counts: DataFrame) -> DataFrame:
    """The area of rows that are counted already: score (each once), pos, neg."""
    c = prefix_sums(counts, "score", ["pos", "neg"])
    return c.agg((F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")).alias("pr_auc"))


def pr_auc_by(df: DataFrame, by: list[str]) -> DataFrame:
    """by, pr_auc of the rows of each group, all in one pass: positions are counted over all groups and each group's first is taken off."""
    per = df.groupBy(*by, "score").agg(F.sum("is_fraud").cast("long").alias("pos"), F.sum(1 - F.col("is_fraud")).cast("long").alias("neg"))
    c = staged(prefix_sums(per.withColumn("_o", F.struct(*by, (-F.col("score")).alias("_s"))), "_o", ["pos", "neg"], descending=False).drop("_o"), "cumulated")
    first = c.groupBy(*by).agg(*[F.min(F.col(f"cum_{x}") - F.col(x)).alias(f"_{x}") for x in ("pos", "neg")])
    p, n = (F.col(f"cum_{x}") - F.col(f"_{x}") for x in ("pos", "neg"))
    return c.join(sized(staged(first, "first")), by).groupBy(*by).agg((F.sum(F.col("pos") * p / (p + n)) / F.sum("pos")).alias("pr_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    c = prefix_sums(by_score(df), "score", ["pos", "neg"], descending=False)
    return c.agg((F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def confusion(df: DataFrame, threshold: Column, by: list[str] | None = None) -> DataFrame:
    hit, bad = F.col("score") >= threshold, F.col("is_fraud") == 1
    n = lambda c: F.count_if(c).alias
    raw = df.groupBy(*(by or [])).agg(n(hit & bad)("tp"), n(hit & ~bad)("fp"), n(~hit & bad)("fn"), n(~hit & ~bad)("tn"), F.sum(F.when(~hit & bad, F.col("amount")).otherwise(0.0)).alias("lost"), F.sum(F.when(hit & bad, F.col("amount")).otherwise(0.0)).alias("caught"))
    return rates(raw).withColumn("cost", REVIEW * F.col("fp") + F.col("lost"))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def grid_counts(df: DataFrame, grid: DataFrame, score: str = "score") -> DataFrame:
    """tp, fp, missed amount for each threshold ``thr`` of a grid of at most a few hundred rows.

    A row is put in the slot of the greatest threshold it reaches and slots are
    cumulated: work follows rows plus grid, not their product.
    """
    table = grid.agg(F.sort_array(F.collect_set("thr")).alias("g"))
    placed = df.crossJoin(F.broadcast(table)).withColumn("slot", F.size(F.filter("g", lambda x: x <= F.col(score))))
    per = placed.groupBy("slot").agg(F.sum("is_fraud").cast("long").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_fraud") == 1, F.col("amount")).otherwise(0.0)).alias("a"))
    slots = table.select(F.posexplode("g").alias("i", "thr"), F.size("g").alias("m"))
    w = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    every = slots.select((F.col("i") + 1).alias("slot"), "thr").unionByName(slots.limit(1).select(F.lit(0).alias("slot"), F.lit(None).cast("double").alias("thr")))
    full = every.join(F.broadcast(per), "slot", "left").select("slot", "thr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "n", "a")])
    total = full.agg(F.sum("p").alias("tp_all"), F.sum("a").alias("a_all"))
    cum = full.select("slot", "thr", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("hits"), F.sum("a").over(w).alias("caught"))
    return rates(cum.crossJoin(F.broadcast(total)).filter("slot > 0").select("thr", "tp", (F.col("hits") - F.col("tp")).alias("fp"), (F.col("tp_all") - F.col("tp")).alias("fn"), (F.col("a_all") - F.col("caught")).alias("lost")))
