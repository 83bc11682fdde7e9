"""Causal features: velocity, fan-out, reputation, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.operators.metrics import prefix_sums
from ringsight.session import sized, staged

PRIOR, WEIGHT = 0.035, 20.0
#: Fraud rate of each risky email domain.
DOMAIN_RISK = {"protonmail.com": 0.41, "mail.com": 0.19, "outlook.es": 0.13, "aim.com": 0.13, "outlook.com": 0.09, "hotmail.es": 0.07, "live.com.mx": 0.05}


#: Rows of one key that a task takes in one window; keys with more are split over time.
HOT_ROWS = 1_000_000
WEEK, DAY, HOUR = 604800, 86400, 3600


def hot_keys(txn: DataFrame, key: str, hot: int) -> DataFrame | None:
    """The values of ``key`` (as _hot) with over ``hot`` rows, a null among them; None if there are none. One for ``hot`` rows at most."""
    many = staged(txn.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_hot"), "hot")
    return None if many.isEmpty() else many


def apart(txn: DataFrame, key: str, hot: int, plain, split) -> DataFrame:
    """``plain`` of the rows of ordinary keys and ``split`` of those of hot ones."""
    many = hot_keys(txn, key, hot)
    if many is None:
        return plain(txn)
    side, on = sized(many), F.col(key).eqNullSafe(F.col("_hot"))
    return plain(txn.join(side, on, "left_anti")).unionByName(split(txn.join(side, on, "left_semi")))


def in_buckets(txn: DataFrame, length: int) -> DataFrame:
    """Each row in the time bucket of its own (``_guest`` false) and, to be looked back at, in the next one (true).

    A frame no longer than a bucket sees all its rows within (key, bucket), so that a
    key of very many rows is split over time.
    """
    own = F.floor(F.col("t") / length).cast("long")
    at = F.array(F.struct(own.alias("_bucket"), F.lit(False).alias("_guest")), F.struct((own + 1).alias("_bucket"), F.lit(True).alias("_guest")))
    return txn.select("*", F.inline(at))


def _velocities(by: list[str]) -> list[Column]:
    w = lambda s: Window.partitionBy(*by).orderBy("t").rangeBetween(-s, -1)
    return [F.count(F.lit(1)).over(w(DAY)).alias("n_24h"), F.count(F.lit(1)).over(w(WEEK)).alias("n_7d"), F.coalesce(F.sum("amount").over(w(DAY)), F.lit(0.0)).alias("sum_24h"), F.avg("amount").over(w(DAY)).alias("mean_24h")]


def velocity(txn: DataFrame, key: str, hot: int = HOT_ROWS) -> DataFrame:
    """Counts and amounts over [t - W, t): rows of the same second are not before each other. ``gap`` is the time since the row before, however long. The rows of a key with over ``hot`` of them are split over weeks."""

    def plain(rows: DataFrame) -> DataFrame:
        prev = Window.partitionBy(key).orderBy("t", "txn_id")
        return rows.select(*txn.columns, (F.col("t") - F.lag("t").over(prev)).alias("gap"), *_velocities([key]))

    def split(rows: DataFrame) -> DataFrame:
        prev = Window.partitionBy(key, "_bucket").orderBy("t", "txn_id")
        seen = in_buckets(rows, WEEK).select("*", F.lag("t").over(prev).alias("_prev"), *_velocities([key, "_bucket"])).filter(~F.col("_guest"))
        # the last row of the buckets before, for rows with nothing in the bucket before theirs: a row per key and bucket
        lasts = rows.groupBy(key, F.floor(F.col("t") / WEEK).cast("long").alias("_bucket")).agg(F.max("t").alias("_t"))
        lasts = lasts.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.lag("_t").over(Window.partitionBy(key).orderBy("_bucket")).alias("_last")).filter("_last is not null")
        out = seen.join(lasts.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
        return out.select(*txn.columns, (F.col("t") - F.coalesce("_prev", "_last")).alias("gap"), "n_24h", "n_7d", "sum_24h", "mean_24h")

    return apart(txn, key, hot, plain, split)


def fanout(txn: DataFrame, key: str, value: str, name: str, length: int = WEEK, hot: int = HOT_ROWS) -> DataFrame:
    """Distinct values of ``value`` seen under ``key`` before each row; null is a value.

    Of a key with over ``hot`` rows the first row of every pair is found by an aggregate,
    first rows are counted within (key, time bucket), and those of the buckets before are
    added: no task needs all its rows. Other keys take two windows over one shuffle.
    """
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(key, value).orderBy("t", "txn_id")) == 1
        marked = rows.repartition(key).withColumn("_first", first.cast("long"))
        return marked.select(*txn.columns, F.coalesce(F.sum("_first").over(upto.partitionBy(key).orderBy("t", "txn_id")), F.lit(0)).alias(name))

    def split(rows: DataFrame) -> DataFrame:
        firsts = rows.groupBy(key, value).agg(F.min(F.struct("t", "txn_id")).alias("_f")).select("_f.txn_id", F.lit(1).alias("_first"))
        marked = rows.join(firsts.hint("merge"), "txn_id", "left").withColumns({"_first": F.coalesce("_first", F.lit(0)), "_bucket": F.floor(F.col("t") / length).cast("long")})
        marked = staged(marked.select(*txn.columns, "_first", "_bucket"), "firsts")
        per = marked.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b")).agg(F.sum("_first").alias("_n"))
        before = per.select("_k", "_b", F.coalesce(F.sum("_n").over(upto.partitionBy("_k").orderBy("_b")), F.lit(0)).alias("_before"))
        own = marked.withColumn("_own", F.coalesce(F.sum("_first").over(upto.partitionBy(key, "_bucket").orderBy("t", "txn_id")), F.lit(0)))
        out = own.join(before.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
        return out.select(*txn.columns, (F.col("_own") + F.col("_before")).alias(name))

    return apart(txn, key, hot, plain, split)


def histories(txn: DataFrame, key: str, spread: tuple[str, ...], hot: int = HOT_ROWS) -> DataFrame:
    """``velocity`` of ``key`` as {key}_{figure}, and its ``fanout`` for each value of ``spread`` as {key}_{value}s. Rows go to their key once for all of these."""
    figures = ("n_24h", "n_7d", "sum_24h", "mean_24h")

    def plain(rows: DataFrame) -> DataFrame:
        first = lambda v: F.row_number().over(Window.partitionBy(key, v).orderBy("t", "txn_id")) == 1
        marked = rows.repartition(key).withColumns({f"_first_{v}": first(v).cast("long") for v in spread})
        own = Window.partitionBy(key).orderBy("t", "txn_id")
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        fans = [F.coalesce(F.sum(f"_first_{v}").over(before), F.lit(0)).alias(f"{key}_{v}s") for v in spread]
        out = marked.select(*txn.columns, (F.col("t") - F.lag("t").over(own)).alias(f"{key}_gap"), *fans)
        return out.select("*", *_velocities([key])).withColumnsRenamed({c: f"{key}_{c}" for c in figures})  # these find the rows sorted

    def split(rows: DataFrame) -> DataFrame:
        out = velocity(staged(rows, "hot"), key, hot).withColumnsRenamed({c: f"{key}_{c}" for c in ("gap", *figures)})
        for v in spread:
            out = fanout(out, key, v, f"{key}_{v}s", hot=hot)
        return out

    return apart(txn, key, hot, plain, split)


def folds(train: DataFrame, k: int = 5) -> DataFrame:
    """``fold``: equal sequential blocks by (t, txn_id), from positions that are counted in parallel."""
    keyed = train.withColumn("_o", F.struct("t", "txn_id")).withColumn("_one", F.lit(1))
    pos = prefix_sums(keyed, "_o", ["_one"], descending=False)
    n = staged(train.agg(F.count(F.lit(1)).alias("_n")), "count")
    return pos.crossJoin(F.broadcast(n)).withColumn("fold", F.floor((F.col("cum__one") - 1) * k / F.col("_n")).cast("long")).drop("_o", "_one", "cum__one", "_n")


def fold_cuts(train: DataFrame, k: int = 5) -> list[tuple[int, int]]:
    """(t, txn_id) of the rows at which the ``folds`` but the first begin, so that a row tells its fold by itself: see ``fold_of``."""
    n = train.count()
    at = [-(-f * n // k) for f in range(1, k)]
    pos = prefix_sums(train.select(F.struct("t", "txn_id").alias("_o"), F.lit(1).alias("_one")), "_o", ["_one"], descending=False).withColumn("_at", F.col("cum__one") - 1)
    found = {r["_at"]: (r["t"], r["txn_id"]) for r in pos.filter(F.col("_at").isin(at)).select("_at", "_o.t", "_o.txn_id").collect()}
    return [found[p] for p in at if p in found]


def fold_of(cuts: list[tuple[int, int]]) -> Column:
    """The fold of a row by its t and txn_id."""
    reached = [(F.col("t") > t) | ((F.col("t") == t) & (F.col("txn_id") >= i)) for t, i in cuts]
    return sum((r.cast("long") for r in reached), F.lit(0).cast("long"))


def reputation(train: DataFrame, key: str) -> DataFrame:
    """Per (key, fold): counts of the other folds, in one pass: total less own."""
    own = train.groupBy(key, "fold").agg(F.sum("is_fraud").cast("long").alias("fr"), F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(key)
    other = own.select(key, "fold", (F.sum("fr").over(w) - F.col("fr")).alias("fr"), (F.sum("cnt").over(w) - F.col("cnt")).alias("cnt"))
    return other.select(key, "fold", *smoothed())


def smoothed() -> list[Column]:
    return [((F.col("fr") + WEIGHT * PRIOR) / (F.col("cnt") + WEIGHT)).alias("rate"), F.log1p(F.col("cnt").cast("double")).alias("log_n"), (F.col("cnt") > 0).cast("int").alias("seen")]


def hour_peers(txn: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Peers in the hour before each row: accounts and cards with this row's own, merchants (shop) without. Nulls are no peers; a row without a card or account has none by it. If a card or account has over ``hot`` rows, all are split over hours."""

    def told(rows: DataFrame, more: list[str]) -> DataFrame:
        w = lambda k: Window.partitionBy(k, *more).orderBy("t").rangeBetween(-HOUR, -1)
        seen = lambda c, k: F.collect_set(c).over(w(k))
        both = lambda c, k: F.when(F.col(k).isNull(), 0).otherwise(F.size(F.array_compact(F.array_union(seen(c, k), F.array(c)))))
        return rows.select("*", both("account", "card1").alias("accounts"), F.when(F.col("card1").isNull(), 0).otherwise(F.size(seen("shop", "card1"))).alias("merchants"), both("card1", "account").alias("cards"))

    if all(hot_keys(txn, c, hot) is None for c in ("card1", "account")):
        return told(txn, [])
    return told(in_buckets(txn, HOUR), ["_bucket"]).filter(~F.col("_guest")).drop("_guest", "_bucket")


def rules_score(df: DataFrame) -> DataFrame:
    """Rule score and reasons from email_domain, international, amount and the hour's peers. An amount of 0 is not known: no rule on amounts fires."""
    risk = F.create_map(*[F.lit(x) for kv in DOMAIN_RISK.items() for x in kv])
    rate = F.try_element_at(risk, F.col("email_domain"))
    grown = lambda c: 0.25 + 0.08 * F.least(F.col(c) - 2, F.lit(4))
    rules = [
        ("email", rate.isNotNull(), 0.15 + 0.25 * rate), ("international", F.col("international"), F.lit(0.20)), ("tiny", (F.col("amount") < 3) & (F.col("amount") != 0), F.lit(0.15)), ("large", F.col("amount") > 2000, F.lit(0.10)),
        ("accounts", F.col("accounts") >= 2, grown("accounts")), ("merchants", F.col("merchants") >= 2, F.lit(0.15)), ("cards", F.col("cards") >= 2, grown("cards")),
    ]
    score = F.lit(0.05)
    for _, hit, add in rules:
        score = score + F.when(hit, add).otherwise(0.0)
    return df.withColumn("rule_score", F.least(score, F.lit(0.99))).withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(h, n) for n, h, _ in rules])), ",")).withColumn("flagged", F.col("rule_score") >= 0.5)
