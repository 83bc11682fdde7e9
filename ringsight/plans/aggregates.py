"""Queries: ring and KPI aggregates, metrics, thresholds, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators import features as X
from ringsight.operators import metrics as M
from ringsight.operators import rings as R
from ringsight.operators import views as V
from ringsight.plans.base import ADDR, DEV, SPEC, query
from ringsight.plans.federated import RATES
from ringsight.plans.rowwise import DISP, INR, R4, disputes, in_ring, rings, rows, split, txn
from ringsight.session import staged

FLAG = "score_mean >= 0.35::DOUBLE"


def divided(a, b):
    """a / b of counts as doubles: infinite, or not a number, where b is 0."""
    return F.when(b != 0, a / b).when(b == 0, F.when(a > 0, float("inf")).otherwise(float("nan")))


def ring_sql(by: str, table: str) -> str:
    return f"SELECT {by}, txns, members, cards, accounts, merchants, round(score_mean, 9) AS score_mean, round(score_max, 9) AS score_max, round(hot_share, 9) AS hot_share, round(amount, 4) AS amount, frauds, frauds >= 2 AS is_fraud_ring, round(span_h, 9) AS span_h FROM {table}"


def ring_figures(r, by):
    return r.select(*by, "txns", "members", "cards", "accounts", "merchants", *[R4(c).alias(c) for c in ("score_mean", "score_max", "hot_share")], F.round("amount", 4).alias("amount"), "frauds", (F.col("frauds") >= 2).alias("is_fraud_ring"), R4("span_h").alias("span_h"))


@query(ring_sql("kind, key, day", "ring"))
def ring_agg(spark, d):
    return ring_figures(R.ring_agg(rows(spark, d)), R.DAILY)


#: Rings of a key over a whole split.
WHOLE = (
    "wr AS (SELECT split, kind, key, count(*) AS txns, count(DISTINCT member) AS members, count(DISTINCT card1) AS cards, count(DISTINCT account) AS accounts, count(DISTINCT merchant) AS merchants, avg(score) AS score_mean, max(score) AS score_max,"
    " avg(CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS hot_share, sum(amount) AS amount, min(t) AS t0, max(t) AS t1, CAST(sum(is_fraud) AS BIGINT) AS frauds, greatest((max(t) - min(t)) / 3600, 1.0::DOUBLE / 60) AS span_h"
    " FROM rr JOIN (SELECT txn_id, split FROM sp) x USING (txn_id) GROUP BY ALL)"
)


@query(ring_sql("split, kind, key", "wr"), WHOLE)
def ring_agg_whole(spark, d):
    """Rings of each key over its split, whatever the day."""
    by = ("split", *R.WHOLE)
    return ring_figures(R.ring_agg(R.ring_rows(split(spark, d)), by=by), by)


LIVE = (
    "xs AS (SELECT *, shop AS merchant, CASE WHEN txn_id % 5 = 0 THEN 'live' ELSE 'replay' END AS source, is_fraud = 1 AND txn_id % 2 = 0 AS disputed FROM txn WHERE t >= (SELECT max(t) FROM txn) - 604800),"
    f" lr AS (SELECT *, 'device' AS kind, {DEV} AS key, account AS member FROM xs WHERE {SPEC} UNION ALL SELECT *, 'address', {ADDR}, card1 FROM xs WHERE {ADDR} IS NOT NULL UNION ALL SELECT *, 'card', CAST(card1 AS VARCHAR), account FROM xs WHERE source = 'live')"
)


@query(
    "SELECT kind, key, count(*) AS size, count(DISTINCT member) AS members, count(DISTINCT card1) AS cards, count(DISTINCT merchant) AS merchants, round(avg(score), 9) AS score_mean, round(max(score), 9) AS score_max, round(sum(amount), 4) AS amount, min(t) AS t0, max(t) AS t1,"
    " count(*) FILTER (WHERE is_fraud = 1) AS frauds, count(*) FILTER (WHERE disputed) AS disputed, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS source, avg(score) >= 0.35::DOUBLE AS flagged FROM lr GROUP BY 1, 2 HAVING count(DISTINCT member) BETWEEN 2 AND 25",
    LIVE,
)
def rings_live(spark, d):
    """Device, address and live card rings over the trailing week, whatever the day."""
    g = R.live_rings(R.with_source(txn(spark, d)))
    return g.select("kind", "key", "size", "members", "cards", "merchants", R4("score_mean").alias("score_mean"), R4("score_max").alias("score_max"), F.round("amount", 4).alias("amount"), "t0", "t1", "frauds", "disputed", "source", "flagged")


def live(before: int = 0) -> str:
    """SQL tables lr, lg and lw: rows and rings of the live window, by default up to the latest row."""
    return LIVE.replace("(SELECT max(t) FROM txn) - 604800", f"(SELECT max(t) FROM txn) - {before} - 604800 AND t <= (SELECT max(t) FROM txn) - {before}")


_LG = "SELECT kind, key, count(*) AS size, count(DISTINCT member) AS members, avg(score) AS score_mean, min(t) AS t0, max(t) AS t1, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS source, avg(score) >= 0.35::DOUBLE AS flagged FROM lr GROUP BY ALL HAVING count(DISTINCT member) BETWEEN 2 AND 25"
LW = LIVE + f", lw AS ({_LG})"
_WORST = "ORDER BY round(score_mean, 9) DESC, kind, key"


def live_window(spark, d):
    return staged(R.live_rings(R.with_source(txn(spark, d))), "live")


@query(f"SELECT kind, key, size, source FROM (SELECT * FROM lw WHERE flagged AND source = 'mixed' AND kind = 'address' {_WORST} LIMIT 500)", LW)
def list_rings_live(spark, d):
    """Flagged address rings of both sources."""
    return V.rings(live_window(spark, d), flagged=True, kind="address", source="mixed", limit=600).select("kind", "key", "size", "source")


@query(f"SELECT row_number() OVER ({_WORST}) AS rank, kind, key, size, members, round(score_mean, 9) AS score_mean FROM (SELECT * FROM lw WHERE flagged {_WORST} LIMIT 12)", LW)
def list_rings_ranked(spark, d):
    return V.ranked_rings(live_window(spark, d)).select("rank", "kind", "key", "size", "members", R4("score_mean").alias("score_mean"))


def worst_ring(spark, d):
    held = live_window(spark, d)
    first = V.ranked_rings(held, 1).first()
    return held, (first["kind"], first["key"]) if first else ("", "")


@query(
    f"SELECT kind, key, row_number() OVER (ORDER BY t, txn_id) AS n, t, txn_id, round(score, 9) AS score, round(greatest((t1 - t0) / 3600, 1.0::DOUBLE / 60), 9) AS window_hours FROM lr JOIN (SELECT kind, key, t0, t1 FROM lw WHERE flagged {_WORST} LIMIT 1) w USING (kind, key) ORDER BY t, txn_id LIMIT 40", LW,
)
def ring_detail_worst(spark, d):
    """The payments of the ring of rank 1."""
    held, ring = worst_ring(spark, d)
    x = R.with_source(txn(spark, d))
    clock = x.agg((F.max("t") - 604800).alias("_m"))
    rows = R.live_rows(x.crossJoin(F.broadcast(clock)).filter("t >= _m"))
    return V.ring_detail(held, rows, ring).withColumns({"score": R4("score"), "window_hours": R4("window_hours")})


_ANY = f"SELECT *, 'device' AS kind, {DEV} AS key FROM lx WHERE {SPEC} UNION ALL SELECT *, 'address', {ADDR} FROM lx WHERE {ADDR} IS NOT NULL UNION ALL SELECT *, 'card', CAST(card1 AS VARCHAR) FROM lx WHERE source = 'live'"


@query(f"SELECT txn_id, t, source, flagged FROM (SELECT x.* FROM ({_ANY}) x JOIN (SELECT kind, key FROM lw WHERE flagged {_WORST} LIMIT 1) w USING (kind, key)) ORDER BY t DESC, txn_id DESC LIMIT 100", LW + ", lx AS (SELECT *, CASE WHEN txn_id % 5 = 0 THEN 'live' ELSE 'replay' END AS source, score >= 0.5::DOUBLE AS flagged FROM txn)")
def list_transactions_of_ring(spark, d):
    """The newest payments of the ring of rank 1, whenever they were."""
    return V.transactions(R.with_source(txn(spark, d)), ring=worst_ring(spark, d)[1]).select("txn_id", "t", "source", "flagged")


@query("SELECT txn_id, t FROM txn WHERE txn_id % 5 = 0 AND NOT coalesce(score >= 0.5::DOUBLE, false) ORDER BY t DESC, txn_id DESC LIMIT 1000")
def list_transactions_live(spark, d):
    """Live payments that are not flagged; what is wanted over the most is not shown."""
    return V.transactions(R.with_source(txn(spark, d)), flagged=False, source="live", limit=5_000).select("txn_id", "t")


def _snapshot(name: str, before: int) -> str:
    return live(before).replace("xs AS", f"xs{name} AS").replace("lr AS", f"lr{name} AS").replace("FROM xs", f"FROM xs{name}") + f", lw{name} AS ({_LG.replace('FROM lr', f'FROM lr{name}')})"


NEWLY = _snapshot("0", 0) + ", " + _snapshot("1", 86400) + ", nf AS (SELECT * FROM lw0 WHERE flagged AND (kind, key) NOT IN (SELECT (kind, key) FROM lw1 WHERE flagged))"


def newly_flagged(spark, d):
    x = R.with_source(txn(spark, d))
    return R.newly_flagged(R.live_rings(x), R.live_rings(x, 86400))


@query("SELECT kind, key, t1 AS t, members, round(score_mean, 9) AS score_mean FROM nf", NEWLY)
def new_ring_alerts(spark, d):
    """Rings flagged in the week up to now and not in the week up to a day ago."""
    return newly_flagged(spark, d).select("kind", "key", F.col("t1").alias("t"), "members", R4("score_mean").alias("score_mean"))


ALERTS = NEWLY + ", al AS (SELECT t, 'txn' AS kind, CAST(txn_id AS VARCHAR) AS subject, score FROM txn WHERE score >= 0.5::DOUBLE UNION ALL SELECT t1, 'ring', kind || '|' || key, score_mean FROM nf)"


def all_alerts(spark, d):
    return V.alert_table(txn(spark, d), newly_flagged(spark, d).withColumnRenamed("t1", "t"))


@query("SELECT t, kind, subject, round(score, 9) AS score FROM (SELECT * FROM al ORDER BY t DESC, kind DESC, subject LIMIT 50)", ALERTS)
def list_alerts(spark, d):
    return V.alerts(all_alerts(spark, d)).withColumn("score", R4("score"))


@query("SELECT t, kind, subject, round(score, 9) AS score FROM (SELECT * FROM al WHERE kind = 'ring' ORDER BY t DESC, subject LIMIT 500)", ALERTS)
def list_alerts_of_rings(spark, d):
    return V.alerts(all_alerts(spark, d), kind="ring", limit=10_000).withColumn("score", R4("score"))


@query("SELECT kind, key, day, txns, merchants, frauds, round(risk_est, 9) AS risk_est FROM exact")
def exact_ring_stats(spark, d):
    b = K.risk_bucket(F.col("score"))
    mid = F.element_at(F.array(*[F.lit(x) for x in K.MIDS]), b + 1)
    return rows(spark, d).groupBy("kind", "key", "day").agg(F.count(F.lit(1)).alias("txns"), F.count_distinct("merchant").alias("merchants"), F.sum("is_fraud").cast("long").alias("frauds"), R4(F.avg(mid)).alias("risk_est"))


@query("SELECT kind, count(*) AS rings, count(*) FILTER (WHERE frauds >= 2) AS fraud_rings, count(*) FILTER (WHERE frauds >= 2 AND merchants >= 2) AS cross_merchant, count(*) FILTER (WHERE frauds >= 2 AND merchants = 1) AS single_merchant FROM win GROUP BY 1")
def ring_census(spark, d):
    bad = F.col("frauds") >= 2
    return rings(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("rings"), F.count_if(bad).alias("fraud_rings"), F.count_if(bad & (F.col("merchants") >= 2)).alias("cross_merchant"), F.count_if(bad & (F.col("merchants") == 1)).alias("single_merchant"))


@query("SELECT card1 % 8 AS merchant, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds, round(avg(is_fraud), 9) AS rate FROM txn GROUP BY 1")
def merchant_summary(spark, d):
    return txn(spark, d).withColumn("merchant", K.merchant()).groupBy("merchant").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("long").alias("frauds"), R4(F.avg("is_fraud")).alias("rate"))


CONF = "conf AS (SELECT split, count(*) FILTER (WHERE h AND b) AS tp, count(*) FILTER (WHERE h AND NOT b) AS fp, count(*) FILTER (WHERE NOT h AND b) AS fn, count(*) FILTER (WHERE NOT h AND NOT b) AS tn, coalesce(sum(amount) FILTER (WHERE NOT h AND b), 0) AS lost, coalesce(sum(amount) FILTER (WHERE h AND b), 0) AS caught FROM (SELECT *, score >= 0.5::DOUBLE AS h, is_fraud = 1 AS b FROM sp) GROUP BY 1)"


@query("SELECT split, tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(lost, 4) AS lost, round(caught, 4) AS caught FROM conf", CONF)
def confusion_at(spark, d):
    c = M.confusion(split(spark, d), F.lit(0.5), ["split"])
    return c.select("split", "tp", "fp", "fn", "tn", *[R4(x).alias(x) for x in ("precision", "recall", "f1")], F.round("lost", 4).alias("lost"), F.round("caught", 4).alias("caught"))


@query("SELECT split, round(3.0 * fp + lost, 4) AS cost FROM conf", CONF)
def expected_cost(spark, d):
    return M.confusion(split(spark, d), F.lit(0.5), ["split"]).select("split", F.round("cost", 4).alias("cost"))


def shares(low: float, high: float, n: int) -> list[float]:
    return [low + i * (high - low) / (n - 1) for i in range(n)]


VAL_GRID, TEST_GRID = shares(0.80, 0.99995, 400), shares(0.80, 0.99995, 200)


def quant(table: str, column: str, points: list[float], where: str) -> str:
    """SQL of the distinct quantiles of a column."""
    return f"SELECT DISTINCT unnest(quantile_cont({column}, {points!r})) AS thr FROM {table} WHERE {where}"


def grid_sql(split_: str, points: list[float], name: str) -> str:
    at = lambda c: f"count(*) FILTER (WHERE {c})"
    return (
        f"{name}g AS ({quant('sp', 'score', points, f"split = '{split_}'")}), {name} AS (SELECT thr, {at('score >= thr AND is_fraud = 1')} AS tp, {at('score >= thr AND is_fraud = 0')} AS fp, {at('score < thr AND is_fraud = 1')} AS fn,"
        f" coalesce(sum(amount) FILTER (WHERE score < thr AND is_fraud = 1), 0) AS lost FROM sp, {name}g WHERE split = '{split_}' GROUP BY 1)"
    )


GC, TC = grid_sql("val", VAL_GRID, "gc"), grid_sql("test", TEST_GRID, "tc")


def score_grid(spark, rows, points):
    """Counts at the distinct quantiles of the rows' scores."""
    s = rows.select("score", "is_fraud", "amount")
    grid = [(q,) for q in sorted(set(M.quantiles(s, "score", points))) if q is not None]
    return M.grid_counts(s, spark.createDataFrame(grid, "thr double"))


def val_grid(spark, d):
    return score_grid(spark, split(spark, d).filter("split = 'val'"), VAL_GRID)


@query("SELECT round(thr, 9) AS thr, tp, fp, fn, round(lost, 4) AS lost FROM gc", GC)
def threshold_grid_join(spark, d):
    """400 quantiles of the val scores."""
    return val_grid(spark, d).select(R4("thr").alias("thr"), "tp", "fp", "fn", F.round("lost", 4).alias("lost"))


def cheapest(grid):
    """thr and cost of the least cost, the least threshold of equals."""
    best = grid.agg(F.min(F.struct(F.round(M.REVIEW * F.col("fp") + F.col("lost"), 4).alias("cost"), "thr")).alias("b"))
    return best.select("b.thr", "b.cost")


@query("SELECT round(thr, 9) AS thr, round(3.0 * fp + lost, 4) AS cost FROM gc ORDER BY round(3.0 * fp + lost, 4), thr LIMIT 1", GC)
def cost_optimal_threshold(spark, d):
    return cheapest(val_grid(spark, d)).select(R4("thr").alias("thr"), "cost")


@query(
    "SELECT round(thr, 9) AS thr, round(3.0 * fp + lost, 4) AS cost, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, tp + fp AS flagged, round(idle, 4) AS do_nothing, round(1 - (3.0 * fp + lost) / idle, 9) AS reduction"
    " FROM tc, (SELECT sum(amount) AS idle FROM sp WHERE split = 'test' AND is_fraud = 1)",
    TC,
)
def cost_curve(spark, d):
    """Costs at 200 quantiles of the test scores against doing nothing."""
    test = split(spark, d).filter("split = 'test'")
    idle = test.filter("is_fraud = 1").agg(F.sum("amount").alias("idle"))
    cost = M.REVIEW * F.col("fp") + F.col("lost")
    g = score_grid(spark, test, TEST_GRID).crossJoin(F.broadcast(idle))
    return g.select(R4("thr").alias("thr"), F.round(cost, 4).alias("cost"), R4("precision").alias("precision"), R4("recall").alias("recall"), (F.col("tp") + F.col("fp")).alias("flagged"), F.round("idle", 4).alias("do_nothing"), R4(1 - cost / F.col("idle")).alias("reduction"))


TARGETS = (0.5, 0.8, 0.9)
RECALL = "rc AS (SELECT target, max(score) AS thr FROM (SELECT score, sum(p) OVER (ORDER BY score DESC) AS c, sum(p) OVER () AS a FROM (SELECT score, sum(is_fraud) AS p FROM sp WHERE split = 'val' GROUP BY 1)), (SELECT unnest([0.5, 0.8, 0.9]::DOUBLE[]) AS target) WHERE c >= target * a GROUP BY 1)"


def recall_thresholds(val):
    """target, thr: the highest threshold with that recall."""
    c = staged(M.prefix_sums(M.by_score(val), "score", ["pos"]), "cumulated")
    a = c.agg(F.max("cum_pos").alias("a"))
    hit = lambda t: F.max(F.when(F.col("cum_pos") >= t * F.col("a"), F.col("score")))
    one = c.crossJoin(F.broadcast(a)).agg(*[hit(t).alias(f"t{i}") for i, t in enumerate(TARGETS)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias("thr")) for i, t in enumerate(TARGETS)])))


@query("SELECT target, round(thr, 9) AS thr FROM rc", RECALL)
def threshold_for_recall(spark, d):
    return recall_thresholds(split(spark, d).filter("split = 'val'")).select("target", R4("thr").alias("thr"))


@query("SELECT round(sum(p * c / (c + m)) / sum(p), 9) AS pr_auc FROM (SELECT p, sum(p) OVER w AS c, sum(n) OVER w AS m FROM (SELECT score, sum(is_fraud) AS p, sum(1 - is_fraud) AS n FROM txn GROUP BY 1) WINDOW w AS (ORDER BY score DESC))")
def pr_auc(spark, d):
    return M.pr_auc(txn(spark, d)).select(R4("pr_auc").alias("pr_auc"))


@query("SELECT round(sum(p * (m - n / 2.0)) / (sum(p) * sum(n)), 9) AS roc_auc FROM (SELECT p, n, sum(n) OVER (ORDER BY score) AS m FROM (SELECT score, CAST(sum(is_fraud) AS DOUBLE) AS p, CAST(sum(1 - is_fraud) AS DOUBLE) AS n FROM txn GROUP BY 1))")
def roc_auc(spark, d):
    return M.roc_auc(txn(spark, d)).select(R4("roc_auc").alias("roc_auc"))


RE = f"re AS (SELECT kind, count(*) FILTER (WHERE {FLAG} AND frauds >= 2) AS tp, count(*) FILTER (WHERE {FLAG} AND frauds < 2) AS fp, count(*) FILTER (WHERE NOT {FLAG} AND frauds >= 2) AS fn FROM win GROUP BY kind)"
PRF = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"


def ring_confusion(r, by):
    hit, bad = F.col("score_mean") >= 0.35, F.col("frauds") >= 2
    return r.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn")) if by is None else r.groupBy(by).agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"))


def rounded_rates(df):
    return M.rates(df).withColumns({c: R4(c) for c in ("precision", "recall", "f1")})


@query(f"SELECT kind, tp, fp, fn, {PRF} FROM re", RE)
def ring_eval(spark, d):
    return rounded_rates(ring_confusion(rings(spark, d), "kind"))


@query(f"SELECT coalesce(kind, 'combined') AS kind, tp, fp, fn, {PRF} FROM (SELECT kind, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn FROM re GROUP BY ROLLUP (kind))", RE)
def kind_rollup(spark, d):
    """By kind and together; without rings all figures together are 0."""
    return rounded_rates(and_combined(ring_confusion(rings(spark, d), "kind")))


def and_combined(counts):
    """``counts`` by kind, a row each, with their sums as kind 'combined': noughts where there is no kind."""
    per = staged(counts, "kinds")
    names = [c for c in per.columns if c != "kind"]
    return per.unionByName(per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn("kind", F.lit("combined")))


@query(f"SELECT tp, fp, fn, {PRF} FROM (SELECT CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn FROM re)", RE)
def set_precision_recall(spark, d):
    """Counts of all rings and their rates; without rings all are 0."""
    return rounded_rates(ring_confusion(rings(spark, d), None))


RING_VAL, RING_TEST = shares(0.3, 0.999, 300), shares(0.3, 0.999, 120)
KINDS = ("address", "device")
F1 = "round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9)"


def _ring_grid(name: str, split_: str, grid: str, rv: str = "rv") -> str:
    return f"{name} AS (SELECT kind, thr, count(*) FILTER (WHERE score >= thr AND bad) AS tp, count(*) FILTER (WHERE score >= thr AND NOT bad) AS fp, count(*) FILTER (WHERE score < thr AND bad) AS fn FROM {grid} LEFT JOIN (SELECT * FROM {rv} WHERE split = '{split_}') USING (kind) GROUP BY ALL)"


RT = (
    "rv AS (SELECT split, kind, key, day, round(avg(score), 9) AS score, sum(is_fraud) >= 2 AS bad FROM rr JOIN (SELECT txn_id, split FROM sp WHERE split <> 'train') x USING (txn_id) GROUP BY ALL HAVING count(DISTINCT member) BETWEEN 2 AND 25), "
    + ", ".join(f"{n} AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, thr FROM ({quant('rv', 'score', pts, f"split = '{sp}' AND kind = '{k}'")})" for k in KINDS) + ")" for n, sp, pts in (("gv", "val", RING_VAL), ("gt", "test", RING_TEST)))
    + ", " + _ring_grid("rv1", "val", "gv") + f", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {F1} DESC, thr) AS o FROM rv1) WHERE o = 1), " + _ring_grid("rt1", "test", "best") + ", " + _ring_grid("rt2", "test", "gt")
)


@query(" UNION ALL ".join(f"SELECT kind, '{part}' AS part, round(thr, 9) AS thr, tp, fp, fn, {F1} AS f1 FROM {t}" for part, t in (("val", "best"), ("test", "rt1"), ("curve", "rt2"))), RT)
def ring_tune(spark, d):
    """Per kind the best F1 over 300 quantiles of the val rings' means, that threshold on test, and a curve of 120 test quantiles.

    Rings are counted per grid slot and slots cumulated.
    """
    rows = R.ring_rows(split(spark, d).filter("split <> 'train'"))
    g = R.in_window(rows.groupBy("split", "kind", "key", "day").agg(F.count_distinct("member").alias("members"), R4(F.avg("score")).alias("score"), (F.sum("is_fraud") >= 2).cast("int").alias("is_fraud")))
    base = staged(g.select("split", "kind", "score", "is_fraud", F.lit(0.0).alias("amount")), "rings")
    out = None
    for kind in KINDS:
        val, test = (base.filter(f"split = '{s}' and kind = '{kind}'") for s in ("val", "test"))
        f1 = R4("f1").alias("f1")
        best = staged(score_grid(spark, val, RING_VAL).agg(F.max(F.struct(f1, (-F.col("thr")).alias("m"), "tp", "fp", "fn")).alias("b")).filter("b is not null").select((-F.col("b.m")).alias("thr"), "b.tp", "b.fp", "b.fn", "b.f1"), "best")
        parts = {"val": best, "test": M.grid_counts(test, best.select("thr")), "curve": score_grid(spark, test, RING_TEST)}
        for part, table in parts.items():
            one = table.select(F.lit(kind).alias("kind"), F.lit(part).alias("part"), R4("thr").alias("thr"), "tp", "fp", "fn", f1)
            out = one if out is None else out.unionByName(one)
    return out


def best_f1(spark, val):
    """thr of the best F1 over 300 quantiles of the rings' means; the least of equals. No row without rings."""
    best = score_grid(spark, val, RING_VAL).agg(F.max(F.struct(R4("f1").alias("f1"), (-F.col("thr")).alias("m"))).alias("b"))
    return best.filter("b is not null").select((-F.col("b.m")).alias("thr"))


TUNED = (
    WHOLE + ", rw AS (SELECT split, kind, key, round(score_mean, 9) AS score, frauds >= 2 AS bad FROM wr WHERE split <> 'train' AND members BETWEEN 2 AND 25), gw AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, thr FROM ({quant('rw', 'score', RING_VAL, f"split = 'val' AND kind = '{k}'")})" for k in KINDS) + "), " + _ring_grid("rw1", "val", "gw", "rw")
    + f", bw AS (SELECT kind, thr FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {F1} DESC, thr) AS o FROM rw1) WHERE o = 1)"
    ", fw AS (SELECT kind, key, bad, score >= thr AS hit FROM rw JOIN bw USING (kind) WHERE split = 'test'), te AS (SELECT * FROM sp WHERE split = 'test')"
    ", mw AS (SELECT rr.kind, txn_id, rr.score, is_fraud, hit FROM rr SEMI JOIN te USING (txn_id) JOIN fw USING (kind, key))"
    ", cw AS (SELECT kind, count(*) FILTER (WHERE is_fraud = 1) AS frauds, count(*) FILTER (WHERE is_fraud = 1 AND hit) AS covered, count(*) FILTER (WHERE is_fraud = 1 AND hit AND score < 0.5::DOUBLE) AS bonus FROM mw GROUP BY 1"
    " UNION ALL SELECT 'combined', count(DISTINCT txn_id) FILTER (WHERE is_fraud = 1), count(DISTINCT txn_id) FILTER (WHERE is_fraud = 1 AND hit), count(DISTINCT txn_id) FILTER (WHERE is_fraud = 1 AND hit AND score < 0.5::DOUBLE) FROM mw)"
    ", ew AS (SELECT coalesce(kind, 'combined') AS kind, count(*) AS groups, count(*) FILTER (WHERE bad) AS fraud_rings, count(*) FILTER (WHERE hit) AS flagged, count(*) FILTER (WHERE hit AND bad) AS tp, count(*) FILTER (WHERE hit AND NOT bad) AS fp, count(*) FILTER (WHERE bad AND NOT hit) AS fn FROM fw GROUP BY ROLLUP (kind))"
)


@query(
    f"SELECT ew.*, {PRF}, round(thr, 9) AS thr, frauds, covered, bonus, round(covered / (SELECT sum(is_fraud) FROM te), 9) AS share_of_frauds, round((SELECT count(*) FILTER (WHERE score >= 0.5::DOUBLE) FROM te) / greatest(flagged, 1), 9) AS reduction FROM ew JOIN cw USING (kind) LEFT JOIN bw USING (kind)",
    TUNED,
)
def ring_report(spark, d):
    """Rings of each key over the test rows, flagged at the val threshold of their kind: counts, frauds in them, covered and below their own threshold, and transaction alerts for each ring alert; by kind and together."""
    s = staged(split(spark, d).filter("split <> 'train'"), "later")
    rows = staged(R.ring_rows(s).select("split", "kind", "key", "t", "txn_id", "score", "is_fraud", "amount", "card1", "account", "merchant"), "rows")
    rings = R.in_window(R.ring_agg(rows, by=("split", *R.WHOLE)))
    rings = staged(rings.select("split", "kind", "key", R4("score_mean").alias("score"), (F.col("frauds") >= 2).cast("int").alias("is_fraud"), F.lit(0.0).alias("amount")), "rings")
    thr = None
    for kind in KINDS:
        one = best_f1(spark, rings.filter(f"split = 'val' and kind = '{kind}'")).withColumn("kind", F.lit(kind))
        thr = one if thr is None else thr.unionByName(one)
    thr = staged(thr, "thresholds")  # a row for a kind
    bad = F.col("is_fraud") == 1
    flagged = staged(rings.filter("split = 'test'").join(F.broadcast(thr), "kind").select("kind", "key", bad.alias("bad"), (F.col("score") >= F.col("thr")).alias("hit")), "flagged")
    n = lambda c, name: F.count_if(c).alias(name)
    hit, of = F.col("hit"), F.col("bad")
    counts = and_combined(flagged.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), n(of, "fraud_rings"), n(hit, "flagged"), n(hit & of, "tp"), n(hit & ~of, "fp"), n(of & ~hit, "fn")))
    held = staged(rows.filter("split = 'test'").select("kind", "key", "txn_id", "score", bad.alias("f")).filter("f").join(flagged.select("kind", "key", "hit").hint("merge"), ["kind", "key"]), "held")
    told = [F.count(F.lit(1)).alias("frauds"), n(hit, "covered"), n(hit & (F.col("score") < 0.5), "bonus")]
    covered = held.groupBy("kind").agg(*told).unionByName(held.groupBy("txn_id").agg(F.max("hit").alias("hit"), F.max("score").alias("score")).agg(*told).withColumn("kind", F.lit("combined")))
    whole = s.filter("split = 'test'").agg(F.sum("is_fraud").alias("_f"), n(F.col("score") >= 0.5, "_a"))
    out = rounded_rates(counts).join(F.broadcast(covered), "kind", "left").join(F.broadcast(thr), "kind", "left").crossJoin(F.broadcast(whole))  # three rows
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("frauds", "covered", "bonus")})  # a kind's rings may hold no fraud
    return out.select(*counts.columns, "precision", "recall", "f1", R4("thr").alias("thr"), "frauds", "covered", "bonus", R4(divided(F.col("covered"), F.col("_f"))).alias("share_of_frauds"), R4(F.col("_a") / F.greatest("flagged", F.lit(1))).alias("reduction"))


@query(f"SELECT a.n AS txn_alerts, r.n AS ring_alerts, f.n AS frauds, c.n AS covered, round(a.n / r.n, 9) AS reduction FROM (SELECT count(*) AS n FROM txn WHERE score >= 0.5::DOUBLE) a, (SELECT count(*) AS n FROM win WHERE {FLAG}) r, (SELECT count(*) AS n FROM txn WHERE is_fraud = 1) f, (SELECT count(*) AS n FROM txn JOIN inr USING (txn_id) WHERE is_fraud = 1) c", INR)
def alert_reduction(spark, d):
    """Transaction alerts for each ring alert; infinite where no ring is flagged, not a number where there is no alert at all."""
    x = txn(spark, d)
    a = x.agg(F.count_if(F.col("score") >= 0.5).alias("txn_alerts"), F.count_if(F.col("is_fraud") == 1).alias("frauds"))
    r = rings(spark, d).agg(F.count_if(F.col("score_mean") >= 0.35).alias("ring_alerts"))
    c = x.filter("is_fraud = 1").join(in_ring(spark, d).hint("merge"), "txn_id", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    return a.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c)).select("txn_alerts", "ring_alerts", "frauds", "covered", R4(divided(F.col("txn_alerts"), F.col("ring_alerts"))).alias("reduction"))


CLOCK = "(SELECT (max(t) // 86400) * 86400 FROM txn)"


@query(
    f"SELECT a.*, r.*, x.*, round(txns / (SELECT count(*) FROM txn), 9) AS progress FROM (SELECT count(*) AS txns, CAST(sum(is_fraud) AS BIGINT) AS frauds, count(*) FILTER (WHERE score >= 0.5::DOUBLE) AS flagged, count(*) FILTER (WHERE score >= 0.5::DOUBLE AND is_fraud = 1) AS true_positives,"
    f" round(avg(is_fraud) FILTER (WHERE score >= 0.5::DOUBLE), 9) AS precision FROM txn WHERE t < {CLOCK}) a, (SELECT count(*) AS rings, count(*) FILTER (WHERE {FLAG}) AS rings_flagged FROM win WHERE t1 < {CLOCK}) r,"
    f" (SELECT count(*) AS disputes, count(*) FILTER (WHERE w) AS disputes_flagged, round(coalesce(sum(greatest((dt - t) / 3600, 0)) FILTER (WHERE w), 0) / greatest(count(*) FILTER (WHERE w), 1), 6) AS lead_h FROM (SELECT dt, t, score >= 0.5::DOUBLE OR inr.txn_id IS NOT NULL AS w FROM disp JOIN txn USING (txn_id) LEFT JOIN inr USING (txn_id) WHERE dt < {CLOCK})) x",
    DISP + ", " + INR,
)
def kpi_summary(spark, d):
    """Figures as of the start of the feed's last day: what came before it, rings that ended before it, disputes raised before it."""
    hit, x = F.col("score") >= 0.5, txn(spark, d)
    clock = staged(x.agg((F.floor(F.max("t") / 86400) * 86400).alias("clock"), F.count(F.lit(1)).alias("all")), "clock")
    before = lambda df, t: df.crossJoin(F.broadcast(clock)).filter(F.col(t) < F.col("clock"))
    a = before(x, "t").agg(F.count(F.lit(1)).alias("txns"), F.sum("is_fraud").cast("long").alias("frauds"), F.count_if(hit).alias("flagged"), F.count_if(hit & (F.col("is_fraud") == 1)).alias("true_positives"), R4(F.avg(F.when(hit, F.col("is_fraud")))).alias("precision"))
    r = before(rings(spark, d), "t1").agg(F.count(F.lit(1)).alias("rings"), F.count_if(F.col("score_mean") >= 0.35).alias("rings_flagged"))
    warned = (F.col("score") >= 0.5) | F.col("r").isNotNull()
    j = before(disputes(spark, d), "dt").join(x.select("txn_id", "t", "score"), "txn_id").join(in_ring(spark, d).withColumn("r", F.lit(True)).hint("merge"), "txn_id", "left")
    lead = F.sum(F.when(warned, F.greatest((F.col("dt") - F.col("t")) / 3600, F.lit(0.0))))
    q = j.agg(F.count(F.lit(1)).alias("disputes"), F.count_if(warned).alias("disputes_flagged"), F.round(F.coalesce(lead, F.lit(0.0)) / F.greatest(F.count_if(warned), F.lit(1)), 6).alias("lead_h"))
    return a.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(q)).crossJoin(F.broadcast(clock)).select(*a.columns, *r.columns, *q.columns, R4(F.col("txns") / F.col("all")).alias("progress"))


@query("SELECT round(median(v), 6) AS med, round(mad(v), 6) AS mad FROM (SELECT card1 % 8 AS m, CAST(sum(amount) AS DOUBLE) AS v FROM txn GROUP BY 1)")
def median_mad(spark, d):
    v = txn(spark, d).withColumn("m", K.merchant()).groupBy("m").agg(F.sum("amount").alias("v"))
    med = v.agg(F.percentile("v", F.lit(0.5)).alias("med"))
    return v.crossJoin(F.broadcast(med)).agg(F.round(F.first("med"), 6).alias("med"), F.round(F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)), 6).alias("mad"))


@query("SELECT txn_id, t - lag(t) OVER (PARTITION BY account ORDER BY t, txn_id) AS gap FROM txn")
def gap_seconds(spark, d):
    return X.velocity(txn(spark, d), "account").select("txn_id", "gap")


@query("SELECT txn_id, count(*) OVER a AS n_24h, count(*) OVER b AS n_7d, round(coalesce(sum(amount) OVER a, 0), 4) AS sum_24h, round(avg(amount) OVER a, 6) AS mean_24h FROM txn WINDOW a AS (PARTITION BY card1 ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY card1 ORDER BY t RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)")
def velocity_24h_7d(spark, d):
    return X.velocity(txn(spark, d), "card1").select("txn_id", "n_24h", "n_7d", F.round("sum_24h", 4).alias("sum_24h"), F.round("mean_24h", 6).alias("mean_24h"))


@query("SELECT txn_id, CAST(coalesce(sum(f) OVER (PARTITION BY card1 ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS card_addrs FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY card1, addr1 ORDER BY t, txn_id) = 1 THEN 1 ELSE 0 END AS f FROM txn)")
def cum_distinct_fanout(spark, d):
    return X.fanout(txn(spark, d), "card1", "addr1", "card_addrs").select("txn_id", "card_addrs")


FOLD = "fo AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY t, txn_id) - 1) * 5 / count(*) OVER ()) AS BIGINT) AS fold FROM sp WHERE split = 'train')"


@query("SELECT txn_id, fold FROM fo", FOLD)
def oof_time_folds(spark, d):
    return X.folds(split(spark, d).filter("split = 'train'").select("txn_id", "t", "is_fraud", "card1")).select("txn_id", "fold")


OOF = FOLD + ", ow AS (SELECT card1, fold, sum(is_fraud) AS fr, count(*) AS cnt FROM fo GROUP BY ALL), ot AS (SELECT card1, sum(is_fraud) AS fr, count(*) AS cnt FROM fo GROUP BY ALL)"


@query("SELECT card1, fold, round((ot.fr - ow.fr + 20 * 0.035::DOUBLE) / (ot.cnt - ow.cnt + 20), 9) AS rate, round(ln(1 + ot.cnt - ow.cnt), 9) AS log_n, CASE WHEN ot.cnt > ow.cnt THEN 1 ELSE 0 END AS seen FROM ow JOIN ot USING (card1)", OOF)
def oof_reputation(spark, d):
    tr = X.folds(split(spark, d).filter("split = 'train'").select("txn_id", "t", "is_fraud", "card1"))
    return X.reputation(tr, "card1").select("card1", "fold", R4("rate").alias("rate"), R4("log_n").alias("log_n"), "seen")


@query("SELECT txn_id, round(coalesce((fr + 20 * 0.035::DOUBLE) / (cnt + 20), 0.035::DOUBLE), 9) AS rate FROM sp LEFT JOIN (SELECT card1, sum(is_fraud) AS fr, count(*) AS cnt FROM sp WHERE split = 'train' GROUP BY 1) USING (card1) WHERE split = 'test'")
def reputation_lookup(spark, d):
    s = split(spark, d)
    per = s.filter("split = 'train'").groupBy("card1").agg(F.sum("is_fraud").alias("fr"), F.count(F.lit(1)).alias("cnt"))
    return s.filter("split = 'test'").join(per.select("card1", *X.smoothed()).hint("merge"), "card1", "left").select("txn_id", R4(F.coalesce("rate", F.lit(X.PRIOR))).alias("rate"))


PEERS = "peers AS (SELECT txn_id, (SELECT count(DISTINCT p.account) FROM txn p WHERE p.card1 = x.card1 AND (p.t BETWEEN x.t - 3600 AND x.t - 1 OR p.txn_id = x.txn_id)) AS accounts, (SELECT count(DISTINCT p.shop) FROM txn p WHERE p.card1 = x.card1 AND p.t BETWEEN x.t - 3600 AND x.t - 1) AS merchants, (SELECT count(DISTINCT p.card1) FROM txn p WHERE p.account = x.account AND (p.t BETWEEN x.t - 3600 AND x.t - 1 OR p.txn_id = x.txn_id)) AS cards FROM txn x)"


@query("SELECT txn_id, CAST(accounts AS INT) AS accounts, CAST(merchants AS INT) AS merchants, CAST(cards AS INT) AS cards FROM peers", PEERS)
def shared_entity_velocity(spark, d):
    return X.hour_peers(txn(spark, d)).select("txn_id", "accounts", "merchants", "cards")


@query(
    "SELECT txn_id, round(least(s, 0.99::DOUBLE), 9) AS rule_score, concat_ws(',', CASE WHEN rate IS NOT NULL THEN 'email' END, CASE WHEN txn_id % 2 = 0 THEN 'international' END, CASE WHEN amount < 3 AND amount <> 0 THEN 'tiny' END, CASE WHEN amount > 2000 THEN 'large' END, CASE WHEN accounts >= 2 THEN 'accounts' END, CASE WHEN merchants >= 2 THEN 'merchants' END, CASE WHEN cards >= 2 THEN 'cards' END) AS reasons FROM (SELECT txn_id, rate, amount, accounts, merchants, cards, 0.05::DOUBLE + CASE WHEN rate IS NOT NULL THEN 0.15::DOUBLE + 0.25::DOUBLE * rate ELSE 0 END + CASE WHEN txn_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN amount < 3 AND amount <> 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN amount > 2000 THEN 0.1::DOUBLE ELSE 0 END"
    " + CASE WHEN accounts >= 2 THEN 0.25::DOUBLE + 0.08::DOUBLE * least(accounts - 2, 4) ELSE 0 END + CASE WHEN merchants >= 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN cards >= 2 THEN 0.25::DOUBLE + 0.08::DOUBLE * least(cards - 2, 4) ELSE 0 END AS s"
    " FROM (SELECT *, CASE email_domain WHEN 'protonmail.com' THEN 0.41 WHEN 'mail.com' THEN 0.19 WHEN 'outlook.es' THEN 0.13 WHEN 'aim.com' THEN 0.13 WHEN 'outlook.com' THEN 0.09 WHEN 'hotmail.es' THEN 0.07 WHEN 'live.com.mx' THEN 0.05 END::DOUBLE AS rate FROM txn) JOIN peers USING (txn_id))",
    PEERS,
)
def rules_score(spark, d):
    x = X.hour_peers(txn(spark, d)).withColumn("international", F.col("txn_id") % 2 == 0)
    return X.rules_score(x).select("txn_id", R4("rule_score").alias("rule_score"), "reasons")


AT = "(SELECT count(*) FILTER (WHERE score >= thr AND is_fraud = 1) AS tp, count(*) FILTER (WHERE score >= thr AND is_fraud = 0) AS fp, count(*) FILTER (WHERE score < thr AND is_fraud = 1) AS fn, coalesce(sum(amount) FILTER (WHERE score < thr AND is_fraud = 1), 0) AS lost, name FROM sp, pts WHERE split = 'test' GROUP BY name)"
_PR = "SELECT split, sum(p * c / (c + m)) / sum(p) AS v FROM (SELECT split, p, sum(p) OVER w AS c, sum(n) OVER w AS m FROM (SELECT split, score, sum(is_fraud) AS p, sum(1 - is_fraud) AS n FROM sp WHERE split <> 'train' GROUP BY 1, 2) WINDOW w AS (PARTITION BY split ORDER BY score DESC)) GROUP BY 1"
_ROC = "SELECT split, sum(p * (m - n / 2.0)) / (sum(p) * sum(n)) AS v FROM (SELECT split, p, n, sum(n) OVER (PARTITION BY split ORDER BY score) AS m FROM (SELECT split, score, CAST(sum(is_fraud) AS DOUBLE) AS p, CAST(sum(1 - is_fraud) AS DOUBLE) AS n FROM sp WHERE split <> 'train' GROUP BY 1, 2)) GROUP BY 1"
REPORT = (
    GC + ", " + RECALL + ", pts AS (SELECT 'operating' AS name, thr FROM (SELECT thr FROM gc ORDER BY round(3.0 * fp + lost, 4), thr LIMIT 1) UNION ALL SELECT 'recall_' || CAST(CAST(round(target * 100) AS INT) AS VARCHAR), thr FROM rc)"
    f", att AS (SELECT name, thr, tp, fp, fn, lost, (SELECT sum(amount) FROM sp WHERE split = 'test' AND is_fraud = 1) AS idle FROM {AT} x JOIN pts USING (name))"
    f", lines AS (SELECT 'rows' AS section, split AS name, count(*)::DOUBLE AS value FROM sp GROUP BY 2 UNION ALL SELECT 'fraud_rate', split, avg(is_fraud) FROM sp GROUP BY 2 UNION ALL SELECT 'pr_auc', split, v FROM ({_PR}) UNION ALL SELECT 'roc_auc', split, v FROM ({_ROC})"
    + "".join(f" UNION ALL SELECT name, '{n}', {e} FROM att" for n, e in (("threshold", "thr"), ("precision", RATES["precision"]), ("recall", RATES["recall"]), ("f1", RATES["f1"]), ("cost", "3.0 * fp + lost"), ("do_nothing", "idle"), ("reduction", "1 - (3.0 * fp + lost) / idle")))
    + ")"
)


def report_lines(spark, d):
    """section, name, value: rows and fraud rates, areas under the curves, and test figures at the threshold that costs least on val and at those of given recalls on val."""
    s = staged(split(spark, d).select("split", "score", "is_fraud", "amount"), "scored")
    val, test = s.filter("split = 'val'"), s.filter("split = 'test'")
    lines = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("is_fraud").alias("r"))
    out = lines.select(F.inline(F.array(F.struct(F.lit("rows").alias("section"), F.col("split").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.lit("fraud_rate").alias("section"), F.col("split").alias("name"), F.col("r").alias("value")))))
    for name, part in (("val", val), ("test", test)):
        out = out.unionByName(M.pr_auc(part).select(F.lit("pr_auc").alias("section"), F.lit(name).alias("name"), F.col("pr_auc").alias("value")))
        out = out.unionByName(M.roc_auc(part).select(F.lit("roc_auc").alias("section"), F.lit(name).alias("name"), F.col("roc_auc").alias("value")))
    points = cheapest(score_grid(spark, val, VAL_GRID)).select(F.lit("operating").alias("section"), "thr")
    points = staged(points.unionByName(recall_thresholds(val).select(F.concat(F.lit("recall_"), F.round(F.col("target") * 100).cast("int")).alias("section"), "thr")), "points")
    idle = test.filter("is_fraud = 1").agg(F.sum("amount").alias("idle"))
    cost = M.REVIEW * F.col("fp") + F.col("lost")
    at = points.join(F.broadcast(M.grid_counts(test, points.select("thr").distinct())), "thr").crossJoin(F.broadcast(idle))  # four rows
    values = {"threshold": F.col("thr"), "precision": F.col("precision"), "recall": F.col("recall"), "f1": F.col("f1"), "cost": cost, "do_nothing": F.col("idle"), "reduction": 1 - cost / F.col("idle")}
    return out.unionByName(at.select("section", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()]))))


@query("SELECT section, name, round(value, 6) AS value FROM lines", REPORT)
def scorer_report(spark, d):
    return report_lines(spark, d).withColumn("value", F.round("value", 6))
