"""Queries: scans, projections, filters, joins, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators import rings as R
from ringsight.operators import views as V
from ringsight.operators.metrics import quantiles
from ringsight.plans.base import ADDR, BUCKET, DEV, SPEC, hmac_sql, query
from ringsight.session import staged
from ringsight.sources import tables as S

R4 = lambda c: F.round(c, 9)


def txn(spark, d):
    return S.transactions(spark, d)


def split(spark, d):
    return S.temporal_split(txn(spark, d))


def rows(spark, d):
    return R.ring_rows(txn(spark, d))


def rings(spark, d):
    return R.in_window(R.ring_agg(rows(spark, d)))


@query("SELECT txn_id, t, amount, card1, account, addr1, device_info FROM txn")
def scan_parquet(spark, d):
    return txn(spark, d).select("txn_id", "t", "amount", "card1", "account", "addr1", "device_info")


@query("SELECT txn_id, t, amount FROM txn ORDER BY t, txn_id LIMIT 500")
def scan_pruned_capped(spark, d):
    return txn(spark, d).select("txn_id", "t", "amount").orderBy("t", "txn_id").limit(500)


DISP = "disp AS (SELECT 'd' || txn_id AS dispute_id, txn_id, t + 7200 + (txn_id % 5) * 3600 AS dt, CASE WHEN txn_id % 4 = 0 THEN NULL ELSE CAST(txn_id % 1000 AS BIGINT) END AS amount_minor FROM txn WHERE is_fraud = 1)"


@query(
    "SELECT 'payment.captured' AS event, 'pay_' || txn_id AS id, NULL AS payment_id, CAST(round(amount * 100) AS BIGINT) AS amount_minor, 'm' || (card1 % 8) AS merchant FROM txn"
    " UNION ALL SELECT 'payment.dispute.created', dispute_id, 'pay_' || txn_id, amount_minor, NULL FROM disp",
    DISP,
)
def scan_events_json(spark, d):
    """Payments and disputes out of one feed of bodies; disputes stand under either of two names."""
    x = S.payment_events(S.payment_json(txn(spark, d)).unionByName(S.dispute_json(disputes(spark, d))))
    pay, dis = F.col("payment"), F.col("dispute")
    return x.select("event", F.coalesce(pay["id"], dis["id"]).alias("id"), dis["payment_id"].alias("payment_id"), F.coalesce(pay["amount"], dis["amount"]).alias("amount_minor"), pay["notes"]["merchant"].alias("merchant"))


@query(
    "SELECT 'pay_' || txn_id AS id, round(CAST(round(amount * 100) AS BIGINT) / 100.0, 2) AS amount, '+91' || account AS account, 'm' || (card1 % 8) AS merchant, txn_id % 2 = 0 AS international, email_domain AS domain,"
    " CASE WHEN txn_id % 3 = 0 THEN 'upi' ELSE 'Visa|credit|last4:' || lpad(CAST(card1 % 10000 AS VARCHAR), 4, '0') END AS card, 'rzp|' || email_domain || '|+91' || account AS addr_key FROM txn"
)
def payment_normalize(spark, d):
    p = S.payment_events(S.payment_json(txn(spark, d))).select("payment.*")
    dom = K.email_domain(F.col("email"))
    return p.select(
        "id", F.round(F.col("amount") / 100, 2).alias("amount"), F.coalesce("contact", "email").alias("account"), F.col("notes")["merchant"].alias("merchant"), (F.lower("card.international") == "true").alias("international"),
        dom.alias("domain"), K.card_identity("card", "method").alias("card"), F.concat(F.lit("rzp|"), dom, F.lit("|"), "contact").alias("addr_key"),
    )


@query("SELECT txn_id, CAST((t // 3600) % 24 AS BIGINT) AS hour, CAST((t // 86400) % 7 AS BIGINT) AS weekday FROM txn")
def time_features(spark, d):
    return txn(spark, d).select("txn_id", F.pmod(F.floor(F.col("t") / 3600), F.lit(24)).cast("long").alias("hour"), F.pmod(F.floor(F.col("t") / 86400), F.lit(7)).cast("long").alias("weekday"))


@query("SELECT txn_id, CASE WHEN email_domain IN (SELECT email_domain FROM sp WHERE split = 'train') THEN email_domain END AS email_domain, CASE WHEN device_info IN (SELECT device_info FROM sp WHERE split = 'train') THEN device_info END AS device_info, CAST(NULL AS DOUBLE) AS absent FROM sp WHERE split <> 'train'")
def feature_transform(spark, d):
    """Levels that train has not are null; a feature that the rows lack is null."""
    s = split(spark, d)
    out = s.filter("split <> 'train'")
    for c in ("email_domain", "device_info"):
        known = s.filter("split = 'train'").select(F.col(c)).distinct().withColumn("_k", F.lit(1))
        out = out.join(known.hint("merge"), c, "left").withColumn(c, F.when(F.col("_k") == 1, F.col(c))).drop("_k")
    return out.select("txn_id", "email_domain", "device_info", F.lit(None).cast("double").alias("absent"))


@query("SELECT txn_id, card1 || '|' || coalesce(CAST(addr1 AS VARCHAR), 'n') || '|' || coalesce(device_info, 'n') AS key FROM txn")
def composite_key(spark, d):
    return txn(spark, d).select("txn_id", K.composite_key("card1", "addr1", "device_info").alias("key"))


@query(f"SELECT txn_id, t // 86400 AS day, card1 || '|' || coalesce(CAST(addr1 AS VARCHAR), 'n') || '|' || coalesce(CAST(CASE WHEN txn_id % 6 > 0 THEN account % 60 END - t // 86400 AS VARCHAR), 'n') AS uid, CAST(card1 AS VARCHAR) AS card_id, {DEV} AS device_id, coalesce(email_domain, 'n') || '|' || coalesce(CAST(addr1 AS VARCHAR), 'n') AS emailaddr_id FROM txn")
def entity_keys(spark, d):
    """An account is a card, an address and the day on which its age was nought, from the card's age ``d1`` in days."""
    x = txn(spark, d).withColumn("d1", F.when(F.col("txn_id") % 6 > 0, F.col("account") % 60 + 0.25))
    return x.select("txn_id", K.day().alias("day"), K.account_key("card1", "addr1").alias("uid"), K.composite_key("card1").alias("card_id"), K.device_key().alias("device_id"), K.composite_key("email_domain", "addr1").alias("emailaddr_id"))


@query(f"SELECT txn_id, {SPEC} AS specific FROM txn")
def specific_device(spark, d):
    return txn(spark, d).select("txn_id", K.specific_device(F.col("device_info")).alias("specific"))


@query(f"SELECT txn_id, {ADDR} AS addr_key FROM txn")
def address_key(spark, d):
    return txn(spark, d).select("txn_id", K.address_key().alias("addr_key"))


@query("SELECT txn_id, CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS hot FROM txn")
def hot_flag(spark, d):
    return txn(spark, d).select("txn_id", (F.col("score") >= 0.5).cast("int").alias("hot"))


@query("SELECT txn_id, nullif(email_domain, '') AS domain FROM txn")
def email_domain(spark, d):
    return txn(spark, d).select("txn_id", K.email_domain(F.concat(F.lit("U@x@"), F.upper("email_domain"))).alias("domain"))


@query("SELECT txn_id, CASE WHEN txn_id % 3 = 0 THEN 'upi' ELSE 'Visa|credit|last4:' || lpad(CAST(card1 % 10000 AS VARCHAR), 4, '0') END AS card FROM txn")
def card_identity(spark, d):
    p = S.payment_events(S.payment_json(txn(spark, d))).select("payment.*")
    return p.select(F.substr("id", F.lit(5)).cast("long").alias("txn_id"), K.card_identity("card", "method").alias("card"))


@query("SELECT txn_id, card1 % 8 AS merchant FROM txn")
def merchant_partition(spark, d):
    return txn(spark, d).select("txn_id", K.merchant().alias("merchant"))


@query(f"SELECT txn_id, {BUCKET} AS bucket FROM txn")
def risk_bucket(spark, d):
    return txn(spark, d).select("txn_id", K.risk_bucket(F.col("score")).alias("bucket"))


@query("SELECT kind, fp, round(risk_est, 9) AS risk_est FROM fsum")
def risk_estimate(spark, d):
    from ringsight.operators import privacy as P

    return P.federated_sum(P.merchant_hist(rows(spark, d))).select("kind", "fp", R4("risk_est").alias("risk_est"))


@query(f"SELECT txn_id, {hmac_sql(b'k', 'device_info')}[1:16] AS fp FROM txn WHERE device_info IS NOT NULL")
def fingerprint_hmac(spark, d):
    return txn(spark, d).filter("device_info is not null").select("txn_id", F.substr(K.hmac_sha256(b"k", F.col("device_info")), F.lit(1), F.lit(16)).alias("fp"))


@query(f"SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN false ELSE true END AS valid FROM txn WHERE {hmac_sql(b'k', 'CAST(txn_id AS VARCHAR)')} IS NOT NULL")
def signature_check(spark, d):
    """A fifth of the given signatures is wrong, another row's."""
    mac = lambda c: K.hmac_sha256(b"k", c.cast("string"))
    given = txn(spark, d).select("txn_id", F.when(F.col("txn_id") % 5 == 0, mac(F.col("txn_id") + 1)).otherwise(mac(F.col("txn_id"))).alias("signature"))
    return given.select("txn_id", F.coalesce(mac(F.col("txn_id")) == F.col("signature"), F.lit(False)).alias("valid"))


IMPUTED = ("addr1", "addr2", "amount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(m, 9) AS median, round(avg(x), 9) AS mean, round(CASE WHEN stddev_pop(x) <= 1e-9 THEN 1 ELSE stddev_pop(x) END, 9) AS std FROM (SELECT m, coalesce({c}, m) AS x FROM sp, (SELECT median({c}) AS m FROM sp WHERE split = 'train') WHERE split = 'train') GROUP BY m" for c in IMPUTED))
def fit_impute_scale(spark, d):
    """Median, and mean and population deviation after filling, of every column: fitted on train in one pass after the medians."""
    train = split(spark, d).filter("split = 'train'").select(*[F.col(c).cast("double").alias(c) for c in IMPUTED])
    mid = {c: quantiles(train, c, [0.5])[0] for c in IMPUTED}
    x = train.fillna({c: m for c, m in mid.items() if m is not None})
    got = x.agg(*[f(c).alias(f"{c}_{n}") for c in IMPUTED for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    std = lambda c: F.when(F.col(f"{c}_s") <= 1e-9, 1.0).otherwise(F.col(f"{c}_s"))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), R4(F.lit(mid[c]).cast("double")).alias("median"), R4(f"{c}_m").alias("mean"), R4(std(c)).alias("std")) for c in IMPUTED])
    return got.select(F.inline(each))


@query("SELECT txn_id, round(coalesce(c / n, 0), 6) AS freq FROM sp LEFT JOIN (SELECT device_info, count(*) AS c FROM sp WHERE split = 'train' AND device_info IS NOT NULL GROUP BY 1) USING (device_info), (SELECT count(device_info) AS n FROM sp WHERE split = 'train')")
def frequency_encode(spark, d):
    s = split(spark, d)
    train = s.filter("split = 'train' and device_info is not null")
    n = train.agg(F.count(F.lit(1)).alias("n"))
    share = train.groupBy("device_info").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("device_info", (F.col("c") / F.col("n")).alias("f"))
    return s.join(share.hint("merge"), "device_info", "left").select("txn_id", F.round(F.coalesce("f", F.lit(0.0)), 6).alias("freq"))


@query("SELECT txn_id, round(CASE WHEN txn_id % 7 = 0 OR txn_id % 11 = 0 THEN 0 ELSE amount END, 9) AS amount FROM txn")
def finite_guard(spark, d):
    odd = F.when(F.col("txn_id") % 7 == 0, float("nan")).when(F.col("txn_id") % 11 == 0, float("-inf")).otherwise(F.col("amount"))
    return txn(spark, d).select("txn_id", R4(K.finite(odd)).alias("amount"))


@query(
    "SELECT *, coalesce(t0 >= lag(t1) OVER (ORDER BY t0), true) AS after_last, sum(n) OVER () = (SELECT count(*) FROM txn) AS complete FROM (SELECT split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds, round(100 * avg(is_fraud), 9) AS fraud_pct, min(t) // 86400 AS first_day, max(t) // 86400 AS last_day, min(t) AS t0, max(t) AS t1 FROM sp GROUP BY 1)"
)
def split_report(spark, d):
    """Figures of the splits; after_last: none of its rows is before a row of the split before; complete: the splits hold every row once."""
    day = lambda c: F.floor(c / 86400).cast("long")
    per = split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("long").alias("frauds"), R4(100 * F.avg("is_fraud")).alias("fraud_pct"), day(F.min("t")).alias("first_day"), day(F.max("t")).alias("last_day"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    whole = txn(spark, d).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1))  # three rows
    out = staged(per, "report").crossJoin(F.broadcast(whole))
    return out.select(*per.columns, F.coalesce(F.col("t0") >= F.lag("t1").over(w.orderBy("t0")), F.lit(True)).alias("after_last"), (F.sum("n").over(w) == F.col("_n")).alias("complete"))


@query("SELECT kind, day, kind || ' ring ' || key[1:48] || ': ' || members || ' members, ' || txns || ' payments' AS summary FROM win")
def alert_text(spark, d):
    return rings(spark, d).select("kind", "day", F.format_string("%s ring %s: %d members, %d payments", "kind", F.substr("key", F.lit(1), F.lit(48)), "members", "txns").alias("summary"))


@query("SELECT txn_id, split FROM sp")
def temporal_split(spark, d):
    return split(spark, d).select("txn_id", "split")


@query("SELECT txn_id, t, amount FROM txn WHERE score >= 0.5::DOUBLE ORDER BY t DESC, txn_id DESC LIMIT 200")
def list_transactions(spark, d):
    return V.transactions(R.with_source(txn(spark, d)), flagged=True, limit=200).select("txn_id", "t", "amount")


@query("SELECT kind, key, day, txns, round(score_mean, 9) AS score_mean FROM win WHERE score_mean >= 0.35::DOUBLE AND kind = 'device' ORDER BY ring_order.o LIMIT 100".replace("ORDER BY ring_order.o", "ORDER BY round(win.score_mean, 9) DESC, kind, key, day"))
def list_rings(spark, d):
    table = rings(spark, d).withColumn("flagged", F.col("score_mean") >= 0.35)
    return V.rings(table, flagged=True, kind="device").select("kind", "key", "day", "txns", R4("score_mean").alias("score_mean"))


@query("SELECT txn_id, t FROM txn WHERE t >= (SELECT max(t) FROM txn) - 604800")
def trailing_window(spark, d):
    x = txn(spark, d)
    m = x.agg(F.max("t").alias("m"))
    return x.crossJoin(F.broadcast(m)).filter("t >= m - 604800").select("txn_id", "t")


@query("SELECT kind, key, day, members FROM win")
def ring_window_filter(spark, d):
    return rings(spark, d).select("kind", "key", "day", "members")


@query("SELECT kind, key, day, merchants >= 2 AND score_mean >= 0.35::DOUBLE AS flagged FROM win")
def flag_rule(spark, d):
    return rings(spark, d).select("kind", "key", "day", ((F.col("merchants") >= 2) & (F.col("score_mean") >= 0.35)).alias("flagged"))


@query("SELECT txn_id, i.device_info AS id_device, i.browser AS id_browser FROM txn LEFT JOIN ident i USING (txn_id)")
def join_identity(spark, d):
    x = txn(spark, d)
    i = S.identity(x).select("txn_id", F.col("device_info").alias("id_device"), F.col("browser").alias("id_browser"))
    return x.select("txn_id").join(i, "txn_id", "left")


@query("SELECT round(avg(CASE WHEN i.txn_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM txn LEFT JOIN ident i USING (txn_id)")
def identity_coverage(spark, d):
    x = txn(spark, d)
    i = S.identity(x).select("txn_id", F.lit(1).alias("has"))
    return x.select("txn_id").join(i, "txn_id", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0))), 6).alias("coverage"))


@query("SELECT count(DISTINCT txn_id) AS n, count(DISTINCT txn_id) FILTER (WHERE is_fraud = 1) AS frauds, count(DISTINCT txn_id) FILTER (WHERE is_fraud = 1 AND score < 0.5::DOUBLE) AS bonus FROM rr SEMI JOIN (SELECT kind, key, day FROM win WHERE score_mean >= 0.35::DOUBLE) f USING (kind, key, day)")
def ring_members_semi(spark, d):
    f = rings(spark, d).filter("score_mean >= 0.35D").select("kind", "key", "day")
    m = rows(spark, d).join(f.hint("merge"), ["kind", "key", "day"], "left_semi").groupBy("txn_id").agg(F.max("is_fraud").alias("f"), F.max("score").alias("s"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") == 1).alias("frauds"), F.count_if((F.col("f") == 1) & (F.col("s") < 0.5)).alias("bonus"))


OVERLAP = ("card1", "addr1", "email_domain", "device_info")


@query(" UNION ALL ".join(f"SELECT '{c}' AS key, round(avg(CASE WHEN {c} IN (SELECT {c} FROM sp WHERE split = 'train') THEN 1 ELSE 0 END), 6) AS share FROM sp WHERE split = 'test' AND {c} IS NOT NULL" for c in OVERLAP))
def key_overlap(spark, d):
    """Share of test rows whose key train has, for all keys in one pass."""
    s = split(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("v")) for c in OVERLAP]))
    kv = s.select("split", each.alias("x")).select("split", "x.*").filter("v is not null")
    per = kv.groupBy("key", "v").agg(F.max((F.col("split") == "train").cast("int")).alias("seen"), F.count_if(F.col("split") == "test").alias("n"))
    return per.groupBy("key").agg(F.round(F.sum(F.col("seen") * F.col("n")) / F.sum("n"), 6).alias("share"))


@query("SELECT txn_id, CASE email_domain WHEN 'protonmail.com' THEN 0.41 WHEN 'mail.com' THEN 0.19 WHEN 'outlook.es' THEN 0.13 WHEN 'aim.com' THEN 0.13 WHEN 'outlook.com' THEN 0.09 WHEN 'hotmail.es' THEN 0.07 WHEN 'live.com.mx' THEN 0.05 END::DOUBLE AS rate FROM txn")
def domain_risk_lookup(spark, d):
    from ringsight.operators.features import DOMAIN_RISK

    dim = spark.createDataFrame(list(DOMAIN_RISK.items()), "email_domain string, rate double")
    return txn(spark, d).join(F.broadcast(dim), "email_domain", "left").select("txn_id", "rate")


@query("SELECT txn_id FROM txn WHERE txn_id % 3 = 0 AND txn_id % 2 = 1")
def dedup_ingest(spark, d):
    """Deliveries of every third row, twice; the even ones are stored already."""
    x = txn(spark, d).filter("txn_id % 3 = 0").select("txn_id")
    return x.union(x).distinct().join(x.filter("txn_id % 2 = 0"), "txn_id", "left_anti")


@query("SELECT kind, key, day, txn_id, n, round(span_h, 9) AS window_hours FROM (SELECT *, row_number() OVER (PARTITION BY kind, key, day ORDER BY t, txn_id) AS n FROM rr JOIN win USING (kind, key, day)) WHERE n <= 40")
def ring_detail(spark, d):
    w = Window.partitionBy("kind", "key", "day").orderBy("t", "txn_id")
    j = rows(spark, d).select("kind", "key", "day", "t", "txn_id").join(rings(spark, d).select("kind", "key", "day", "span_h").hint("merge"), ["kind", "key", "day"])
    return j.withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 40").select("kind", "key", "day", "txn_id", "n", R4("span_h").alias("window_hours"))


def disputes(spark, d):
    x = txn(spark, d).filter("is_fraud = 1")
    return x.select(F.concat(F.lit("d"), "txn_id").alias("dispute_id"), "txn_id", (F.col("t") + 7200 + (F.col("txn_id") % 5) * 3600).alias("dt"), F.when(F.col("txn_id") % 4 != 0, F.col("txn_id") % 1000).cast("long").alias("amount_minor"))


@query("SELECT dispute_id, txn_id, dt FROM disp ORDER BY dt DESC, txn_id LIMIT 100", DISP)
def list_disputes(spark, d):
    return V.disputes(disputes(spark, d), 100).select("dispute_id", "txn_id", "dt")


@query("SELECT dispute_id, txn_id, dt FROM disp", DISP)
def list_disputes_all(spark, d):
    return V.disputes(disputes(spark, d)).select("dispute_id", "txn_id", "dt")


INR = "inr AS (SELECT DISTINCT txn_id FROM rr SEMI JOIN (SELECT kind, key, day FROM win WHERE score_mean >= 0.35::DOUBLE) f USING (kind, key, day))"


def in_ring(spark, d):
    f = rings(spark, d).filter("score_mean >= 0.35D").select("kind", "key", "day")
    return rows(spark, d).join(f.hint("merge"), ["kind", "key", "day"], "left_semi").select("txn_id").distinct()


@query("SELECT dispute_id, txn_id, round(coalesce(amount_minor / 100.0, amount), 2) AS amount, score >= 0.5::DOUBLE OR inr.txn_id IS NOT NULL AS was_flagged FROM disp JOIN txn USING (txn_id) LEFT JOIN inr USING (txn_id)", DISP + ", " + INR)
def dispute_enrich(spark, d):
    j = disputes(spark, d).join(txn(spark, d).select("txn_id", "amount", "score"), "txn_id").join(in_ring(spark, d).withColumn("r", F.lit(True)).hint("merge"), "txn_id", "left")
    return j.select("dispute_id", "txn_id", F.round(F.coalesce(F.col("amount_minor") / 100, "amount"), 2).alias("amount"), ((F.col("score") >= 0.5) | F.coalesce("r", F.lit(False))).alias("was_flagged"))


@query("SELECT dispute_id, txn_id, CASE WHEN txn_id % 2 = 0 THEN 'won' ELSE 'open' END AS status FROM disp", DISP)
def dispute_status_update(spark, d):
    """Each dispute is opened; even ones are won later: the last status stands."""
    x = disputes(spark, d)
    ev = x.select("dispute_id", "txn_id", "dt", F.lit("open").alias("status")).unionByName(x.filter("txn_id % 2 = 0").select("dispute_id", "txn_id", (F.col("dt") + 60).alias("dt"), F.lit("won").alias("status")))
    return ev.groupBy("dispute_id", "txn_id").agg(F.max_by("status", "dt").alias("status"))


@query("SELECT dispute_id, CASE WHEN score >= 0.5::DOUBLE OR inr.txn_id IS NOT NULL THEN round(greatest((dt - t) / 3600, 0), 9) END AS lead_h FROM disp JOIN txn USING (txn_id) LEFT JOIN inr USING (txn_id)", DISP + ", " + INR)
def lead_time(spark, d):
    j = disputes(spark, d).join(txn(spark, d).select("txn_id", "t", "score"), "txn_id").join(in_ring(spark, d).withColumn("r", F.lit(True)).hint("merge"), "txn_id", "left")
    return j.select("dispute_id", F.when((F.col("score") >= 0.5) | F.coalesce("r", F.lit(False)), R4(F.greatest((F.col("dt") - F.col("t")) / 3600, F.lit(0.0)))).alias("lead_h"))


@query("SELECT d, count(*) AS n, count(DISTINCT card1) AS cards FROM txn, (SELECT DISTINCT t // 86400 AS d FROM txn) WHERE t > d * 86400 - 604800 AND t < (d + 1) * 86400 GROUP BY 1")
def day_window_join(spark, d):
    """Each row serves its own and the next seven days, one of a day's first second the next six: an equi-join on days, no theta join."""
    x = txn(spark, d).withColumn("day", K.day())
    last = F.col("day") + F.when(F.pmod("t", F.lit(86400)) > 0, 7).otherwise(6)
    per = x.groupBy("day", last.alias("last"), "card1").agg(F.count(F.lit(1)).alias("n"))
    serves = per.select("card1", "n", F.explode(F.sequence("day", "last")).alias("d")).groupBy("d", "card1").agg(F.sum("n").alias("n"))
    return serves.join(x.select(F.col("day").alias("d")).distinct().hint("merge"), "d", "left_semi").groupBy("d").agg(F.sum("n").alias("n"), F.count("card1").alias("cards"))


@query("SELECT txn_id, t FROM txn ORDER BY t, txn_id")
def sort_time(spark, d):
    return txn(spark, d).select("txn_id", "t").orderBy("t", "txn_id")


@query("SELECT txn_id, t FROM txn ORDER BY t DESC, txn_id DESC LIMIT 50")
def topk_feed(spark, d):
    return txn(spark, d).select("txn_id", "t").orderBy(F.desc("t"), F.desc("txn_id")).limit(50)


@query("SELECT kind, key, day, members, round(score_mean, 9) AS score_mean, frauds FROM win ORDER BY round(win.score_mean, 9) DESC, kind, key, day LIMIT 20")
def topk_rings(spark, d):
    return rings(spark, d).orderBy(F.desc(F.round("score_mean", 9)), "kind", "key", "day").limit(20).select("kind", "key", "day", "members", R4("score_mean").alias("score_mean"), "frauds")


@query("SELECT kind, key, day, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score_mean, 9) DESC, kind, key) AS rank FROM win WHERE score_mean >= 0.35::DOUBLE)")
def ring_rank(spark, d):
    """Rank of the flagged rings of each day."""
    w = Window.partitionBy("day").orderBy(F.desc(F.round("score_mean", 9)), "kind", "key")
    return rings(spark, d).filter("score_mean >= 0.35D").withColumn("rank", F.row_number().over(w).cast("long")).select("kind", "key", "day", "rank")


@query("SELECT txn_id, source, round(score, 6) AS score FROM (SELECT *, CASE WHEN txn_id % 5 = 0 THEN 'live' ELSE 'replay' END AS source FROM txn) x JOIN inr USING (txn_id) WHERE score >= 0.5::DOUBLE AND NOT (is_fraud = 1 AND txn_id % 2 = 0) AND (source = 'live' OR is_fraud = 1) ORDER BY source DESC, x.score DESC, txn_id LIMIT 1", INR)
def dispute_candidate(spark, d):
    """The flagged, undisputed row of a flagged ring with the highest score: frauds of the replay first, else live rows. Even frauds are disputed already."""
    x = R.with_source(txn(spark, d)).filter((F.col("score") >= 0.5) & ~F.col("disputed") & ((F.col("source") == "live") | (F.col("is_fraud") == 1)))
    return x.join(in_ring(spark, d).hint("merge"), "txn_id", "left_semi").orderBy(F.desc("source"), F.desc("score"), "txn_id").limit(1).select("txn_id", "source", F.round("score", 6).alias("score"))


@query("SELECT txn_id, split FROM sp")
def union_splits(spark, d):
    s = split(spark, d).select("txn_id", "split")
    return s.filter("split = 'train'").unionByName(s.filter("split = 'val'")).unionByName(s.filter("split = 'test'"))


def truth_and_flagged(spark, d):
    w = staged(rings(spark, d), "rings")
    k = ["kind", "key", "day"]
    return w.filter("score_mean >= 0.35D").select(*k), w.filter("frauds >= 2").select(*k)


def set_query(name, op, sql):
    def run(spark, d):
        return op(*truth_and_flagged(spark, d))

    run.__name__ = name
    a, b = "SELECT kind, key, day FROM win WHERE score_mean >= 0.35::DOUBLE", "SELECT kind, key, day FROM win WHERE frauds >= 2"
    return query(sql.format(a=a, b=b))(run)


set_tp = set_query("set_tp", lambda a, b: a.intersect(b), "({a}) INTERSECT ({b})")
set_fp = set_query("set_fp", lambda a, b: a.exceptAll(b), "({a}) EXCEPT ({b})")
set_fn = set_query("set_fn", lambda a, b: b.exceptAll(a), "({b}) EXCEPT ({a})")


@query("SELECT DISTINCT kind, fp FROM hist")
def union_fps(spark, d):
    from ringsight.operators import privacy as P

    h = P.merchant_hist(rows(spark, d)).select("merchant", "kind", "fp")
    return h.filter("merchant < 4").drop("merchant").union(h.filter("merchant >= 4").drop("merchant")).distinct()


@query("SELECT txn_id FROM inr", INR)
def union_flagged_members(spark, d):
    return in_ring(spark, d)


@query("SELECT kind, key, day, txn_id FROM rr SEMI JOIN win USING (kind, key, day)")
def ring_members(spark, d):
    return rows(spark, d).join(rings(spark, d).hint("merge"), ["kind", "key", "day"], "left_semi").select("kind", "key", "day", "txn_id")
