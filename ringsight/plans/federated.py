"""Queries: histograms, releases, commitments, robust updates, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators import graph as G
from ringsight.operators import metrics as M
from ringsight.operators import privacy as P
from ringsight.operators import rings as R
from ringsight.operators import sliding as C
from ringsight.plans.base import BUCKET, DEV, hmac_sql, query
from ringsight.plans.rowwise import R4, rows, split, txn
from ringsight.session import sized, staged

BS = ", ".join(f"b{i}" for i in range(5))
TOT = "b0 + b1 + b2 + b3 + b4"
S10 = "b0 + 3 * b1 + 5 * b2 + 7 * b3 + 9 * b4"
FLAGGED = f"txns BETWEEN 2 AND 40 AND merchants >= 2 AND {S10} >= 3 * ({TOT})"


def hist(spark, d):
    return P.merchant_hist(rows(spark, d))


@query(f"SELECT merchant, kind, {hmac_sql(P.SECRET, 'key')}[1:16] AS fp, " + ", ".join(f"CAST(count(*) FILTER (WHERE {BUCKET} = {i}) AS DOUBLE) AS b{i}" for i in range(5)) + " FROM rr GROUP BY ALL")
def merchant_hist_whole(spark, d):
    """Fingerprints of the shared value alone, over all days."""
    return P.merchant_hist(rows(spark, d), of=("key",))


@query(f"SELECT merchant, kind, fp, {BS} FROM hist")
def merchant_hist(spark, d):
    return hist(spark, d)


@query(f"SELECT kind, fp, {BS}, merchants, round(txns, 4) AS txns, round(risk_est, 9) AS risk_est FROM fsum")
def federated_sum(spark, d):
    return P.federated_sum(hist(spark, d)).withColumn("risk_est", R4("risk_est"))


@query("SELECT eps, round(CASE WHEN eps IS NULL OR eps <= 0 THEN 0 ELSE sqrt(2 * ln(1.25::DOUBLE / 0.00001::DOUBLE)) / eps END, 9) AS sigma FROM (SELECT CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey - 1.0 END::DOUBLE AS eps FROM nation)")
def gaussian_sigma(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.when(F.col("n_nationkey") != 0, F.col("n_nationkey") - 1.0).alias("eps"))
    return n.select("eps", R4(K.gaussian_sigma(F.col("eps"))).alias("sigma"))


def _noise(seed: str, b: int, eps: str) -> str:
    h = f"sha256({seed} || '|' || merchant || '|' || fp || '|b{b}')"
    u = lambda a, z: f"((CAST('0x' || {h}[{a}:{z}] AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)"
    sigma = f"(CASE WHEN {eps} IS NULL OR {eps} = 0 THEN 0 ELSE sqrt(2 * ln(1.25::DOUBLE / 0.00001::DOUBLE)) / {eps} END)"
    return f"greatest(0, round(b{b} + {sigma} * sqrt(-2 * ln({u(1, 12)})) * cos(2 * pi() * {u(13, 24)}))) AS b{b}"


REL = "rel AS (SELECT * FROM (SELECT merchant, kind, fp, " + ", ".join(_noise("'7'", b, "8::DOUBLE") for b in range(5)) + f" FROM hist) WHERE {TOT} >= 1)"


@query(f"SELECT merchant, kind, fp, {BS} FROM rel", REL)
def dp_release(spark, d):
    return P.dp_release(hist(spark, d), F.lit("7"), F.lit(8.0)).select("merchant", "kind", "fp", *P.B)


PADDED = (
    "pd AS (SELECT merchant, kind, fp, " + ", ".join(f"coalesce(b{i}, 0) AS b{i}" for i in range(5)) + " FROM (SELECT * FROM (SELECT DISTINCT merchant FROM hist), (SELECT DISTINCT kind, fp FROM hist)) LEFT JOIN hist USING (merchant, kind, fp)),"
    + " pr AS (SELECT * FROM (SELECT merchant, kind, fp, " + ", ".join(_noise("'7'", b, "2::DOUBLE") for b in range(5)) + f" FROM pd) WHERE {TOT} >= 1)"
)


@query(f"SELECT merchant, kind, fp, {BS} FROM pr", PADDED)
def dp_release_padded(spark, d):
    """Every merchant releases all fingerprints that any has, so that noise also covers which it has."""
    return P.dp_release(P.padded(staged(hist(spark, d), "hist")), F.lit("7"), F.lit(2.0)).select("merchant", "kind", "fp", *P.B)


FP = hmac_sql(P.SECRET, "kind || '|' || key || '|' || day") + "[1:16]"
BUCKETS = ", ".join(f"CAST(count(*) FILTER (WHERE {BUCKET} = {i}) AS DOUBLE) AS b{i}" for i in range(5))
SWEEP = (
    f"""rs AS (SELECT rr.*, x.split FROM rr JOIN (SELECT txn_id, split FROM sp WHERE split <> 'train') x USING (txn_id)),
hs AS (SELECT split, merchant, kind, {FP} AS fp, {BUCKETS} FROM rs GROUP BY ALL),
es AS (SELECT split, kind, {FP} AS fp, count(*) AS txns, count(DISTINCT merchant) AS merchants, sum(is_fraud) AS frauds, {BUCKETS} FROM rs GROUP BY ALL),
se AS (SELECT 0 AS eps, 0 AS rep, unnest(['val', 'test']) AS split UNION ALL SELECT e, r, 'test' FROM (SELECT unnest([32, 16, 8, 4, 2, 1]) AS e), (SELECT unnest(range(0, 5)) AS r)
       UNION ALL SELECT e, r, 'val' FROM (SELECT unnest([32, 16, 8, 4, 2, 1]) AS e), (SELECT unnest(range(1000, 1003)) AS r)),
nz AS (SELECT * FROM (SELECT eps, rep, split, merchant, kind, fp, """
    + ", ".join(_noise("eps || '-' || rep", b, "eps::DOUBLE") for b in range(5))
    + f""" FROM hs JOIN se USING (split)) WHERE {TOT} >= 1),
mvs AS (SELECT eps, rep, split, kind, merchant, sum({TOT}) AS volume, sum({S10}) / (10 * greatest(sum({TOT}), 1)) AS risk FROM nz GROUP BY ALL),
mds AS (SELECT eps, rep, split, kind, median(volume) AS v, median(risk) AS r, count(*) AS n FROM mvs GROUP BY ALL),
kp AS (SELECT mvs.* FROM mvs JOIN mds USING (eps, rep, split, kind) WHERE n < 3 OR NOT (volume / v > 5 OR risk / r > 2)),
fs AS (SELECT eps, rep, split, kind, fp, count(*) AS merchants, sum({TOT}) AS txns, sum({S10}) AS s10 FROM nz SEMI JOIN kp USING (eps, rep, split, kind, merchant) GROUP BY ALL),
tn AS (SELECT eps, rep, kind, fs.txns, s10, coalesce(frauds >= 2, false) AS real FROM fs LEFT JOIN es USING (split, kind, fp) WHERE split = 'val' AND fs.txns BETWEEN 2 AND 40),
tg AS (SELECT eps, rep, kind, i, count(*) FILTER (WHERE real AND 10 * s10 >= i * txns) AS tp, count(*) FILTER (WHERE NOT real AND 10 * s10 >= i * txns) AS fp, count(*) FILTER (WHERE real) AS a FROM tn, (SELECT unnest(range(10, 91)) AS i) GROUP BY ALL),
tb AS (SELECT *, row_number() OVER (PARTITION BY eps, rep, kind ORDER BY round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + a) END, 9) DESC, i) AS o FROM tg),
th AS (SELECT eps, kind, CAST(median(i) AS BIGINT) AS slot FROM tb WHERE o = 1 GROUP BY ALL),
tr AS (SELECT kind, fp FROM es WHERE split = 'test' AND frauds >= 2 AND merchants >= 2 AND txns BETWEEN 2 AND 40),
fl AS (SELECT eps, rep, kind, fp FROM fs JOIN th USING (eps, kind) WHERE split = 'test' AND merchants >= 2 AND txns BETWEEN 2 AND 40 AND 10 * s10 >= slot * txns),
ce AS (SELECT eps, rep, kind, (SELECT count(*) FROM fl WHERE fl.eps = c.eps AND fl.rep = c.rep AND fl.kind = c.kind) AS flagged, (SELECT count(*) FROM fl SEMI JOIN tr USING (kind, fp) WHERE fl.eps = c.eps AND fl.rep = c.rep AND fl.kind = c.kind) AS tp,
       (SELECT count(*) FROM tr WHERE tr.kind = c.kind) AS a FROM (SELECT eps, rep, kind FROM se, (SELECT DISTINCT kind FROM th) WHERE split = 'test') c),
ju AS (SELECT eps, rep, coalesce(kind, 'combined') AS kind, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(flagged - tp) AS BIGINT) AS fp, CAST(sum(a - tp) AS BIGINT) AS fn FROM ce GROUP BY GROUPING SETS ((eps, rep, kind), (eps, rep)))"""
)
RATES = {
    "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE",
    "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE",
    "f1": "CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE",
}


def swept(spark, d):
    return P.sweep(R.ring_rows(split(spark, d)))


@query("SELECT nullif(eps, 0) AS eps, CAST(rep AS INT) AS rep, kind, flagged, tp, fp, fn, " + ", ".join(f"round({x}, 9) AS {c}" for c, x in RATES.items()) + " FROM ju", SWEEP)
def dp_sweep(spark, d):
    """Seven budgets, five draws each, thresholds tuned on val under the same noise; figures on test."""
    out = M.rates(swept(spark, d)[0])
    return out.select(F.nullif("eps", F.lit(0)).alias("eps"), "rep", "kind", "flagged", "tp", "fp", "fn", *[R4(c).alias(c) for c in RATES])


@query("SELECT nullif(eps, 0) AS eps, kind, " + ", ".join(f"round(avg({x}), 6) AS {c}, round(stddev_pop({x}), 6) AS {c}_std" for c, x in RATES.items()) + " FROM ju GROUP BY ALL", SWEEP)
def repeat_stats(spark, d):
    """Mean and spread over the draws."""
    out = M.rates(swept(spark, d)[0]).groupBy("eps", "kind").agg(*[f(c).alias(c + e) for c in RATES for f, e in ((F.avg, ""), (F.stddev_pop, "_std"))])
    return out.select(F.nullif("eps", F.lit(0)).alias("eps"), "kind", *[F.round(c + e, 6).alias(c + e) for c in RATES for e in ("", "_std")])


LINE = "fp || ':' || " + " || ':' || ".join(f"printf('%.1f', b{i})" for i in range(5))


def commit_sql(hist: str, name: str) -> str:
    """SQL tables up to ``name`` (kind, merchant, digest): roots of trees of two levels at most."""
    ups = "sha256(string_agg(p || ':' || d, ',' ORDER BY p))"
    return (
        f"{name}0 AS (SELECT kind, merchant, CAST(count(*) > {P.LEAF} AS INT) + CAST(count(*) > {16 * P.LEAF} AS INT) AS depth FROM {hist} GROUP BY ALL),"
        f" {name}2 AS (SELECT kind, merchant, depth, fp[1:depth] AS p, sha256(string_agg({LINE}, ',' ORDER BY {LINE})) AS d FROM {hist} JOIN {name}0 USING (kind, merchant) GROUP BY ALL),"
        f" {name}1 AS (SELECT kind, merchant, p, d FROM {name}2 WHERE depth = 1 UNION ALL SELECT kind, merchant, p[1:1], {ups} FROM {name}2 WHERE depth = 2 GROUP BY kind, merchant, p[1:1]),"
        f" {name} AS (SELECT kind, merchant, d AS digest FROM {name}2 WHERE depth = 0 UNION ALL SELECT kind, merchant, {ups} FROM {name}1 GROUP BY ALL)"
    )


COMMIT = commit_sql("hist", "cm")


@query("SELECT kind, merchant, digest FROM cm", COMMIT)
def commit_hist(spark, d):
    return P.commitments(hist(spark, d))


@query("SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY merchant) - 1 AS BIGINT) AS pos, digest FROM cm", COMMIT)
def merkle_order(spark, d):
    return leaves(spark, d)


def leaves(spark, d):
    return P.merkle_leaves(staged(P.commitments(hist(spark, d)), "commitments"))


def _up(below: str) -> str:
    return f"SELECT kind, pos // 2 AS pos, sha256(from_hex(max(digest) FILTER (WHERE pos % 2 = 0) || coalesce(max(digest) FILTER (WHERE pos % 2 = 1), max(digest)))) AS digest FROM {below} GROUP BY 1, 2"


@query("SELECT kind, digest AS root FROM l3", COMMIT + f", l0 AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY merchant) - 1 AS pos, digest FROM cm), l1 AS ({_up('l0')}), l2 AS ({_up('l1')}), l3 AS ({_up('l2')})")
def merkle_root(spark, d):
    """Over eight merchants of each kind."""
    return P.merkle_root(leaves(spark, d), ("kind",))


def filter_sql(rows: str, name: str) -> str:
    """SQL tables up to ``name`` (kind, merchant, reason, ratio) of the filters over ``rows``."""
    why = lambda a, b: f"CASE WHEN n >= 3 AND volume / v > 5 THEN {a} WHEN n >= 3 AND risk / r > 2 THEN {b} END"
    return (
        f"{name}v AS (SELECT kind, merchant, sum({TOT}) AS volume, sum({S10}) / (10 * greatest(sum({TOT}), 1)) AS risk FROM {rows} GROUP BY ALL), {name}m AS (SELECT kind, median(volume) AS v, median(risk) AS r, count(*) AS n FROM {name}v GROUP BY 1),"
        f" {name} AS (SELECT kind, merchant, {why("'volume'", "'risk'")} AS reason, {why('volume / v', 'risk / r')} AS ratio FROM {name}v JOIN {name}m USING (kind))"
    )


BAD = "bad AS (SELECT merchant, kind, fp, b0, b1, b2, b3, CASE WHEN merchant = 3 AND kind = 'device' THEN b4 + 40 WHEN merchant = 6 AND kind = 'address' THEN b4 + 3 ELSE b4 END AS b4 FROM hist)"
FILTERED = BAD + ", " + filter_sql("bad", "au")
SEEN = BAD + ", seen AS (SELECT * FROM bad WHERE merchant <> 5), " + filter_sql("seen", "au")


def poisoned(spark, d):
    """Merchant 3 floods the top bucket of its devices, merchant 6 puts some rows into those of its addresses."""
    own = lambda m, k: (F.col("merchant") == m) & (F.col("kind") == k)
    return hist(spark, d).withColumn("b4", F.when(own(3, "device"), F.col("b4") + 40).when(own(6, "address"), F.col("b4") + 3).otherwise(F.col("b4")))


def changed(h):
    """Merchant 5 reveals other than it committed to."""
    return h.withColumn("b0", F.when(F.col("merchant") == 5, F.col("b0") + 1).otherwise(F.col("b0")))


@query("SELECT kind, merchant, reason IS NOT DISTINCT FROM 'volume' AS rejected FROM au", FILTERED)
def volume_outlier(spark, d):
    return P.outliers(poisoned(spark, d)).select("kind", "merchant", F.col("reason").eqNullSafe("volume").alias("rejected"))


@query("SELECT kind, merchant, reason IS NOT DISTINCT FROM 'risk' AS rejected FROM au", FILTERED)
def risk_outlier(spark, d):
    return P.outliers(poisoned(spark, d)).select("kind", "merchant", F.col("reason").eqNullSafe("risk").alias("rejected"))


@query("SELECT kind, merchant, reason, round(ratio, 6) AS ratio FROM au WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT kind, 5, 'commit', NULL FROM bad WHERE merchant = 5", SEEN)
def audit_log(spark, d):
    h = staged(poisoned(spark, d), "hist")
    return P.rejected(changed(h), P.commitments(h)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT DISTINCT kind, merchant, merchant <> 5 AS ok FROM hist")
def commit_reveal_join(spark, d):
    h = staged(hist(spark, d), "hist")
    return P.reveal_check(changed(h), P.commitments(h))


SUMMED = SEEN + f", fed AS (SELECT kind, fp, count(*) AS merchants, sum({TOT}) AS txns, {', '.join(f'sum(b{i}) AS b{i}' for i in range(5))} FROM seen SEMI JOIN (SELECT * FROM au WHERE reason IS NULL) k USING (kind, merchant) GROUP BY ALL)"


@query(f"SELECT kind, fp, merchants, round(txns, 4) AS txns, round(({S10}) / (10 * greatest(txns, 1)), 9) AS risk_est, {FLAGGED} AS flagged FROM fed", SUMMED)
def fed_rings(spark, d):
    """One merchant reveals other than it committed to, and the filters take out others."""
    h = staged(poisoned(spark, d), "hist")
    return P.fed_rings(changed(h), P.commitments(h), 0.3).select("kind", "fp", "merchants", "txns", R4("risk_est").alias("risk_est"), "flagged")


def _cells(table: str, arms: str, flagged: str, truth: str) -> str:
    """SQL of flagged, tp and a (true rings) of every cell (arm, kind) of a table of flagged rings."""
    at = f"{flagged}.arm = c.arm AND {flagged}.kind = c.kind"
    return f"{table} AS (SELECT arm, kind, (SELECT count(*) FROM {flagged} WHERE {at}) AS flagged, (SELECT count(*) FROM {flagged} SEMI JOIN {truth} USING (kind, fp) WHERE {at}) AS tp, (SELECT count(*) FROM {truth} WHERE {truth}.kind = c.kind) AS a FROM ({arms}) c)"


KEYED = hmac_sql(P.SECRET, "key") + "[1:16]"
FLOOD = ", ".join(f"CASE WHEN merchant = 0 THEN {TOT if b == 4 else '0'} ELSE b{b} END AS b{b}" for b in range(5))
ATTACK = (
    "rs AS (SELECT rr.*, x.split FROM rr JOIN (SELECT txn_id, split FROM sp WHERE split <> 'train') x USING (txn_id)),"
    f" hk AS (SELECT merchant, kind, {KEYED} AS fp, {BUCKETS} FROM rs WHERE split = 'test' GROUP BY ALL), ek AS (SELECT split, kind, {KEYED} AS fp, count(*) AS txns, count(DISTINCT merchant) AS merchants, sum(is_fraud) AS frauds, {BUCKETS} FROM rs GROUP BY ALL),"
    f" vk AS (SELECT kind, i, count(*) FILTER (WHERE frauds >= 2 AND 10 * ({S10}) >= i * txns) AS tp, count(*) FILTER (WHERE frauds < 2 AND 10 * ({S10}) >= i * txns) AS fp_, count(*) FILTER (WHERE frauds >= 2) AS a FROM ek, (SELECT unnest(range(10, 91)) AS i) WHERE split = 'val' AND txns BETWEEN 2 AND 40 GROUP BY ALL),"
    " tk AS (SELECT kind, i AS slot FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp_ + a) END, 9) DESC, i) AS o FROM vk) WHERE o = 1),"
    f" fk AS (SELECT merchant, kind, fp, {FLOOD} FROM hk), hn AS (SELECT * FROM fk WHERE merchant <> 0), " + ", ".join(filter_sql(t, n) for t, n in (("hk", "a0"), ("fk", "a1"), ("hn", "a2")))
    + ", ar AS (SELECT 'honest' AS arm, * FROM hk SEMI JOIN (SELECT * FROM a0 WHERE reason IS NULL) k USING (kind, merchant) UNION ALL SELECT 'hot_flood_no_defense', * FROM fk UNION ALL SELECT 'hot_flood_defended', * FROM fk SEMI JOIN (SELECT * FROM a1 WHERE reason IS NULL) k USING (kind, merchant)"
    " UNION ALL SELECT 'commit_mismatch_defended', * FROM hn SEMI JOIN (SELECT * FROM a2 WHERE reason IS NULL) k USING (kind, merchant)),"
    f" sk AS (SELECT arm, kind, fp, count(*) AS merchants, sum({TOT}) AS txns, sum({S10}) AS s10 FROM ar GROUP BY ALL), gk AS (SELECT arm, kind, fp FROM sk JOIN tk USING (kind) WHERE merchants >= 2 AND txns BETWEEN 2 AND 40 AND 10 * s10 >= slot * txns),"
    " uk AS (SELECT kind, fp FROM ek WHERE split = 'test' AND frauds >= 2 AND merchants >= 2 AND txns BETWEEN 2 AND 40), "
    + _cells("ck", "SELECT unnest(['honest', 'hot_flood_no_defense', 'hot_flood_defended', 'commit_mismatch_defended']) AS arm, kind FROM tk", "gk", "uk")
    + ", jk AS (SELECT arm, coalesce(kind, 'combined') AS kind, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(flagged - tp) AS BIGINT) AS fp, CAST(sum(a - tp) AS BIGINT) AS fn FROM ck GROUP BY GROUPING SETS ((arm, kind), (arm)))"
)


@query("SELECT arm, kind, flagged, tp, fp, fn, " + ", ".join(f"round({x}, 9) AS {c}" for c, x in RATES.items()) + " FROM jk", ATTACK)
def attack_arms(spark, d):
    """Rings of whole splits when merchant 0 floods the top bucket or reveals other than it committed to, with and without defence."""
    out = M.rates(P.attack_arms(R.ring_rows(split(spark, d)))[0])
    return out.select("arm", "kind", "flagged", "tp", "fp", "fn", *[R4(c).alias(c) for c in RATES])


@query(
    "SELECT 'honest' AS arm, kind, merchant, reason, round(ratio, 6) AS ratio FROM a0 WHERE reason IS NOT NULL UNION ALL SELECT 'hot_flood_defended', kind, merchant, reason, round(ratio, 6) FROM a1 WHERE reason IS NOT NULL"
    " UNION ALL SELECT 'commit_mismatch_defended', kind, merchant, reason, round(ratio, 6) FROM a2 WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT 'commit_mismatch_defended', kind, 0, 'commit', NULL FROM hk WHERE merchant = 0",
    ATTACK,
)
def attack_audit(spark, d):
    """Who is left out in each arm, and why."""
    return P.attack_arms(R.ring_rows(split(spark, d)))[1].withColumn("ratio", F.round("ratio", 6))


CENTRAL = SWEEP + f""", cf AS (SELECT kind, fp FROM es JOIN th USING (kind) WHERE th.eps = 0 AND split = 'test' AND merchants >= 2 AND txns BETWEEN 2 AND 40 AND 10 * ({S10}) >= slot * txns),
cc AS (SELECT kind, (SELECT count(*) FROM cf WHERE cf.kind = c.kind) AS flagged, (SELECT count(*) FROM cf SEMI JOIN tr USING (kind, fp) WHERE cf.kind = c.kind) AS tp, (SELECT count(*) FROM tr WHERE tr.kind = c.kind) AS a FROM (SELECT DISTINCT kind FROM th) c),
bo AS (SELECT arm, coalesce(kind, 'combined') AS kind, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(flagged - tp) AS BIGINT) AS fp, CAST(sum(a - tp) AS BIGINT) AS fn FROM (SELECT 'central' AS arm, * FROM cc) GROUP BY GROUPING SETS ((arm, kind), (arm))
       UNION ALL SELECT 'federated', kind, flagged, tp, fp, fn FROM ju WHERE eps = 0)"""


@query("SELECT arm, kind, flagged, tp, fp, fn, " + ", ".join(f"round({x}, 9) AS {c}" for c, x in RATES.items()) + " FROM bo", CENTRAL)
def central_vs_fed(spark, d):
    """Rings counted in one place and from merchants' histograms without noise, both at the thresholds of val. Told are the kinds that have a threshold under any budget; no rows if none has."""
    rows = staged(R.ring_rows(split(spark, d)), "rows")
    table, slots = P.sweep(rows)
    exact = staged(P.exact_rings(rows.filter("split = 'test'")), "exact")
    at, kinds = slots.filter("eps = 0").select("kind", "slot"), slots.select("kind").distinct()
    hit = exact.join(F.broadcast(at), "kind").filter((F.col("merchants") >= 2) & F.col("txns").between(P.LOW, P.CAP) & (10 * K.risk_tenths([F.col(b) for b in P.B]) >= F.col("slot") * F.col("txns")))  # one row per kind
    central = P.judged(hit.select(F.lit("central").alias("arm"), "kind", "fp"), exact, ["arm"], kinds.select(F.lit("central").alias("arm"), "kind"))
    both = central.unionByName(table.filter("eps = 0").drop("eps", "rep").withColumn("arm", F.lit("federated")))
    return M.rates(both).select("arm", "kind", "flagged", "tp", "fp", "fn", *[R4(c).alias(c) for c in RATES])


@query(f"SELECT h.merchant, left(digest, 12) AS commitment, left(fp, 8) AS fp8, kind, {TOT} AS n FROM hist h JOIN cm USING (kind, merchant)", COMMIT)
def merchant_sketch(spark, d):
    h = staged(hist(spark, d), "hist")
    c = P.commitments(h).select("kind", "merchant", F.substr("digest", F.lit(1), F.lit(12)).alias("commitment"))
    return h.join(sized(staged(c, "commitments")), ["kind", "merchant"]).select("merchant", "commitment", F.substr("fp", F.lit(1), F.lit(8)).alias("fp8"), "kind", P.total().alias("n"))


@query("SELECT nullif(eps, 0) AS eps, kind, slot * 0.01::DOUBLE AS thr FROM th", SWEEP)
def fed_tune(spark, d):
    """Threshold of the best F1 on val for every budget and kind."""
    return swept(spark, d)[1].select(F.nullif("eps", F.lit(0)).alias("eps"), "kind", (F.col("slot") * F.lit(0.01)).alias("thr"))


# updates of a model: the mean amount and score of each hour of day, per merchant, less the mean over all; merchant 2 flips signs tenfold
UPD = "hr AS (SELECT card1 % 8 AS merchant, (t // 3600) % 24 AS idx, avg(amount) AS v FROM txn GROUP BY ALL), gw AS (SELECT (t // 3600) % 24 AS idx, avg(amount) AS g FROM txn GROUP BY ALL), de AS (SELECT merchant, idx, round((v - g) * CASE WHEN merchant = 2 THEN -10 ELSE 1 END, 6) AS value FROM hr JOIN gw USING (idx)), we AS (SELECT card1 % 8 AS merchant, count(*) AS rows_, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows FROM txn GROUP BY 1)"
NF = UPD + ", nn AS (SELECT merchant, sqrt(sum(value * value)) AS norm FROM de GROUP BY 1), nf AS (SELECT merchant, norm, norm <= 3 * (SELECT median(norm) FROM nn) AS ok FROM nn)"
CF = NF + ", d2 AS (SELECT * FROM de SEMI JOIN (SELECT merchant FROM nf WHERE ok) USING (merchant)), mi AS (SELECT idx, median(value) AS mid FROM d2 GROUP BY 1), di AS (SELECT merchant, 1 - sum(value * mid) / (sqrt(sum(value * value)) * sqrt(sum(mid * mid))) AS distance FROM d2 JOIN mi USING (idx) GROUP BY 1), cf AS (SELECT merchant, distance, distance <= greatest((SELECT median(distance) + 3 * mad(distance) FROM di), 0.85::DOUBLE) AS ok FROM di)"


def updates(spark, d):
    x = txn(spark, d).withColumn("merchant", K.merchant()).withColumn("idx", F.pmod(F.floor(F.col("t") / 3600), F.lit(24)).cast("long"))
    g = x.groupBy("idx").agg(F.avg("amount").alias("g"))
    v = x.groupBy("merchant", "idx").agg(F.avg("amount").alias("v")).join(F.broadcast(g), "idx")  # 24 rows
    w = x.groupBy("merchant").agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").cast("long").alias("fraud_rows"))
    delta = F.round((F.col("v") - F.col("g")) * F.when(F.col("merchant") == 2, -10).otherwise(1), 6)
    return staged(v.select("merchant", "idx", delta.alias("value")), "updates"), w


@query("SELECT merchant, idx, round(value, 4) AS value FROM de", UPD)
def update_delta(spark, d):
    return updates(spark, d)[0].withColumn("value", F.round("value", 4))


@query("SELECT merchant, sha256(string_agg(idx || ':' || CAST(round(value * 1000) AS BIGINT), ',' ORDER BY idx)) AS digest FROM de GROUP BY 1", UPD)
def update_digest(spark, d):
    x = F.sort_array(F.collect_list(F.struct("idx", F.concat_ws(":", F.col("idx").cast("string"), F.round(F.col("value") * 1000).cast("long").cast("string")).alias("s"))))
    return updates(spark, d)[0].groupBy("merchant").agg(F.sha2(F.array_join(F.transform(x, lambda r: r["s"]), ","), 256).alias("digest"))


@query("SELECT merchant, round(norm, 6) AS norm, ok FROM nf", NF)
def norm_filter(spark, d):
    return P.norm_filter(updates(spark, d)[0]).withColumn("norm", F.round("norm", 6))


@query("SELECT merchant, round(distance, 6) AS distance, ok FROM cf", CF)
def cosine_filter(spark, d):
    u, _ = updates(spark, d)
    ok = P.norm_filter(u).filter("ok").select("merchant")
    return P.cosine_filter(u.join(sized(staged(ok, "kept")), "merchant", "left_semi")).withColumn("distance", F.round("distance", 6))


@query("SELECT idx, round(sum(fraud_rows * value) / sum(fraud_rows), 6) AS value FROM d2 JOIN (SELECT merchant, greatest(fraud_rows, 1) AS fraud_rows FROM we) USING (merchant) SEMI JOIN (SELECT merchant FROM cf WHERE ok) k USING (merchant) GROUP BY 1", CF)
def robust_aggregate(spark, d):
    return P.robust_aggregate(*updates(spark, d)).withColumn("value", F.round("value", 6))


@query("SELECT idx, round(sum(rows_ * value) / sum(rows_), 6) AS value FROM de JOIN we USING (merchant) GROUP BY 1", UPD)
def plain_aggregate(spark, d):
    u, w = updates(spark, d)
    return P.weighted_mean(u, w, "rows").withColumn("value", F.round("value", 6))


@query("SELECT idx, round(sum(fraud_rows * value) / sum(fraud_rows), 6) AS value FROM de JOIN (SELECT merchant, greatest(fraud_rows, 1) AS fraud_rows FROM we) USING (merchant) GROUP BY 1", UPD)
def weighted_mean(spark, d):
    u, w = updates(spark, d)
    return P.weighted_mean(u, w, "fraud_rows").withColumn("value", F.round("value", 6))


ROUNDS = UPD + ", er AS (SELECT merchant, sum(value * value) AS e FROM de GROUP BY 1), me AS (SELECT idx, avg(value) AS value FROM de WHERE merchant >= 5 GROUP BY 1), pick AS (SELECT (SELECT sum(value * value) FROM me) <= (SELECT min(e) FROM er) AS m)"


@query("SELECT CASE WHEN m THEN 'mean' ELSE 'best' END AS choice, idx, round(value, 6) AS value FROM pick, (SELECT true AS of_mean, idx, value FROM me UNION ALL SELECT false, idx, value FROM de WHERE merchant = (SELECT merchant FROM er ORDER BY round(e, 6), merchant LIMIT 1)) x WHERE x.of_mean = m", ROUNDS)
def mean_of_rounds(spark, d):
    """Merchants stand for rounds: the mean of the last three or the round nearest the pooled vector, whichever is nearer to it. ``models.mean_or_best`` chooses by scores on val."""
    u, _ = updates(spark, d)
    mean = u.filter("merchant >= 5").groupBy("idx").agg(F.avg("value").alias("value"))
    errors = staged(u.groupBy("merchant").agg(F.sum(F.col("value") * F.col("value")).alias("e")), "errors")
    top = errors.agg(F.min(F.struct(F.round("e", 6).alias("r"), "merchant")).alias("t"), F.min("e").alias("e"))
    pick = staged(mean.agg(F.sum(F.col("value") * F.col("value")).alias("own")).crossJoin(F.broadcast(top)).select((F.col("own") <= F.col("e")).alias("m"), F.col("t.merchant").alias("merchant")), "pick")
    both = mean.select(F.lit(True).alias("of_mean"), "idx", "value").unionByName(u.join(F.broadcast(pick), "merchant").select(F.lit(False).alias("of_mean"), "idx", "value"))
    out = both.join(F.broadcast(pick.select("m")), F.col("of_mean") == F.col("m"))
    return out.select(F.when(F.col("m"), "mean").otherwise("best").alias("choice"), "idx", F.round("value", 6).alias("value"))


@query(
    "SELECT merchant, idx, round(value / greatest(norm, 1) + sqrt(2 * ln(1.25::DOUBLE / 0.00001::DOUBLE)) / 8 * " + "sqrt(-2 * ln((CAST('0x' || sha256('u|' || merchant || '|' || idx)[1:12] AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)) * cos(2 * pi() * ((CAST('0x' || sha256('u|' || merchant || '|' || idx)[13:24] AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)), 6) AS value FROM de JOIN nf USING (merchant)",
    NF,
)
def dp_update(spark, d):
    """Updates clipped to norm 1 plus Gaussian noise at epsilon 8."""
    u, _ = updates(spark, d)
    n = P.norm_filter(u).select("merchant", "norm")
    noise = K.gaussian_sigma(F.lit(8.0)) * K.unit_noise(F.lit("u"), F.col("merchant").cast("string"), F.col("idx").cast("string"))
    return u.join(sized(staged(n, "norms")), "merchant").select("merchant", "idx", F.round(F.col("value") / F.greatest("norm", F.lit(1.0)) + noise, 6).alias("value"))


def reach(edges: str, by: str, rounds: int) -> str:
    """SQL tables up to ``reach`` (by, n, m): m is the least node within 2 ** rounds steps of n, over the tables edges (by, a, b)."""
    g = f"{by}, " if by else ""
    on = lambda x, y: f" AND {x}.{by} = {y}.{by}" if by else ""
    two = f"un AS MATERIALIZED (SELECT {g}a, b FROM {edges} UNION SELECT {g}b, a FROM {edges}), l0 AS MATERIALIZED (SELECT {g}a AS n, least(a, min(b)) AS m FROM un GROUP BY {g}a)"
    at = lambda t: f"{t}.{by}, " if by else ""
    for i in range(1, rounds + 1):  # the least label of the neighbours, then that label's own
        two += f", h{i} AS MATERIALIZED (SELECT {at('x')}x.n, least(x.m, min(y.m)) AS m FROM l{i - 1} x JOIN un ON x.n = un.a{on('x', 'un')} JOIN l{i - 1} y ON y.n = un.b{on('y', 'un')} GROUP BY {at('x')}x.n, x.m)"
        two += f", l{i} AS MATERIALIZED (SELECT {at('x')}x.n, least(x.m, y.m) AS m FROM h{i} x JOIN h{i} y ON y.n = x.m{on('x', 'y')})"
    return two + f", reach AS (SELECT * FROM l{rounds})"


def comps(first: str, last: str) -> str:
    """SQL tables wk (rows of every day's window: later than ``first``, earlier than ``last``), reach and st (figures of components)."""
    return (
        f"dy AS (SELECT unnest(range((SELECT min(t) // 86400 FROM txn), (SELECT max(t) // 86400 FROM txn) + 1)) AS day),"
        f" wk AS MATERIALIZED (SELECT day, t, account, 'c' || coalesce(CAST(card1 AS VARCHAR), 'n') AS a, 'v' || {DEV} AS v FROM dy JOIN txn ON t > {first} AND t < {last}),"
        " ed AS (SELECT DISTINCT day, a, coalesce(v, a) AS b FROM wk), " + reach("ed", "day", 12)
        + ", st AS (SELECT day, m, count(*) AS comp_size, count(DISTINCT a) AS comp_cards, count(DISTINCT v) AS comp_devices, count(DISTINCT account) AS comp_accounts, count(*) / greatest((max(t) - min(t)) / 3600, 1.0::DOUBLE / 60) AS comp_rate FROM wk JOIN reach USING (day) WHERE n = a GROUP BY ALL)"
    )


COMPS = comps("(day - 7) * 86400", "(day + 1) * 86400")
COMP_COLUMNS = "comp_size, comp_cards, comp_devices, comp_accounts, round(comp_rate, 6) AS comp_rate"
OWN_COMP = f"SELECT txn_id, {COMP_COLUMNS} FROM txn LEFT JOIN (SELECT day, n, st.* EXCLUDE (day, m) FROM reach JOIN st USING (day, m)) x ON x.day = t // 86400 AND n = 'c' || coalesce(CAST(card1 AS VARCHAR), 'n')"


@query(f"SELECT day, {COMP_COLUMNS} FROM st", COMPS)
def ring_components(spark, d):
    """Every day's components of cards and devices over the week before it and the day itself."""
    return C.component_stats(C.sliding_components(txn(spark, d))).drop("component").withColumn("comp_rate", F.round("comp_rate", 6))


@query(OWN_COMP, COMPS)
def component_features(spark, d):
    """For each row its card's component."""
    return C.component_features(txn(spark, d)).withColumn("comp_rate", F.round("comp_rate", 6))


@query(OWN_COMP, comps("(day - 7) * 86400", "day * 86400"))
def component_features_causal(spark, d):
    """For each row its card's component in the week that ended at the midnight before."""
    return C.component_features(txn(spark, d), causal=True).withColumn("comp_rate", F.round("comp_rate", 6))


EDGE = "ed AS (SELECT DISTINCT 2 * account AS a, 2 * (addr1 * 4 + addr2) + 1 AS b FROM txn WHERE addr1 IS NOT NULL), " + reach("ed", "", 8)


@query("SELECT size, count(*) AS components FROM (SELECT m, count(*) AS size FROM reach GROUP BY 1) GROUP BY 1", EDGE)
def component_sizes(spark, d):
    """Sizes of the components of accounts and the addresses that they use."""
    e = txn(spark, d).filter("addr1 is not null").select((2 * F.col("account")).alias("src"), (2 * (F.col("addr1") * 4 + F.col("addr2")) + 1).alias("dst"))
    return G.connected_components(e).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query(f"SELECT kind, {hmac_sql(P.SECRET, "kind || '|' || key || '|' || day")}[1:16] AS fp, frauds >= 2 AS truth FROM exact")
def truth_join(spark, d):
    r = rows(spark, d)
    truth = r.groupBy("kind", "key", "day").agg(F.sum("is_fraud").alias("f")).filter("f >= 2").select("kind", P.fingerprint().alias("fp"), F.lit(True).alias("t"))
    return P.federated_sum(P.merchant_hist(r)).join(truth.hint("merge"), ["kind", "fp"], "left").select("kind", "fp", F.coalesce("t", F.lit(False)).alias("truth"))
