"""Queries: files, feature tables, model fits and streams over the transaction feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators import features as X
from ringsight.operators import models as L
from ringsight.operators import privacy as P
from ringsight.plans.aggregates import FOLD, PEERS
from ringsight.plans.base import ADDR, DEV, SPEC, hmac_sql, query
from ringsight.plans.federated import BUCKETS, COMPS, OWN_COMP, S10, TOT, _noise
from ringsight.plans.rowwise import DISP, INR, R4, disputes, in_ring, rings, split, txn
from ringsight.session import staged, workspace
from ringsight.sources import files
from ringsight.streaming import feeds

CATEGORIES = ("email_domain", "device_info", "browser")
FEATURES = ("amount", "addr1", "addr2", *CATEGORIES)
#: Names of the numeric columns of the federated fits.
DENSE = ("amount", "hour", "n_24h", "n_7d", "sum_24h")

SHARES = "sh AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, count(*) / sum(count(*)) OVER () AS share FROM sp WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}" for c in CATEGORIES) + ")"
PREPARED = (
    "SELECT txn_id, split, is_fraud, CAST(amount AS DOUBLE) AS amount, CAST(addr1 AS DOUBLE) AS addr1, CAST(addr2 AS DOUBLE) AS addr2, "
    + ", ".join(f"round(coalesce((SELECT share FROM sh WHERE feature = '{c}' AND level = sp.{c}), 0), 9) AS {c}" for c in CATEGORIES)
    + " FROM sp"
)


def labelled(spark, d):
    return split(spark, d).select("txn_id", "split", "is_fraud", *FEATURES)


@query("SELECT txn_id, t, amount, card1, account, addr1, device_info FROM txn")
def scan_csv(spark, d):
    rows = txn(spark, d).select("txn_id", "t", "amount", "card1", "account", "addr1", "device_info")
    path = workspace(spark, "csv")
    files.sink_csv(rows, path)
    return files.scan_csv(spark, path, rows.schema)


@query("SELECT txn_id, t, amount, split FROM sp WHERE split <> 'train'")
def sink_splits(spark, d):
    rows, path = split(spark, d).select("txn_id", "t", "amount", "split"), workspace(spark, "splits")
    files.sink_splits(rows, path)
    return spark.read.schema(rows.schema).parquet(path).filter("split <> 'train'")


@query("SELECT split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds, min(t) AS t0, max(t) AS t1 FROM sp GROUP BY 1")
def sink_report(spark, d):
    """A flat report, written and read back."""
    path = workspace(spark, "report")
    report = split_lines(spark, d)
    files.sink_report(report, path)
    return files.scan_report_json(spark, path, report.schema)


def split_lines(spark, d):
    return split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("long").alias("frauds"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query("SELECT split, n, frauds, (SELECT count(*) FROM sp) AS total, round(frauds / n, 9) AS rate FROM (SELECT split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM sp GROUP BY 1)")
def scan_report_json(spark, d):
    """A nested report (meta, and figures by split), read back and flattened."""
    lines = split_lines(spark, d).withColumn("figures", F.struct((F.col("frauds") / F.col("n")).alias("rate")))
    report = lines.agg(F.struct(F.sum("n").alias("total"), F.lit("splits").alias("name")).alias("meta"), F.collect_list(F.struct("split", "n", "frauds", "figures")).alias("parts"))  # three parts
    path = workspace(spark, "report")
    files.sink_report(report, path)
    back = files.scan_report_json(spark, path, report.schema)
    return back.select("meta.total", F.inline("parts")).select("split", "n", "frauds", "total", R4("figures.rate").alias("rate"))


CENSUS = ("rings", "fraud_rings", "cross_merchant", "single_merchant")
LEVELS = (0.3, 0.35, 0.5)
_CEN = "SELECT kind, count(*) AS rings, count(*) FILTER (WHERE frauds >= 2) AS fraud_rings, count(*) FILTER (WHERE frauds >= 2 AND merchants >= 2) AS cross_merchant, count(*) FILTER (WHERE frauds >= 2 AND merchants = 1) AS single_merchant FROM win GROUP BY 1"
_LEV = "SELECT e, kind, count(*) FILTER (WHERE score_mean >= e AND frauds >= 2) AS tp, count(*) FILTER (WHERE score_mean >= e AND frauds < 2) AS fp FROM win, (SELECT unnest([0.3, 0.35, 0.5]::DOUBLE[]) AS e) GROUP BY ALL"


@query(
    " UNION ALL ".join(f"SELECT 'ground_truth' AS section, NULL::DOUBLE AS setting, kind AS name, '{m}' AS metric, {m}::DOUBLE AS value FROM ce" for m in CENSUS)
    + "".join(f" UNION ALL SELECT 'levels', e, kind, '{m}', {m}::DOUBLE FROM le" for m in ("tp", "fp")),
    f"ce AS ({_CEN}), le AS ({_LEV})",
)
def scan_report_sections(spark, d):
    """A report whose maps are keyed by kind and metric, and a list with a setting each, written and read back."""
    held = staged(rings(spark, d).select("kind", "frauds", "merchants", "score_mean"), "rings")
    bad = F.col("frauds") >= 2
    census = held.groupBy("kind").agg(F.count(F.lit(1)).alias("rings"), F.count_if(bad).alias("fraud_rings"), F.count_if(bad & (F.col("merchants") >= 2)).alias("cross_merchant"), F.count_if(bad & (F.col("merchants") == 1)).alias("single_merchant"))
    hit = F.col("score_mean") >= F.col("e")
    levels = held.withColumn("e", F.explode(F.array(*map(F.lit, LEVELS)))).groupBy("e", "kind").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"))
    lines = lambda df, section, setting, names: df.select(F.lit(section).alias("section"), setting.cast("double").alias("setting"), F.col("kind").alias("name"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    path = workspace(spark, "report")
    files.sink_sectioned(lines(census, "ground_truth", F.lit(None), CENSUS).unionByName(lines(levels, "levels", F.col("e"), ("tp", "fp"))), path, ["levels"])
    return files.sectioned(spark, path, ["ground_truth"], ["levels"])


@query("SELECT txn_id, amount FROM txn")
def sink_event_store(spark, d):
    """Three deliveries that overlap leave each transaction once."""
    rows, path = txn(spark, d).select("txn_id", "amount"), workspace(spark, "store")
    for part in ("txn_id % 3 <> 0", "txn_id % 3 <> 1", "txn_id % 2 = 0"):
        files.sink_event_store(rows.filter(part), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT feature, level, round(share, 9) AS share FROM sh", SHARES)
def feature_spec_fit(spark, d):
    train = labelled(spark, d).filter("split = 'train'")
    return L.category_shares(train, L.feature_spec(train)).withColumn("share", R4("share"))


@query(PREPARED, SHARES)
def prepare_features(spark, d):
    out = L.prepare_features(labelled(spark, d))[0]
    return out.select("txn_id", "split", "is_fraud", "amount", "addr1", "addr2", *[R4(c).alias(c) for c in CATEGORIES])


_RANKED = "lv AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) - 1 AS idx FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, count(*) AS n FROM sp WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}" for c in CATEGORIES) + "))"


@query(f"SELECT feature, level, CAST(idx AS INT) AS idx FROM lv WHERE idx < {L.LEVELS}", _RANKED)
def category_levels(spark, d):
    train = labelled(spark, d).filter("split = 'train'")
    return L.category_levels(train, L.feature_spec(train))


FEW = 4


@query("SELECT txn_id, " + ", ".join(f"coalesce((SELECT idx FROM lv WHERE feature = '{c}' AND level = sp.{c} AND idx < {FEW}), (SELECT count(*) FROM lv WHERE feature = '{c}' AND idx < {FEW}))::DOUBLE AS {c}_level" for c in CATEGORIES) + " FROM sp", _RANKED)
def category_index(spark, d):
    """Four levels of a category have an index of their own; rarer, unseen and absent ones share the next."""
    rows = labelled(spark, d)
    train = rows.filter("split = 'train'")
    spec = L.feature_spec(train)
    return L.indexed(rows, spec, staged(L.category_levels(train, spec, FEW), "levels")).select("txn_id", *[f"{c}_level" for c in CATEGORIES])


@query(PREPARED, SHARES)
def cache_features(spark, d):
    """The second call finds version 1 and builds nothing."""
    root, made = workspace(spark, "features"), prepare_features(spark, d)
    files.cache_features(spark, root, 1, made.schema, lambda: made)
    return files.cache_features(spark, root, 1, made.schema, lambda: made.limit(0))


def scorer(spark, d):
    table, names = L.scorer_table(labelled(spark, d))
    return L.train_scorer(table, names), table


@query()
def train_scorer(spark, d):
    """pr_auc and roc_auc on the test rows."""
    model, table = scorer(spark, d)
    return L.quality(L.score_batch(model, table.filter("split = 'test'")))


@query()
def scorer_rounds(spark, d):
    """Losses after each round that the scorer kept."""
    return L.scorer_rounds(*scorer(spark, d))


@query()
def score_batch(spark, d):
    model, table = scorer(spark, d)
    return L.score_batch(model, table).select("txn_id", "split", "score")


@query()
def top_features(spark, d):
    return L.top_features(scorer(spark, d)[0], spark)


@query()
def model_save_load(spark, d):
    """Largest difference of scores before and after saving: 0."""
    model, table = scorer(spark, d)
    path = workspace(spark, "model")
    files.save_model(model, path)
    a = L.score_batch(model, table).select("txn_id", "score")
    b = L.score_batch(files.load_model(path), table).select("txn_id", F.col("score").alias("again"))
    return a.join(b.hint("merge"), "txn_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("again"))).alias("gap"))


def _velocity(key: str) -> str:
    a, b = (f"(PARTITION BY {key} ORDER BY t RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (86400, 604800))
    return f"t - lag(t) OVER (PARTITION BY {key} ORDER BY t, txn_id) AS {key}_gap, count(*) OVER {a} AS {key}_n_24h, count(*) OVER {b} AS {key}_n_7d, round(coalesce(sum(amount) OVER {a}, 0), 4) AS {key}_sum_24h, round(avg(amount) OVER {a}, 6) AS {key}_mean_24h"


SPREAD, REPUTED = (("card1", "account"), ("card1", "addr1"), ("account", "device_info")), ("card1", "addr1", "email_domain")
_FIRSTS = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY {k}, {v} ORDER BY t, txn_id) = 1 THEN 1 ELSE 0 END AS f{i}" for i, (k, v) in enumerate(SPREAD))
_FANS = ", ".join(f"CAST(coalesce(sum(f{i}) OVER (PARTITION BY {k} ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {k}_{v}s" for i, (k, v) in enumerate(SPREAD))
_COUNTS = "".join(f", own_{k} AS (SELECT {k}, fold, sum(is_fraud) AS fr, count(*) AS cnt FROM fo WHERE {k} IS NOT NULL GROUP BY ALL), all_{k} AS (SELECT {k}, sum(is_fraud) AS fr, count(*) AS cnt FROM fo WHERE {k} IS NOT NULL GROUP BY ALL)" for k in REPUTED)
_RATES = ", ".join(
    f"round(coalesce((a_{k}.fr - coalesce(o_{k}.fr, 0) + 20 * 0.035::DOUBLE) / (a_{k}.cnt - coalesce(o_{k}.cnt, 0) + 20), 0.035::DOUBLE), 9) AS {k}_rate, round(coalesce(ln(1 + a_{k}.cnt - coalesce(o_{k}.cnt, 0)), 0), 9) AS {k}_log_n, CASE WHEN a_{k}.cnt - coalesce(o_{k}.cnt, 0) > 0 THEN 1 ELSE 0 END AS {k}_seen"
    for k in REPUTED
)
_COMP = ", ".join(f"comp_{c}" for c in ("size", "cards", "devices", "accounts")) + ", round(comp_rate, 6) AS comp_rate"
ENTITY = (
    COMPS + ", " + FOLD + _COUNTS
    + ", pc AS (" + OWN_COMP.replace("round(comp_rate, 6) AS comp_rate", "comp_rate") + ")"
    + f", ve AS (SELECT *, {_velocity('account')}, {_velocity('card1')}, {_FANS} FROM (SELECT *, {_FIRSTS} FROM sp))"
    + ", ef AS (SELECT ve.*, coalesce(x.fold, -1) AS fold FROM ve LEFT JOIN (SELECT txn_id, fold FROM fo) x USING (txn_id))"
)
MADE = [f"{k}_{c}" for k in ("account", "card1") for c in ("gap", "n_24h", "n_7d", "sum_24h", "mean_24h")] + [f"{k}_{v}s" for k, v in SPREAD]


@query(
    f"SELECT txn_id, {', '.join('ef.' + c for c in MADE)}, {_COMP}, {_RATES} FROM ef LEFT JOIN pc USING (txn_id)"
    + "".join(f" LEFT JOIN all_{k} a_{k} ON ef.{k} = a_{k}.{k} LEFT JOIN own_{k} o_{k} ON ef.{k} = o_{k}.{k} AND ef.fold = o_{k}.fold" for k in REPUTED),
    ENTITY,
)
def entity_features(spark, d):
    x = L.entity_features(split(spark, d))
    digits = {c: 4 if "sum" in c else 6 for c in MADE if "sum" in c or "mean" in c} | {"comp_rate": 6} | {f"{k}_{c}": 9 for k in REPUTED for c in ("rate", "log_n")}
    names = ["txn_id", *MADE, "comp_size", "comp_cards", "comp_devices", "comp_accounts", "comp_rate", *[f"{k}_{c}" for k in REPUTED for c in ("rate", "log_n", "seen")]]
    return x.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in names])


@query()
def feature_lift(spark, d):
    return L.feature_lift(split(spark, d))


def dense(spark, d):
    read = split(spark, d).select("txn_id", "t", "split", "card1", "account", "amount", "is_fraud")  # no more goes through the windows
    rows = X.velocity(read, "account").withColumn("hour", F.pmod(F.floor(F.col("t") / 3600), F.lit(24))).withColumn("merchant", K.merchant())
    return staged(L.standardized(staged(rows, "dense"), DENSE), "dense")


#: SQL tables: dn (txn_id, split, merchant, y, x0.. the constant and the standardized columns), w1 to w3 the merchants' weights after each step.
_RAW = {"amount": "amount", "hour": "(t // 3600) % 24", "n_24h": "account_n_24h", "n_7d": "account_n_7d", "sum_24h": "account_sum_24h_"}
_N = len(DENSE) + 1


def _step(i: int) -> str:
    w = [f"w{k}" if i > 1 else "0::DOUBLE" for k in range(_N)]
    e = "(1 / (1 + exp(-(" + " + ".join(f"{a} * x{k}" for k, a in enumerate(w)) + "))) - y)"
    of = ", ".join(f"{'any_value(w' + str(k) + ')' if i > 1 else '0'} - avg({e} * x{k}) AS w{k}" for k in range(_N))
    return f"g{i} AS (SELECT merchant, {of} FROM dn {f'JOIN g{i - 1} USING (merchant)' if i > 1 else ''} WHERE split = 'train' GROUP BY 1)"


LOCAL = (
    f"vl AS (SELECT *, {_velocity('account')}, coalesce(sum(amount) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS account_sum_24h_ FROM sp),"
    f" ra AS (SELECT txn_id, split, card1 % 8 AS merchant, is_fraud::DOUBLE AS y, {', '.join(f'({x})::DOUBLE AS r{i}' for i, x in enumerate(_RAW.values(), 1))} FROM vl),"
    f" sc AS (SELECT {', '.join(f'avg(r{i}) AS m{i}, CASE WHEN stddev_pop(r{i}) > 1e-9 THEN stddev_pop(r{i}) ELSE 1 END AS s{i}' for i in range(1, _N))} FROM ra WHERE split = 'train'),"
    f" dn AS (SELECT txn_id, split, merchant, y, 1::DOUBLE AS x0, {', '.join(f'(r{i} - m{i}) / s{i} AS x{i}' for i in range(1, _N))} FROM ra, sc), " + ", ".join(map(_step, (1, 2, 3)))
)


@query(" UNION ALL ".join(f"SELECT merchant, {k} AS idx, round(w{k}, 6) AS value FROM g3" for k in range(_N)), LOCAL)
def local_fit(spark, d):
    """Three gradient steps of each merchant from weights of nought."""
    return L.local_fit(dense(spark, d).filter("split = 'train'"), [0.0] * _N).withColumn("value", F.round("value", 6))


@query()
def central_fit(spark, d):
    return L.central_fit(dense(spark, d), _N)


@query()
def fed_rounds(spark, d):
    return L.fed_rounds(dense(spark, d), _N)[0]


@query()
def fed_arms(spark, d):
    """Plain and robust rounds, with a merchant that attacks and with privacy budgets."""
    return L.fed_arms(dense(spark, d), _N)


def delivered(spark, d, run, twice=None, late=feeds.LATE, close=False, columns=("*",)):
    """Deliver the splits one after another, rows of the condition ``twice`` doubly; after each, ``run`` reads what is new. Gives the output path.

    ``columns``: those that ``run`` reads, split among them; others are not delivered.

    With ``close`` a last row without keys comes two hours later, so that all rows before are complete.
    """
    rows, source, out, mark = split(spark, d), workspace(spark, "feed"), workspace(spark, "out"), workspace(spark, "mark")
    rows = staged(rows.select(*columns), "splits")
    parts = [rows.filter(F.col("split") == part) for part in ("train", "val", "test")]
    if close:
        end = rows.agg(F.max("t").alias("m")).select(*[(F.col("m") + 7200 if c == "t" else F.lit(None)).cast(k).alias(c) for c, k in rows.dtypes])
        parts.append(end)
    for some in parts:
        (some.unionByName(some.filter(twice)) if twice else some).write.mode("append").parquet(source)
        run(feeds.transaction_feed(spark, source, rows.schema, 10_000, late), out, mark)
    return out


@query("SELECT txn_id, CAST(accounts AS INT) AS accounts, CAST(merchants AS INT) AS merchants, CAST(cards AS INT) AS cards FROM peers", PEERS)
def stream_velocity(spark, d):
    """Every tenth row is delivered twice and counts once."""
    return feeds.peers(spark, delivered(spark, d, feeds.run_velocity, "txn_id % 10 = 0", close=True))


DETECTED = (
    f"lv AS (SELECT shop AS merchant, 'card' AS kind, {hmac_sql(P.LIVE_SECRET, 'CAST(card1 AS VARCHAR)')}[1:16] AS fp, {BUCKETS} FROM txn WHERE txn_id % 5 = 0 GROUP BY ALL)"
    f", ln AS (SELECT * FROM (SELECT merchant, kind, fp, " + ", ".join(_noise("'live'", b, "8::DOUBLE") for b in range(5)) + f" FROM lv) WHERE {TOT} >= 1)"
)
DETECT = f"SELECT kind, fp, merchants, txns, round(s10 / (10 * greatest(txns, 1)), 9) AS risk_est, txns BETWEEN 2 AND 25 AND 100 * s10 >= 35 * 10 * txns AS flagged FROM (SELECT kind, fp, count(*) AS merchants, sum({TOT}) AS txns, sum({S10}) AS s10 FROM %s GROUP BY ALL) WHERE merchants >= 2"


def detected(spark, d, epsilon=None):
    out = delivered(spark, d, lambda feed, path, mark: feeds.run_fed_detect(feed, path, mark, epsilon), columns=("split", *feeds.DETECTS))
    return feeds.fed_detected(spark, out).select("kind", "fp", "merchants", "txns", R4("risk_est").alias("risk_est"), "flagged")


@query(DETECT % "lv", DETECTED)
def stream_fed_detect(spark, d):
    """Cards that several merchants saw, from what they released of live payments."""
    return detected(spark, d)


@query(DETECT % "ln", DETECTED)
def stream_fed_detect_noisy(spark, d):
    """The same under noise for epsilon 8."""
    return detected(spark, d, 8.0)


@query("SELECT dispute_id, txn_id, round(coalesce(amount_minor / 100.0, amount), 2) AS amount, score >= 0.5::DOUBLE OR inr.txn_id IS NOT NULL AS was_flagged, CASE WHEN txn_id % 2 = 0 THEN 'won' ELSE 'open' END AS status FROM disp JOIN txn USING (txn_id) LEFT JOIN inr USING (txn_id)", DISP + ", " + INR)
def stream_disputes(spark, d):
    x = disputes(spark, d).withColumn("status", F.lit("open"))
    events = x.unionByName(x.filter("txn_id % 2 = 0").withColumn("dt", F.col("dt") + 60).withColumn("status", F.lit("won")))
    source, out = workspace(spark, "feed"), workspace(spark, "out")
    events.write.parquet(source)
    rings = in_ring(spark, d).withColumn("r", F.lit(True))
    warned = (F.col("score") >= 0.5) | F.coalesce("r", F.lit(False))
    known = staged(txn(spark, d).select("txn_id", "amount", "score").join(rings.hint("merge"), "txn_id", "left").select("txn_id", "amount", warned.alias("warned")), "known")
    feeds.run_disputes(spark.readStream.schema(events.schema).parquet(source), known, out, workspace(spark, "mark"))
    return feeds.latest_disputes(spark, out)


@query("SELECT txn_id, t, max(t) OVER (PARTITION BY split) AS clock FROM sp")
def stream_feed(spark, d):
    """Every row with the clock of its delivery."""
    return spark.read.parquet(delivered(spark, d, feeds.run_feed)).drop("batch")


@query("SELECT txn_id, t FROM txn")
def stream_dedup(spark, d):
    """Every tenth row is delivered twice and comes out once."""
    run = lambda feed, out, mark: feeds.run_available(feeds.deduplicated(feed).select("txn_id", "t"), out, mark)
    return spark.read.parquet(delivered(spark, d, run, twice="txn_id % 10 = 0"))


@query("SELECT txn_id, round(score, 9) AS score, score >= 0.5::DOUBLE AS flagged, CASE WHEN score >= 0.5::DOUBLE THEN 'payment ' || txn_id || ' scored ' || CAST(floor(score * 1000) AS BIGINT) || ' of 1000' END AS alert FROM txn")
def stream_score(spark, d):
    run = lambda feed, out, mark: feeds.run_available(feeds.scored(feed).select("txn_id", R4("score").alias("score"), "flagged", "alert"), out, mark)
    return spark.read.parquet(delivered(spark, d, run))


@query(
    "SELECT *, members BETWEEN 2 AND 25 AS in_window, members BETWEEN 2 AND 25 AND score_mean >= 0.35::DOUBLE AS flagged FROM (SELECT dd AS day, kind, key, count(*) AS txns, CAST(least(count(DISTINCT member), 26) AS INT) AS members, round(avg(score), 12) AS score_mean FROM (SELECT *, unnest(range(day - 6, day + 1)) AS dd FROM rr) GROUP BY ALL)"
)
def stream_rings_sliding(spark, d):
    """Every sliding week as its last batch left it; members are counted up to one more than the cap."""
    return feeds.last_sliding(spark, delivered(spark, d, feeds.run_sliding)).withColumn("score_mean", F.round("score_mean", 12))


FIRST = (
    "bt AS (SELECT max(t) AS clock, row_number() OVER (ORDER BY max(t)) AS b FROM sp GROUP BY split), xs AS (SELECT *, CASE WHEN txn_id % 5 = 0 THEN 'live' ELSE 'replay' END AS source FROM txn),"
    f" lr AS (SELECT 'device' AS kind, {DEV} AS key, account AS member, t, score FROM xs WHERE {SPEC} UNION ALL SELECT 'address', {ADDR}, card1, t, score FROM xs WHERE {ADDR} IS NOT NULL UNION ALL SELECT 'card', CAST(card1 AS VARCHAR), account, t, score FROM xs WHERE source = 'live'),"
    " rb AS (SELECT b, clock, kind, key, count(DISTINCT member) AS members, avg(score) AS score_mean FROM bt JOIN lr ON t BETWEEN clock - 604800 AND clock GROUP BY ALL), fi AS (SELECT * FROM rb WHERE members BETWEEN 2 AND 25 AND round(score_mean, 9) >= 0.35::DOUBLE)"
)


@query("SELECT kind, key, clock AS t, CAST(members AS INT) AS members, round(score_mean, 9) AS score_mean FROM fi WHERE NOT EXISTS (SELECT 1 FROM fi p WHERE p.b = fi.b - 1 AND p.kind = fi.kind AND p.key = fi.key)", FIRST)
def stream_new_alerts(spark, d):
    """Live rings when they become flagged, at the end of each of three deliveries. Means are judged as they are told, to nine digits: sums in another order settle no tie."""
    return spark.read.parquet(delivered(spark, d, feeds.run_rings, late="0 seconds")).withColumn("score_mean", R4("score_mean"))
