"""Cross-merchant rings from noised histograms: commit, reveal, check, sum; and robust model updates.

Merchant-side steps only ever group by merchant first; what crosses is a table of
(merchant, fp, b0..b4).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators.metrics import prefix_sums
from ringsight.operators.rings import DAILY, bucket_counts
from ringsight.session import sized, staged

B = [f"b{i}" for i in range(5)]
SECRET, LIVE_SECRET = b"ring-salt", b"live-salt"
#: Transactions of a ring that may be flagged.
LOW, CAP = 2, 40


def total() -> Column:
    return reduce(lambda a, b: a + b, map(F.col, B))


def fingerprint(secret: bytes = SECRET, of: tuple[str, ...] = DAILY) -> Column:
    """A keyed hash of the columns of a ring; its first 16 characters."""
    return F.substr(K.hmac_sha256(secret, F.concat_ws("|", *[F.col(c).cast("string") for c in of])), F.lit(1), F.lit(16))


def merchant_hist(rows: DataFrame, secret: bytes = SECRET, by: tuple[str, ...] = (), of: tuple[str, ...] = DAILY) -> DataFrame:
    """merchant, kind, fp, b0..b4: a keyed hash, made once a group, stands for the shared value and what else is ``of`` the ring (by default its day)."""
    keys = [c for c in dict.fromkeys(("kind", "key", *of))]
    return bucket_counts(rows, [*by, "merchant", *keys]).select(*by, "merchant", "kind", fingerprint(secret, of).alias("fp"), *B)


def dp_release(hist: DataFrame, seed: Column, epsilon: Column, drop: bool = True) -> DataFrame:
    """Rounded, non-negative noisy buckets; rows that sum to less than one are dropped, unless ``drop`` is off. A secret in the seed keeps draws unpredictable.

    The hashes come out of a generator, below which the filter is not pushed: each is made once.
    """
    sigma = K.gaussian_sigma(epsilon)
    hashes = F.struct(*[F.sha2(F.concat_ws("|", seed, F.col("merchant").cast("string"), F.col("fp"), F.lit(b)), 256).alias(f"_{b}") for b in B])
    noisy = {b: F.greatest(F.lit(0.0), F.round(F.col(b) + sigma * K.unit_normal(F.col(f"_{b}")))) for b in B}
    return hist.select("*", F.inline(F.array(hashes))).withColumns(noisy).drop(*[f"_{b}" for b in B]).filter((total() >= 1) | F.lit(not drop))


def padded(hist: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """``hist`` with a row of noughts for every merchant and every fingerprint of its shared ``domain`` (kind, fp) that it has not.

    Released with noise, what a merchant has and what it has not look alike. The domain
    must be known to all: by default what any merchant has. The output is merchants
    times the domain; merchants are broadcast if counted few, else they are dealt out.
    """
    have = domain if domain is not None else hist.select("kind", "fp").distinct()
    merchants = staged(hist.select("merchant").distinct(), "merchants")
    every = have.crossJoin(F.broadcast(merchants)) if merchants.count() <= 200_000 else have.crossJoin(merchants)
    full = every.join(hist.hint("merge"), ["merchant", "kind", "fp"], "left")
    return full.select("merchant", "kind", "fp", *[F.coalesce(b, F.lit(0.0)).alias(b) for b in B])


#: Rows of a merchant that make one leaf of its tree, about; children of an inner node: one for each hexadecimal digit.
LEAF = 512


def chunk_depth(n: Column) -> Column:
    """Characters of fp that tell a merchant's leaves apart: so many that a leaf holds about LEAF rows."""
    deep = F.lit(0)
    for i in range(8):
        deep = deep + (n > LEAF * 16**i).cast("int")
    return deep


def chunk_digests(hist: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """by, merchant, prefix, depth, digest of every node of every merchant's tree, one for each kind.

    A leaf is SHA-256 over the rows whose fp begins with its prefix, in order of fp; the
    prefix is as long as the merchant's counted rows ask for. An inner node is SHA-256
    over the digests of its children, sixteen at most, in order, each after its prefix.
    No list is longer than about LEAF rows, however large a merchant is; a merchant
    whose rows are few is one leaf, its root.
    """
    keys = [*by, "merchant"]
    text = F.concat_ws(":", "fp", *[F.format_string("%.1f", F.col(b)) for b in B])
    depth = staged(hist.groupBy(*keys).agg(chunk_depth(F.count(F.lit(1))).alias("depth")), "depths")
    rows = hist.join(sized(depth), keys).select(*keys, "depth", F.expr("substr(fp, 1, depth)").alias("prefix"), text.alias("text"))
    level = rows.groupBy(*keys, "depth", "prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("text")), ","), 256).alias("digest"))
    level = out = staged(level.select(*keys, "prefix", "depth", "digest"), "leaves")
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    for d in range(deepest, 0, -1):
        child = F.struct("prefix", "digest")
        kids = F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x["prefix"], x["digest"]))
        ups = out.filter(F.col("depth") == d).groupBy(*keys, F.expr(f"substr(prefix, 1, {d - 1})").alias("prefix")).agg(F.sha2(F.array_join(kids, ","), 256).alias("digest"))
        level = staged(ups.select(*keys, "prefix", F.lit(d - 1).alias("depth"), "digest"), "nodes")
        out = out.unionByName(level)
    return out


def commitments(hist: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """by, merchant, digest: the roots of ``chunk_digests``."""
    return chunk_digests(hist, by).filter("depth = 0").select(*by, "merchant", "digest")


def chunk_proof(nodes: DataFrame, merchant: int, prefix: str, by: dict[str, str]) -> DataFrame:
    """prefix, digest of the nodes that a leaf's owner needs to come from the leaf ``prefix`` to the root: the children of every node above it. ``by``: the group's values."""
    own = nodes.filter(F.col("merchant") == merchant)
    for c, v in by.items():
        own = own.filter(F.col(c) == v)
    on_path = F.lit(prefix).startswith(F.expr("substr(prefix, 1, length(prefix) - 1)")) & (F.col("depth") > 0)
    return own.filter(on_path & (F.length("prefix") <= len(prefix))).select("prefix", "digest")


def merkle_leaves(committed: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """by, pos (from 0, in order of merchant), digest: positions are counted in parallel. A row for a merchant."""
    ordered = prefix_sums(committed.withColumn("_o", F.struct(*by, "merchant")).withColumn("_one", F.lit(1)), "_o", ["_one"], descending=False)
    ordered = staged(ordered.select(*by, "merchant", "digest", F.col("cum__one").cast("long").alias("_at")), "ordered")
    first = ordered.groupBy(*by).agg(F.min("_at").alias("_first"))
    out = ordered.join(sized(staged(first, "first")), list(by)) if by else ordered.crossJoin(F.broadcast(first))
    return out.select(*by, (F.col("_at") - F.col("_first")).alias("pos"), "digest")


def merkle_root(leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, root of hex ``digest`` leaves in order of ``pos`` (from 0): pairs are hashed, the last doubled on odd levels. Without ``by`` the digest of nothing if empty."""
    sizes = staged(leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    level = leaves.select(*by, "pos", "digest").join(sized(sizes), list(by)) if by else leaves.select("pos", "digest").crossJoin(F.broadcast(sizes))
    while most > 1:
        w = F.col("pos") % 2
        pair = level.groupBy(*by, "_n", F.floor(F.col("pos") / 2).cast("long").alias("up")).agg(F.max(F.when(w == 0, F.col("digest"))).alias("l"), F.max(F.when(w == 1, F.col("digest"))).alias("r"))
        up = F.when(F.col("_n") > 1, F.sha2(F.unhex(F.concat("l", F.coalesce("r", "l"))), 256)).otherwise(F.col("l"))
        level = staged(pair.select(*by, F.col("up").alias("pos"), up.alias("digest"), F.ceil(F.col("_n") / 2).cast("long").alias("_n")), "merkle")
        most = (most + 1) // 2
    if by:
        return level.select(*by, F.col("digest").alias("root"))
    return level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("root"))


def reveal_check(hist: DataFrame, committed: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """by, merchant, ok: whether what was revealed has the committed digest."""
    keys = [*by, "merchant"]
    got = commitments(hist, by).withColumnRenamed("digest", "revealed")
    return committed.join(got.hint("merge"), keys, "full").select(*keys, F.col("digest").eqNullSafe(F.col("revealed")).alias("ok"))


def outliers(hist: DataFrame, volume: float = 5.0, risk: float = 2.0, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """by, merchant, volume, risk, reason (null if kept), ratio; one row per merchant, within each group ``by``."""
    per = hist.groupBy(*by, "merchant").agg(*[F.sum(b).alias(b) for b in B])
    m = staged(per.select(*by, "merchant", total().alias("volume"), K.risk_estimate([F.col(b) for b in B]).alias("risk")), "volumes")
    med = m.groupBy(*by).agg(F.percentile("volume", F.lit(0.5)).alias("mv"), F.percentile("risk", F.lit(0.5)).alias("mr"), F.count(F.lit(1)).alias("n"))
    rv, rr = F.col("volume") / F.col("mv"), F.col("risk") / F.col("mr")
    reason = F.when(F.col("n") < 3, None).when(rv > volume, "volume").when(rr > risk, "risk")
    both = m.join(sized(staged(med, "medians")), list(by)) if by else m.crossJoin(F.broadcast(med))
    return both.select(*by, "merchant", "volume", "risk", reason.alias("reason"), F.when(reason == "volume", rv).when(reason == "risk", rr).alias("ratio"))


def federated_sum(hist: DataFrame, by: tuple[str, ...] = ("kind", "fp")) -> DataFrame:
    out = hist.groupBy(*by).agg(*[F.sum(b).alias(b) for b in B], F.count_if(total() >= 1).alias("merchants"))
    return out.withColumn("txns", total()).withColumn("risk_est", K.risk_estimate([F.col(b) for b in B]))


def fed_flag(sums: DataFrame, threshold: float, low: int = LOW, cap: int = CAP) -> DataFrame:
    """``threshold`` counts in thousandths."""
    return sums.withColumn("flagged", F.col("txns").between(low, cap) & (F.col("merchants") >= 2) & K.risk_reaches([F.col(b) for b in B], threshold))


def surviving(hist: DataFrame, committed: DataFrame, defend: bool = True) -> DataFrame:
    """The rows of the merchants whose reveal is what they committed to and, with ``defend``, that no filter takes out; each kind apart."""
    keys = ["kind", "merchant"]
    good = reveal_check(hist, committed).filter("ok").select(*keys)
    seen = staged(hist.join(sized(staged(good, "good")), keys, "left_semi"), "revealed")
    if not defend:
        return seen
    kept = outliers(seen).filter("reason is null").select(*keys)
    return seen.join(sized(staged(kept, "kept")), keys, "left_semi")


def fed_rings(hist: DataFrame, committed: DataFrame, threshold: float, defend: bool = True, cap: int = CAP) -> DataFrame:
    """Checked, filtered, summed and flagged."""
    return fed_flag(federated_sum(surviving(hist, committed, defend)), threshold, cap=cap)


def rejected(hist: DataFrame, committed: DataFrame) -> DataFrame:
    """kind, merchant, reason (commit, volume or risk), ratio to the median of every merchant that is left out. Commitments are checked first; filters see those that pass."""
    checked = staged(reveal_check(hist, committed), "checked")
    wrong = checked.filter("not ok").select("kind", "merchant", F.lit("commit").alias("reason"), F.lit(None).cast("double").alias("ratio"))
    seen = hist.join(sized(checked.filter("ok").select("kind", "merchant")), ["kind", "merchant"], "left_semi")
    return outliers(seen).filter("reason is not null").select("kind", "merchant", "reason", "ratio").unionByName(wrong)


# the sweep over privacy budgets: every setting in one job
#: Budgets, 0 is none; draws to evaluate on test; draws to tune on val.
BUDGETS, DRAWS, TUNING = (0, 32, 16, 8, 4, 2, 1), 5, 3


def settings(spark: SparkSession) -> DataFrame:
    """eps, rep, split: some dozens of rows."""
    test = [(e, r, "test") for e in BUDGETS for r in range(DRAWS if e else 1)]
    val = [(e, 1000 + r if e else 0, "val") for e in BUDGETS for r in range(TUNING if e else 1)]
    return spark.createDataFrame(test + val, "eps int, rep int, split string")


def exact_rings(rows: DataFrame, of: tuple[str, ...] = DAILY) -> DataFrame:
    """split, kind, fp, b0..b4, merchants, txns, frauds of rings counted in one place."""
    bucket, keys = K.risk_bucket(F.col("score")), [*dict.fromkeys(("split", "kind", "key", *of))]
    per = rows.groupBy(*keys, "merchant").agg(*[F.count_if(bucket == i).cast("double").alias(b) for i, b in enumerate(B)], F.sum("is_fraud").alias("frauds"))
    g = per.groupBy(*keys).agg(*[F.sum(b).alias(b) for b in B], F.count(F.lit(1)).alias("merchants"), F.sum("frauds").alias("frauds"))
    return g.select("split", "kind", fingerprint(of=of).alias("fp"), *B, "merchants", total().alias("txns"), "frauds")


def noisy_sums(hist: DataFrame, sets: DataFrame) -> DataFrame:
    """eps, rep, split, kind, fp and sums over the merchants that pass, of ``hist`` (with split) under every setting."""
    by = ("eps", "rep", "split", "kind")
    seed = F.concat_ws("-", F.col("eps").cast("string"), F.col("rep").cast("string"))
    noisy = staged(dp_release(hist.join(F.broadcast(sets), "split"), seed, F.col("eps").cast("double")), "noisy")  # some dozens of settings
    kept = staged(outliers(noisy, by=by).filter("reason is null").select(*by, "merchant"), "kept")
    return federated_sum(noisy.join(sized(kept), [*by, "merchant"], "left_semi"), (*by, "fp"))


def tuned(sums: DataFrame, exact: DataFrame) -> DataFrame:
    """eps, kind, slot: hundredths of the threshold .1 to .9 with the best F1 on val, the median over its draws; the least of equals.

    Rings are counted by the highest slot they reach and slots cumulated.
    """
    truth = exact.filter("split = 'val'").select("kind", "fp", (F.col("frauds") >= 2).alias("real"))
    seen = sums.filter(f"split = 'val' and txns between {LOW} and {CAP}").join(truth.hint("merge"), ["kind", "fp"], "left").withColumn("real", F.coalesce("real", F.lit(False)))
    slot = F.least(F.lit(90), F.floor(10 * K.risk_tenths([F.col(b) for b in B]) / F.col("txns")).cast("int"))
    per = staged(seen.groupBy("eps", "rep", "kind", slot.alias("slot")).agg(F.count_if("real").alias("p"), F.count_if(~F.col("real")).alias("n")), "slots")
    every = per.select("eps", "rep", "kind").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(90))))
    own = Window.partitionBy("eps", "rep", "kind")  # 91 rows
    w, zero = own.orderBy(F.desc("slot")), F.lit(0)
    cum = every.join(per.hint("merge"), ["eps", "rep", "kind", "slot"], "left").select("eps", "rep", "kind", "slot", F.sum(F.coalesce("p", zero)).over(w).alias("tp"), F.sum(F.coalesce("n", zero)).over(w).alias("fp_"), F.sum(F.coalesce("p", zero)).over(own).alias("all"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("tp") + F.col("fp_") + F.col("all")))
    best = cum.filter("slot >= 10").groupBy("eps", "rep", "kind").agg(F.max(F.struct(F.round(f1, 9).alias("f1"), (-F.col("slot")).alias("m"))).alias("b"))
    return best.groupBy("eps", "kind").agg(F.percentile(-F.col("b.m"), F.lit(0.5)).cast("long").alias("slot"))


def judged(flagged: DataFrame, exact: DataFrame, by: list[str], cells: DataFrame) -> DataFrame:
    """by, kind, flagged, tp, fp, fn of flagged rings (by, kind, fp) on test, and kind 'combined'; ``cells`` (by, kind) lists what is to be told."""
    real = staged(exact.filter(f"split = 'test' and frauds >= 2 and merchants >= 2 and txns between {LOW} and {CAP}").select("kind", "fp"), "truth")
    hits = flagged.join(real.withColumn("real", F.lit(True)).hint("merge"), ["kind", "fp"], "left").groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("flagged"), F.count_if("real").alias("tp"))
    totals = real.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = cells.join(hits.hint("merge"), [*by, "kind"], "left").join(F.broadcast(totals), "kind", "left")  # one row per kind
    per = staged(per.select(*by, "kind", zero("flagged").alias("flagged"), zero("tp").alias("tp"), (zero("flagged") - zero("tp")).alias("fp"), (zero("n") - zero("tp")).alias("fn")), "judged")
    both = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("flagged", "tp", "fp", "fn")]).select(*by, F.lit("combined").alias("kind"), "flagged", "tp", "fp", "fn")
    return per.unionByName(both)


def sweep(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eps, rep, kind, flagged, tp, fp, fn on test), (eps, kind, slot): every budget and draw, tuned on val under the same noise. rows: ring rows with split."""
    later = staged(rows.filter("split <> 'train'").select("split", "merchant", "kind", "key", "day", "score", "is_fraud"), "later")
    exact = staged(exact_rings(later), "exact")
    sums = staged(noisy_sums(merchant_hist(later, by=("split",)), settings(rows.sparkSession)), "sums")
    slots = staged(tuned(sums, exact), "thresholds")
    tests = sums.filter(f"split = 'test' and merchants >= 2 and txns between {LOW} and {CAP}").join(F.broadcast(slots), ["eps", "kind"])  # budgets times kinds
    flagged = tests.filter(10 * K.risk_tenths([F.col(b) for b in B]) >= F.col("slot") * F.col("txns")).select("eps", "rep", "kind", "fp")
    cells = settings(rows.sparkSession).filter("split = 'test'").select("eps", "rep").crossJoin(F.broadcast(slots.select("kind").distinct()))
    return judged(flagged, exact, ["eps", "rep"], cells), slots


#: Arms of the attack: what merchant 0 reveals and commits to, and whether filters are on.
ARMS = (("honest", True), ("hot_flood_no_defense", False), ("hot_flood_defended", True), ("commit_mismatch_defended", True))


def flooded(hist: DataFrame, merchant: int = 0) -> DataFrame:
    """All of a merchant's counts in the top bucket."""
    own = F.col("merchant") == merchant
    return hist.withColumns({b: F.when(own, total() if b == B[-1] else F.lit(0.0)).otherwise(F.col(b)) for b in B})


def attack_arms(rows: DataFrame, of: tuple[str, ...] = ("key",)) -> tuple[DataFrame, DataFrame]:
    """(arm, kind, flagged, tp, fp, fn on test), (arm, kind, merchant, reason, ratio): rings of whole splits without noise, thresholds from exact counts on val.

    Merchant 0 floods the top bucket of all its rings and commits to that, or commits to
    its honest counts and reveals the flood. rows: ring rows with split.
    """
    later = staged(rows.filter("split <> 'train'").select("split", "merchant", "kind", "key", "day", "score", "is_fraud"), "later")
    exact = staged(exact_rings(later, of), "exact")
    slots = staged(tuned(exact.withColumns({"eps": F.lit(0), "rep": F.lit(0)}), exact).select("kind", "slot"), "thresholds")
    hist = staged(merchant_hist(later.filter("split = 'test'"), of=of), "hist")
    committed, bad = staged(commitments(hist), "committed"), staged(flooded(hist), "flooded")
    flood = staged(commitments(bad), "committed")
    flagged = audit = None
    for arm, defend in ARMS:
        revealed, told = (hist, committed) if arm == "honest" else (bad, committed if arm.startswith("commit") else flood)
        sums = federated_sum(surviving(revealed, told, defend)).filter(f"merchants >= 2 and txns between {LOW} and {CAP}").join(F.broadcast(slots), "kind")  # a row for a kind
        one = sums.filter(10 * K.risk_tenths([F.col(b) for b in B]) >= F.col("slot") * F.col("txns")).select(F.lit(arm).alias("arm"), "kind", "fp")
        out = rejected(revealed, told) if defend else rejected(revealed, told).filter("reason = 'commit'")
        out = out.select(F.lit(arm).alias("arm"), "*")
        flagged, audit = (one, out) if flagged is None else (flagged.unionByName(one), audit.unionByName(out))
    cells = rows.sparkSession.createDataFrame([(a,) for a, _ in ARMS], "arm string").crossJoin(F.broadcast(slots.select("kind")))
    return judged(flagged, exact, ["arm"], cells), audit


# model updates: (by, merchant, idx, value), weights (merchant, rows, fraud_rows); ``by`` tells runs apart, a few
def _beside(df: DataFrame, few: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with the figures of its run."""
    return df.join(F.broadcast(few), list(by)) if by else df.crossJoin(F.broadcast(few))


def norm_filter(deltas: DataFrame, limit: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    n = staged(deltas.groupBy(*by, "merchant").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")), "norms")
    med = n.groupBy(*by).agg(F.percentile("norm", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n"))
    return _beside(n, med, by).select(*by, "merchant", "norm", ((F.col("n") < 3) | (F.col("norm") <= limit * F.col("m"))).alias("ok"))


def cosine_filter(deltas: DataFrame, k: float = 3.0, floor: float = 0.85, by: tuple[str, ...] = ()) -> DataFrame:
    mid = deltas.groupBy(*by, "idx").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    s = deltas.join(mid.hint("merge"), [*by, "idx"]).groupBy(*by, "merchant").agg(F.sum(F.col("value") * F.col("mid")).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("a"), F.sqrt(F.sum(F.col("mid") * F.col("mid"))).alias("b"))
    d = staged(s.select(*by, "merchant", F.when((F.col("a") == 0) | (F.col("b") == 0), 1.0).otherwise(1 - F.col("dot") / (F.col("a") * F.col("b"))).alias("distance")), "distances")
    med = d.groupBy(*by).agg(F.percentile("distance", F.lit(0.5)).alias("m"))
    dev = _beside(d, med, by).groupBy(*by).agg(F.first("m").alias("m"), F.percentile(F.abs(F.col("distance") - F.col("m")), F.lit(0.5)).alias("mad"))
    return _beside(d, dev, by).select(*by, "merchant", "distance", (F.col("distance") <= F.greatest(F.col("m") + k * F.col("mad"), F.lit(floor))).alias("ok"))


def weighted_mean(deltas: DataFrame, weights: DataFrame, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    w = weights.select("merchant", F.greatest(F.col(weight), F.lit(1)).alias("w"))
    return deltas.join(sized(staged(w, "weights")), "merchant").groupBy(*by, "idx").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def passing(deltas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, merchant of the updates that pass the filter of norms and then that of directions."""
    a = staged(norm_filter(deltas, by=by).filter("ok").select(*by, "merchant"), "kept")
    return staged(cosine_filter(deltas.join(a.hint("merge"), [*by, "merchant"], "left_semi"), by=by).filter("ok").select(*by, "merchant"), "kept")


def robust_aggregate(deltas: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fraud-weighted mean of the updates that pass both filters; no rows if fewer than two do."""
    b = passing(deltas, by)
    n = b.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    return _beside(weighted_mean(deltas.join(b.hint("merge"), [*by, "merchant"], "left_semi"), weights, "fraud_rows", by), n, by).select(*by, "idx", "value")


def private_update(deltas: DataFrame, epsilon: Column, seed: Column, clip: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Updates clipped to norm ``clip`` plus Gaussian noise for ``epsilon``; null is no clipping and no noise. The draw comes from ``seed`` (a secret keeps it unpredictable), merchant and idx."""
    norm = deltas.groupBy(*by, "merchant").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    noise = clip * K.gaussian_sigma(epsilon) * K.unit_noise(seed, F.col("merchant").cast("string"), F.col("idx").cast("string"))
    value = F.when(epsilon.isNull(), F.col("value")).otherwise(F.col("value") / F.greatest(F.col("_norm") / clip, F.lit(1.0)) + noise)
    return deltas.join(norm.hint("merge"), [*by, "merchant"]).withColumn("value", value).drop("_norm")
