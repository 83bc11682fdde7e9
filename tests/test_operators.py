import hashlib
import hmac
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators import features, graph, metrics, privacy
from ringsight.streaming import feeds


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (205, 201), (201, 203), (None, 1)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == 100 and {got[i] for i in (201, 203, 205)} == {201}
    two = spark.createDataFrame([(1, 5, 6), (2, 6, 7), (2, 7, 8)], "day long, src long, dst long")
    assert sorted(tuple(r) for r in graph.connected_components(two, ["day"]).collect()) == [(1, 5, 5), (1, 6, 5), (2, 6, 6), (2, 7, 6), (2, 8, 6)]


def test_hmac_and_edges(spark):
    r = spark.range(1).select(K.hmac_sha256(b"s", F.lit("é")).alias("a"), K.hmac_sha256(b"k" * 70, F.lit("x")).alias("b"), *[K.risk_bucket(F.lit(x)).alias(f"e{i}") for i, x in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 1.0))]).first()
    assert r["a"] == hmac.new(b"s", "é".encode(), "sha256").hexdigest() and r["b"] == hmac.new(b"k" * 70, b"x", "sha256").hexdigest()
    assert [r[f"e{i}"] for i in range(6)] == [0, 1, 2, 3, 4, 4]


def test_merkle(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def root(level):
        if not level:
            return sha(b"")
        while len(level) > 1:
            level = [sha(bytes.fromhex(level[i] + level[min(i + 1, len(level) - 1)])) for i in range(0, len(level), 2)]
        return level[0]

    for n in (0, 1, 3, 5):
        leaves = [(i, sha(bytes([i]))) for i in range(n)]
        assert privacy.merkle_root(spark.createDataFrame(leaves, "pos long, digest string")).first()["root"] == root([d for _, d in leaves])


def test_metrics_ties(spark):
    rows = [(0.9, 1, 1.0), (0.9, 0, 1.0), (0.5, 1, 2.0), (0.1, 0, 1.0)]
    df = spark.createDataFrame(rows, "score double, is_fraud int, amount double")
    assert abs(metrics.pr_auc(df).first()[0] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert metrics.roc_auc(df).first()[0] == 0.625
    c = metrics.confusion(df.limit(0), F.lit(0.5)).first()
    assert c["precision"] == 0 and c["f1"] == 0


def test_streams_equal_batch(spark, tmp_path):
    from ringsight.plans.rowwise import txn

    x = txn(spark, "/root/testdata/sf0.001")
    twice = x.unionByName(x.filter("txn_id % 10 = 0"))
    cuts = [None, *x.approxQuantile("t", [0.25, 0.5, 0.75], 0), None]
    for low, high in zip(cuts, cuts[1:], strict=False):  # one after another: a feed comes in time order, files of one write come in any
        part = twice.filter((F.col("t") > low) if low is not None else F.lit(True)).filter((F.col("t") <= high) if high is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = feeds.transaction_feed(spark, str(tmp_path / "in"), x.schema)
    feeds.run_available(feeds.deduplicated(feed), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == x.count()


def test_quantiles_at_any_size(spark):
    rows = [(float(v),) for v in [3, 1, 1, 7, 9, 9, 9, 2, 5, 5.5]] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = np.quantile([r[0] for r in rows[:-1]], shares).tolist()
    for most in (3, 1000):
        assert np.allclose(metrics.quantiles(df, "x", shares, most), want)
    assert metrics.quantiles(df.limit(0), "x", [0.5]) == [None]


def test_hot_nodes_have_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 3)
    star = [(i, 0) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(9)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(star, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[100 + i] == 100 for i in range(10))


@pytest.mark.parametrize("hot", [0, 60, 10_000])
def test_velocity_over_buckets(spark, hot):
    """All keys hot, some or none; rows in weeks far apart and on their borders, against plain Python."""
    rng = np.random.default_rng(2)
    times = sorted({*rng.integers(0, 40 * 86400, 150).tolist(), 604799, 604800, 604801, 1209600, 0, 86400})
    rows = [(i, int(t), int(rng.integers(0, 3)), float(i % 7)) for i, t in enumerate(times)] + [(500, times[5], 1, 2.0), (501, times[5], 1, 3.0)]
    df = spark.createDataFrame(rows, "txn_id long, t long, card1 long, amount double")
    got = {r["txn_id"]: r for r in features.velocity(df, "card1", hot).collect()}
    assert len(got) == len(rows)
    for i, t, c, _ in rows:
        mine = [(x[1], x[3]) for x in rows if x[2] == c]
        day, week = [a for u, a in mine if t - 86400 <= u < t], [a for u, a in mine if t - 604800 <= u < t]
        before = [x[1] for x in rows if x[2] == c and (x[1], x[0]) < (t, i)]
        r = got[i]
        assert (r["n_24h"], r["n_7d"], r["sum_24h"], r["gap"]) == (len(day), len(week), sum(day), t - max(before) if before else None)


def test_unfinished_caches_are_built_again(spark, tmp_path):
    from ringsight.sources import files

    df = spark.range(3)
    (tmp_path / "v=1" / "_temporary").mkdir(parents=True)
    got = files.cache_features(spark, str(tmp_path), 1, df.schema, lambda: df)
    assert got.count() == 3 and files.cache_features(spark, str(tmp_path), 1, df.schema, lambda: df.limit(0)).count() == 3
    assert files.stored(spark, str(tmp_path / "absent"), df.schema).count() == 0


@pytest.mark.parametrize("hot", [0, 40, 10_000])
def test_fanout_and_peers_of_hot_keys(spark, hot):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3_000_000)) if i % 3 else 1_000_000 + i, int(c) if (c := rng.choice([1, 1, 1, 2, 3, 0])) else None, int(a) if (a := rng.integers(0, 6)) else None, int(rng.integers(0, 3))) for i in range(160)]
    df = spark.createDataFrame(rows, "txn_id long, t long, card1 long, account long, shop long")
    got = {r["txn_id"]: r["n"] for r in features.fanout(df, "card1", "account", "n", hot=hot).collect()}
    assert got == {i: len({x[3] for x in rows if x[2] == c and (x[1], x[0]) < (t, i)}) for i, t, c, a, s in rows}
    peers = {r["txn_id"]: (r["accounts"], r["merchants"], r["cards"]) for r in features.hour_peers(df, hot).collect()}
    for i, t, c, a, s in rows:
        own = [x for x in rows if x[2] == c and t - 3600 <= x[1] < t] if c is not None else []
        far = [x for x in rows if x[3] == a and t - 3600 <= x[1] < t] if a is not None else []
        assert peers[i] == (0 if c is None else len(({x[3] for x in own} | {a}) - {None}), len({x[4] for x in own}), len(({x[2] for x in far} | {c}) - {None}) if a is not None else 0)


def test_scratch_deletes_what_was_written_within(spark):
    from ringsight import session

    before = session.staged(spark.range(3), "before")
    with session.scratch(spark):
        within = session.staged(spark.range(4), "within")
        path = within.inputFiles()[0]
        assert within.count() == 4
    assert before.count() == 3 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
