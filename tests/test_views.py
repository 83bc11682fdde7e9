"""Views with parameters, padding, and reports whose maps are keyed by names."""

import json

import pytest
from pyspark.sql import functions as F

from ringsight.operators import privacy as P
from ringsight.operators import rings as R
from ringsight.operators import views as V
from ringsight.sources import files

TXN = "txn_id long, t long, amount double, card1 long, account long, addr1 long, addr2 long, email_domain string, device_info string, browser string, score double, is_fraud int, shop long"


@pytest.fixture(scope="module")
def txn(spark):
    rows = [(i, 1_000 * i, 1.0, i % 4, i % 7, None, 0, None, ["D 1", "D 2", None][i % 3], "b", (i % 10) / 10 if i else None, i % 2, i % 3) for i in range(1_200)]
    return R.with_source(spark.createDataFrame(rows, TXN)).cache()


def test_transactions(txn):
    ids = lambda **x: [r["txn_id"] for r in V.transactions(txn, **x).collect()]
    assert ids(limit=5) == [1199, 1198, 1197, 1196, 1195] and len(ids(limit=5_000)) == 1_000 and len(ids()) == 100 and ids(limit=0) == ids(limit=-3) == []
    assert all(i % 10 >= 5 for i in ids(flagged=True)) and all(i % 10 < 5 for i in ids(flagged=False)) and 0 in ids(flagged=False, source="live", limit=1_000)
    assert all(i % 5 == 0 for i in ids(source="live")) and all(i % 5 for i in ids(source="replay"))
    assert ids(ring=("device", "D 1|b"), limit=3) == [1197, 1194, 1191] and ids(ring=("card", "3"), limit=2) == [1195, 1175] and ids(ring=("card", "none")) == []


def test_rings_and_detail(txn):
    table = R.live_agg(R.live_rows(txn), 0.4).cache()
    key = lambda rows: [(r["kind"], r["key"]) for r in rows]
    ranked = V.ranked_rings(table, 3).collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and all(r["flagged"] for r in ranked) and [r["score_mean"] for r in ranked] == sorted((r["score_mean"] for r in ranked), reverse=True)
    assert len(V.ranked_rings(table, 0).collect()) == 1 and V.ranked_rings(table.filter("false"), 5).count() == 0
    assert key(V.rings(table, flagged=True, limit=3).collect()) == key(ranked) and all(r["kind"] == "card" for r in V.rings(table, kind="card").collect())
    assert all(r["source"] == "mixed" for r in V.rings(table, source="mixed").collect()) and V.rings(table, kind="device", source="live").count() == 0
    got = V.ring_detail(table, R.live_rows(txn), ("device", "D 1|b"), 4).orderBy("n").collect()
    assert [(r["n"], r["txn_id"]) for r in got] == [(1, 0), (2, 3), (3, 6), (4, 9)] and got[0]["window_hours"] == pytest.approx(1_197_000 / 3600)
    assert V.ring_detail(table, R.live_rows(txn), ("device", "gone")).count() == 0


def test_alerts_and_disputes(spark, txn):
    told = spark.createDataFrame([("device", "D 1|b", 1_190_000, 0.7)], "kind string, key string, t long, score_mean double")
    table = V.alert_table(txn, told)
    assert [(r["kind"], r["subject"]) for r in V.alerts(table, limit=7).collect()][-2:] == [("ring", "device|D 1|b"), ("txn", "1189")] and V.alerts(table, kind="ring").first()["subject"] == "device|D 1|b"
    assert V.alerts(table, limit=9_999).count() == 500
    d = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("c", 3, 9)], "dispute_id string, txn_id long, dt long")
    assert [r["dispute_id"] for r in V.disputes(d).collect()] == ["b", "c", "a"] and [r["dispute_id"] for r in V.disputes(d, 1).collect()] == ["b"]


def test_snapshots_of_the_live_window(txn):
    now, before = R.live_rings(txn, 0, 0.0), R.live_rings(txn, 600_000, 0.0)
    assert {r["t1"] for r in now.collect()} != {r["t1"] for r in before.collect()} and R.newly_flagged(now, now).count() == 0
    assert max(r["t1"] for r in before.collect()) <= 1_199_000 - 600_000 and min(r["t0"] for r in now.collect()) >= 1_199_000 - 604_800


def test_padding_hides_presence(spark):
    """Without padding what is absent is never released; with it present and absent fingerprints are."""
    rows = [(m, "device", f"{i:016x}", 0.0, 1.0, 0.0, 0.0, 0.0) for m in range(2) for i in range(300) if i % 2 == m]
    hist = spark.createDataFrame(rows, "merchant long, kind string, fp string, b0 double, b1 double, b2 double, b3 double, b4 double")
    have = {(r[0], r[2]) for r in rows}
    seen = lambda h: {(r["merchant"], r["fp"]) for r in P.dp_release(h, F.lit("s"), F.lit(1.0)).collect()}
    assert seen(hist) <= have
    full = P.padded(hist)
    assert full.count() == 600 and full.agg(F.sum("b1")).first()[0] == 300
    got = seen(full)
    assert abs(len(got - have) / 300 - len(got & have) / 300) < 0.1 and len(got - have) > 100
    one = P.padded(hist.filter("merchant = 0"), spark.createDataFrame([("device", "x")], "kind string, fp string"))
    assert [(r["merchant"], r["fp"], r["b1"]) for r in one.collect()] == [(0, "x", 0.0)]


def test_sections_of_a_report(spark, tmp_path):
    """The shape that experiments publish: notes, objects of objects, a list with a budget each."""
    report = {
        "meta": {"seed": 42, "dp": {"delta": 1e-05}, "limits": ["a", "b"]},
        "ground_truth": {"device": {"fraud_rings": 100, "single": 17}, "address": {"fraud_rings": 38}},
        "dp_sweep": [{"epsilon": None, "thresholds": {"device": 0.17}, "device": {"f1": 0.6}, "merkle_root": "ab", "rejections": []}, {"epsilon": 8.0, "n_repeats": 5, "device": {"f1": 0.4, "f1_std": 0.01, "note": "x"}}],
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    got = {tuple(r) for r in files.sectioned(spark, str(tmp_path / "r.json"), ["ground_truth"], ["dp_sweep"]).collect()}
    want = {("ground_truth", None, "device", "fraud_rings", 100.0), ("ground_truth", None, "device", "single", 17.0), ("ground_truth", None, "address", "fraud_rings", 38.0)}
    want |= {("dp_sweep", None, "thresholds", "device", 0.17), ("dp_sweep", None, "device", "f1", 0.6), ("dp_sweep", 8.0, "device", "f1", 0.4), ("dp_sweep", 8.0, "device", "f1_std", 0.01)}
    assert got == want
    lines = spark.createDataFrame(sorted(want, key=str), "section string, setting double, name string, metric string, value double")
    files.sink_sectioned(lines, str(tmp_path / "out"), ["dp_sweep"])
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert json.loads(text)["ground_truth"] == report["ground_truth"] and json.loads(text)["dp_sweep"][1]["epsilon"] == 8.0
    assert {tuple(r) for r in files.sectioned(spark, str(tmp_path / "out"), ["ground_truth"], ["dp_sweep"]).collect()} == want
