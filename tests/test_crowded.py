"""Tables without any ring in the window: each query tells what its SQL tells."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ringsight.plans import catalog
from ringsight.streaming import feeds

SF = "/root/testdata/sf0.001"
#: Rows with neither device nor address; or all rows of a device and address, with members beyond any cap.
NONE, CROWD = '{"k": 35}', '{"k": 2}'


@pytest.fixture(scope="module", params=["none", "crowd"])
def odd(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    events = spark.read.parquet(f"{SF}/events.parquet")
    if request.param == "crowd":
        day = F.expr("make_timestamp_ntz(2024, 1, 1 + cast(event_id / 100 as int), 12, 0, cast(event_id % 60 as int))")
        events = events.withColumns({"user_id": 40 * F.col("event_id"), "event_type": F.lit("click"), "ts": day, "props": F.lit(CROWD)})
    else:
        events = events.withColumn("props", F.lit(NONE))
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def told(spark, path, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, path).select(*want.columns).collect()
    plain = lambda rows: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    return plain(got), plain(want.fetchall())


def test_alert_reduction_without_rings(spark, odd):
    got, want = told(spark, odd, "alert_reduction")
    assert got == want and got[0][-1] == math.inf and got[0][1] == 0


def test_kind_rollup_without_rings(spark, odd):
    got, want = told(spark, odd, "kind_rollup")
    assert got == want == [("combined", 0, 0, 0, 0, 0, 0)]


def test_set_precision_recall_without_rings(spark, odd):
    got, want = told(spark, odd, "set_precision_recall")
    assert got == want == [(0, 0, 0, 0, 0, 0)]


def test_ring_report_without_rings(spark, odd):
    got, want = told(spark, odd, "ring_report")
    assert got == want and [r[0] for r in got] == ["combined"] and got[0][1] == 0


def test_ring_report_of_a_kind_without_frauds(spark, tmp_path):
    """Address rings without any fraud are told, with no frauds in them."""
    x = spark.read.parquet(f"{SF}/events.parquet")
    quiet = F.col("event_id") % 29 == 0
    x.filter(~quiet).withColumns({"user_id": 7 * F.col("event_id"), "value": F.lit(50.0), "event_type": F.lit("click"), "props": F.lit('{"k": 10}')}).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = told(spark, str(tmp_path), "ring_report")
    assert got == want and {r[0] for r in got} == {"address", "combined"}


def test_central_vs_fed_without_thresholds(spark, odd):
    """Without any threshold neither arm tells anything."""
    got, want = told(spark, odd, "central_vs_fed")
    assert got == want and {r[0] for r in got} in (set(), {"central", "federated"})


def test_central_vs_fed_with_thresholds_under_noise_only(spark, tmp_path):
    """Rings of one payment each count only once noise is added: central rings of their kind are told too."""
    x = spark.read.parquet(f"{SF}/events.parquet")
    x.withColumns({"event_type": F.lit("signup"), "props": F.format_string('{"k": %d}', "event_id")}).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = told(spark, str(tmp_path), "central_vs_fed")
    assert got == want and [r[:2] for r in got] == [("central", "combined"), ("central", "device"), ("federated", "combined"), ("federated", "device")]


def test_ring_at_the_threshold_is_alerted(spark, tmp_path):
    """The mean of .005, .345 and .7 is .35, though their sum in order comes out lower."""
    rows = [(i, 100 + i, 1.0, i, i, None, 0, None, "D 1", "b", s, 0, 0) for i, s in enumerate((0.005, 0.345, 0.7), 1)]
    schema = "txn_id long, t long, amount double, card1 long, account long, addr1 long, addr2 long, email_domain string, device_info string, browser string, score double, is_fraud int, shop long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    feeds.run_rings(feeds.transaction_feed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 10, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r["kind"], r["members"], r["score_mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("device", 3, 0.35)]
