"""Keyed streams against batch operators and plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ringsight.operators import features as X
from ringsight.operators import privacy as P
from ringsight.operators import rings as R
from ringsight.plans import learning
from ringsight.streaming import feeds

DAY = 86400
TXN = "txn_id long, t long, amount double, card1 long, account long, addr1 long, addr2 long, email_domain string, device_info string, browser string, score double, is_fraud int, shop long"


def row(txn_id, t, card=1, account=1, device=None, score=0.5, shop=0, addr=None):
    return (txn_id, t, 1.0, card, account, addr, 0, "x" if addr is not None else None, device, "b", score, 0, shop)


def deliver(spark, tmp_path, batches, run, late="1 hour"):
    """Each batch is delivered and taken up before the next."""
    for rows in batches:
        spark.createDataFrame(rows, TXN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(feeds.transaction_feed(spark, str(tmp_path / "in"), spark.createDataFrame([], TXN).schema, 10, late), str(tmp_path / "out"), str(tmp_path / "cp"))
    return str(tmp_path / "out")


def test_velocity_with_late_and_repeated_rows(spark, tmp_path):
    draw = random.Random(5)
    rows = [row(i, draw.randrange(40_000), draw.choice([None, 1, 2, 3]), draw.choice([None, 7, 8, 9, 10]), shop=draw.choice([None, 1, 2])) for i in range(300)]
    rows += [row(1_000 + i, 20_000, 1, i % 3, shop=i % 2) for i in range(4)]  # one second
    come = sorted(rows, key=lambda r: r[1] + draw.randrange(3_500))  # late by less than the watermark waits
    batches = [come[i : i + 60] for i in range(0, len(come), 60)]
    for i in range(1, len(batches)):
        batches[i] = batches[i] + batches[i - 1][-15:]  # told twice
    end = [(None, 60_000, *[None] * 11)]
    out = feeds.peers(spark, deliver(spark, tmp_path, [*batches, end], feeds.run_velocity))
    got = {r["txn_id"]: (r["accounts"], r["merchants"], r["cards"]) for r in out.collect()}
    want = {r["txn_id"]: (r["accounts"], r["merchants"], r["cards"]) for r in X.hour_peers(spark.createDataFrame(rows, TXN)).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(v == (0, 0, 0) for k, v in want.items() if k not in got)  # without card and account
    assert any(v[1] == 2 for v in got.values()) and any(v[2] == 3 for v in got.values())


def test_velocity_does_not_wait_for_what_is_complete(spark, tmp_path):
    first = [row(1, 100), row(2, 200, account=2), row(3, 9_000, 5, 5)]
    out = deliver(spark, tmp_path, [first], feeds.run_velocity)
    got = {r["txn_id"]: (r["accounts"], r["cards"]) for r in feeds.peers(spark, out).collect()}
    assert got == {1: (1, 1), 2: (2, 1)}  # the last hour is still open
    deliver(spark, tmp_path, [[row(4, 20_000, 5, 6)]], feeds.run_velocity)
    assert {r["txn_id"] for r in feeds.peers(spark, out).collect()} == {1, 2, 3}


def test_velocity_keeps_rows_of_pieces_not_of_keys(spark, tmp_path):
    """the state has a value for a window and a piece of the keys, however many keys there are; a crowded card is counted as in batch."""
    from ringsight.streaming import state

    draw = random.Random(11)
    rows = [row(i, draw.randrange(7_200), 100 + i, 5_000 + i, shop=i % 3) for i in range(1_500)]
    rows += [row(2_000 + i, 3_000 + i // 2, 1, i % 7, shop=i % 3) for i in range(1_500)]  # a card of an hour's middle
    batch = spark.createDataFrame(rows, TXN)
    batch.write.parquet(str(tmp_path / "in"))
    feed = feeds.transaction_feed(spark, str(tmp_path / "in"), batch.schema, 10)
    run = state.hour_peers(feed, feeds.EPOCH, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    assert 0 < max(held) <= 4 * 3  # windows that end with hours 1 to 3, four pieces each
    batch = spark.createDataFrame([row(None, 40_000, None, None)], TXN)
    feeds_out = deliver(spark, tmp_path / "whole", [rows, batch.collect()], feeds.run_velocity)
    got = {r["txn_id"]: (r["accounts"], r["merchants"], r["cards"]) for r in feeds.peers(spark, feeds_out).collect()}
    assert got == {r["txn_id"]: (r["accounts"], r["merchants"], r["cards"]) for r in X.hour_peers(spark.createDataFrame(rows, TXN)).collect()}


def alerts(spark, path):
    return sorted((r["kind"], r["key"], r["t"], r["members"], round(r["score_mean"], 6)) for r in spark.read.parquet(path).collect())


def test_ring_is_told_again_after_it_was_not_flagged(spark, tmp_path):
    """Flagged, gone after a week, flagged again: two alerts; nothing while it stays flagged."""
    hot = lambda i, t, a, s=0.9: row(i, t, a, a, "D 1", s)
    batches = [
        [hot(1, DAY, 1), hot(2, DAY + 5, 2)],  # flagged
        [hot(3, 2 * DAY, 3)],  # still
        [hot(4, 3 * DAY, 4, 0.0), hot(6, 3 * DAY, 4, 0.0), hot(7, 3 * DAY, 4, 0.0), hot(8, 3 * DAY, 4, 0.0), hot(9, 3 * DAY, 4, 0.0)],  # the mean falls: 2.7 over 8
        [hot(11, 8 * DAY + 10, 5)],  # the first two have left
        [row(12, 12 * DAY, 9, 9, "E 2", 0.1)],  # only the row of day 8 is left: one member
        [hot(13, 12 * DAY + 60, 6)],  # two again
        [hot(13, 12 * DAY + 60, 6), hot(14, 12 * DAY + 90, 6)],  # a repeated row, and still flagged
    ]
    got = alerts(spark, deliver(spark, tmp_path, batches, feeds.run_rings, "0 seconds"))
    assert [x[:4] for x in got if x[0] == "device"] == [("device", "D 1|b", DAY + 5, 2), ("device", "D 1|b", 12 * DAY + 60, 2)]


def test_card_rings_of_live_rows(spark, tmp_path):
    got = alerts(spark, deliver(spark, tmp_path, [[row(5, 100, 3, 1), row(10, 200, 3, 2), row(11, 300, 4, 1), row(12, 310, 4, 2)]], feeds.run_rings, "0 seconds"))
    assert got == [("card", "3", 310, 2, 0.5)]  # rows 11 and 12 are replayed


def test_crowded_rings_and_their_return(spark, tmp_path):
    """Over the cap nothing is told; when members leave, a ring is told from rows that were kept."""
    crowd = [row(i, 1_000 + i, i, i, "D 1", 0.9) for i in range(30)]
    batches = [crowd, [row(100 + i, 5 * DAY + i, 50 + i, 50 + i, "D 1", 0.8) for i in range(10)], [row(200, 8 * DAY, 70, 70, "E 2", 0.0)]]
    got = alerts(spark, deliver(spark, tmp_path, batches, feeds.run_rings, "0 seconds"))
    assert got == [("device", "D 1|b", 8 * DAY, 10, 0.8)]


def plain_alerts(batches, threshold=0.35, cap=25):
    seen, before, out, clock = {}, set(), [], 0
    for rows in batches:
        for r in rows:
            seen[r[0]] = r
            clock = max(clock, r[1])
        rings = defaultdict(list)
        for r in seen.values():
            if clock - 7 * DAY <= r[1] <= clock:
                if r[8] is not None and any(c in "0123456789 " for c in r[8]):
                    rings["device", f"{r[8]}|{r[9]}"].append((r[4], r[10]))
                if r[0] % 5 == 0 and r[3] is not None:
                    rings["card", str(r[3])].append((r[4], r[10]))
        now = set()
        for k, m in rings.items():
            n, mean = len({a for a, _ in m} - {None}), sum(s for _, s in m) / len(m)
            if 2 <= n <= cap and mean >= threshold:
                now.add(k)
                if k not in before:
                    out.append((*k, clock, n, round(mean, 6)))
        before = now
    return sorted(out)


def test_alerts_match_plain_python(spark, tmp_path):
    draw = random.Random(8)
    rows = sorted((row(i, draw.randrange(25 * DAY), draw.choice([None, 1, 2, 3]), draw.choice([None, *range(40 if i % 3 else 4)]), draw.choice([None, "Windows", "D 1", "D 2", "D3"]), draw.random() * 0.7) for i in range(700)), key=lambda r: r[1])
    rows = [r for i, r in enumerate(rows) if i == 0 or r[1] != rows[i - 1][1]]
    batches = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    want = plain_alerts(batches)
    assert alerts(spark, deliver(spark, tmp_path, batches, feeds.run_rings, "0 seconds")) == want and len(want) > 5


def test_sliding_weeks_count_members_up_to_the_cap(spark, tmp_path):
    one = [row(i, DAY + i, i, i % 24, "D 1", 0.5) for i in range(60)]
    two = [row(100 + i, 4 * DAY + i, i, 20 + i, "D 1", 0.7) for i in range(5)]  # the union has 25 members
    three = [row(200, 5 * DAY, 1, 999, "D 1", 0.6), row(201, 5 * DAY, 1, None, "D 1", 0.6)]
    out = deliver(spark, tmp_path, [one, two, three], feeds.run_sliding)
    got = {r["day"]: (r["txns"], r["members"], r["in_window"], r["flagged"]) for r in feeds.last_sliding(spark, out).collect()}
    assert got[-1] == (65 + 2, 26, False, False) and got[-2] == (65, 25, True, True) and got[-5] == (60, 24, True, True) and got[2] == (7, 6, True, True) and got[5] == (2, 1, False, False)


def test_live_detection_adds_only_what_changed(spark, tmp_path):
    one = [row(5 * i, 100 + i, i % 4, 1, shop=i % 3, score=0.9) for i in range(24)]
    two = [row(1_000, 5_000, 2, 1, shop=5, score=0.1), row(1_001, 5_000, 3, 1, shop=5, score=0.1)]  # the second is replayed
    out = deliver(spark, tmp_path, [one, two], feeds.run_fed_detect)
    assert spark.read.parquet(out).filter("batch > 0").count() == 1
    got = {r["fp"]: (r["merchants"], r["txns"], r["flagged"]) for r in feeds.fed_detected(spark, out).collect()}
    live = R.with_source(spark.createDataFrame(one + two, TXN)).filter("source = 'live'").select(F.col("shop").alias("merchant"), F.lit("card").alias("kind"), F.col("card1").cast("string").alias("key"), "score")
    hist = P.merchant_hist(live, P.LIVE_SECRET, of=("key",)).cache()
    want = P.fed_rings(hist, P.commitments(hist), 0.35, defend=False, cap=25).filter("merchants >= 2")
    assert got == {r["fp"]: (r["merchants"], r["txns"], r["flagged"]) for r in want.collect()} and sorted(v[1] for v in got.values()) == [6, 6, 6, 7] and len(got) == 4
    raw = spark.read.parquet(out)
    assert "card1" not in raw.columns and not {r["fp"] for r in raw.collect()} & {"0", "1", "2", "3"}


def test_live_detection_is_delivered_what_it_reads(spark, monkeypatch):
    """the feed has the columns that are read and no more; with all columns the same comes out."""
    seen, feed = [], feeds.transaction_feed
    monkeypatch.setattr(feeds, "transaction_feed", lambda spark, path, schema, *a: seen.append(set(schema.names)) or feed(spark, path, schema, *a))
    got = learning.detected(spark, "/root/testdata/sf0.001", 8.0).collect()
    assert len(seen) == 3 and all(x == {"split", *feeds.DETECTS} for x in seen)
    wide = learning.delivered(spark, "/root/testdata/sf0.001", lambda rows, path, mark: feeds.run_fed_detect(rows, path, mark, 8.0))
    names = ["kind", "fp", "merchants", "txns", "risk_est", "flagged"]
    want = feeds.fed_detected(spark, wide).withColumn("risk_est", F.round("risk_est", 9)).select(*names).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want)) and "email_domain" in seen[-1]
