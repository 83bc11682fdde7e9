"""Components over sliding windows against union-find over each day's rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ringsight.operators import graph, sliding

TXN = "txn_id long, t long, card1 long, account long, device_info string, browser string"
DAY = 86400


def plain(rows, causal=False):
    """txn_id -> size, cards, devices, accounts, rate; and each day's sorted figures."""
    out, days = {}, {}
    for day in range(min(r[1] for r in rows) // DAY, max(r[1] for r in rows) // DAY + 1):
        held = [r for r in rows if (day - 7) * DAY < r[1] < (day + (not causal)) * DAY]
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        dev = lambda r: None if r[4] is None else ("v", r[4], r[5])
        for r in held:
            up[top(("c", r[2]))] = top(dev(r) or ("c", r[2]))
        by = defaultdict(list)
        for r in held:
            by[top(("c", r[2]))].append(r)
        figures = {}
        for k, m in by.items():
            ts = [r[1] for r in m]
            figures[k] = (len(m), len({r[2] for r in m}), len({dev(r) for r in m} - {None}), len({r[3] for r in m} - {None}), round(len(m) / max((max(ts) - min(ts)) / 3600, 1 / 60), 6))
        days[day] = sorted(figures.values())
        for r in rows:
            if r[1] // DAY == day:
                out[r[0]] = figures.get(top(("c", r[2])), (None,) * 5)
    return out, {d: f for d, f in days.items() if f}


COLUMNS = ("comp_size", "comp_cards", "comp_devices", "comp_accounts", "comp_rate")


def compared(spark, rows, causal=False):
    txn = spark.createDataFrame(rows, TXN)
    one = lambda r: tuple(round(r[c], 6) if c == "comp_rate" and r[c] is not None else r[c] for c in COLUMNS)
    want, days = plain(rows, causal)
    assert {r["txn_id"]: one(r) for r in sliding.component_features(txn, causal).collect()} == want
    got = defaultdict(list)
    for r in sliding.component_stats(sliding.sliding_components(txn, causal)).collect():
        got[r["day"]].append(one(r))
    assert {d: sorted(f) for d, f in got.items()} == days
    return want


def test_window_borders_and_cards_without_device(spark):
    rows = [
        (1, 20 * DAY + 100, 1, 10, "D", "b"), (2, 20 * DAY + 500, 2, 20, None, None), (3, 20 * DAY + 900, 2, 21, None, "b"),  # card 2 has no device
        (4, int(12.75 * DAY), 3, 30, "D", "b"),  # 7.5 days before noon of day 20: its day began eight days back, out of reach
        (5, int(13.5 * DAY), 4, 40, "D", "b"),  # within the window of day 20
        (6, 13 * DAY, 5, 50, "D", "b"),  # a day's first second: out of the window that begins there
        (7, 13 * DAY + 1, 6, 60, "D", "b"), (8, 21 * DAY, 1, 10, None, None), (9, 19 * DAY + 5, 6, None, None, None),
    ]
    want = compared(spark, rows)
    assert want[2] == want[3] == (2, 1, 0, 2, round(2 / (400 / 3600), 6))
    assert want[1][:4] == (4, 3, 1, 3)  # rows 1, 5, 7 and 9; row 9 has no account
    causal = compared(spark, rows, True)
    assert causal[4] == causal[2] == (None,) * 5 and causal[8][:2] == (1, 1) and causal[9][:2] == (4, 4)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("causal", [False, True])
def test_random_rows(spark, seed, causal):
    draw = random.Random(seed)
    cards, devices = (6, 4) if seed == 1 else (25, 30)
    rows = [
        (i, draw.choice([draw.randrange(25 * DAY), DAY * draw.randrange(25)]) if draw.random() < 0.9 else 30 * DAY, draw.choice([None, *range(cards)]), draw.choice([None, *range(20)]), draw.choice([None, *[f"d{k}" for k in range(devices)]]), draw.choice([None, "x"]))
        for i in range(150)
    ]
    compared(spark, rows, causal)


def test_empty_table(spark):
    none = spark.createDataFrame([], TXN)
    assert sliding.component_features(none).count() == 0 and sliding.component_stats(sliding.sliding_components(none)).count() == 0


@pytest.mark.parametrize("piece", [3, 50, 100_000])
def test_pieces_make_the_same_components(spark, piece):
    draw = random.Random(piece)
    edges = [(g, draw.randrange(60), draw.randrange(60)) for g in range(3) for _ in range(45)] + [(9, 5, 5), (9, None, 1)]
    df = spark.createDataFrame(edges, "g long, src long, dst long")
    got = {(r["g"], r["node"]): r["component"] for r in graph.grouped_components(df, ["g"], piece).collect()}
    assert got == {(r["g"], r["node"]): r["component"] for r in graph.connected_components(df, ["g"]).collect()} and (9, 5) in got


def test_hot_card_and_device(spark):
    """A card that holds most rows of every day."""
    x = spark.range(3_000).select(F.col("id").alias("txn_id"), (F.col("id") * 400).alias("t"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("long").alias("card1"), (F.col("id") % 7).alias("account"), F.when(F.col("id") % 3 == 0, "hot").alias("device_info"), F.lit("b").alias("browser"))
    rows = [tuple(r) for r in x.collect()]
    got = {r["txn_id"]: r["comp_size"] for r in sliding.component_features(x).collect()}
    assert got == {k: v[0] for k, v in plain(rows)[0].items()}
