"""Rings, commitments and filters on hand-made rows."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ringsight.operators import features as X
from ringsight.operators import privacy as P
from ringsight.operators import rings as R

ROWS = "kind string, key string, day long, t long, card1 long, account long, merchant long, score double, amount double, is_fraud int"


@pytest.mark.parametrize("crowded", [0, 3, 10_000])
@pytest.mark.parametrize("by", [R.DAILY, R.WHOLE])
def test_distinct_counts_in_two_levels(spark, crowded, by):
    rows = [("address" if i % 2 else "device", f"k{i % 3}", i % 4, 10 * i, i % 7 if i % 5 else None, i % 11, i % 2 if i % 9 else None, i / 100, 1.5, int(i % 6 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, ROWS)
    told = R.figures() | {"frauds": (F.sum("is_fraud").cast("long"), "sum")}
    got = {tuple(r[c] for c in by): r.asDict() for r in R.grouped(df, by, told, crowded).collect()}
    at = {c: i for i, c in enumerate(("kind", "key", "day"))}
    want = {}
    for r in rows:
        want.setdefault(tuple(r[at[c]] for c in by), []).append(r)
    assert got.keys() == want.keys()
    for k, m in want.items():
        sets = {n: len({r[i] for r in m} - {None}) for n, i in (("cards", 4), ("accounts", 5), ("merchants", 6))}
        sets |= {"members": sets["cards" if k[0] == "address" else "accounts"], "txns": len(m), "frauds": sum(r[9] for r in m), "t0": min(r[3] for r in m), "t1": max(r[3] for r in m)}
        assert {n: got[k][n] for n in sets} == sets and got[k]["score"] == pytest.approx(sum(r[7] for r in m))


def test_ring_agg_makes_no_copies_of_rows(spark):
    df = spark.createDataFrame([("device", "k", 1, 1, 1, 1, 1, 0.5, 1.0, 1)], ROWS)
    plan = R.ring_agg(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def hist(spark, n, merchants=(1, 2, 3)):
    fp = F.substr(F.sha2(F.col("id").cast("string"), 256), F.lit(1), F.lit(16))
    m = F.element_at(F.array(*map(F.lit, merchants)), (F.col("id") % len(merchants) + 1).cast("int"))
    return spark.range(n).select(m.cast("long").alias("merchant"), F.when(F.col("id") % 2 == 0, "device").otherwise("address").alias("kind"), fp.alias("fp"), *[(F.col("id") % (i + 2)).cast("double").alias(b) for i, b in enumerate(P.B)])


def plain_root(rows, depth, prefix=""):
    if len(prefix) == depth:
        return hashlib.sha256(",".join(sorted(":".join([r["fp"], *[f"{r[b]:.1f}" for b in P.B]]) for r in rows)).encode()).hexdigest()
    kids = sorted({r["fp"][: len(prefix) + 1] for r in rows})
    return hashlib.sha256(",".join(f"{k}:{plain_root([r for r in rows if r['fp'].startswith(k)], depth, k)}" for k in kids).encode()).hexdigest()


def test_chunk_trees_and_proofs(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAF", 4)  # merchants with 4, 64 and more rows have trees of depth 1, 2 and 3
    h = hist(spark, 400, (1, 1, 1, 1, 2, 1, 1, 1, 1, 3)).unionByName(hist(spark, 6, (7,))).cache()
    nodes = P.chunk_digests(h).cache()
    rows = h.collect()
    got = {(r["kind"], r["merchant"]): r["digest"] for r in P.commitments(h).collect()}
    assert len(got) == len({(r["kind"], r["merchant"]) for r in rows})
    for (kind, m), digest in got.items():
        own = [r for r in rows if (r["kind"], r["merchant"]) == (kind, m)]
        depth = sum(len(own) > 4 * 16**i for i in range(8))
        assert digest == plain_root(own, depth)
    leaf = nodes.filter("kind = 'device' and merchant = 1 and depth = 2").first()
    proof = {r["prefix"]: r["digest"] for r in P.chunk_proof(nodes, 1, leaf["prefix"], {"kind": "device"}).collect()}
    assert proof[leaf["prefix"]] == leaf["digest"] and {len(p) for p in proof} == {1, 2} and len(proof) <= 32
    up = lambda at: hashlib.sha256(",".join(f"{p}:{d}" for p, d in sorted(proof.items()) if len(p) == len(at) + 1 and p.startswith(at)).encode()).hexdigest()
    assert up(leaf["prefix"][:1]) == proof[leaf["prefix"][:1]] and up("") == got[("device", 1)]  # the owner's leaf leads to the root


def test_filters_see_each_kind_apart(spark):
    rows = [(m, k, f"{m}{k}", 10.0, 0.0, 0.0, 0.0, 5.0 if (m, k) == (1, "device") else 0.0) for m in range(4) for k in ("device", "address")] + [(9, "address", "9", 0.0, 0.0, 600.0, 0.0, 0.0)]
    got = {(r["kind"], r["merchant"]): r["reason"] for r in P.outliers(spark.createDataFrame(rows, "merchant long, kind string, fp string, b0 double, b1 double, b2 double, b3 double, b4 double")).collect()}
    assert got == {(k, m): None for m in range(4) for k in ("device", "address")} | {("address", 9): "volume", ("device", 1): "risk"}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_roots_of_groups_of_any_size(spark, n):
    leaf = lambda k, i: hashlib.sha256(f"{k}{i}".encode()).hexdigest()
    sizes = {"a": n, "b": 4, "c": 1}
    df = spark.createDataFrame([(k, i, leaf(k, i)) for k, m in sizes.items() for i in range(m)], "kind string, pos long, digest string")

    def root(level):
        while len(level) > 1:
            level = [hashlib.sha256(bytes.fromhex(level[i] + (level[i + 1] if i + 1 < len(level) else level[i]))).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    assert {r["kind"]: r["root"] for r in P.merkle_root(df, ("kind",)).collect()} == {k: root([leaf(k, i) for i in range(m)]) for k, m in sizes.items()}


def test_rules_by_hand(spark):
    rows = [(1, 1, 10, 5, 0.0, None), (2, 1, 11, 6, 2.5, "mail.com"), (3, 2, 11, 6, 3000.0, "MAIL.com"), (4, 1, 12, 7, None, None)]
    df = spark.createDataFrame([(i, 100 * i, c, a, s, x, e, False) for i, c, a, s, x, e in rows], "txn_id long, t long, card1 long, account long, shop long, amount double, email_domain string, international boolean")
    got = {r["txn_id"]: (round(r["rule_score"], 9), r["reasons"]) for r in X.rules_score(X.hour_peers(df)).collect()}
    assert got[1] == (0.05, "") and got[2] == (round(0.05 + 0.15 + 0.25 * 0.19 + 0.15 + 0.25, 9), "email,tiny,accounts")
    assert got[3] == (round(0.05 + 0.10 + 0.25, 9), "large,cards") and got[4] == (round(0.05 + 0.25 + 0.08 + 0.15, 9), "accounts,merchants")  # card 1 at shops 5 and 6 before


def test_fingerprints_of_the_value_alone(spark):
    df = spark.createDataFrame([("device", "D", 1, 1, 1, 1, 1, 0.5, 1.0, 1), ("device", "D", 2, 1, 1, 1, 1, 0.9, 1.0, 1)], ROWS)
    got = P.merchant_hist(df, b"s", of=("key",)).collect()
    assert len(got) == 1 and got[0]["fp"] == hmac.new(b"s", b"D", "sha256").hexdigest()[:16] and got[0]["b4"] == got[0]["b2"] == 1.0
    assert P.merchant_hist(df, b"s").count() == 2
