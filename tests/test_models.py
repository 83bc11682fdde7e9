"""Fits and feature tables against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from ringsight.operators import features as X
from ringsight.operators import metrics as M
from ringsight.operators import models as L
from ringsight.operators import privacy as P
from ringsight.plans import learning

SF = "/root/testdata/sf0.001"


def test_local_fit_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(m), float(y), [1.0, *map(float, x)]) for m, y, x in zip(rng.integers(0, 3, 60), rng.integers(0, 2, 60), rng.normal(size=(60, 2)), strict=True)]
    got = {}
    for r in L.local_fit(spark.createDataFrame(rows, "merchant long, y double, x array<double>"), [0.1, -0.2, 0.0], 3, 0.5).collect():
        got.setdefault(r["merchant"], [0.0] * 3)[r["idx"]] = r["value"]
    for m in range(3):
        x, y, w = np.array([r[2] for r in rows if r[0] == m]), np.array([r[1] for r in rows if r[0] == m]), np.array([0.1, -0.2, 0.0])
        for _ in range(3):
            w = w - 0.5 * ((1 / (1 + np.exp(-x @ w)) - y)[:, None] * x).mean(0)
        assert np.allclose(w, got[m])


def test_entity_features(spark):
    rows = learning.split(spark, SF)
    got = L.entity_features(rows).toPandas()
    base = rows.toPandas()
    assert len(got) == len(base) and got["txn_id"].is_unique and len(got.columns) - len(base.columns) == 27
    train = base[base["split"] == "train"]
    rates = train.groupby("card1")["is_fraud"].agg(["sum", "count"])
    for r in got[got["split"] == "test"].itertuples():
        want = (rates["sum"].get(r.card1, 0) + 20 * 0.035) / (rates["count"].get(r.card1, 0) + 20)
        assert abs(r.card1_rate - want) < 1e-9
    one = got.dropna(subset=["comp_size"]).iloc[0]
    assert got["comp_size"].notna().all() and one["comp_size"] >= one["comp_cards"] and one["comp_rate"] > 0


def test_fed_rounds(spark):
    rows = learning.dense(spark, SF)
    table, weights = L.fed_rounds(rows, len(learning.DENSE) + 1, 2, 2)
    got = table.collect()
    assert [r["round"] for r in got] == [1, 2] and sum(r["best"] for r in got) == 1 and len(weights[1]) == len(learning.DENSE) + 1
    few, held = L.fed_rounds(rows.filter("merchant = 1"), len(learning.DENSE) + 1, 1, 1)
    assert held == [[0.0] * (len(learning.DENSE) + 1)] and few.count() == 1


def test_changed_reveals_are_left_out(spark):
    rows, size = learning.dense(spark, SF), len(learning.DENSE) + 1
    plain = L.fed_rounds(rows, size, 1, 1)[0].first()["merchants"]
    table, weights = L.fed_rounds(rows, size, 1, 1, reveal=lambda x: x.withColumn("value", F.when(F.col("merchant") == 2, F.col("value") + 1).otherwise(F.col("value"))))
    assert table.first()["merchants"] == plain - 1
    few, held = L.fed_rounds(rows, size, 1, 1, reveal=lambda x: x.withColumn("value", F.col("value") + 1))
    assert few.first()["merchants"] == 0 and held == [[0.0] * size]


def test_mean_or_best_round(spark):
    rows, size = learning.dense(spark, SF), len(learning.DENSE) + 1
    table, weights = L.fed_rounds(rows, size, 2, 2)
    got = L.mean_or_best(rows, table, weights).orderBy("idx").collect()
    best = table.filter("best").first()
    want = [sum(w[i] for w in weights) / 2 for i in range(size)] if got[0]["choice"] == "mean" else weights[best["round"] - 1]
    assert [r["value"] for r in got] == want and got[0]["pr_auc"] >= best["pr_auc"]


def test_model_keeps_scores(spark):
    r = learning.model_save_load(spark, SF).first()
    assert r["n"] > 0 and r["gap"] == 0


def test_shares_of_nulls_and_unseen(spark):
    rows = spark.createDataFrame([(1, "train", 0, "a"), (2, "train", 1, None), (3, "test", 0, "b"), (4, "test", 0, None)], "txn_id long, split string, is_fraud int, c string")
    out, spec = L.prepare_features(rows)
    assert spec.categorical == ("c",) and {r["txn_id"]: r["c"] for r in out.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    gone = L.encoded(rows.drop("c"), spec, L.category_shares(rows, spec))
    assert gone.filter(F.col("c").isNotNull()).count() == 0


def test_levels_of_categories(spark):
    """Frequent levels first, ties by name; rare, unseen and null ones share an index, as do absent columns."""
    levels = ["b", "b", "b", "a", "c", None, "d", "d"]
    rows = spark.createDataFrame([(i, "train", 0, c, 1.0) for i, c in enumerate(levels)] + [(9, "test", 0, "new", 1.0)], "txn_id long, split string, is_fraud int, c string, x double")
    train = rows.filter("split = 'train'")
    spec = L.feature_spec(train)
    few = L.category_levels(train, spec, 3)
    assert {r["level"]: r["idx"] for r in few.collect()} == {"b": 0, "d": 1, "a": 2}
    out = L.indexed(rows, spec, few)
    assert [r["c_level"] for r in out.orderBy("txn_id").collect()] == [0, 0, 0, 2, 3, 3, 1, 1, 3]
    assert {r["c_level"] for r in L.indexed(rows.drop("c"), spec, few).collect()} == {3}
    table, names = L.scorer_table(rows)
    assert names == ("c", "x", "c_level") and table.schema["c_level"].metadata["ml_attr"]["num_vals"] == 5  # kept over the write
    assert L.category_levels(train.limit(0), spec).count() == 0


def test_shares_of_many_levels_stay_in_pieces(spark):
    """no task has all levels of a category; shares are those of the non-null rows, each feature's sum is 1."""
    rows = spark.range(4000).select(F.concat(F.lit("v"), F.col("id") % 3000).alias("many"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("w"), F.col("id") % 2)).alias("two"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.category_shares(rows, L.feature_spec(rows)).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["at"] for r in got if r["feature"] == "many"}) > 1
    share = {(r["feature"], r["level"]): r["share"] for r in got}
    assert len(share) == len(got) == 3002 and share["many", "v5"] == 2 / 4000 and share["many", "v2999"] == 1 / 4000
    assert (share["two", "w0"], share["two", "w1"]) == (1000 / 3000, 2000 / 3000)
    assert L.category_shares(rows.limit(0), L.feature_spec(rows)).count() == 0


def test_val_stops_the_scorer(spark):
    """Frauds by a set of levels and by an amount are learned; labels by chance end after few rounds; without val rows all rounds are made."""
    rng = np.random.default_rng(5)
    level, x, luck = rng.choice(list("abcdefgh"), 1200), rng.normal(size=1200), rng.integers(0, 2, 1200)
    split = np.array(["train", "train", "val", "test"])[np.arange(1200) % 4]
    fraud = np.where(np.isin(level, ["a", "d", "f"]), x > 0, x > 1.5).astype(int)
    make = lambda y: L.scorer_table(spark.createDataFrame([(i, str(split[i]), int(y[i]), str(level[i]), float(x[i])) for i in range(1200)], "txn_id long, split string, is_fraud int, c string, x double"))
    table, names = make(fraud)
    model = L.train_scorer(table, names, rounds=12)
    told = L.scorer_rounds(model, table).orderBy("round").collect()
    assert [r["round"] for r in told] == list(range(1, told[0]["of"] + 1)) and all(a["val_loss"] > b["val_loss"] for a, b in zip(told, told[1:]))
    assert " in {" in model.stages[-1].toDebugString and L.quality(L.score_batch(model, table.filter("split = 'test'"))).first()["pr_auc"] > 0.95
    noise, names = make(luck)
    assert L.train_scorer(noise, names, rounds=12).stages[-1].getNumTrees < 12
    assert L.train_scorer(noise.filter("split = 'train'"), names, rounds=3).stages[-1].getNumTrees == 3


def test_scorer_fits_ranges_of_numbers(spark, monkeypatch):
    """rows that all differ in an amount are fitted as its ranges, none lost; numbers of few values stay; values beyond train and nulls are scored."""
    rng = np.random.default_rng(7)
    x, k = np.round(rng.gamma(2.0, 50.0, 4000), 6), rng.integers(0, 5, 4000)
    split = np.array(["train", "train", "val", "test"])[np.arange(4000) % 4]
    rows = [(i, str(split[i]), int(x[i] > 120 and k[i] < 3), float(x[i]), int(k[i])) for i in range(4000)] + [(4000, "test", 0, 1e9, 0), (4001, "test", 0, -1e9, 0), (4002, "test", 0, None, 0)]
    table, names = L.scorer_table(spark.createDataFrame(rows, "txn_id long, split string, is_fraud int, x double, k long"))
    read, alike = [], L.alike
    assert [type(s).__name__ for s in L.train_scorer(table, names, rounds=2).stages][:-1] == ["ImputerModel", "VectorAssembler"]  # few rows stay as they are
    monkeypatch.setattr(L, "FEW_ROWS", 1000)
    monkeypatch.setattr(L, "alike", lambda *a: read.append(alike(*a)) or read[-1])
    model = L.train_scorer(table, names, rounds=8)
    few = read[0].agg(F.count(F.lit(1)).alias("different"), F.sum("_n").alias("n"), F.count_distinct("x_filled_range").alias("x"), F.count_distinct("k_filled").alias("k")).first()
    assert few["n"] == 3000 and few["x"] == 32 and few["k"] == 5 and few["different"] <= 2 * 2 * 32 * 5 < 3000
    edges = np.array(model.stages[1].getSplitsArray()[0][1:-1])
    share = np.bincount(np.searchsorted(edges, x[(split == "train")], "right")) / 2000
    assert len(edges) == 31 and share.max() < 2 / 32
    scored = {r["txn_id"]: r["score"] for r in L.score_batch(model, table).collect()}
    assert len(scored) == len(rows) and scored[4000] > 0.5 > max(scored[4001], scored[4002])
    assert L.quality(L.score_batch(model, table.filter("split = 'test'"))).first()["roc_auc"] > 0.99
    assert {r["feature"] for r in L.top_features(model, spark).collect()} == {"x", "k"}
    assert L.scorer_rounds(model, table).count() == model.stages[-1].getNumTrees


def test_attacks_and_budgets(spark):
    """Attacks ruin plain runs and not robust ones; updates that differ from their commitment are left out; noise grows as budgets fall."""
    rows = spark.createDataFrame(synthetic(900), "split string, merchant long, y double, x array<double>")
    arms = (L.Arm("plain", robust=False), L.Arm("robust"), L.Arm("bad", False, "sign_flip"), L.Arm("good", True, "sign_flip"), L.Arm("late", True, "last_mover"), L.Arm("wide", epsilon=1e6), L.Arm("narrow", epsilon=0.01))
    got = {r["arm"]: r for r in L.fed_arms(rows, 3, arms, rounds=2, steps=2).collect()}
    assert got["plain"]["test"] > 0.8 and got["robust"]["test"] > 0.8 and got["good"]["test"] > 0.8 and got["late"]["test"] > 0.8
    assert got["bad"]["test"] < 0.5 < got["good"]["test"] and got["good"]["rejected"] >= 2 and got["late"]["rejected"] >= 2 and got["plain"]["rejected"] == 0
    assert abs(got["wide"]["test"] - got["robust"]["test"]) < 0.05 and got["narrow"]["val"] <= got["wide"]["val"] + 1e-9


def synthetic(n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    y = (2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 1).astype(float)
    split = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    return [(str(split[i]), int(i % 5), float(y[i]), [1.0, *map(float, x[i])]) for i in range(n)]


def test_private_updates(spark):
    rows = [(m, i, float(v)) for m, vs in ((1, (3, 4)), (2, (0.3, 0.4)), (3, (0, 0))) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "merchant long, idx int, value double")
    plain = {(r["merchant"], r["idx"]): r["value"] for r in P.private_update(df, F.lit(None).cast("double"), F.lit("s")).collect()}
    assert plain == {r[:2]: r[2] for r in rows}
    wide = {(r["merchant"], r["idx"]): r["value"] for r in P.private_update(df, F.lit(1e9), F.lit("s")).collect()}
    assert np.allclose([wide[k] for k in sorted(wide)], [0.6, 0.8, 0.3, 0.4, 0, 0], atol=1e-6)
    noise = [r["value"] for r in P.private_update(spark.range(4_000).select(F.col("id").alias("merchant"), F.lit(0).alias("idx"), F.lit(0.0).alias("value")), F.lit(4.0), F.lit("s")).collect()]
    sigma = np.sqrt(2 * np.log(1.25 / 1e-5)) / 4
    assert abs(np.mean(noise)) < 0.1 and abs(np.std(noise) / sigma - 1) < 0.05


def test_network_is_the_plain_network_of_its_weights(spark):
    rows = spark.createDataFrame(synthetic(400), "split string, merchant long, y double, x array<double>")
    told, model = L.network_fit(rows, 3, (4, 3), epochs=6, patience=2, iterations=5)
    assert [e for e, _ in told] == list(range(1, len(told) + 1)) and max(a for _, a in told) > 0.8
    best = max(range(len(told)), key=lambda i: (told[i][1], -i))
    assert len(told) == 6 or len(told) - 1 - best >= 2  # stopped after two epochs without a better one
    got = model.transform(L.pooled(rows)).select("x", "probability").collect()
    w, at, x = np.array(model.weights.toArray()), 0, np.array([r["x"] for r in got])
    layers = [3, 4, 3, 2]
    for i, (a, b) in enumerate(zip(layers, layers[1:])):
        m, c = w[at : at + a * b].reshape(a, b).T, w[at + a * b : at + a * b + b]
        x = x @ m.T + c
        x = 1 / (1 + np.exp(-x)) if i < 2 else np.exp(x) / np.exp(x).sum(1, keepdims=True)
        at += a * b + b
    assert at == len(w) and np.allclose(x, [r["probability"].toArray() for r in got])


def test_central_fits_pass_over_val_points_not_rows(spark):
    """F16: val rows that are alike are one point with its numbers of frauds and others; the area is that of the rows, also where like rows differ in their label."""
    rows = synthetic(200) + [("val", 0, float(i % 2), [1.0, 0.25, -0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "split string, merchant long, y double, x array<double>")
    train, val = L.parts(df)
    held = [r for r in rows if r[0] == "val"]
    assert val.count() == len({tuple(r[3]) for r in held}) < len(held) and val.agg(F.sum("pos"), F.sum("neg")).first()[:] == (sum(r[2] for r in held), sum(1 - r[2] for r in held))
    model = L.LogisticRegression(maxIter=20).fit(train)
    scored = model.transform(L.pooled(df).filter("split = 'val'")).select(L.vector_to_array("probability")[1].alias("score"), F.col("label").cast("int").alias("is_fraud"))
    assert abs(L._area(model, val) - M.pr_auc(scored).first()["pr_auc"]) < 1e-12
    train.unpersist()


def test_areas_by_group_are_those_of_each(spark):
    rng = np.random.default_rng(1)
    rows = [(a, int(c), float(np.round(s, 1)), int(f)) for a, c, s, f in zip(rng.choice(["a", "b"], 300), rng.integers(0, 3, 300), rng.random(300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "arm string, c int, score double, is_fraud int")
    got = {(r["arm"], r["c"]): r["pr_auc"] for r in M.pr_auc_by(df, ["arm", "c"]).collect()}
    assert len(got) == 6
    for (a, c), v in list(got.items())[:3]:
        assert abs(v - M.pr_auc(df.filter((F.col("arm") == a) & (F.col("c") == c))).first()[0]) < 1e-12


def test_shares_are_not_joined_by_level(spark):
    """Rows do not go to one task for each level; of many levels the frequent ones are broadcast, and all give the same."""
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", 0, None if i % 5 == 0 else "ab"[i % 2] if i % 4 else f"r{i % 7}") for i in range(200)], "txn_id long, split string, is_fraud int, c string")
    own = L.staged(L.category_shares(rows.filter("split = 'train'"), L.feature_spec(rows)), "shares")
    few, many = L.with_share(rows, "c", own), L.with_share(rows, "c", own, most=3, frequent=0.2)
    want = {r["level"]: r["share"] for r in own.collect()}
    for out in (few, many):
        assert out.count() == 200 and all(r["_c"] == want.get(r["c"]) for r in out.collect()) and out.columns == [*rows.columns, "_c"]
    plan = L.encoded(rows, L.feature_spec(rows), own)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(c" not in plan


def test_gradients_in_tasks_are_those_of_joined_weights(spark, monkeypatch):
    """Few weights go to every task, which reads a row once for all runs; many are joined: the same fits."""
    rows = spark.createDataFrame([r[1:] for r in synthetic(300)], "merchant long, y double, x array<double>")
    starts = spark.createDataFrame([("a", [0.0, 0.0, 0.0]), ("b", [0.3, -900.0, 0.1])], "arm string, w array<double>")
    fits = lambda: {(r["arm"], r["merchant"], r["idx"]): r["value"] for r in L.local_fits(rows, starts, 2).collect()}
    few = fits()
    monkeypatch.setattr(L, "FEW_WEIGHTS", 0)
    many = fits()
    assert len(few) == 30 and few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)
    own = starts.withColumn("merchant", F.lit(1).cast("long"))
    assert "Generate" not in (plan := L.gradients(rows, own, 3)._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan


def test_rates_are_not_joined_by_few_keys(spark):
    """Rows do not go to one task for each domain."""
    plan = L.entity_features(learning.split(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(email_domain" not in plan and "hashpartitioning(addr1" not in plan


def test_histories_are_velocity_and_fanouts(spark):
    """in one go what the operators tell apart, of ordinary keys and of hot ones, a null key among them."""
    rng = np.random.default_rng(2)
    pick = lambda values: [None if v == 0 else int(v) for v in rng.integers(0, values, 300)]
    rows = [(i, int(t), float(a), k, v, w) for i, (t, a, k, v, w) in enumerate(zip(rng.integers(0, 40, 300) * 50_000, rng.integers(1, 9, 300), pick(9), pick(5), pick(4), strict=True))]
    df = spark.createDataFrame(rows, "txn_id long, t long, amount double, k long, v long, w long")
    want = X.velocity(df, "k").withColumnsRenamed({c: f"k_{c}" for c in ("gap", "n_24h", "n_7d", "sum_24h", "mean_24h")})
    want = sorted(X.fanout(X.fanout(want, "k", "v", "k_vs"), "k", "w", "k_ws").select("*").collect())
    for hot in (1_000_000, 35, 1):
        got = X.histories(df, "k", ("v", "w"), hot)
        assert sorted(r[:1] for r in got.collect()) == sorted(r[:1] for r in rows)
        assert {r["txn_id"]: r.asDict() for r in got.collect()} == {r["txn_id"]: r.asDict() for r in want}


def test_cuts_tell_the_folds(spark):
    """a row's fold by its time and id is its fold by position, also of fewer rows than folds."""
    for n in (0, 1, 3, 7, 100):
        rows = spark.createDataFrame([((i * 37) % 101, (i * i) % 10) for i in range(n)], "txn_id long, t long")
        cuts = X.fold_cuts(rows)
        assert sorted(X.folds(rows).select("txn_id", "fold").collect()) == sorted(rows.select("txn_id", X.fold_of(cuts).alias("fold")).collect())


def test_features_are_not_joined_row_by_row(spark):
    """folds, rates and components come by time, key and day, not by a shuffle of all rows by txn_id."""
    assert "hashpartitioning(txn_id" not in L.entity_features(learning.split(spark, SF))._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_cut_and_fits_are_even(spark, monkeypatch):
    """a range is a number to trees, not a level; the rows of a fit lie in equal parts, as many as cores or a multiple."""
    rows = spark.range(4000).select(F.col("id").alias("txn_id"), F.when(F.col("id") % 4 == 3, "test").when(F.col("id") % 4 == 2, "val").otherwise("train").alias("split"), ((F.col("id") * 7919 % 4001) / 7).alias("x"))
    table, names = L.scorer_table(rows.withColumn("is_fraud", ((F.col("x") > 400) & (F.col("x") < 500)).cast("int")))
    monkeypatch.setattr(L, "FEW_ROWS", 60)
    monkeypatch.setattr(L, "FIT_ROWS", 5)
    parts, deal = [], L.dealt
    monkeypatch.setattr(L, "dealt", lambda *a: parts.append(deal(*a)) or parts[-1])
    model = L.train_scorer(table, names, rounds=3)
    text = model.stages[-1].toDebugString
    assert " in {" not in text and "feature 0 <= " in text
    assert L.quality(L.score_batch(model, table.filter("split = 'test'"))).first()["pr_auc"] > 0.9
    sizes = [r["n"] for r in parts[0].groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) % spark.sparkContext.defaultParallelism == 0 and max(sizes) - min(sizes) <= len(sizes)


def test_lift_prepares_one_table(spark, monkeypatch):
    """both arms read one table, with the features they are told."""
    made, read, prepare, fit = [], [], L.scorer_table, L.boosted
    monkeypatch.setattr(L, "scorer_table", lambda *a: made.append(a) or prepare(*a))
    monkeypatch.setattr(L, "boosted", lambda rows, columns, bins: read.append(columns) or fit(rows, columns, bins, 3))
    got = L.feature_lift(learning.split(spark, SF)).collect()
    assert [r["arm"] for r in got] == ["base", "entity"] and len(made) == 1 and all(0 < r["pr_auc"] <= 1 for r in got)
    base, entity = ({c.removesuffix("_filled") for c in x} for x in read)
    assert base < entity and {c for c in entity if c.startswith(("account_", "card1_", "comp_"))} <= entity - base and {"amount", "browser", "browser_level"} <= base and len(entity - base) == 27
    assert not {"score", "is_fraud", "t", "txn_id", "split"} & entity
