"""Feature tables, boosted trees and federated logistic fits, on Spark ML and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ringsight.functions import keys as K
from ringsight.operators import features as X
from ringsight.operators import metrics as M
from ringsight.operators import privacy as P
from ringsight.operators.sliding import card_node, component_days
from ringsight.session import sized, staged

NOT_FEATURES = ("txn_id", "t", "is_fraud", "split")
#: Levels of a category that trees tell apart; rarer ones share the index of unseen levels, and are told by their share.
LEVELS = 255
#: Rows of a leaf of the scorer's trees.
LEAST = 20


@dataclass(frozen=True)
class Spec:
    """Order of the features; those that are not numbers are categories."""

    order: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(c for c in self.order if c not in self.categorical)


def feature_spec(train: DataFrame, drop: tuple[str, ...] = NOT_FEATURES) -> Spec:
    kept = [f for f in train.schema if f.name not in drop]
    return Spec(tuple(f.name for f in kept), tuple(f.name for f in kept if not isinstance(f.dataType, (NumericType, BooleanType))))


def category_shares(train: DataFrame, spec: Spec) -> DataFrame:
    """feature, level, share of the non-null train rows: one pass and one shuffle for all features. Totals are summed apart, so no task reads all levels of a feature."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in spec.categorical])).alias("x")).select("x.*")
    n = staged(long.filter("level is not null").groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = n.groupBy("feature").agg(F.sum("n").alias("total"))  # a row for each category
    return n.join(F.broadcast(total), "feature").select("feature", "level", (F.col("n") / F.col("total")).alias("share"))


#: Levels up to which a category's shares are broadcast; beyond it only those that so large a share of train has.
MOST_LEVELS, FREQUENT = 200_000, 1e-4


def with_share(df: DataFrame, c: str, own: DataFrame, most: int = MOST_LEVELS, frequent: float = FREQUENT) -> DataFrame:
    """``df`` plus _{c}, the share of its level of c, by ``own`` (level, share): null for nulls and levels without one.

    Few levels are shared by very many rows, so rows are not brought together by level.
    Of a category with over ``most`` levels the frequent ones are broadcast, ten thousand at
    most; rows of others go to those, and rows that need none are dealt out.
    """
    name, level = f"_{c}", F.col(c).cast("string")
    of = lambda t: t.select(F.col("level").alias("_level"), F.col("share").alias("_share"))
    if own.count() <= most:
        return df.join(F.broadcast(of(own)), level == F.col("_level"), "left").withColumn(name, F.col("_share")).drop("_level", "_share")
    out = df.join(F.broadcast(of(own.filter(F.col("share") >= frequent))), level == F.col("_level"), "left").withColumnRenamed("_share", "_hot").drop("_level")
    out = out.withColumn("_rare", F.when(F.col("_hot").isNull(), level))
    out = out.withColumn("_salt", F.when(F.col("_rare").isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1000))).otherwise(F.lit(0)).cast("int"))
    rest = of(own.filter(F.col("share") < frequent)).withColumn("_none", F.lit(0)).hint("merge")
    out = out.join(rest, (F.col("_rare") == F.col("_level")) & (F.col("_salt") == F.col("_none")), "left")
    return out.withColumn(name, F.coalesce("_hot", "_share")).drop("_hot", "_rare", "_salt", "_level", "_share", "_none")


def encoded(df: DataFrame, spec: Spec, shares: DataFrame) -> DataFrame:
    """``df`` with its features as doubles in order: numbers as they are (null where absent), categories by their share in train (unseen and null: 0). ``shares`` should be cheap to count."""
    out = df
    for c in spec.categorical:
        if c in df.columns:
            out = with_share(out, c, shares.filter(F.col("feature") == c))
    value = lambda c: F.lit(None).cast("double") if c not in df.columns else (F.coalesce(f"_{c}", F.lit(0.0)) if c in spec.categorical else F.col(c).cast("double"))
    kept = [c for c in df.columns if c not in spec.order]
    return out.select(*kept, *[value(c).alias(c) for c in spec.order])


def category_levels(train: DataFrame, spec: Spec, most: int = LEVELS) -> DataFrame:
    """feature, level, idx: the ``most`` most frequent levels of each category, numbered from 0 by falling count; ties by name."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in spec.categorical])).alias("x")).select("x.*")
    n = long.filter("level is not null").groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    # the rank is cut in each task before the shuffle, so no task sorts all levels of a feature
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "level"))).filter(F.col("r") <= most)
    return ranked.select("feature", "level", (F.col("r") - 1).alias("idx"))


def indexed(df: DataFrame, spec: Spec, levels: DataFrame) -> DataFrame:
    """``df`` plus {c}_level for each category c: the idx of its level; one beyond the last for levels without one, nulls and columns that are absent.

    The columns carry nominal attributes, so that trees split them by sets of levels.
    ``levels`` (of category_levels) has LEVELS rows a category at most.
    """
    known, out = {r["feature"]: r["n"] for r in levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}, df
    for c in spec.categorical:
        n, name = known.get(c, 0), f"{c}_level"
        if c in df.columns:
            own = levels.filter(F.col("feature") == c).select(F.col("level").alias("_own"), F.col("idx").cast("double").alias("_idx"))
            out = out.join(F.broadcast(own), F.col(c).cast("string") == F.col("_own"), "left").withColumn("_idx", F.coalesce("_idx", F.lit(float(n)))).drop("_own")
        else:
            out = out.withColumn("_idx", F.lit(float(n)))
        nominal = {"ml_attr": {"type": "nominal", "name": name, "num_vals": max(2, n + 1)}}
        kept = [k for k in out.columns if k not in ("_idx", name)]
        out = out.select(*kept, F.col("_idx").alias(name, metadata=nominal))
    return out


def prepare_features(rows: DataFrame, drop: tuple[str, ...] = NOT_FEATURES) -> tuple[DataFrame, Spec]:
    """Fit on the train rows of ``rows`` (split), applied to all."""
    train = rows.filter("split = 'train'")
    spec = feature_spec(train, drop)
    return encoded(rows, spec, staged(category_shares(train, spec), "shares")), spec


#: Keys up to which their counts by fold are broadcast.
FEW_KEYS = 50_000
FOLDS = 5


def entity_features(rows: DataFrame) -> DataFrame:
    """``rows`` (splits) with gaps, velocities, fan-outs, components and reputations.

    A train row's reputation comes from the other folds, any other row's from all
    of train; keys that train lacks have the prior.
    """
    rows = staged(rows, "rows")
    train = rows.filter("split = 'train'")
    fold = X.fold_of(X.fold_cuts(train, FOLDS))
    out = rows.withColumn("_fold", F.when(F.col("split") == "train", fold).otherwise(F.lit(-1)).cast("int"))
    made, keys = [], ("card1", "addr1", "email_domain")
    for key, spread in (("account", ("device_info",)), ("card1", ("account", "addr1"))):
        out = X.histories(out, key, spread)
        made += [f"{key}_{c}" for c in ("gap", "n_24h", "n_7d", "sum_24h", "mean_24h")]
    for key in keys:  # rows lie by card1 already
        per = train.filter(F.col(key).isNotNull()).groupBy(key, fold.alias("fold")).agg(F.sum("is_fraud").cast("long").alias("fr"), F.count(F.lit(1)).alias("cnt"))
        own = F.array(*[F.struct(*[F.coalesce(F.sum(F.when(F.col("fold") == i, F.col(c))), F.lit(0)).alias(c) for c in ("fr", "cnt")]) for i in range(FOLDS)])
        known = per.groupBy(key).agg(F.sum("fr").alias("_fr"), F.sum("cnt").alias("_cnt"), own.alias("_folds"))
        # few keys have very many rows each: their counts are broadcast, so that rows do not go to a task by key
        out = out.join(sized(staged(known, "counts"), FEW_KEYS), key, "left")
        own = F.get("_folds", F.col("_fold"))  # null for none
        out = out.withColumns({c: F.col(f"_{c}") - F.coalesce(own[c], F.lit(0)) for c in ("fr", "cnt")}).select("*", *X.smoothed())
        none = {"rate": F.lit(X.PRIOR), "log_n": F.lit(0.0), "seen": F.lit(0)}
        out = out.withColumns({f"{key}_{c}": F.coalesce(c, n) for c, n in none.items()}).drop("fr", "cnt", "_fr", "_cnt", "_folds", *none)
    out = out.withColumns({"_day": K.day(), "_src": card_node()})
    days = component_days(rows).withColumnsRenamed({"day": "_day", "src": "_src"})
    out = out.join(days.hint("merge"), ["_day", "_src"], "left")
    figures = [c for c in days.columns if c not in ("_day", "_src")]
    return out.select(*rows.columns, *made, "card1_accounts", "card1_addr1s", "account_device_infos", *figures, *[f"{k}_{c}" for k in keys for c in ("rate", "log_n", "seen")])


def scorer_table(rows: DataFrame, drop: tuple[str, ...] = NOT_FEATURES) -> tuple[DataFrame, tuple[str, ...]]:
    """A written table of ``rows`` with what the scorer reads, and the names of that: numbers, and the share and level of each category, as train has them."""
    rows = staged(rows.select(*[c for c in rows.columns if c in (*NOT_FEATURES, *feature_spec(rows, drop).order)]), "rows")
    train = rows.filter("split = 'train'")
    spec = feature_spec(train, drop)
    levels = indexed(rows, spec, staged(category_levels(train, spec), "levels")) if spec.categorical else rows
    made = tuple(f"{c}_level" for c in spec.categorical)
    shared = encoded(levels, spec, staged(category_shares(train, spec), "shares")) if spec.categorical else encoded(rows, spec, rows.limit(0))
    return staged(shared, "prepared"), (*spec.order, *made)


def train_scorer(prepared: DataFrame, names: tuple[str, ...], rounds: int = 60, depth: int = 4, rate: float = 0.2) -> PipelineModel:
    """Boosted trees on the train rows. They end with the round after which the loss on the val rows rises, after ``rounds`` at the latest. Nulls take the train median.

    Columns with nominal attributes (of ``indexed``) are split by sets of levels. Without
    val rows all rounds are made. Numbers of many rows go into ranges (``ranges``) before the fit, as
    many as trees tell apart. Rows that are alike in all that is read then are one row with
    their number as weight, and LEAST rows make a leaf by weight: each pass costs the
    different rows, of which there are no more than combinations of ranges and levels.
    """
    before, held, bins = read_by_trees(prepared, names)
    trees = boosted(before.transform(prepared), [held[c] for c in names], bins, rounds, depth, rate)
    return PipelineModel([*before.stages, *trees.stages])


def read_by_trees(prepared: DataFrame, names: tuple[str, ...]) -> tuple[PipelineModel, dict[str, str], int]:
    """Stages fitted on the train rows that fill numbers and put those of many values into ranges, the column that trees read for each of ``names``, and how many values of a column they tell apart."""
    nominal = [c for c in names if prepared.schema[c].metadata.get("ml_attr", {}).get("type") == "nominal"]
    bins = max([32, *[prepared.schema[c].metadata["ml_attr"]["num_vals"] for c in nominal]])
    train, numeric = prepared.filter("split = 'train'"), [c for c in names if c not in nominal]
    filled = {c: f"{c}_filled" for c in numeric}
    fill = Imputer(inputCols=numeric, outputCols=list(filled.values()), strategy="median").fit(train.select(*numeric))
    cut = ranges(fill.transform(train), list(filled.values()), bins)
    held = dict(zip(cut.getInputCols(), cut.getOutputCols(), strict=True)) if cut else {}
    return PipelineModel([fill, cut] if cut else [fill]), {c: held.get(filled.get(c), filled.get(c, c)) for c in names}, bins


def boosted(rows: DataFrame, columns: list[str], bins: int, rounds: int = 60, depth: int = 4, rate: float = 0.2) -> PipelineModel:
    """The last two stages of ``train_scorer``, over ``rows`` with split, is_fraud and ``columns`` as ``read_by_trees`` has them."""
    gather = VectorAssembler(inputCols=columns, outputCol="features")
    # the number of a range is a number: as the level that its attributes make it, trees would take any set of ranges for a cut
    rows = rows.withColumns({c: F.col(c).cast("int") for c in columns if c.endswith("_range")})
    rows = rows.filter("split in ('train', 'val')").withColumn("_val", F.col("split") == "val").withColumn("label", F.col("is_fraud").cast("double"))
    few = alike(rows, ["_val", "label", *columns])
    n = few.groupBy("_val").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("different")).collect()  # two rows
    train = int(sum(r["n"] for r in n if not r["_val"]))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="_n", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=rate, validationTol=0.0, seed=42)
    # a fraction of the weight may not reach a half; with so few rows no split leaves LEAST on both sides
    trees = trees.setMinInstancesPerNode(1).setMinWeightFractionPerNode((LEAST - 0.5) / train) if train >= 2 * LEAST else trees.setMinInstancesPerNode(train + 1)
    if any(r["_val"] for r in n):
        trees = trees.setValidationIndicatorCol("_val")
    ready = gather.transform(few).select("_val", "label", "_n", "features")
    return PipelineModel([gather, trees.fit(dealt(ready, sum(r["different"] for r in n)))])


#: Rows of a fit that a task reads at a time.
FIT_ROWS = 500_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in equal parts, as many as cores or a multiple: each of a fit's hundreds of passes waits for its largest. FEW_ROWS at most stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if n <= FEW_ROWS else rows.repartition(cores * -(-n // (cores * FIT_ROWS)))


#: Train rows up to which numbers are fitted as they are: so few cost little.
FEW_ROWS = 100_000


def ranges(train: DataFrame, columns: list[str], bins: int) -> Bucketizer | None:
    """A stage that gives {c}_range, the number of one of ``bins`` ranges of about equal counts, for each of ``columns`` with more different values; None without any, or with FEW_ROWS at most.

    Trees that tell ``bins`` values of a feature apart look for cuts between such ranges only.
    """
    seen = train.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    many = [c for c in columns if seen[c] > bins]
    if seen["_rows"] <= FEW_ROWS or not many:
        return None
    cuts = train.approxQuantile(many, [i / bins for i in range(1, bins)], 0.1 / bins)
    edges = [[-float("inf"), *sorted(set(x)), float("inf")] for x in cuts]
    return Bucketizer(inputCols=many, outputCols=[f"{c}_range" for c in many], splitsArray=edges)


def alike(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A written table of the different rows of ``columns``, with _n, how often each is there."""
    return staged(rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_n")), "alike")


def scorer_rounds(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """round, train_loss, val_loss, of: the logistic losses after each of the rounds that the scorer kept, and how many these are."""
    *before, gather, trees = model.stages
    rows = gather.transform(alike(PipelineModel(before).transform(prepared.withColumn("label", F.col("is_fraud").cast("double"))), ["split", "label", *gather.getInputCols()]))
    one = lambda part: trees.evaluateEachIteration(rows.filter(F.col("split") == part))
    train, val, n = one("train"), one("val"), trees.getNumTrees
    return prepared.sparkSession.createDataFrame([(i + 1, a, b, n) for i, (a, b) in enumerate(zip(train, val, strict=True))], "round int, train_loss double, val_loss double, of int")


def score_batch(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with score, the probability of fraud."""
    kept = [c for c in rows.columns if c != "score"]
    return model.transform(rows).withColumn("_score", vector_to_array("probability")[1]).select(*kept, F.col("_score").alias("score"))


def top_features(model: PipelineModel, spark, k: int = 30) -> DataFrame:
    """rank, feature, importance of the k most important features."""
    weights = model.stages[-1].featureImportances.toArray()
    names = [c.removesuffix("_range").removesuffix("_filled") for c in model.stages[-2].getInputCols()]
    best = sorted(zip(names, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(best)], "rank long, feature string, importance double")


def quality(scored: DataFrame) -> DataFrame:
    s = staged(scored.select("score", "is_fraud"), "scored")
    return M.pr_auc(s).crossJoin(F.broadcast(M.roc_auc(s)))


def feature_lift(rows: DataFrame) -> DataFrame:
    """arm, pr_auc, roc_auc of the test rows, with and without entity features. ``score`` is no feature. Both arms read one table, prepared once: what one knows of a column does not depend on the others."""
    drop = (*NOT_FEATURES, "score")
    spec = feature_spec(rows, drop)
    table, names = scorer_table(entity_features(rows), drop)
    before, held, bins = read_by_trees(table, names)
    table = before.transform(table)
    base, out = {*spec.order, *[f"{c}_level" for c in spec.categorical]}, None
    for arm, own in (("base", [c for c in names if c in base]), ("entity", names)):
        model = boosted(table, [held[c] for c in own], bins)
        one = quality(score_batch(model, table.filter("split = 'test'"))).select(F.lit(arm).alias("arm"), "pr_auc", "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out


# federated logistic fits: rows (merchant, y, x array), weights (idx, value)
def standardized(prepared: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """txn_id, split, amount, merchant, y, x: a constant and the features, filled, centred and scaled by train figures."""
    train = prepared.filter("split = 'train'")
    median = {c: M.quantiles(train, c, [0.5])[0] or 0.0 for c in names}
    full = prepared.fillna({c: median[c] for c in names})
    stat = full.filter("split = 'train'").agg(*[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    scale = lambda c: stat[f"{c}_s"] if stat[f"{c}_s"] and stat[f"{c}_s"] > 1e-9 else 1.0
    x = F.array(F.lit(1.0), *[K.finite((F.col(c) - (stat[f"{c}_m"] or 0.0)) / scale(c)) for c in names])
    return full.select("txn_id", "split", "merchant", F.col("is_fraud").cast("double").alias("y"), x.alias("x"))


def probability(x, w):
    dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-dot))


def local_fit(rows: DataFrame, weights: list[float], steps: int = 3, rate: float = 1.0) -> DataFrame:
    """merchant, idx, value: each merchant's weights after gradient steps of the logistic loss on its own rows."""
    return local_fits(rows, rows.sparkSession.createDataFrame([("", weights)], "arm string, w array<double>"), steps, rate).drop("arm")


def local_fits(rows: DataFrame, starts: DataFrame, steps: int = 3, rate: float = 1.0) -> DataFrame:
    """arm, merchant, idx, value: as ``local_fit`` from the weights of each of some dozens of runs (arm, w), all in the same passes.

    A step is one aggregate with a partial sum per task, so a merchant of any size
    is never brought together. Weights are one short row per merchant and run.
    """
    n = len(starts.first()["w"])
    own = staged(rows.select("merchant").distinct().crossJoin(F.broadcast(starts)), "weights")
    few = own.count() <= FEW_WEIGHTS
    for _ in range(steps):
        if few:
            g = gradients(rows, own, n).join(F.broadcast(own), ["arm", "merchant"])
        else:
            dot = sum((F.col("x")[i] * F.col("w")[i] for i in range(1, n)), F.col("x")[0] * F.col("w")[0])
            e = rows.join(own.hint("merge"), "merchant").withColumn("e", 1 / (1 + F.exp(-dot)) - F.col("y"))
            g = e.groupBy("arm", "merchant").agg(F.array(*[F.avg(F.col("e") * F.col("x")[i]) for i in range(n)]).alias("g"), F.first("w").alias("w"))
        own = staged(g.select("arm", "merchant", F.zip_with("w", "g", lambda w, d: w - rate * d).alias("w")), "weights")
    return own.select("arm", "merchant", F.posexplode("w").alias("idx", "value"))


#: Weights of merchants and runs, counted, up to which every task has all of them.
FEW_WEIGHTS = 100_000


def gradients(rows: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """arm, merchant, g: the mean gradient of the logistic loss at each of the few weights ``own`` (arm, merchant, w). A row is read once for all runs; a task tells one sum for a merchant and run."""
    held: dict = {}
    for r in own.collect():  # FEW_WEIGHTS at most
        held.setdefault(r["merchant"], []).append((r["arm"], r["w"]))
    table = rows.sparkSession.sparkContext.broadcast({m: ([a for a, _ in x], np.array([w for _, w in x])) for m, x in held.items()})
    kind = rows.schema["merchant"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            who, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("merchant", "y"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for m in np.unique(who):
                at = who == m
                with np.errstate(over="ignore"):
                    e = 1 / (1 + np.exp(-(x[at] @ table.value[m][1].T))) - y[at][:, None]
                g, k = sums.get(m, (0.0, 0))
                sums[m] = (g + e.T @ x[at], k + int(at.sum()))
        told = [{"arm": a, "merchant": m.item(), "s": g[i].tolist(), "k": k} for m, (g, k) in sums.items() for i, a in enumerate(table.value[m][0])]
        if told:
            yield pa.RecordBatch.from_pylist(told, schema=pa.schema([("arm", pa.string()), ("merchant", batch.schema.field("merchant").type), ("s", pa.list_(pa.float64())), ("k", pa.int64())]))

    parts = rows.filter("merchant is not null").select("merchant", "y", "x").mapInArrow(run, f"arm string, merchant {kind}, s array<double>, k long")
    return parts.groupBy("arm", "merchant").agg(F.array(*[F.sum(F.col("s")[i]) / F.sum("k") for i in range(n)]).alias("g"))


def update_digests(updates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, merchant, digest: SHA-256 of an update's rounded values in order of idx."""
    text = F.concat_ws(":", F.col("idx").cast("string"), F.format_string("%.9f", F.col("value")))
    ordered = F.sort_array(F.collect_list(F.struct("idx", text.alias("s"))))
    return updates.groupBy(*by, "merchant").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["s"]), ","), 256).alias("digest"))


def fed_rounds(rows: DataFrame, size: int, rounds: int = 3, steps: int = 3, reveal: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """(round, pr_auc on val, best, kept merchants), weights of each round.

    A round is a local fit, commitment, reveal check, robust mean of the deltas and
    evaluation. The digests are written before anything is revealed; ``reveal`` gives
    what merchants reveal for what they fitted, the same if it is left out. Merchants
    whose reveal has another digest are left out. The driver holds one vector of
    weights. If fewer than two updates pass, the global weights stay.
    """
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    per = staged(train.groupBy("merchant").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").cast("long").alias("fraud_rows")), "merchants")
    spark, w, got, table = rows.sparkSession, [0.0] * size, [], []
    for r in range(rounds):
        fitted = staged(local_fit(train, w, steps), "updates")
        committed = staged(update_digests(fitted), "digests")
        sent = staged(reveal(fitted), "reveals") if reveal else fitted
        good = staged(committed.join(update_digests(sent).withColumnRenamed("digest", "d").hint("merge"), "merchant").filter("digest = d").select("merchant"), "good")
        deltas = staged(sent.join(good.hint("merge"), "merchant", "left_semi").select("merchant", "idx", (F.col("value") - F.element_at(F.array(*map(F.lit, w)), F.col("idx") + 1)).alias("value")), "deltas")
        step = {x["idx"]: x["value"] for x in P.robust_aggregate(deltas, per).collect()}  # one row per weight
        w = [v + step.get(i, 0.0) for i, v in enumerate(w)]
        got.append(w)
        scored = staged(val.select(probability(F.col("x"), F.array(*map(F.lit, w))).alias("score"), F.col("y").cast("int").alias("is_fraud")), "scored")
        table.append((r + 1, M.pr_auc(scored).first()["pr_auc"], good.count()))
    top = max(table, key=lambda x: (x[1] or 0.0, -x[0]))[0]
    return spark.createDataFrame([(r, a, r == top, n) for r, a, n in table], "round long, pr_auc double, best boolean, merchants long"), got


def mean_or_best(rows: DataFrame, table: DataFrame, weights: list[list[float]], last: int = 3) -> DataFrame:
    """choice ('mean' of the last rounds or 'best' round on val), pr_auc on val, idx, value: the higher on val, the mean of equals."""
    val = rows.filter("split = 'val'")
    best = table.filter("best").first()
    mean = [sum(w[i] for w in weights[-last:]) / len(weights[-last:]) for i in range(len(weights[0]))]
    scored = staged(val.select(probability(F.col("x"), F.array(*map(F.lit, mean))).alias("score"), F.col("y").cast("int").alias("is_fraud")), "scored")
    area = M.pr_auc(scored).first()["pr_auc"] or 0.0
    choice, value, w = ("mean", area, mean) if area >= (best["pr_auc"] or 0.0) else ("best", best["pr_auc"], weights[best["round"] - 1])
    return rows.sparkSession.createDataFrame([(choice, value, i, x) for i, x in enumerate(w)], "choice string, pr_auc double, idx int, value double")


@dataclass(frozen=True)
class Arm:
    """A federated run: who is checked, what merchant 0 does, and the budget of all rounds together.

    Attacks: ``sign_flip`` sends ten times the update backwards, ``flip`` once,
    ``last_mover`` commits to its honest update and reveals the first.
    """

    name: str
    robust: bool = True
    attack: str | None = None
    epsilon: float | None = None


ATTACKS = {"sign_flip": -10.0, "flip": -1.0, "last_mover": -10.0}
ARMS = (
    Arm("plain", robust=False), Arm("robust"), *[Arm(f"{a}_{'defended' if r else 'undefended'}", r, a) for a in ATTACKS for r in (False, True) if r or a != "last_mover"],
    *[Arm(f"private_{e}", epsilon=float(e)) for e in (8, 4, 2, 1)],
)


def fed_arms(rows: DataFrame, size: int, arms: tuple[Arm, ...] = ARMS, rounds: int = 3, steps: int = 3, last: int = 3, seed: str = "fed") -> DataFrame:
    """arm, attack, robust, epsilon, choice (round, 0 for the mean of the last ones), val and test (areas), rejected (updates left out over all rounds).

    All runs go through the same passes. A round is a local fit, with a budget clipped
    and noised by each merchant (epsilon over the rounds, as budgets add up), a
    commitment, a reveal and a mean: robust runs check digests, filter and weigh by
    frauds and keep the weights if fewer than two updates pass, plain ones trust all and
    weigh by rows. Rounds are chosen by val alone. The driver holds one vector a run.
    """
    spark, train, by = rows.sparkSession, rows.filter("split = 'train'"), ("arm",)
    per = staged(train.groupBy("merchant").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").cast("long").alias("fraud_rows")), "merchants")
    table = spark.createDataFrame([(a.name, a.robust, a.attack, a.epsilon, ATTACKS.get(a.attack, 1.0)) for a in arms], "arm string, robust boolean, attack string, epsilon double, scale double")
    weights, history, left_out = {a.name: [0.0] * size for a in arms}, [], {a.name: 0 for a in arms}
    for r in range(1, rounds + 1):
        starts = staged(spark.createDataFrame(list(weights.items()), "arm string, w array<double>"), "starts")
        fitted = local_fits(train, starts, steps).join(F.broadcast(starts), "arm").join(F.broadcast(table), "arm")
        honest = fitted.select("arm", "merchant", "idx", (F.col("value") - F.col("w")[F.col("idx")]).alias("value"), "epsilon")
        noised = private_deltas(honest, rounds, F.concat_ws("|", F.lit(seed), "arm", F.lit(str(r))))
        both = noised.join(F.broadcast(table.select("arm", "attack", "scale", "robust")), "arm")
        bad = F.when(F.col("merchant") == 0, F.col("scale")).otherwise(1.0)
        told = F.when(F.col("attack") == "last_mover", 1.0).otherwise(bad)
        sent = staged(both.select("arm", "robust", "merchant", "idx", (F.col("value") * told).alias("committed"), (F.col("value") * bad).alias("value")), "updates")
        a = update_digests(sent.withColumn("value", F.col("committed")), by)
        b = update_digests(sent, by).withColumnRenamed("digest", "_d")
        good = staged(a.join(b.hint("merge"), ["arm", "merchant"]).filter("digest = _d").select("arm", "merchant"), "good")
        checked = staged(sent.filter("robust").join(good.hint("merge"), ["arm", "merchant"], "left_semi").select("arm", "merchant", "idx", "value"), "deltas")
        kept = P.passing(checked, by)
        n = kept.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
        mean = P.weighted_mean(checked.join(kept.hint("merge"), ["arm", "merchant"], "left_semi").join(F.broadcast(n.filter("n >= 2")), "arm", "left_semi"), per, "fraud_rows", by)
        mean = mean.unionByName(P.weighted_mean(sent.filter("not robust").select("arm", "merchant", "idx", "value"), per, "rows", by))
        for x in mean.collect():  # one row for a weight of a run
            weights[x["arm"]][x["idx"]] += x["value"]
        passed = {x["arm"]: x["n"] for x in n.collect()}
        for x in arms:
            left_out[x.name] += per.count() - passed.get(x.name, 0) if x.robust else 0
        history.append({k: list(w) for k, w in weights.items()})
    tried = [(k, r, h[k]) for r, h in enumerate(history, 1) for k in h] + [(k, 0, [sum(h[k][i] for h in history[-last:]) / len(history[-last:]) for i in range(size)]) for k in weights]
    areas = {(x["arm"], x["choice"]): x["pr_auc"] or 0.0 for x in areas_of(rows.filter("split = 'val'"), tried).collect()}
    best = {a.name: max(range(rounds + 1), key=lambda r, a=a: (areas.get((a.name, r), 0.0), -r)) for a in arms}
    chosen = [t for t in tried if best[t[0]] == t[1]]
    test = {x["arm"]: x["pr_auc"] for x in areas_of(rows.filter("split = 'test'"), chosen).collect()}
    out = [(a.name, a.attack, a.robust, a.epsilon, best[a.name], areas.get((a.name, best[a.name])), test.get(a.name), left_out[a.name]) for a in arms]
    return spark.createDataFrame(out, "arm string, attack string, robust boolean, epsilon double, choice int, val double, test double, rejected long")


def private_deltas(deltas: DataFrame, rounds: int, seed) -> DataFrame:
    return P.private_update(deltas, F.col("epsilon") / rounds, seed, by=("arm",)).drop("epsilon")


def areas_of(rows: DataFrame, tried: list[tuple[str, int, list[float]]]) -> DataFrame:
    """arm, choice, pr_auc of logistic weights on ``rows``: some dozens of them, in one pass."""
    w = rows.sparkSession.createDataFrame(tried, "arm string, choice int, w array<double>")
    scored = rows.crossJoin(F.broadcast(w)).select("arm", "choice", probability(F.col("x"), F.col("w")).alias("score"), F.col("y").cast("int").alias("is_fraud"))
    return M.pr_auc_by(scored, ["arm", "choice"])


def central_fit(rows: DataFrame, size: int, strengths: tuple[float, ...] = (0.0, 0.001, 0.01), hidden: tuple[int, ...] = (16, 8), epochs: int = 12, patience: int = 4) -> DataFrame:
    """model (logistic or network), step (its strength or epoch), pr_auc on val, best: fits on the pooled rows, the ceiling for federated rounds."""
    train, val = parts(rows)
    table = [("logistic", s, a) for s, a in logistic_fits(train, val, strengths)] + [("network", float(e), a) for e, a in network_epochs(train, val, size, hidden, epochs, patience)[0]]
    train.unpersist()
    top = max(range(len(table)), key=lambda i: (table[i][2] or 0.0, -i))
    return rows.sparkSession.createDataFrame([(*t, i == top) for i, t in enumerate(table)], "model string, step double, pr_auc double, best boolean")


def pooled(rows: DataFrame) -> DataFrame:
    return staged(rows.select("split", F.col("y").alias("label"), "x"), "pooled").withColumn("features", array_to_vector("x"))


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pooled train rows (features, label), kept in memory or on disk for all passes, and the different val points (features, pos, neg) with their numbers of frauds and others."""
    data = pooled(rows)
    points = data.filter("split = 'val'").groupBy("x").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return data.filter("split = 'train'").select("features", "label").persist(), staged(points, "points").withColumn("features", array_to_vector("x"))


def _area(model, val: DataFrame) -> float | None:
    scored = model.transform(val).select(vector_to_array("probability")[1].alias("score"), "pos", "neg")
    return M.pr_auc_of(scored.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).first()["pr_auc"]


def logistic_fits(train: DataFrame, val: DataFrame, strengths: tuple[float, ...]) -> list[tuple[float, float | None]]:
    fit = lambda s: LogisticRegression(regParam=s, maxIter=50, standardization=False).fit(train)
    return [(s, _area(fit(s), val)) for s in strengths]


def network_fit(rows: DataFrame, size: int, hidden: tuple[int, ...] = (16, 8), epochs: int = 12, patience: int = 4, iterations: int = 10, seed: int = 42):
    """(epoch and area on val of each epoch, the best epoch's model) of ``network_epochs`` on the pooled rows."""
    train, val = parts(rows)
    out = network_epochs(train, val, size, hidden, epochs, patience, iterations, seed)
    train.unpersist()
    return out


def network_epochs(train: DataFrame, val: DataFrame, size: int, hidden: tuple[int, ...], epochs: int, patience: int, iterations: int = 10, seed: int = 42):
    """A network of ``hidden`` layers trained on the train rows of ``parts``.

    An epoch is ``iterations`` steps of L-BFGS on gradients summed over tasks, and goes
    on from the weights of the one before. Training stops after ``patience`` epochs
    without a better area on val; the best epoch stands.
    """
    told, best, model, weights = [], None, None, None
    for epoch in range(1, epochs + 1):
        net = MultilayerPerceptronClassifier(layers=[size, *hidden, 2], maxIter=iterations, seed=seed, tol=0.0)
        now = (net.setInitialWeights(weights) if weights is not None else net).fit(train)
        weights, area = now.weights, _area(now, val) or 0.0
        told.append((epoch, area))
        if best is None or area > best + 1e-4:
            best, model = area, now
        elif epoch - max(e for e, a in told if a == best) >= patience:
            break
    return told, model
