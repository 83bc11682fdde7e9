"""Quality rules whose cutoffs are controlled for false rejection. Native expressions only.

Base features are counted within each row. Every rule has cutoffs from loose to
strict, and all rules together have one path fixed beforehand: level by level, rule
by rule, one cutoff is tightened at a time, so that each step of the path rejects
what the step before rejects and maybe more. A document falls at the first step that
rejects it.

For every stratum (language) the labelled good documents that have fallen by each
step are counted over all labels. The exact binomial tail P(Bin(n, a) <= k) at the
tolerated rate a tests "more than a share a of the good ones is rejected" for each
step. Steps are tested in the order of the path until one is not significant (a
fixed sequence needs no correction along the path); the error budget is divided by
the number of strata (Bonferroni). So with probability 1 - ERROR no stratum loses
more than RATE of its good documents. A stratum without enough labels for the first
step keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import bind, by_ids, read, staged, words
from ringsight.session import sized

MIN_WORDS, MAX_REPEAT = 50, 50
#: rule -> (numerator, denominator, cutoffs in thousandths, loose to strict; a document fails if 1000 * numerator > cutoff * denominator)
RULES = {
    "symbols": ("n_symbols", "n_words", (800, 400, 200, 100, 50, 20)),
    "dup_lines": ("n_dup_lines", "n_lines", (600, 400, 300, 200, 100, 50)),
    "repeats": ("n_repeat_words", "n_words", (400, 300, 200, 100, 50)),
    "long_words": ("word_chars", "n_words", (15000, 12000, 10000, 9000, 8000, 7000)),
    "shouting": ("n_upper", "word_chars", (500, 300, 200, 150, 100, 60)),
}
#: The path: (rule, cutoff) of each step.
PATH = [(r, grid[j]) for j in range(max(len(g) for _, _, g in RULES.values())) for r, (_, _, grid) in RULES.items() if j < len(grid)]
#: Tolerated rate of false rejection by all rules together, and the chance that any stratum exceeds it.
RATE, ERROR = 0.03, 0.05


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs more than once; hashes are in text order.

    Sorted by (hash, place), equal windows stand side by side. Over the sorted places
    of the repeated ones each adds three words, or as many as lie before the next.
    """

    def covered(p):
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, i: a + F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(3))))

    def places(s):
        twin = lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    some = bind(pairs, lambda s: bind(places(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(some).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper and stratum.

    Null and empty texts have no words and all counts 0, a null lang is the stratum
    "none". Repeated rows are counted each. Columns of docs with one of these names are
    replaced. The result need not be written before rules read it: counts are made
    once a row.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "stratum")
    keep = [c for c in docs.columns if c.lower() not in (*names, "_w", "_l", "_t", "_h", "_f")]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(*keep, words(F.col("text")).alias("_w"), lines.alias("_l"), F.translate(text, " \t\n\x0b\x0c\r", "").alias("_t"))
    w = F.col("_w")
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    two = one.select(*keep, F.size(w).cast("long").alias("n_words"), hashes.alias("_h"), "_l", "_t")
    made = F.struct(
        "n_words",
        F.char_length("_t").cast("long").alias("word_chars"),
        F.regexp_count(F.col("_t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count(F.col("_t"), F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.coalesce("lang", F.lit("none")).alias("stratum"),
    )
    # out of a generator, so that no rule that reads a count copies its expression
    return two.select(*keep, made.alias("_f")).select(*keep, F.inline(F.array("_f")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def fires(rule: str, cutoff: int) -> Column:
    num, den, _ = RULES[rule]
    return 1000 * F.col(num) > cutoff * F.col(den)


def fall() -> Column:
    """The first step of the path that rejects a document; null if none does."""
    out = F
    for i, (r, c) in enumerate(PATH):
        out = out.when(fires(r, c), i)
    return out


def cutoffs_at(level: int | None) -> dict[str, int | None]:
    """The cutoff of each rule at a step of the path."""
    steps = PATH[: level + 1] if level is not None else []
    return {r: min((c for x, c in steps if x == r), default=None) for r in RULES}


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed in logarithms."""
    step = lambda a, i: F.struct(
        (a["lt"] + F.ln((n - i + 1) / i) + F.ln(F.lit(rate / (1 - rate)))).alias("lt"), (a["s"] + F.exp(a["lt"] + F.ln((n - i + 1) / i) + F.ln(F.lit(rate / (1 - rate))))).alias("s")
    )
    first = n * F.ln(F.lit(1 - rate))
    start = F.struct(first.alias("lt"), F.exp(first).alias("s"))
    return F.when(k >= n * rate, 1.0).when(k == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["s"])


def levels(features: DataFrame, labels: DataFrame, rate: float = RATE, error: float = ERROR) -> DataFrame:
    """stratum, n (labelled good documents) and level, the last step of the path that is admitted; null where none is.

    features: of with_features; labels: doc_id, quality (1 is good). A document that
    is labelled more than once counts with its lowest label. Documents that fail the
    base rules do not count, nor do null doc_ids; each row of a repeated doc_id counts.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select("doc_id")
    held = features.filter(~base_failed()).join(good.hint("merge"), "doc_id", "left_semi").select("stratum", fall().alias("_fall"))
    counts = staged(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_fall") <= i).alias(f"_{i}") for i in range(len(PATH))]), "counts")
    least = error / max(1, counts.count())
    tails = [binomial_tail(F.col("n"), F.col(f"_{i}"), rate) for i in range(len(PATH))]
    passed = F.filter(F.transform(F.array(*tails), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] <= least)
    # tails rise along the path, so those that pass are its beginning
    return counts.select("stratum", "n", F.when(F.size(passed) > 0, F.size(passed) - 1).alias("level"))


def verdict(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """features plus base_failed and kept. ``cuts`` has one row per stratum; a stratum without one keeps all that the base rules keep. Every row has its own verdict, whether its doc_id is null or repeated."""
    joined = features.join(sized(staged(cuts.select("stratum", F.col("level").alias("_level")), "cuts")), "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(fall() <= F.col("_level"), F.lit(False))).drop("_level")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of docs.

    Only counts are gathered; no text is shuffled while the rejected ids are few
    enough to be broadcast. A doc_id goes if any of its rows fails; rows without
    doc_id stay.
    """
    feats = staged(with_features(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "features")
    bad = staged(verdict(feats, levels(feats, labels)).filter("not kept").select("doc_id").distinct(), "rejected")
    return by_ids(docs, bad, "doc_id", "left_anti").select(*docs.columns)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    feats = staged(with_features(docs).drop("text", "lang"), "features")
    return verdict(feats, levels(feats, read(spark, sf_dir, "labels"))).select(*COLUMNS)


_FALL = "CASE " + " ".join(f"WHEN 1000 * {RULES[r][0]} > {c} * {RULES[r][1]} THEN {i}" for i, (r, c) in enumerate(PATH)) + " END"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'none') AS stratum FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(count(DISTINCT i + j) AS BIGINT) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {_FALL} AS fall FROM f),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
k AS (SELECT stratum, i, count(*) AS n, count(*) FILTER (WHERE fall <= i) AS k FROM good, (SELECT unnest(range(0, {len(PATH)})) AS i) GROUP BY ALL),
ok AS (SELECT stratum, max(i) AS level FROM k WHERE k < n * {RATE!r}::DOUBLE
         AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RATE!r}::DOUBLE) + (n - i) * ln(1 - {RATE!r}::DOUBLE)) FOR i IN range(0, k + 1)]) <= {ERROR!r}::DOUBLE / (SELECT count(DISTINCT stratum) FROM k)
       GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(fall <= level, false) AS kept FROM b LEFT JOIN ok USING (stratum)
"""
