"""Operators 11 to 13: importance resampling, sharding, prefix tries."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.llm import prefixtrie, resample, sharding
from ringsight.llm.common import workspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, bucket string, Score string, _hot long"
ODD = [
    None, "", " \t\n ", "one", "Two words", "a b c", "A-b_C d", "same " * 30, "x" * 3000, "word " * 25_000, "É é ß İ 你好 мир 🙂🙂 a b c\x85d é", "0x1F, 2.5; it's [ok] {no} ~tilde^", "same " * 30, "\x7f\x00a\x00b",
    "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in this long sentence of more than twenty words",
]


def against_sql(spark, sql, got, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda r: sorted(map(str, r))
    assert rows(want.fetchall()) == rows(tuple(x) for x in got.select(*want.columns).collect())


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i if i % 5 else None, t, "en", "b", "s", i) for i, t in enumerate([*ODD, *ODD])] + [(3, "one", "en", "b", "s", 1)] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11 importance resampling
def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(docs, target, num=5, den=100):
    at = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in grams(x)[1]:
                counts[at(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, fit = [], []
    for i, (doc, text) in enumerate(docs):
        n, fs = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        w = sum(gain[at(f)] for f in fs)
        out.append([doc, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        fit += [i] * (n >= 20)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for rank, i in enumerate(fit[: num * len(fit) // den], 1):
        out[i][4] = rank
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_resampling_matches_plain_python(spark, odd, parts):
    target = spark.createDataFrame([("the quick brown fox and 你好 мир",), (None,), ("word one two",)], "text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = resample.importance_resample(odd, target, 40, 100).select("doc_id", "n_features", "weight", "score", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = drawn([(r["doc_id"], r["text"]) for r in odd.collect()], [r["text"] for r in target.collect()], 40)
    # rows of equal doc_id and weight may have their ranks in any order, and are equal otherwise
    assert sorted(str(list(r)) for r in got) == want
    assert any("1]" in x for x in want)


def test_resampling_of_empty_tables(spark, odd, none):
    assert resample.importance_resample(none, odd).count() == 0
    got = resample.importance_resample(odd, none, 1, 1).filter("n_words >= 20")
    assert got.filter("rank is not null").count() == got.count() > 0 and got.agg(F.max("rank")).first()[0] == got.count()


def test_op11_matches_sql(spark):
    against_sql(spark, resample.OP11_SQL, resample.op11_importance_resampling(spark, SF))


def test_chained_seeds_are_crcs_of_runs():
    words = [b"ab", b"c", "é".encode(), b"ab", b"9"]
    want = [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert resample.feature_buckets(words).tolist() == want and resample.feature_buckets([]).tolist() == []


# 12 sharding
def laws(rows, n, shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by[k]) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_op12_holds_its_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = sharding.op12_external_shuffle(spark, SF).collect()
    laws(rows, len(docs))
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


@pytest.mark.parametrize("shards", [1, 3, 16, 64])
def test_shards_of_odd_rows(spark, odd, none, shards):
    path = workspace(spark, "shards")
    got = sharding.shard_documents(odd, path, shards, bucket_bytes=10_000)
    assert set(got.columns) == (set(odd.columns) - {"bucket", "_hot"}) | {"shard", "slot"}  # names of its own are replaced
    laws(got.collect(), odd.count(), shards)
    pairs = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert pairs(got) == pairs(odd)
    written = spark.read.parquet(path)
    listed = sharding.manifest(written)
    for k in (0, shards - 1):
        assert sorted(map(str, sharding.read_shard(written, listed, k, shards).select("doc_id", "text", "slot").collect())) == sorted(map(str, got.filter(F.col("shard") == k).select("doc_id", "text", "slot").collect()))
    assert sharding.shard_documents(none, workspace(spark, "shards"), shards).count() == 0


def test_order_is_the_same_however_rows_come_and_spreads(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    one = sharding.shard_documents(docs.repartition(7), workspace(spark, "shards"), bucket_bytes=1_000).collect()
    two = sharding.shard_documents(docs.orderBy(F.desc("id")), workspace(spark, "shards"), bucket_bytes=1_000).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    other = sharding.shard_documents(docs, workspace(spark, "shards"), seed=7, bucket_bytes=1_000).collect()
    assert sorted(map(str, one)) != sorted(map(str, other))
    means = defaultdict(list)
    for r in one:
        means[r["shard"]].append(r["doc_id"])
    assert all(abs(sum(x) / len(x) - 1999.5) < 5 * 4000 / math.sqrt(12 * len(x)) for x in means.values())  # ids are uniform in every shard


def test_hot_ids_are_spread(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = [r["count"] for r in sharding.scattered(docs, 50, hot=100).groupBy("bucket").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 3 * 60
    assert max(r["count"] for r in sharding.scattered(docs, 50, hot=5_000).groupBy("bucket").count().collect()) >= 1_000


def test_fisher_yates_is_uniform():
    seen = defaultdict(int)
    rng = np.random.default_rng(1)
    for _ in range(6_000):
        seen[tuple(sharding.fisher_yates(3, rng).tolist())] += 1
    assert len(seen) == 6 and all(abs(n - 1_000) < 150 for n in seen.values())
    assert sharding.fisher_yates(0, rng).tolist() == [] and sharding.fisher_yates(1, rng).tolist() == [0]


# 13 prefix tries
def test_parentheses():
    draw = random.Random(3)
    for _ in range(200):
        n, bits, opened, depth = draw.randint(1, 400), [1], 0, 0
        while len(bits) <= 2 * n:
            if opened < n and (depth == 0 or draw.random() < 0.55):
                bits, opened, depth = [*bits, 1], opened + 1, depth + 1
            else:
                bits, depth = [*bits, 0], depth - 1
        bits.append(0)
        tree, stack = prefixtrie.Parentheses(np.array(bits, np.int8), draw.choice([2, 4, 8, 64])), []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                assert tree.findclose(stack.pop()) == i
            assert tree.opens[i] == sum(bits[:i]) and tree.pairs[i] == sum(x == 1 and y == 0 for x, y in zip(bits[:i], bits[1 : i + 1]))


def plain_trie(convs):
    """conv -> list of (role, text): the rows of the trie, one dictionary entry for each prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, m in members.items():
        below = [x for x in members if len(x) >= len(node) and x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out[node] = (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(str, out.values()))


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


TURNS = "conv_id long, turn long, role string, text string, path string, shard long"


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_trie_matches_plain_python(spark, shards):
    draw = random.Random(shards)
    rows = [(c, t if t else None, draw.choice(["user", None, "assistant"]), draw.choice(["a", "é🙂", "", None]), "p", 1) for c in range(40) for t in range(draw.randint(1, 12))]
    rows += [(c, t, "user", f"hot {t}", "p", 1) for c in range(40, 90) for t in range(6)]  # most go on alike
    rows += [(None, 0, "user", "lost", "p", 1), (97, 0, "x", "y", "p", 1)]  # no base: turnless if h > 0
    got = prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.digested(spark.createDataFrame(rows, TURNS))), least_shards=shards)
    assert [c.split(" ")[0] for c in prefixtrie.NODE.split(", ")] == got.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(plain_rebuilt([r[:4] for r in rows]))


@pytest.mark.parametrize("shards", [1, 9])
def test_equal_conversations_over_many_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    same = spark.range(500).select(F.col("id").alias("conv_id"), F.array(*[F.lit(x).cast("binary") for x in "abc"]).alias("path"), F.array(*[F.lit(2).cast("long")] * 3).alias("sizes"))
    long = spark.range(500, 503).select(F.col("id").alias("conv_id"), F.array(*[F.lit("abc"[i % 3] if i < 3 else "z").cast("binary") for i in range(300)]).alias("path"), F.array_repeat(F.lit(1).cast("long"), 300).alias("sizes"))
    rows = {r["depth"]: r for r in prefixtrie.prefix_trie(same.union(long), least_shards=shards).collect()}
    assert len(rows) == 301 and all((r["conv_id"], r["n_leaves"], r["n_children"]) == (0 if d <= 3 else 500, 1, int(d < 300)) for d, r in rows.items())
    assert [rows[d]["n_convs"] for d in (0, 3, 4, 300)] == [503, 503, 3, 3] and rows[4]["parent_conv_id"] == 0 and rows[5]["parent_conv_id"] == 500
    assert rows[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert rows[0]["saved_tokens"] == 3 * 502 * 2 + 297 * 2 * 1  # two bytes a turn for all, one for the three that go on


def test_trie_of_no_conversations(spark):
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.digested(spark.createDataFrame([], TURNS)))).count() == 0


def test_op13_matches_sql(spark):
    against_sql(spark, prefixtrie.OP13_SQL, prefixtrie.op13_prefix_trie(spark, SF))
    against_sql(spark, prefixtrie.OP13_SQL, prefixtrie.op13_prefix_trie(spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1")
