import hashlib
import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.llm import bpe, chat, fingerprints, jaccard, langid, licenses, packing, quality, tokencount, warc
from ringsight.llm.common import workspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens long"
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "one", "Two words", "a b c", "A b C", "a  b\nc", "x" * 3000, "word " * 400, "same line\nsame line\n\nsame line",
    "it's we'll I'M don't 12 3½ ² é À Ñ ß İ ı Σ ΑΣ 你好 мир 🙂🙂 a\u00adb e\u0301 \u0301", "<|endoftext|> x<|startoftext|>y <|EndOfText|>", "a\x1cb\x85c\u2028d\u180ee\u200bf\xa0g",
    "three   spaces \n\n  and tabs\t\tend  ", "### $$$ %%% 123 456", "Licensed under the Apache License, Version 2.0.\nbody", "\\### Assistant: </turn> ok <turn> \\l \\e",
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, 7) for i, t in enumerate([*ODD, *ODD[3:6]])]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def by_doc(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 chat
def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", chat.PROBE), (1, 3, "assistant", "\\l</turn>\n<turn>user\n\\e"), (1, 4, "user", "tail"), (2, None, None, "x"), (2, 1, "odd\nrole>\\n", ""), (None, 0, "assistant", "é🙂"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    ex = chat.expand_prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = ex.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    for conv in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["example"])
        assert [tuple(t) for t in mine[-1]["turns"]] == want
        assert [r["loss"] for r in mine if r["is_target"]] == [t for role, t in want if role == "assistant"]
        for r in mine:
            assert [tuple(t) for t in r["turns"]] == want[: r["n_turns"]]
    assert chat.expand_prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 2 packing
def check_packing(rows, docs_text, path, capacity=2048):
    lib = bpe.library(path)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(docs_text)
    for d, t in docs_text.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        cuts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert [(pieces[d][k]["start"], pieces[d][k]["length"], pieces[d][k]["ids_crc32"]) for k in range(len(cuts))] == [(k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(spark, docs, odd, none):
    path = bpe.default_path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    n = check_packing(rows, texts(docs), path)
    assert n <= 1 + 1.005 * np.ceil(sum(r["length"] for r in rows) / 2048)
    check_packing(packing.pack_documents(odd, path).collect(), texts(odd), path)
    assert packing.pack_documents(none, path).count() == 0
    out = packing.pack(spark.createDataFrame([(5, "x"), (None, "y"), (9, "z"), (3, "x"), (3, "x"), (5, "w")], "length long, sequence string"), 8).collect()
    assert sum(r["sequence_id"] is None for r in out) == 2 and len({r["sequence_id"] for r in out} - {None}) == 2
    clash = [(5, i, 7, 9, None, 3, 2) for i in range(4)] + [(3, 1, 7, 9, "a", 4, 1)]
    wide = packing.pack(spark.createDataFrame(clash, "length long, slots long, _rank long, _length long, `a.b` string, offset long, sequence_id long"), 8)
    assert wide.columns == ["length", "slots", "_rank", "_length", "a.b", "sequence_id", "offset"]
    rows = wide.collect()
    assert all((r["_rank"], r["_length"]) == (7, 9) for r in rows) and sorted(r["slots"] for r in rows) == [0, 1, 1, 2, 3]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5 and len({r["sequence_id"] for r in rows}) == 4
    assert packing.pack(spark.createDataFrame([(5,), (3,), (3,)], "length long"), 8).agg(F.countDistinct("sequence_id", "offset")).first()[0] == 3


def used_by(plan, n):
    used = Counter()
    for conf, m in plan:
        for i, k in conf.items():
            used[i] += k * m
    return [used[i] for i in range(n)]


def test_configurations_cover():
    rng = np.random.default_rng(1)
    cases = [(np.unique(rng.integers(1, 65, 12)), None) for _ in range(5)] + [(np.array([40]), [7]), (np.array([20, 45]), [9, 100]), (np.array([64]), [3]), (np.array([], np.int64), []), (np.array([1]), [1])]
    for lengths, counts in cases:
        counts = rng.integers(1, 50, len(lengths)) if counts is None else np.array(counts, np.int64)
        plan = packing.configurations(lengths, counts, 64)
        assert all(sum(int(lengths[i]) * k for i, k in conf.items()) <= 64 and m > 0 for conf, m in plan.packed)
        assert used_by(plan.packed, len(lengths)) == counts.tolist()
        assert plan.bound <= plan.sequences <= 1.2 * plan.bound + 2
    assert packing.configurations(np.array([40]), np.array([7]), 64).bound == 7  # the dual bound sees what the tokens do not
    assert packing.configurations(np.array([20, 45]), np.array([9, 100]), 64).bound >= 98


def test_program_makes_the_packing(spark):
    """On the lengths of sf0.1's documents (by words) the program covers nearly all, and most sequences are its columns."""
    words = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select((2 * F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")) + 1).alias("n"))
    n = np.array([r["n"] for r in words.collect()])
    hist = np.bincount(n % 2048, minlength=2049)
    hist[2048], hist[0] = (n // 2048).sum(), 0
    lengths = np.flatnonzero(hist)
    plan = packing.configurations(lengths, hist[lengths], 2048)
    assert used_by(plan.packed, len(lengths)) == hist[lengths].tolist()
    assert plan.value <= 1.005 * plan.bound + 1  # the program's gap to its dual bound
    assert plan.sequences <= 1.005 * plan.bound + 1
    assert plan.columns > 0.5 * plan.sequences and plan.covered > 0.5


def test_knapsack_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 6))
        prices = rng.random(len(lengths)) * lengths
        got, want = packing.knapsack(lengths, prices, 40), [0.0] * 41
        for c in range(1, 41):
            want[c] = max([want[c - 1]] + [want[c - x] + p for x, p in zip(lengths.tolist(), prices.tolist(), strict=True) if x <= c])
        assert np.allclose(got, want)


# 3 WARC
def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (7, "u", big), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "z" * 2000), (None, "u", big), (9, "u", "a" * 1000), (10, "u", "a" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("n_bytes", F.lit(2))
    path = workspace(spark, "warc")
    warc.write_archives(df, path)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    want = []
    for p, _, html in rows:
        b = (html or "").encode()
        again = (html == big and p != 7) or p == 9
        want.append((p or -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", (7 if html == big else 10) if again else None))
    assert got == sorted(want, key=lambda x: x[:4]) or sorted(got, key=str) == sorted(want, key=str)
    path = workspace(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_parts(spark):
    """Members and records over any borders of parts; a cut file is an error."""
    import gzip

    rec = lambda b: f"WARC/1.1\r\nContent-Length: {len(b)}\r\nX: y\r\n\r\n".encode() + b + b"\r\n\r\n"
    bodies = [b"", b"a\r\n\r\nb", b"z" * 5000, "é".encode() * 700]
    blob = b"".join(gzip.compress(rec(b)) for b in bodies[:2]) + gzip.compress(b"".join(map(rec, bodies[2:])))
    for step in (1, 7, 64, 1 << 20):
        assert [b for _, b in warc.parse_warc(warc.inflated(blob, step))] == bodies
    with pytest.raises(ValueError):
        list(warc.parse_warc([b"".join(map(rec, bodies))[:-900]]))
    path = workspace(spark, "warc")
    pages = spark.createDataFrame([(i, "u", "x" * (i * 10)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path, file_bytes=20_000)
    assert spark.read.format("binaryFile").load(path).count() > 5 and warc.read_archives(spark, path).count() == 200


# 4 Jaccard
def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]


def shingles(t, n):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs_text, n, num, den):
    sets = {d: shingles(t, n) for d, t in docs_text.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        seen = Counter(e for s in sets[d] for e in index[s])
        for e, i in seen.items():
            if den * i >= num * (len(sets[d]) + len(sets[e]) - i):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            index[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_matches_brute_force(spark, docs, n, num, den):
    rng = np.random.default_rng(3)
    base = texts(docs)
    grown = dict(base)
    for d, t in list(base.items())[:120]:  # copies with few edits, at all sizes
        w = t.split()[: int(rng.integers(1, 60))]
        for k in range(5):
            v = list(w)
            for _ in range(int(rng.integers(0, 3))):
                v[int(rng.integers(len(v)))] = f"w{rng.integers(3)}"
            grown[100_000 + d * 10 + k] = " ".join(v)
    df = spark.createDataFrame(list(grown.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, num, den).collect()}
    assert got == brute(grown, n, num, den)


@pytest.mark.parametrize("block", [2, 128])
def test_jaccard_links_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(4)
    pieces = {0: None, 1: "", 2: "one", 3: "one"}
    for g, size in enumerate((6, 30, 90)):  # groups of near copies, some of them equal
        base = [f"v{rng.integers(10_000)}" for _ in range(size)]
        for k in range(14):
            v = list(base)
            for _ in range(k // 3):
                v[int(rng.integers(size))] = f"w{rng.integers(4)}"
            pieces[100 * (g + 1) + k] = " ".join(v)
    sets = {d: shingles(t or "", 3) for d, t in pieces.items()}
    want = {(a, b) for a in sets for b in sets if a > b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(list(pieces.items()), "doc_id long, text string").repartition(3)
    pairs, members = jaccard.jaccard_links(df, 3, 80, 100)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    got = {(a, b) for a in rep for b in rep if a > b and sets[a] and (rep[a] == rep[b] or (max(rep[a], rep[b]), min(rep[a], rep[b])) in linked)}
    assert got == want and all(rep[a] == a and rep[b] == b for a, b in linked)
    rows = by_doc(jaccard.jaccard_degrees(df, 3, 80, 100))
    full = brute({d: t or "" for d, t in pieces.items()}, 3, 80, 100)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == full
    assert {d: r["n_links"] for d, r in rows.items()} == {d: sum(d in p for p in want) for d in sets}


def test_jaccard_edges(odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()}
    assert got == brute(texts(odd), 3, 90, 100)
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_signatures_lose_no_pair(num, den):
    rng = np.random.default_rng(5)
    scheme = jaccard.Scheme(num, den)
    for trial in range(3000):
        boundary = (1, 8, 12, 20)[trial % 4]
        n = int(rng.integers(1, 400)) if rng.random() < 0.3 else int(rng.integers(1, 45))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        cut = int(rng.integers(0, max(1, n // 4) + 1))
        new = rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 4) + 1)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = np.unique(a), np.unique(np.concatenate([a[cut:], new]))
        inter = len(np.intersect1d(x, y))
        if len(y) and den * inter >= num * (len(x) + len(y) - inter):
            (sx, gx), (sy, gy) = jaccard.signatures(x, scheme, boundary), jaccard.signatures(y, scheme, boundary)
            if max(len(x), len(y)) <= boundary:
                assert len(np.intersect1d(sx, sy))
            else:  # each may leave its longest lists, but for its need
                assert len(np.intersect1d(gx, gy)) >= max(scheme.need(len(x)), scheme.need(len(y)))


def test_boundary_follows_cost():
    s = jaccard.Scheme(90, 100)
    assert s.fitted({5: 1000}).boundary >= 5 and s.fitted({30: 1000}).boundary < 30 and s.fitted({}).boundary == 1
    for sizes in ({5: 10, 14: 3, 20: 50}, {9: 1, 12: 1000, 13: 5}, {k: 1 for k in range(1, 60)}):
        b = s.fitted(sizes).boundary
        assert all(s.cost(b, sizes) <= s.cost(x, sizes) for x in range(1, 90) if s.subsets(x) <= jaccard.MOST_SUBSETS)


@pytest.mark.parametrize("block", [2, 5])
def test_open_lists_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "OPEN", block)
    rng = np.random.default_rng(8)
    docs_text = {}
    for g in range(6):  # groups whose members differ from the least one more than from each other
        base = [f"v{g}_{i}" for i in range(60)]
        for k in range(12):
            v = list(base)
            for _ in range(int(rng.integers(0, 6))):
                v[int(rng.integers(60))] = f"w{rng.integers(3)}"
            docs_text[100 * g + k] = " ".join(v)
    df = spark.createDataFrame(list(docs_text.items()), "doc_id long, text string").repartition(3)
    for n, num in ((3, 90), (3, 75)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, num, 100).collect()}
        assert got == brute(docs_text, n, num, 100)


# 5 language
def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs.withColumn("held", langid.bucket() == 1), langid.fit(docs.filter(langid.bucket() != 1))).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    rows = by_doc(langid.predict(odd, langid.fit(docs)))
    assert all((rows[i]["lang_pred"] == "und") == (not langid.has_letter(t)) for i, t in enumerate(ODD))
    empty = langid.predict(odd, langid.fit(none)).collect()
    assert {r["lang_pred"] for r in empty} == {"und"}
    assert langid.predict(none, langid.fit(docs)).count() == 0


def test_language_keeps_rare_languages(spark):
    import corpus_pipeline as p

    rows = [(100 * k + i, " ".join(chr(0x4E00 + 20 * k + (i + j) % 10) * 3 for j in range(12)), f"l{k:02}", None, None, None) for k in range(70) for i in range(6 - (k > 60))]
    df = spark.createDataFrame(rows, DOCS)
    assert all(r["lang"] == r["lang_pred"] for r in langid.predict(df, langid.fit(df)).collect())
    assert p.language(spark, df, SF).count() == len(rows)
    bare = spark.createDataFrame([(1, "some words", None, None, None, None), (2, "12 %", None, None, None, None), (3, None, None, None, None, None)], DOCS)
    assert [r["doc_id"] for r in p.language(spark, bare, SF).collect()] == [1]


def test_presence_in_parts(monkeypatch):
    text = "The quick Brown föx 12 — jumps " * 50
    whole = langid.Presence()(text)
    monkeypatch.setattr(langid, "PART", 64)
    assert set(whole) <= set(langid.Presence()(text))


def test_scores_are_kernel_ridge():
    """With all training texts as landmarks the model is the exact weighted kernel ridge regression, here solved in its dual form."""
    texts_, langs = ["der hund und die katze", "das haus und der baum", "the dog and the cat", "the house and a tree", "le chien et le chat", "la maison et un arbre", "ein mann", "a man", "un homme"], ["de", "de", "en", "en", "fr", "fr", "de", "en", "fr"]
    ridge = 1e-2
    make = langid.Presence()
    model = pickle.loads(pickle.dumps(langid.Model([make.packed(t) for t in texts_], langs, landmarks=100, ridge=ridge)))
    assert "marks" not in model.__getstate__()
    grams = lambda t: set(make(t).tolist())
    plain = {f" {t} "[i : i + n] for t in texts_[:1] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    assert len(plain) - 2 <= len(grams(texts_[0])) <= len(plain)  # but for grams that share a bucket
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    w = np.array([1 / langs.count(x) for x in langs])
    k = np.array([[kernel(a, b) + 1 for b in texts_] for a in texts_])
    y = np.array([[1.0 if x == lang else -1.0 for lang in model.langs] for x in langs])
    alpha = np.linalg.solve(k + ridge * np.diag(1 / w), y)
    new = ["the hund and le chat", "un arbre", "xyz"]
    want = np.array([[kernel(a, b) + 1 for b in texts_] for a in new]) @ alpha
    assert np.allclose(model.scores(*langid.Presence().matrix(new)), want, atol=2e-3)


def test_sets_of_the_sample(spark):
    """The driver gets bits, not texts; they are the sets of the texts."""
    df = spark.createDataFrame([("das haus", "de"), ("the house " * 90_000, "en"), ("12 %", "en"), ("", "en")], "text string, lang string")
    make, got = langid.Presence(), {r["lang"]: bytes(r["bits"]) for r in langid.packed_sets(df).collect()}
    assert got == {"de": make.packed("das haus"), "en": make.packed("the house " * 90_000)}
    assert all(len(b) == langid.BUCKETS // 8 for b in got.values())
    x, size = langid.unpacked(list(got.values()))
    y, other = make.matrix(["das haus", "the house the house "])
    assert sorted(size) == sorted(other) and {tuple(r) for r in x} == {tuple(r) for r in y}


def test_language_replaces_clashing_columns(spark, none):
    df = spark.createDataFrame([(1, "the house", "en", 7, "x"), (2, "das haus", "de", 8, "y")], "doc_id long, text string, lang string, score int, lang_pred string")
    got = langid.predict(df, langid.fit(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["en", "de"]


# 6 and 7 tokenizers
def test_pretokens_of_all_characters():
    """Cut by the pattern, a text has the tokenizer's own pre-tokens: their lengths add up to its tokens."""
    path = bpe.default_path("byte_bpe_50k.json")
    lib = bpe.library(path)
    rng = np.random.default_rng(6)
    alpha = [chr(c) for c in [*range(0, 0x250), 0x300, 0x301, 0x2028, 0x200B, 0x3A3, 0x3C2, 0x4E00, 0x4E8C, 0x43C, 0x438, 0x1F642, 0x3000, 0x661, 0x2167]] + [" "] * 80 + ["\n", "\t", "'s", "'ll", tokencount.SPECIAL, "<|"] * 4
    cases = ["".join(rng.choice(alpha, int(rng.integers(0, 50)))) for _ in range(4000)]
    cut = [tokencount.pretokens(t) for t in cases]
    assert ["".join(p) for p in cut] == cases
    flat = [w for p in cut for w in p]
    n = iter(tokencount.token_lengths(flat, path))
    assert [sum(next(n) for _ in p) for p in cut] == [len(e.ids) for e in lib.encode_batch(cases, add_special_tokens=False)]


def test_token_counts(docs, odd, none):
    path = bpe.default_path("byte_bpe_50k.json")
    lib = bpe.library(path)
    for df in (docs, odd):
        got = by_doc(tokencount.count_tokens(df, path))
        for d, t in texts(df).items():
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (got[d]["n_tokens"], got[d]["n_bytes"], got[d]["over_limit"]) == (n, len(t.encode()), n > 1024), t[:50]
    assert tokencount.count_tokens(none, path).count() == 0


def test_bpe(docs, odd, none):
    path = bpe.default_path("word_bpe_49k.json")
    lib = bpe.library(path)
    for df in (docs, odd):
        got = by_doc(bpe.encode_table(df, path))
        for d, t in texts(df).items():
            ids = lib.encode(t, add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))), t[:50]
    assert bpe.encode_table(none, path).count() == 0


def test_cut_gives_no_blank_words():
    """Texts that end in blanks where their buffer ends."""
    import pyarrow as pa

    for n in range(600):
        texts = ["x" * (n % 70) + " " * (n % 5), "three   spaces \n\n  and tabs\t\tend  " + "\u2003" * (n % 3)]
        assert bpe.WordBpe._cut(pa.array(texts)).to_pylist() == [t.split() for t in texts]


# 8 licences
def test_licenses(spark, none):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/d/y.txt", None), (4, "a/z.txt", "text"), (5, "q/w.txt", ""), (6, "a/b/h.txt", "word " * 500 + "\nLicensed under the Apache License, Version 2.0.\nmore"),
        (7, None, "x"), (8, "a/b/c/e.txt", "a licence of no kind with many other words in it"), (9, "LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: (r["license"], r["via"], r["from_dir"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("MIT", "inherited", "a/b") and got[3] == ("MIT", "inherited", "a/b")
    assert got[6][:2] == ("Apache-2.0", "header") and got[8] == ("MIT", "inherited", "a/b") and got[9][:2] == ("GPL-3.0", "header")
    assert got[4] == ("GPL-3.0", "inherited", "") and got[5] == ("GPL-3.0", "inherited", "") and got[7] == ("GPL-3.0", "inherited", "")
    assert licenses.scan_licenses(none.withColumn("path", F.lit("x"))).count() == 0


def brute_cosines(pieces, templates):
    """{(piece, license): cosine} with document frequencies of all terms over all pieces."""
    cut = lambda t: Counter(x.rstrip(".") for x in __import__("re").split("[^a-z0-9.]+", t.lower()) if x.rstrip("."))
    tf = {k: cut(t) for k, t in pieces.items()}
    df = Counter(x for c in tf.values() for x in c)
    vec = lambda c: {x: k * (np.log((len(tf) + 1) / (df[x] + 1)) + 1) for x, k in c.items()}
    unit = lambda v: {x: w / np.sqrt(sum(y * y for y in v.values())) for x, w in v.items()}
    names = {k: unit(vec(cut(t))) for k, t in templates.items()}
    out = {}
    for k, c in tf.items():
        v = unit(vec(c))
        out |= {(k, name): sum(w * t[x] for x, w in v.items() if x in t) for name, t in names.items() if v.keys() & t.keys()}
    return out


@pytest.mark.parametrize("size", [40, 4000])
def test_license_weights_count_all_terms(spark, size):
    """A header with frequent extra words keeps its match at any size of the corpus."""
    head = "Copyright (c) 2020 The Project Authors. Licensed under the Apache License, Version 2.0"
    pieces = {i: head if i % 4 else f"Licensed by word{i} other{i % 7}" for i in range(size)}
    df = spark.createDataFrame(list(pieces.items()), "doc_id long, text string")
    tokens = defaultdict(list)
    for r in licenses.header_pieces(df).collect():
        tokens[r["doc_id"], r["piece"]] += [r["term"]] * r["tf"]
    want = defaultdict(float)
    for ((i, _), _), v in brute_cosines({k: " ".join(t) for k, t in tokens.items()}, licenses.TEMPLATES).items():
        want[i] = max(want[i], v)
    got = by_doc(licenses.line_scores(df))
    for i in range(0, size, 3):
        assert got[i]["cosine"] == pytest.approx(want[i], abs=1e-6)
    assert got[1]["license"] == "Apache-2.0" and got[1]["cosine"] > licenses.NEAR


def test_license_files_and_wrapped_headers(spark):
    full = licenses.TEXTS
    prose = "the quick brown fox and the lazy dog ran over the hill to the house of the old man " * 3
    rows = [(i, f"{name}/{file}", text) for i, (name, text) in enumerate(full.items()) for file in ("LICENSE",)]
    rows += [(100 + i, f"{name}/src/a.c", "int x;") for i, name in enumerate(full)]
    wrapped = "/*\n * This Source Code Form is subject to the\n * terms of the Mozilla\n * Public\n * License, v. 2.0\n */\n" + prose
    rows += [
        (200, "w/a.c", wrapped), (201, "w/b.c", "int y;"), (202, "any/T.txt", full["GPL-3.0"]), (203, "any/b.c", "int z;"), (204, "p/a.txt", prose + "\nReleased under the MIT License.\n" + prose[:80]), (205, "p/b.txt", "x"),
        (206, "n/COPYING", prose + "\nReleased under the MIT License.\n" + prose), (207, "n/b.txt", "x"), (208, "k/a.txt", (prose * 40) + " copyright of the author"),
    ]
    got = by_doc(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    for i, name in enumerate(full):
        assert (got[i]["license"], got[i]["via"]) == (name, "header") and (got[100 + i]["license"], got[100 + i]["from_dir"]) == (name, name)
    assert (got[200]["license"], got[200]["via"], got[201]["via"]) == ("MPL-2.0", "header", "none") and got[200]["cosine"] > 0.99
    assert got[203]["license"] == "GPL-3.0" and got[204]["license"] == "MIT" and got[205]["via"] == "none"  # a header is no licence file
    assert got[207]["license"] == "MIT" and got[208]["via"] == "none"


@pytest.mark.parametrize("most", [0, 100_000])
def test_license_ties_copies_and_long_texts(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_DIRS", most)  # salted and broadcast joins
    long = "\n".join(f"some words of line {i} without blank lines between" for i in range(6000))
    rows = [
        (1, "r/LICENSE", "Released under the MIT License"), (1, "r/LICENSE", "Released under the MIT License"), (2, "r/COPYING", "Licensed under CC BY-NC 4.0"), (3, "r/x.c", "a"), (3, "r/x.c", "a"),
        (4, "l/a.txt", long + "\nReleased under the MIT License\n" + long), (5, "l/b.txt", long + "\nall permission " * 200), (6, None, None), (7, "", ""), (None, "r/y.c", "b"),
    ]
    got = defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["via"], r["from_dir"]))
    assert got[1] == [("MIT", "header", None)] * 2 and got[2] == [("CC-BY-NC-4.0", "header", None)]
    assert got[3] == [("MIT", "inherited", "r")] * 2 and got[None] == [("MIT", "inherited", "r")]  # of a directory's licence files the least doc_id gives
    assert got[4] == [("MIT", "header", None)] and got[5] == got[6] == got[7] == [(None, "none", None)]


# 9 quality
def naive_features(t):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_features(docs, odd, none):
    for df in (docs, odd):
        got = by_doc(quality.with_features(df))
        for d, t in texts(df).items():
            r = got[d]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == naive_features(t), t[:50]
    assert quality.with_features(none).count() == 0


def test_quality_cutoffs(spark, none):
    from math import comb

    tail = lambda n, k, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    cases = [(10, 0), (500, 1), (500, 4), (3000, 12), (100, 5)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(tail(r["n"], r["k"], 0.01), rel=1e-9) or (r["k"] >= 0.01 * r["n"] and r["p"] == 1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(none, labels).columns == none.columns
    good = " ".join(f"w{i}" for i in range(60))
    some = spark.createDataFrame([(1, good, None, None, None, 1), (2, "too short", "en", None, None, 1)], DOCS)
    assert [r["doc_id"] for r in quality.quality_filter(some, labels).collect()] == [1]


def test_quality_levels_on_known_labels(spark):
    """Of 1,000 good documents a stratum, the share that falls at each step is known; the level is what the exact test says, by plain Python."""
    from math import comb

    rate, error = 0.05, 0.05
    tail = lambda n, k: sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
    fallen = {"a": {0: 10, 1: 5, 7: 12, 20: 100}, "b": {2: 400}, "c": {}, "few": {}}  # step -> documents
    rows, doc = [], 0
    for stratum, steps in fallen.items():
        n = 40 if stratum == "few" else 1000
        todo = [s for s, k in steps.items() for _ in range(k)]
        for step in todo + [None] * (n - len(todo)):
            f = {"n_words": 1000, "word_chars": 5000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1000, "n_upper": 0}
            if step is not None:
                rule, cut = quality.PATH[step]
                num, den, _ = quality.RULES[rule]
                f[num] = cut * f[den] // 1000 + 1
            rows.append((doc, stratum, *f.values()))
            doc += 1
    feats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    labels = feats.select("doc_id", F.lit(1).alias("quality")).unionByName(feats.filter("stratum = 'few'").select("doc_id", F.lit(1).alias("quality")))
    got = {r["stratum"]: r["level"] for r in quality.levels(feats, labels, rate, error).collect()}
    want = {}
    for stratum, steps in fallen.items():
        n = 40 if stratum == "few" else 1000
        ok = [i for i in range(len(quality.PATH)) if tail(n, sum(k for s, k in steps.items() if s <= i)) <= error / 4]
        want[stratum] = max(ok) if ok else None
    assert got == want and got["a"] == 19 and got["b"] == 1 and got["c"] == len(quality.PATH) - 1 and got["few"] is None
    kept = {(r["stratum"], r["kept"]): r["count"] for r in quality.verdict(feats, quality.levels(feats, labels, rate, error)).groupBy("stratum", "kept").count().collect()}
    assert kept == {("a", False): 27, ("a", True): 973, ("b", True): 1000, ("c", True): 1000, ("few", True): 40}
    assert quality.cutoffs_at(got["b"]) == {"symbols": 800, "dup_lines": 600, "repeats": None, "long_words": None, "shouting": None} and set(quality.cutoffs_at(None).values()) == {None}


def test_quality_sql_where_levels_are_admitted(spark):
    """At sf0.1 every stratum has a level; query and SQL agree on it."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT {', '.join(quality.COLUMNS)} FROM ({quality.OP9_SQL})").fetchall()}
    got = quality.op9_quality_rules(spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(not r["kept"] and not r["base_failed"] for r in got)


# 10 fingerprints
def test_fingerprints(spark, docs, odd, none):
    for df in (docs, odd):
        t = texts(df)
        order = sorted(t)
        nxt = {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}
        pairs = fingerprints.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<long>").alias("sketch")), rows_per_bucket=7)
        got = {r["doc_id"]: r["next_text"] for r in pairs.collect()}
        assert got == {d: t[nxt[d]] for d in t}
    s = lambda x: fingerprints.sketch(F.lit(x))
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(100, 500))
    r = spark.range(1).select(fingerprints.resemblance(s(a), s(b)).alias("j"), fingerprints.containment(s(a), s(b)).alias("c"), fingerprints.distinct_shingles(s(a)).alias("n"), (fingerprints.merge(s(a), s(b)) == s(a + " " + b)).alias("m"), fingerprints.resemblance(s(""), s(" ")).alias("e")).first()
    assert abs(r["j"] - 296 / 496) < 0.15 and abs(r["c"] - 296 / 396) < 0.2 and abs(r["n"] - 396) < 120 and r["e"] == 1
    assert fingerprints.with_next(none.select("doc_id", "text").withColumn("sketch", F.array().cast("array<long>"))).count() == 0


def brute_sketch(text, k=128, size=5):
    import xxhash

    w = __import__("re").findall("[^\x20\x09-\x0d]+", text)

    def h(parts):
        x = 42
        for p in parts:
            x = xxhash.xxh64_intdigest(p.encode(), seed=x)
        return x - (1 << 64) if x >= 1 << 63 else x

    grams = {h(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {h([" ".join(w)])} if w else set()
    return sorted(grams)[:k]


def brute_resemblance(a, b, k=128):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def test_op10_matches_plain_python(spark, tmp_path):
    from ringsight.llm.queries import QUERIES

    t = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    t |= {10_000 + i: x or "" for i, x in enumerate(ODD)} | {10_100: t[min(t)], 10_101: "w " * 30_000}
    spark.createDataFrame([(d, x or None) for d, x in t.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_doc(QUERIES["op10_fingerprints"](spark, str(tmp_path)))
    order = sorted(t)
    hexed = lambda s: ",".join(f"{x & ((1 << 64) - 1):X}" for x in s)
    for i, d in enumerate(order):
        x, y = t[d], t[order[(i + 1) % len(order)]]
        k = len(x) // 4
        e = x[: len(x) - k] + y[:k]
        a, b, c = brute_sketch(x), brute_sketch(e), brute_sketch(y)
        r = got[d]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(x), hexed(a), hexed(b))
        assert r["near_edited"] == pytest.approx(brute_resemblance(a, b)) and r["near_next"] == pytest.approx(brute_resemblance(a, c))


def test_next_with_null_and_repeated_ids(spark):
    rows = [(None, "n"), (None, "a"), (3, "x"), (3, "x"), (3, "b"), (5, "y"), (-9, "z")] + [(100 + i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.array().cast("array<long>"))
    for size in (1, 7, 4000):
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"], r["next_text"]) for r in fingerprints.with_next(df, size).collect())
        order = sorted((d if d is not None else -(1 << 63), x) for d, x in rows)
        assert got == sorted((d, x, order[(i + 1) % len(order)][1]) for i, (d, x) in enumerate(order))


def test_op10_edited_text(spark):
    from ringsight.llm.queries import QUERIES

    got = by_doc(QUERIES["op10_fingerprints"](spark, SF))
    t = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    order = sorted(t)
    for i, d in enumerate(order):
        x, y = t[d], t[order[(i + 1) % len(order)]]
        k = len(x) // 4
        assert got[d]["edited_sha256"] == hashlib.sha256((x[: len(x) - k] + y[:k]).encode()).hexdigest()


# all
CLASH = ("n_tokens", "n_bytes", "over_limit", "ids_sha256", "piece", "start", "length", "ids_crc32", "n_shingles", "component_id", "key", "bits", "need", "sig", "kept", "base_failed", "n_words", "stratum", "next_text", "_key", "_b", "turns", "pieces", "formatted", "loss_chars", "digest", "license", "dir", "lang_pred", "score", "_f", "n_chars", "record_type", "payload_digest")


def test_clashing_columns_copies_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(25_000)) + "\n" + "Released under the MIT License"
    rows = [(1, long, "en"), (1, long, "en"), (2, long + " x", None), (None, "a b c", "de"), (3, None, None), (4, "", "en"), (5, "a b c", "de")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide = plain.withColumns({c: F.lit(7) for c in CLASH})
    path, labels = bpe.default_path("word_bpe_49k.json"), plain.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"))
    empty = F.array().cast("array<long>")
    model = langid.fit(plain)
    some = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    ops = {
        "2": lambda d: some(packing.token_pieces(d, path), "doc_id", "piece", "start", "length", "ids_crc32"),
        "4": lambda d: some(jaccard.jaccard_components(d.filter("doc_id is not null")), "doc_id", "n_shingles", "component_id"),
        "5": lambda d: some(langid.predict(d, model), "doc_id", "lang_pred"),
        "6": lambda d: some(tokencount.count_tokens(d, bpe.default_path("byte_bpe_50k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit"),
        "7": lambda d: some(bpe.encode_table(d, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
        "8": lambda d: some(licenses.scan_licenses(d.withColumn("path", F.lit("a/x"))), "doc_id", "license", "via"),
        "9": lambda d: some(quality.verdict(quality.with_features(d), quality.levels(quality.with_features(d), labels)), "doc_id", "n_words", "kept"),
        "10": lambda d: some(fingerprints.with_next(d.select("*", F.coalesce("text", F.lit("")).alias("t")).drop("text").withColumnRenamed("t", "text").withColumn("sketch", empty)), "doc_id", "next_text"),
    }
    for name, op in ops.items():
        got = op(plain)
        assert got == op(wide), name
        assert len(got) >= (6 if name == "4" else 7), name
        by = defaultdict(list)
        for r in got:
            by[r[0]].append(r)
        if name in ("6", "7", "8", "9"):
            assert len(by[1]) == 2 and by[1][0] == by[1][1], name
    assert quality.quality_filter(wide, labels).columns == wide.columns
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    full = turns.withColumns({c: F.lit(7) for c in CLASH})
    want = some(chat.expand_prefix_targets(turns), "conv_id", "example", "n_turns", "loss_chars", "formatted")
    assert want == some(chat.expand_prefix_targets(full), "conv_id", "example", "n_turns", "loss_chars", "formatted") and len(want) == 3


# pipeline
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns
        assert out.count() > 0.3 * seen.count()
        seen = out
    kept = texts(seen)
    assert all(c[1] == d for d, c in brute(kept, 5, 80, 100).items())
    check_packing(p.STAGES[-1][1](spark, seen, SF).collect(), kept, bpe.default_path("word_bpe_49k.json"))
