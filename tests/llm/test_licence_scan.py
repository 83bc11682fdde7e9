"""The licence scan over whole documents against a plain version."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from ringsight.llm import licenses as S

SF = "/root/testdata/sf0.001"
CUES = regex.compile(S.CUE, regex.I)


def terms(text):
    return [x for x in (t.rstrip(".") for t in regex.split(r"[^a-z0-9.]+", text.lower())) if x]


def pieces_of(text):
    out = [terms(p) for sep in (r"\n", r"\n[^\p{L}\p{N}\n]*\n") for p in regex.split(sep, text) if CUES.search(p)]
    ts = terms(text)
    for i, t in enumerate(ts):
        if m := regex.search(S.CUE, t):
            for cue, at, n in S.anchors():
                if cue == m[0].replace("licence", "license"):
                    out.append(ts[max(i - at, 0) :][: n - max(at - i, 0)])
    return [p for p in out if p]


def best(pieces, templates, least):
    """{doc: (cosine, license)} of the pieces {(doc, key): terms counted} that reach ``least`` of the template."""
    df = Counter(t for p in pieces.values() for t in p)
    weigh = lambda tf: {t: c * (math.log((len(pieces) + 1) / (df[t] + 1)) + 1) for t, c in tf.items()}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    marks, out = {k: weigh(Counter(terms(body))) for k, body in templates.items()}, {}
    for (doc, _), tf in pieces.items():
        w = weigh(tf)
        for name, m in marks.items():
            cos = sum(x * m.get(t, 0) for t, x in w.items()) / (size(w) * size(m))
            if cos > 0 and cos >= least(name):
                out[doc] = max(out.get(doc, (0, "")), (round(cos, 9), name.removesuffix("/full")))
    return out


def plain(files):
    """doc_id -> (license, via, from_dir, cosine, licenses) of files {doc_id: (path, text)}."""
    cued = {d: t for d, (_, t) in files.items() if t is not None and CUES.search(t)}
    parts = {(d, tuple(p)): Counter(p) for d, t in cued.items() for p in pieces_of(t)}
    head = {d: b for d, b in best(parts, S.TEMPLATES, lambda name: 0).items() if b[0] >= S.NEAR}
    names = S.TEMPLATES | {f"{k}/full": v for k, v in S.TEXTS.items()}
    whole = best({(d, 0): Counter(terms(t)) for d, t in cued.items()}, names, lambda name: S.WHOLE if name.endswith("/full") else S.NEAR)
    given = {}
    for d in sorted(files):
        path = files[d][0]
        if d in whole or d in head and regex.search(S.FILE_NAME, path):
            given.setdefault(path.rpartition("/")[0], []).append((whole.get(d) or head[d])[1])
    out = {}
    for d, (path, _) in files.items():
        if d in whole or d in head:
            cos, name = whole.get(d) or head[d]
            out[d] = (name, "header", None, round(cos, 4), [name])
            continue
        up = path.rpartition("/")[0]
        while up not in given and up:
            up = up.rpartition("/")[0]
        out[d] = (given[up][0], "inherited", up, None, sorted(set(given[up]))) if up in given else (None, "none", None, None, [])
    return out


def told(df):
    return {r["doc_id"]: (r["license"], r["via"], r["from_dir"], r["cosine"], r["licenses"]) for r in df.collect()}


def agree(got, want):
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:3] == w[:3] and got[d][4] == w[4] and (got[d][3] is None) == (w[3] is None) and (w[3] is None or abs(got[d][3] - w[3]) < 2e-4), d


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()


def test_op8_matches_plain_python(spark, rows):
    want = plain({r["doc_id"]: (f"{r['source'] or 'none'}/{r['doc_id'] // 64}/{r['doc_id']}.txt", r["text"]) for r in rows})
    assert any(w[1] == "header" for w in want.values()) and any(w[1] == "none" for w in want.values())
    agree(told(S.op8_license_scan(spark, SF)), want)


def test_named_files_give_to_what_lies_below(spark, rows):
    """Every third cued document is a licence file, at several depths; a directory has two licences; full texts and a wrapped header stand among the documents."""
    texts = [r["text"] for r in rows] + [next(iter(S.TEXTS.values())), "# permission\n", S.TEMPLATES["ISC"].replace(" ", "\n", 9), None, ""]
    place = lambda i: "/".join(["a", f"b{i % 2}", f"c{i % 5}"][: i % 4])
    files = {i: (f"{place(i)}/".lstrip("/") + ("LICENSE" if i % 3 == 0 and t and CUES.search(t) else f"{i}.txt"), t) for i, t in enumerate(texts)}
    files |= {9000 + i: (f"a/dual/{name}", text) for i, (name, text) in enumerate([("LICENSE-MIT", S.TEMPLATES["MIT"]), ("LICENSE-APACHE", S.TEMPLATES["Apache-2.0"]), ("LICENSE", S.TEMPLATES["MIT"]), ("code/main.txt", "no word of it")])}
    want = plain(files)
    assert want[9003] == ("MIT", "inherited", "a/dual", None, ["Apache-2.0", "MIT"])
    assert {w[1] for w in want.values()} >= {"header", "inherited"} and max(len(w[4]) for w in want.values()) > 1
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in files.items()], "doc_id long, path string, text string").repartition(3)
    agree(told(S.scan_licenses(df)), want)
    assert S.scan_licenses(df.filter(F.lit(False))).count() == 0
