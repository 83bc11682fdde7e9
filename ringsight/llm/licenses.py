"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. Native expressions only.

Compared with header templates are the pieces of a text round its cue words: every
line with one, every block of adjacent lines with one, and the run of words that a
template would take if its own cue word stood there, however it is wrapped over lines.
Every text with a cue word is also compared as a whole, with the headers and with the
full licence texts under ``licences``. The weights of all terms use the document
frequency over all pieces, or all such texts. Only terms that a template has can add to
a product, so terms are joined to the template postings, a table of fixed size.

A file is a licence file of its directory if it matches as a whole, or if it has the
name of one and any match; files without a match of their own take the licence of the
nearest ancestor directory that has one. Ancestors are resolved once per directory and
joined to the files by directory; directories that give a licence are broadcast while
few, else salted, as the root or one directory may hold most files.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import bind, read, staged
from ringsight.session import sized

#: Header sentences of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Full texts of public licences.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
CUE = "licen[cs]e|copyright|permission|redistribution|waived"
CUES, NEAR, SALTS, FREQUENT, MOST_DIRS = f"(?i){CUE}", 0.6, 16, 1000, 100_000
#: A whole file matches a full text from here on: common words alone bring long English texts near each other.
WHOLE = 0.85
FILE_NAME = r"(?i)(^|/)((un)?licen[cs]e(-[\w.-]+)?(\.(txt|md|rst|html))?|copying(\.\w+)?)$"


def terms(text: Column) -> Column:
    """Terms in lower case, without the dots at their end."""
    return F.filter(F.transform(F.split(F.lower(text), r"[^a-z0-9.]+"), lambda x: F.rtrim(x, F.lit("."))), lambda x: x != "")


def cosines(pieces: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Keys, license and cosine of all pairs of pieces (any key columns, term, tf) and templates that share a term.

    A term weighs tf * (log((n + 1) / (df + 1)) + 1) on both sides, with df of the n pieces holding it.
    """
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if c not in ("term", "tf")]
    n, rows = pieces.select(*keys).distinct().count(), pieces.count()
    known = spark.createDataFrame(list(templates.items()), "license string, body string")
    post = known.select("license", F.explode(terms(F.col("body"))).alias("term")).groupBy("license", "term").agg(F.count(F.lit(1)).alias("t_tf"))
    df = staged(pieces.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    idf = F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    post = post.join(df.join(F.broadcast(post.select("term").distinct()), "term", "left_semi"), "term", "left").withColumn("t_w", F.col("t_tf") * idf)
    norm = post.groupBy("license").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"))
    post = post.join(F.broadcast(norm), "license").groupBy("term").agg(F.collect_list(F.struct("license", (F.col("t_w") / F.col("t_norm")).alias("t_w"))).alias("post"))
    # terms with over 1 / FREQUENT of the rows are FREQUENT at most; the rest are in no hot key
    hot = F.col("df") > rows // FREQUENT
    w = pieces.join(F.broadcast(df.filter(hot)), "term", "left")
    w = w.filter(F.col("df").isNotNull()).unionByName(w.filter(F.col("df").isNull()).drop("df").join(df.filter(~hot).hint("merge"), "term"))
    w = w.join(F.broadcast(post), "term", "left").withColumn("w", F.col("tf") * idf)
    norms = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("post").isNotNull(), F.struct("w", "post"))).alias("ws"))
    hits = norms.select(*keys, "norm", F.explode("ws").alias("x")).select(*keys, "norm", F.col("x.w").alias("w"), F.explode("x.post").alias("p"))
    return hits.groupBy(*keys, F.col("p.license").alias("license")).agg((F.sum(F.col("w") * F.col("p.t_w")) / F.first("norm")).alias("cosine"))


def best(cos: DataFrame) -> DataFrame:
    """doc_id, license, cosine of each document's best piece. Ties go to the last name."""
    top = cos.groupBy("doc_id").agg(F.max(F.struct(F.round("cosine", 9).alias("cosine"), F.col("license"))).alias("b"))
    return top.select("doc_id", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"))


def anchors() -> list[tuple[str, int, int]]:
    """(cue word, its place, number of terms) of the header templates."""
    cut = [[t.rstrip(".") for t in re.split(r"[^a-z0-9.]+", body.lower()) if t.rstrip(".")] for body in TEMPLATES.values()]
    return sorted({(m[0].replace("licence", "license"), at, len(ts)) for ts in cut for at, t in enumerate(ts) if (m := re.search(CUE, t))})


def runs(ts: Column) -> Column:
    """Runs of the terms ``ts`` that a header template would take with its cue word on one of theirs."""
    cue = lambda t: F.replace(F.regexp_extract(t, CUE, 0), F.lit("licence"), F.lit("license"))
    ends = F.array(*[F.struct(F.lit(c).alias("cue"), F.lit(at).alias("at"), F.lit(n).alias("n")) for c, at, n in anchors()])
    places = F.filter(F.transform(ts, lambda t, i: F.struct(cue(t).alias("cue"), i.alias("i"))), lambda p: p["cue"] != "")
    run = lambda p, a: F.slice(ts, F.greatest(p["i"] - a["at"], F.lit(0)) + 1, a["n"] - F.greatest(a["at"] - p["i"], F.lit(0)))
    return F.flatten(F.transform(places, lambda p: F.transform(F.filter(ends, lambda a: a["cue"] == p["cue"]), lambda a: run(p, a))))


def cued(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(CUES))


def exploded(rows: DataFrame, values: str, name: str) -> DataFrame:
    """The other columns and each entry of the array column ``values``.

    An inner explode would filter by the array's size, which is then built several
    times. What is derived from a whole text or array must be a column before this:
    beside an explode it would be made again for every entry.
    """
    return rows.select(*[c for c in rows.columns if c != values], F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def header_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, piece, term, tf of the pieces round cue words: lines, blocks of adjacent lines, and runs of words."""
    text = F.col("text")
    cut = lambda sep: F.transform(F.filter(F.split(text, sep), lambda x: x.rlike(CUES)), terms)
    found = F.concat(cut("\n"), cut(r"\n[^\p{L}\p{N}\n]*\n"), bind(terms(text), runs))
    ts = exploded(cued(docs).select("doc_id", found.alias("all")), "all", "ts").withColumn("piece", F.xxhash64("ts"))
    # a piece that occurs k times has k times the tf in all its terms, which leaves its cosines as they are
    return exploded(ts, "ts", "term").groupBy("doc_id", "piece", "term").agg(F.count(F.lit(1)).alias("tf"))


def line_scores(docs: DataFrame) -> DataFrame:
    """doc_id, license, cosine of each document's best piece; documents without any match are absent.

    docs: doc_id, text. Null and empty texts have no pieces.
    """
    return best(cosines(staged(header_pieces(docs), "pieces"), TEMPLATES))


def whole_scores(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, license, cosine of documents that match a header or a full licence text as a whole."""
    rows = cued(docs).select("doc_id", F.xxhash64("text").alias("piece"), terms(F.col("text")).alias("all"))
    tf = exploded(rows, "all", "term").groupBy("doc_id", "piece", "term").agg(F.count(F.lit(1)).alias("tf"))
    names = TEMPLATES | {f"{k}/full": v for k, v in TEXTS.items()}
    full = F.col("license").endswith("/full")
    cos = cosines(staged(tf, "texts"), names).filter(F.col("cosine") >= F.when(full, WHOLE).otherwise(near))
    return best(cos.withColumn("license", F.regexp_replace("license", "/full$", "")))


def parent(path: Column) -> Column:
    """Directory of a path; '' is the root."""
    return F.when(F.locate("/", path) == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str) -> DataFrame:
    """Join on a key that may hold most rows: a table of up to MOST_DIRS counted rows is broadcast, a larger one copied to SALTS salts that the rows are dealt over."""
    if table.count() <= MOST_DIRS:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [key, "_salt"], how).drop("_salt")


def scan_licenses(files: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, license, via ('header', 'inherited' or 'none'), from_dir, cosine and licenses of each row of files (doc_id, path, text).

    A directory may give several licences: ``license`` is that of its least doc_id,
    ``licenses`` all of them by name (a file's own match alone, none where there is none).

    ``header`` is a match of the file's own, by a piece or as a whole; the latter goes
    first. A null path lies in the root. Rows with the same doc_id share a match.
    """
    path = F.coalesce("path", F.lit(""))
    docs = files.select("doc_id", parent(path).alias("dir"), path.rlike(FILE_NAME).alias("named"), "text")
    some = staged(cued(docs).select("doc_id", "text"), "cued")
    head = line_scores(some).filter(F.col("cosine") >= near)
    whole = whole_scores(some, near).select("doc_id", F.struct("license", "cosine").alias("whole"))
    both = head.join(whole.hint("merge"), "doc_id", "full")
    match = staged(both.select("doc_id", F.coalesce("whole.license", "license").alias("license"), F.coalesce("whole.cosine", "cosine").alias("cosine"), F.col("whole").isNotNull().alias("is_whole")), "match")
    own = docs.select("doc_id", "dir", "named").join(sized(match), "doc_id", "left")
    giving = own.filter(F.col("license").isNotNull() & (F.col("is_whole") | F.col("named")))
    given = staged(giving.groupBy("dir").agg(F.min(F.struct("doc_id", "license")).alias("g"), F.sort_array(F.collect_set("license")).alias("dir_licenses")).select(F.col("dir").alias("up"), F.col("g.license").alias("dir_license"), "dir_licenses"), "given")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))
    ups = exploded(own.select("dir").distinct().select("dir", above.alias("all")), "all", "x").select("dir", "x.depth", "x.up")
    met = spread_join(ups, given, "up", F.xxhash64("dir"), "inner")
    found = staged(met.groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license", "dir_licenses")).alias("f")).select("dir", F.col("f.up").alias("from_dir"), F.col("f.dir_license").alias("dir_license"), F.col("f.dir_licenses").alias("dir_licenses")), "found")
    out = spread_join(own, found, "dir", F.xxhash64("doc_id"), "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id", F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"), F.round("cosine", 4).alias("cosine"),
        F.when(mine, F.array("license")).otherwise(F.coalesce("dir_licenses", F.array().cast("array<string>"))).alias("licenses"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: SOURCE/BLOCK/DOC_ID.txt, 64 documents to a block."""
    docs = read(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / 64).cast("string")
    return scan_licenses(docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), block, F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text"))
