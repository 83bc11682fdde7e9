"""Exact n-gram Jaccard join by a size-aware heavy-light scheme; returns components of linked documents.

A document is the set of hashes of its word n-grams; equal sets form one class and
only its least doc_id goes on. Two sets of sizes s <= t link if their overlap is at
least num / den of their union.

Small sets (up to a boundary) enumerate their subsets of the fixed sizes that an
overlap can have: two small sets that link have a common subset of the size of
their overlap, and both list it. Large sets are found through inverted lists of
single n-grams. A set is listed under its first n-grams in the order of hashes:
as many as may differ from any partner, and as many again. So two sets that link
are together in at least that second number of lists, and each may leave all but
one of these, its longest lists: a passage that very many documents share brings
none of them together, and a set with too few n-grams in common with any others
is in no list at all. The boundary is the one that costs least over the histogram of
the small sets' sizes: what each stores as subsets, or keeps and scans as lists.

A list yields no pairs of all its members, and of lists with equal members one is
kept. Every member is compared with the list's least one; linked ones are joined by
connected components. Of what remains only pairs of different components are
compared whose sizes, hash parities and distances to the least member (Jaccard
distance is a metric) still allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.llm.bpe import blocks
from ringsight.llm.common import by_ids, read, staged
from ringsight.operators.graph import connected_components
from ringsight.session import sized

#: Relative cost of scanning an inverted list against storing one subset; members of a list per copy of its least one.
SCAN_COST, PER_COPY, SALTS = 8, 48, 16
#: Members of a list that are compared under one key where all pairs are wanted, and where few are open.
BLOCK, OPEN = 128, 256
#: Members from which a list's own row is broadcast.
CROWD = 500
#: Sizes are counted for texts of up to so many bytes; subsets that a set may list at most.
SHORT, MOST_SUBSETS = 4096, 100_000
#: Parity words compared before whole parities are.
FIRST = 16
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words, A-Z in lower case; of the whole text if it has fewer words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z fall, only the six ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * M1 + h[j : len(h) - k + 1 + j])
    return np.unique(out)


@dataclass(frozen=True)
class Scheme:
    """What a threshold num / den means for sizes."""

    num: int = 90
    den: int = 100
    #: Largest size whose sets enumerate subsets.
    boundary: int = 1

    def overlap(self, size: int) -> int:
        """Least overlap with any partner: a smaller partner has at least this size."""
        return -(-self.num * size // self.den)

    def subsets(self, size: int) -> int:
        return sum(comb(size, j) for j in range(size - self.overlap(size) + 1))

    def spare(self, size: int) -> int:
        """n-grams listed beyond those that may differ, as many as these; it never falls with size."""
        return max(1, size - self.overlap(size))

    def listed(self, size: int) -> int:
        """Of its first n-grams, by hash, those under which a set is listed.

        At most size - overlap(size) of them are missing from a partner, so that two
        sets share as many lists as the smaller one's ``spare`` at least.
        """
        return size - self.overlap(size) + self.spare(size)

    def need(self, size: int) -> int:
        """Lists that a set shares with any partner, the least partner's ``spare``."""
        return self.spare(self.overlap(size))

    def cost(self, boundary: int, sizes: dict[int, int]) -> float:
        """Of sets by size: subsets stored up to the boundary, lists kept and scanned from the least partner of larger ones on."""
        small = sum(n * self.subsets(s) for s, n in sizes.items() if s <= boundary)
        return small + SCAN_COST * sum(n * self.listed(s) for s, n in sizes.items() if s >= self.overlap(boundary + 1))

    def fitted(self, sizes: dict[int, int]) -> Scheme:
        """The scheme with the boundary of the least cost, the lowest of equals. Sets left out of ``sizes`` are taken for large."""
        able = [b for b in range(1, 2 + self.den * max(sizes, default=1) // self.num) if self.subsets(b) <= MOST_SUBSETS] or [1]
        return replace(self, boundary=min(able, key=lambda b: (self.cost(b, sizes), b)))


def subset_keys(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A key for every subset of s that may be all of an overlap."""
    n, m = len(s), mix(s + M1)
    left, at = np.array([m.sum(dtype=np.uint64)]), np.array([-1])
    out = [mix(left * M1 + np.uint64(n))]
    for j in range(1, n - scheme.overlap(n) + 1):  # subsets with j n-grams left out, each once
        last = [np.arange(a + 1, n) for a in at]
        left = np.concatenate([x - m[k] for x, k in zip(left, last, strict=True)])
        at = np.concatenate(last)
        out.append(mix(left * M1 + np.uint64(n - j)))
    return np.concatenate(out)


def signatures(s: np.ndarray, scheme: Scheme, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of subsets, n-grams) under which a set is listed.

    Two small sets that link share a key; if one is large, they share ``need``
    n-grams of either one at least.
    """
    n, none = len(s), np.zeros(0, np.uint64)
    small = subset_keys(s, scheme) if 0 < n <= boundary else none
    return small, s[: scheme.listed(n)] if n >= scheme.overlap(boundary + 1) else none


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """Bits that tell whether an odd number of hashes fall on each place: sets differ by at least the bits that differ."""
    bits = (np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def parity_words(n: int) -> int:
    """A power of two, one to two bits for each n-gram, at most 512 words."""
    return min(512, 1 << max(0, (n - 1) // 64).bit_length())


def set_table(docs: DataFrame, n: int, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, key (equal for equal sets), bits, subsets, grams (what it is listed under), need of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        boundary = scheme.boundary
        for batch in batches:
            for part in blocks(batch):
                sets = [shingle_set(t, n) for t in part.column("text").to_pylist()]
                bits = [parity(s, parity_words(len(s))) for s in sets]
                small, grams = zip(*[signatures(s, scheme, boundary) for s in sets], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), _lists(bits),
                        _lists([x.view(np.int64) for x in small]), _lists([x.view(np.int64) for x in grams]), pa.array([scheme.need(len(s)) for s in sets], pa.int32()),
                    ],
                    names=["doc_id", "n_shingles", "key", "bits", "subsets", "grams", "need"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key string, bits array<long>, subsets array<long>, grams array<long>, need int")


def inverted_lists(table: DataFrame) -> DataFrame:
    """sig, doc_id, hub (the list's least doc_id), crowd (its length) of table (doc_id, subsets, grams, need).

    Lengths are counted before rows meet them, so a list that a third of all sets
    share is one row of counts a task, and its rows may be split.
    """
    small = table.select("doc_id", F.lit(1).alias("need"), F.lit(True).alias("whole"), F.explode("subsets").alias("sig"))
    rows = small.union(table.select("doc_id", "need", F.lit(False), F.explode("grams")))
    seen = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    longest = Window.partitionBy("doc_id", "whole").orderBy(F.desc("crowd"), F.desc("sig"))
    kept = rows.join(seen.hint("merge"), "sig").withColumn("place", F.row_number().over(longest)).filter("place >= need")
    kept = staged(kept.select("sig", "doc_id"), "kept")
    x = F.xxhash64("doc_id")
    same = ["hub", "crowd", "low", "high"]
    members = [F.min("doc_id"), F.count(F.lit(1)), F.sum(x.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(x, 33))]
    lists = kept.groupBy("sig").agg(*[m.alias(c) for m, c in zip(members, same, strict=True)]).filter("crowd > 1")
    one = staged(lists.groupBy(*same).agg(F.min("sig").alias("sig")).select("sig", "hub", "crowd"), "one")
    # the crowded lists, of which there is one for CROWD rows at most, go to the rows; no task has one as a whole
    big = one.filter(F.col("crowd") > CROWD)
    few = sized(big, 1_000_000)
    rest = kept.join(sized(big.select("sig"), 1_000_000), "sig", "left_anti").join(one.filter(F.col("crowd") <= CROWD).hint("merge"), "sig")
    return staged(kept.join(few, "sig").unionByName(rest), "lists")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def set_contents(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, s: the hashes themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = [shingle_set(t, n).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _lists(sets)], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def contents(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The sets of all documents in ``pairs`` (a, b)."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return staged(set_contents(by_ids(docs, wanted, "doc_id", "left_semi"), n), "contents")


def classes(sets: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep: the least doc_id with an equal set; itself where the set is empty. Hot keys are salted."""
    same = sets.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = same.select("key", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = sets.select("doc_id", "n_shingles", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return left.join(spread.hint("merge"), ["key", "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))


def meet(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b, crowd) with va and vb, the values (doc_id, v) of both ends.

    b may occur in very many pairs, at most ``crowd`` of which meet it through one
    list: its value is copied once for every PER_COPY of them, and the pairs are
    dealt over the copies.
    """
    copies = F.ceil(F.col("crowd") / PER_COPY).cast("int")
    hubs = pairs.groupBy("b").agg(F.max("crowd").alias("crowd"))
    hubs = hubs.join(values.select(F.col("doc_id").alias("b"), F.col("v").alias("vb")).hint("merge"), "b").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("crowd")
    left = pairs.join(values.select(F.col("doc_id").alias("a"), F.col("v").alias("va")).hint("merge"), "a").withColumn("copy", F.pmod(F.xxhash64("a"), copies).cast("int"))
    return left.join(hubs.hint("merge"), ["b", "copy"]).drop("copy")


def verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b, linked, distance of ``pairs`` (a, b, crowd)."""
    both = meet(pairs, sets.select("doc_id", F.col("s").alias("v")))
    done = both.select("a", "b", F.size(F.array_intersect("va", "vb")).cast("long").alias("i"), (F.size("va") + F.size("vb")).cast("long").alias("t"))
    union = F.col("t") - F.col("i")
    return done.select("a", "b", (scheme.den * F.col("i") >= scheme.num * union).alias("linked"), (1 - F.col("i") / union).alias("distance"))


def may_link(na: Column, ba: Column, nb: Column, bb: Column, scheme: Scheme) -> Column:
    """False only where sizes or parities show that two sets cannot link."""
    words = F.least(F.size(ba), F.size(bb))
    most = (na + nb) * float(scheme.den - scheme.num) / float(scheme.den + scheme.num) + 1e-6
    sizes = (na * scheme.den >= nb * scheme.num) & (nb * scheme.den >= na * scheme.num)
    return sizes & (first_words(ba, bb) <= most) & (hamming(folded(ba, words), folded(bb, words)) <= most)


def first_words(a: Column, b: Column) -> Column:
    """At most the differing bits: those of the first FIRST words, written out for generated code; 0 for arrays of unequal length."""
    word = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(0).cast("long"))
    bits = [F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(FIRST)]
    return F.when(F.size(a) == F.size(b), sum(bits[1:], bits[0])).otherwise(0)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def folded(bits: Column, words: Column) -> Column:
    """Parity bits brought to fewer words, a power of two."""
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(bits, j))))


def short_sizes(docs: DataFrame, n: int) -> dict[int, int]:
    """Texts of up to SHORT bytes by their number of n-grams, taken for distinct: what they have in words, counted by blanks."""
    text = F.col("text")
    grams = F.greatest(F.char_length(text) - F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")) + 2 - n, F.lit(1))
    rows = docs.filter(F.octet_length("text") <= SHORT).groupBy(grams.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most SHORT rows
    return {r["s"]: r["n"] for r in rows}


def prepared(docs: DataFrame, n: int, scheme: Scheme) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets, the classes of equal ones, and the lists of their representatives."""
    scheme = scheme.fitted(short_sizes(docs, n))
    table = staged(set_table(docs, n, scheme), "sets")
    members = staged(classes(table.select("doc_id", "n_shingles", "key")), "classes")
    copies = members.filter("doc_id <> rep").select("doc_id").distinct()
    return table, members, inverted_lists(by_ids(table.select("doc_id", "subsets", "grams", "need"), copies, "doc_id", "left_anti"))


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; other columns are ignored).

    Documents link if den * overlap >= num * union. component_id is the least
    doc_id reachable by links. Texts without words (null, empty, blanks) have an
    empty set and link with nothing. Rows that repeat a doc_id are taken for one
    document. An empty table gives an empty result.
    """
    scheme = Scheme(num, den)
    docs = docs.select("doc_id", "text")
    table, members, lists = prepared(docs, n, scheme)
    stars = lists.filter("doc_id <> hub").groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.max("crowd").alias("crowd"))
    shapes = by_ids(table.select("doc_id", F.struct("n_shingles", "bits").alias("v")), lists.select("doc_id").distinct(), "doc_id", "left_semi")
    near = meet(stars, shapes).filter(may_link(F.col("va.n_shingles"), F.col("va.bits"), F.col("vb.n_shingles"), F.col("vb.bits"), scheme))
    stars = staged(near.select("a", "b", "crowd"), "stars")
    first = staged(verified(stars, contents(docs, stars, n), scheme), "verified")
    links = first.filter("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = staged(connected_components(links), "components")
    more = staged(remaining(lists, first, comp, table, scheme), "remaining")
    second = staged(verified(more, contents(docs, more, n), scheme), "verified")
    links = links.unionByName(second.filter("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if not second.filter("linked").isEmpty():
        comp = staged(connected_components(links), "components")
    return by_class(members, comp.select(F.col("node").alias("rep"), "component")).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def by_class(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` with the values of their class (rep and others). A class of copies may be hot: it is looked up once and dealt over salts."""
    left = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge"), ["rep", "salt"], "left").drop("salt")


def list_pairs(lists: DataFrame, sizes: DataFrame, scheme: Scheme) -> DataFrame:
    """a > b, crowd of all members of a list whose sizes (doc_id, n_shingles) may link.

    A list is dealt into blocks of about BLOCK members; every two blocks, and every
    block with itself, meet under a key of their own, so that no task holds a long list.
    """
    count = F.ceil(F.col("crowd") / BLOCK).cast("int")
    rows = lists.join(sizes.hint("merge"), "doc_id").withColumn("last", count - 1).withColumn("own", F.pmod(F.xxhash64("doc_id"), count).cast("int"))
    left = rows.select("sig", "crowd", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"))
    right = rows.select("sig", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"))
    near = (F.col("nx") * scheme.den >= F.col("ny") * scheme.num) & (F.col("ny") * scheme.den >= F.col("nx") * scheme.num)
    met = left.join(right.hint("merge"), ["sig", "i", "j"]).filter(near & (F.col("x") != F.col("y")) & ((F.col("i") < F.col("j")) | (F.col("x") > F.col("y"))))
    return met.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.max("crowd").alias("crowd"))


def jaccard_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link: (pairs, members).

    pairs: a > b, all linked pairs of representatives, each verified. members: doc_id,
    n_shingles, rep, the least doc_id with an equal set; members of one class link too.
    The pairs of a group of near copies grow with the square of its different texts.
    """
    scheme = Scheme(num, den)
    docs = docs.select("doc_id", "text")
    table, members, lists = prepared(docs, n, scheme)
    met = list_pairs(lists, table.select("doc_id", "n_shingles").distinct(), scheme)
    shapes = by_ids(table.select("doc_id", F.struct("n_shingles", "bits").alias("v")), lists.select("doc_id").distinct(), "doc_id", "left_semi")
    near = meet(staged(met, "met"), shapes).filter(may_link(F.col("va.n_shingles"), F.col("va.bits"), F.col("vb.n_shingles"), F.col("vb.bits"), scheme))
    near = staged(near.select("a", "b", "crowd"), "near")
    return staged(verified(near, contents(docs, near, n), scheme).filter("linked").select("a", "b").distinct(), "links"), members


def jaccard_degrees(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: the number of other documents each one links with, copies counted each."""
    pairs, members = jaccard_links(docs, n, num, den)
    size = members.filter("n_shingles > 0").select("doc_id", "rep").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    ends = pairs.select(F.col("a").alias("other"), F.col("b").alias("rep")).union(pairs.select(F.col("b"), F.col("a")))
    # a representative may have very many links: they are dealt over salts
    spread = size.withColumnRenamed("rep", "other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = ends.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["other", "salt"]).groupBy("rep").agg(F.sum("size").alias("near"))
    comp = staged(connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components").select(F.col("node").alias("rep"), "component")
    values = size.join(near.hint("merge"), "rep", "left").join(comp.hint("merge"), "rep", "left")
    links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("near", F.lit(0))
    return by_class(members, values).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), links.alias("n_links"))


def remaining(lists: DataFrame, first: DataFrame, comp: DataFrame, table: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b, crowd) that no comparison with a least member has settled and that may still link."""
    near = first.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), "distance")
    rows = lists.join(near.hint("merge"), ["doc_id", "hub"], "left")
    named = comp.select(F.col("node").alias("doc_id"), "component")
    rows = staged(rows.join(named.hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "rows")
    mixed = staged(rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sig"), "mixed")
    shape = table.select("doc_id", "n_shingles", "bits")
    open_rows = staged(by_ids(rows.filter("doc_id <> hub"), mixed, "sig", "left_semi"), "open")
    some = by_ids(shape, open_rows.select("doc_id").distinct(), "doc_id", "left_semi")
    full = open_rows.join(some.hint("merge"), "doc_id")
    # a list is dealt into blocks; every two of them, and each with itself, meet under a key of their own
    count = F.ceil(F.col("crowd") / OPEN).cast("int")
    dealt = full.withColumn("last", count - 1).withColumn("own", F.pmod(F.xxhash64("doc_id"), count).cast("int"))
    names = ("distance", "component", "n_shingles", "bits", "crowd")
    side = lambda x, i, j: dealt.select("sig", i.alias("i"), j.alias("j"), F.col("doc_id").alias(x), *[F.col(c).alias(p + x) for c, p in zip(names, "dcnbw", strict=True)])
    a = side("a", F.col("own"), F.explode(F.sequence("own", "last")))
    b = side("b", F.explode(F.sequence(F.lit(0), "own")), F.col("own"))
    far = (scheme.den - scheme.num) / scheme.den + 1e-9
    may = (
        ((a["i"] < a["j"]) | (F.col("a") > F.col("b"))) & (F.col("ca") != F.col("cb")) & F.coalesce(F.abs(F.col("da") - F.col("db")) <= far, F.lit(True))
        & may_link(F.col("na"), F.col("ba"), F.col("nb"), F.col("bb"), scheme)
    )
    pairs = a.hint("merge").join(b, (a["sig"] == b["sig"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & may)
    return pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max(F.greatest("wa", "wb")).alias("crowd"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
