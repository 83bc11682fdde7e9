"""The trie of conversation prefixes, as balanced parentheses per shard.

A conversation is the path of its turns' digests. Paths are sorted and dealt into
shards by range, so that a node's members lie side by side, in one shard or in
neighbouring ones. A shard's trie is a string of parentheses in depth-first order:
blocks with least and greatest excess answer findclose, which delimits a subtree;
the rank of "()" counts its leaves, and cumulative arrays give its members and
savings. Nodes that a shard shares with a neighbour, the common beginnings of
neighbouring paths at its ends, are summed over shards and put together last: a few
for each shard, however large the groups of equal conversations are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.llm.common import read, staged
from ringsight.session import sized

#: Ids in one row of a list of ends; turns that a shard holds on average.
CHUNK, SHARD_TURNS = 4_096, 200_000
#: Conversations that share a beginning, and turns of it at most, in ``rebuilt``.
FAMILY, LONGEST_HEAD = 5, 9
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Parentheses:
    """Balanced parentheses with excess blocks and ranks. bits: 1 opens, 0 closes."""

    def __init__(self, bits: np.ndarray, block: int = 256):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        n = max(1, -(-len(bits) // block))
        padded = np.full(n * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        low = padded.reshape(n, block).min(axis=1)
        high = np.maximum.reduceat(self.excess, np.arange(0, len(bits), block)) if len(bits) else np.zeros(1, np.int64)
        self.width = 1 << (n - 1).bit_length()  # leaves of the tree over blocks
        self.low, self.high = (np.full(2 * self.width, x) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
        self.low[self.width : self.width + n], self.high[self.width : self.width + n] = low, high
        for i in range(self.width - 1, 0, -1):
            self.low[i], self.high[i] = min(self.low[2 * i], self.low[2 * i + 1]), max(self.high[2 * i], self.high[2 * i + 1])
        # ranks: opening ones, and leaves "()" that begin, before each place
        self.opens = np.concatenate([[0], np.cumsum(bits)])
        pair = (bits[:-1] == 1) & (bits[1:] == 0) if len(bits) else np.zeros(0, bool)
        self.pairs = np.concatenate([[0], np.cumsum(pair), [pair.sum()]])

    def findclose(self, i: int) -> int:
        """The place of the parenthesis that closes the one opened at ``i``: the first after it with one less excess than it has."""
        want = self.excess[i] - 1
        b = i // self.block
        if (at := self._within(b, i + 1, want)) >= 0:
            return at
        node = b + self.width  # excess moves by one, so a block has the value where its range has it
        while True:
            while node & 1:  # a right child: all to the right lies higher up
                node >>= 1
            node += 1
            if self.low[node] <= want <= self.high[node]:
                break
        while node < self.width:
            node *= 2
            if not self.low[node] <= want <= self.high[node]:
                node += 1
        return self._within(node - self.width, 0, want)

    def _within(self, b: int, start: int, want: int) -> int:
        a, z = max(start, b * self.block), (b + 1) * self.block
        hit = np.flatnonzero(self.excess[a:z] == want)
        return a + int(hit[0]) if len(hit) else -1


class Shard:
    """The trie of sorted paths (digests of turns), with the size of each turn and the conversation's id. Nodes are numbered depth first, the root is 0."""

    def __init__(self, paths: list[list[bytes]], sizes: list[list[int]], ids: list[int]):
        bits, stack, before = [1], [0], []
        self.depth, self.parent, self.ends = [0], [-1], [[]]
        size = [0]
        for path, own, conv in zip(paths, sizes, ids, strict=True):
            same, most = 0, min(len(path), len(before))
            while same < most and path[same] == before[same]:
                same += 1
            bits.extend([0] * (len(stack) - 1 - same))
            del stack[same + 1 :]
            for d in range(same, len(path)):
                bits.append(1)
                self.depth.append(d + 1)
                self.parent.append(stack[-1])
                self.ends.append([])
                size.append(own[d])
                stack.append(len(size) - 1)
            self.ends[stack[-1]].append(conv)
            before = path
        self.first, self.final = range(len(paths[0]) + 1), list(stack)  # nodes of the first and the last path
        bits.extend([0] * len(stack))
        tree = Parentheses(np.array(bits, np.int8))
        n = len(size)
        at = np.flatnonzero(tree.bits)
        close = np.array([tree.findclose(int(i)) for i in at])
        last = tree.opens[close]  # the number of the first node after the subtree
        members = np.concatenate([[0], np.cumsum([len(e) for e in self.ends])])
        self.n_convs = members[last] - members[:n]
        self.n_leaves = tree.pairs[close] - tree.pairs[at]
        saved = np.concatenate([[0], np.cumsum((self.n_convs - 1) * np.array(size, np.int64))])
        self.saved = saved[last] - saved[:n]
        self.n_children = np.bincount(np.array(self.parent[1:], np.int64), minlength=n)
        self.size = size
        self.least = [min(e, default=None) for e in self.ends]
        for i in range(n - 1, 0, -1):
            up, m = self.parent[i], self.least[i]
            if self.least[up] is None or m < self.least[up]:
                self.least[up] = m


def keys_of(path: list[bytes]) -> list[bytes]:
    """A key for each beginning of a path, the empty one first: a digest of its turns."""
    out = [b""]
    for turn in path:
        out.append(hashlib.sha256(out[-1] + turn).digest()[:16])
    return out


def ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: What a shard tells. kind 0: a node of its own (parent_key if the parent is shared). kind 1: its part of a shared node, sums without shared nodes below. kind 2: ends of a shared node.
TOLD = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string()), ("shard", pa.int64()), ("chunk", pa.int64())]
)
TOLD_SQL = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string, shard long, chunk long"


def shard_nodes(table: pa.Table) -> pa.Table:
    """All that one shard tells. table: shard, place, path, sizes, conv_id and left and right, the depths to which its first and last path are shared."""
    table = table.sort_by("place")
    paths, number = table.column("path").to_pylist(), table.column("shard")[0].as_py()
    t = Shard(paths, table.column("sizes").to_pylist(), table.column("conv_id").to_pylist())
    keys: dict[int, bytes] = {}
    for nodes, path, most in ((t.first, paths[0], table.column("left")[0].as_py()), (t.final, paths[-1], table.column("right")[0].as_py())):
        keys.update(zip(nodes[: most + 1], keys_of(path[:most]), strict=True))
    parts = {i: [0, 0, 0] for i in keys}
    out: dict[str, list] = {c: [] for c in TOLD.names}

    def tell(**x) -> None:
        for c, values in out.items():
            values.append(x.get(c))

    for i, up in enumerate(t.parent):
        if i in keys:
            continue
        if up in keys:
            for j, v in enumerate((1, t.n_leaves[i], t.saved[i])):
                parts[up][j] += int(v)
        tell(kind=0, parent_key=keys.get(up), conv_id=t.least[i], depth=t.depth[i], parent_conv_id=t.least[up], n_convs=int(t.n_convs[i]), n_children=int(t.n_children[i]), n_leaves=int(t.n_leaves[i]), saved_tokens=int(t.saved[i]), ends=ends_hash(t.ends[i]))
    for i, (children, leaves, saved) in parts.items():
        tell(kind=1, key=keys[i], parent_key=keys.get(t.parent[i]), conv_id=t.least[i], depth=t.depth[i], n_convs=int(t.n_convs[i]), n_children=children, n_leaves=leaves, saved_tokens=saved, size=t.size[i])
        for k in range(0, len(t.ends[i]), CHUNK):
            tell(kind=2, key=keys[i], ends=",".join(map(str, t.ends[i][k : k + CHUNK])), shard=number, chunk=k)
    return pa.Table.from_pydict(out, TOLD)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared nodes with the sums of their subtrees, from the deepest up. In: a row for each shared node, with what lies below it in shards alone."""
    rows = [r for b in batches for r in b.to_pylist()]
    by = {r["key"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        if (up := by.get(r["parent_key"]) if r["depth"] else None) is not None:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = up["conv_id"]
    names = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], pa.schema([TOLD.field(c) for c in names]))


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of its ids, from pieces in order of key, shard and chunk: one piece is held at a time."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for k, ends in zip(batch.column("key"), batch.column("ends"), strict=True):
            if state is None or k.as_py() != key:
                if state is not None:
                    yield done()
                key, state = k.as_py(), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.as_py().encode())
    if state is not None:
        yield done()


def common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, path and sizes of ``turns`` (conv_id, turn, role, text): a 16-byte digest of each turn's role and text, and its text's bytes, in order of turn.

    Null turns come first, equal ones in order of digest; repeated rows stay. Null roles and
    texts count as empty. Rows without conv_id belong to no conversation and are left out;
    other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return by.select("conv_id", F.col("ts.d").alias("path"), F.col("ts.n").alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % FAMILY and goes on with its own after its first h; h is the CRC-32 of c as decimal text modulo LONGEST_HEAD."""
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), *[F.slice(c, 1, LONGEST_HEAD - 1).alias(f"_{c}") for c in ("path", "sizes")])
    own = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % FAMILY, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_HEAD).cast("int")})
    both = own.join(heads.hint("merge"), "_base", "left")
    head = lambda c: F.coalesce(F.slice(f"_{c}", F.lit(1), F.col("_h")), F.slice(c, 1, 0))
    return both.select("conv_id", *[F.concat(head(c), F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))).alias(c) for c in ("path", "sizes")])


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, least_shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, path, sizes): one for every distinct sequence of first turns.

    conv_id is the node's smallest member, n_convs counts members, n_leaves and
    saved_tokens sum over its subtree, ends_sha256 hashes the ids of those that end at it.
    A conversation without turns ends at the root; without conversations there are no
    nodes. Ids are unique and not null.

    A conversation's path lies in one row, 24 bytes a turn. One task merges the shared
    nodes, no more than the common beginning of two paths for each shard. SHA-256 takes its
    message in order, so the ids that end at one shared node pass through one task as
    a stream; all other nodes are hashed in their shards.
    """
    spark = convs.sparkSession
    paths = staged(convs.select("conv_id", "path", "sizes"), "paths")
    turns = paths.agg(F.sum(F.size("path") + F.lit(1).cast("long"))).first()[0] or 0
    n = max(least_shards or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    order = ["path", "conv_id"]
    dealt = paths.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = staged(dealt.select("conv_id", "path", "sizes", F.shiftright("_m", 33).alias("shard"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("place")), "shards")
    ends = dealt.groupBy("shard").agg(F.min_by("path", "place").alias("a"), F.max_by("path", "place").alias("z"))
    w = Window.orderBy("shard")  # a row for a shard
    depth = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    bounds = staged(ends.select("shard", depth(common(F.col("a"), F.lag("z").over(w))).alias("left"), depth(common(F.col("z"), F.lead("a").over(w))).alias("right")), "bounds")
    told = staged(dealt.join(sized(bounds), "shard").groupBy("shard").applyInArrow(shard_nodes, TOLD_SQL), "told")
    sums = told.filter("kind = 1").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "depth", "size")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    shared = sums.coalesce(1).mapInArrow(merged, "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    pieces = told.filter("kind = 2").select("key", "shard", "chunk", "ends").repartition(n, "key").sortWithinPartitions("key", "shard", "chunk")
    hashes = staged(pieces.mapInArrow(hashed_ends, "key binary, ends_sha256 string"), "ends")
    spine = staged(shared.join(sized(hashes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ends_hash([])))), "spine")
    tops = sized(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up")))
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    own = told.filter("kind = 0").withColumnRenamed("ends", "ends_sha256").join(tops, "parent_key", "left")
    return own.withColumn("parent_conv_id", F.coalesce("_up", "parent_conv_id")).select(*names).unionByName(spine.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(digested(read(spark, sf_dir, "conversations"))))


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(c::VARCHAR, '')])),"
    " lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"
)
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, octet_length(encode(text)) AS n, k, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM t),
h AS (SELECT c, {_CRC} % {LONGEST_HEAD} AS h FROM (SELECT DISTINCT c FROM t)),
a AS (SELECT h.c, i AS d, n, k FROM h JOIN o ON o.c = h.c - h.c % {FAMILY} AND i <= h),
r AS (SELECT * FROM a UNION ALL SELECT o.c, i - h + (SELECT count(*) FROM a WHERE a.c = h.c) AS d, n, k FROM o JOIN h USING (c) WHERE i > h),
p AS (SELECT c, 0::BIGINT AS d, 0::BIGINT AS n, '' AS k FROM h UNION ALL SELECT p.c, r.d, r.n, sha256(p.k || r.k) FROM p JOIN r ON r.c = p.c AND r.d = p.d + 1),
m AS (SELECT c, max(d) AS d FROM p GROUP BY 1),
v AS (SELECT p.d, k, min(p.c) AS c, any_value(n) AS n, count(*) AS n_convs, sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE m.d = p.d), '')) AS ends FROM p JOIN m USING (c) GROUP BY p.d, k),
u AS (SELECT v.*, x.k AS up_k, x.c AS up_c FROM v LEFT JOIN (SELECT p.c AS own, v.d, v.k, v.c FROM p JOIN v USING (d, k)) x ON x.own = v.c AND x.d = v.d - 1),
ch AS (SELECT d - 1 AS d, up_k AS k, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(ch.n, 0) AS n_children FROM u LEFT JOIN ch USING (d, k)),
s AS (SELECT x.d, x.k, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.n) AS BIGINT) AS saved FROM w JOIN p x ON x.c = w.c AND x.d <= w.d GROUP BY ALL)
SELECT c AS conv_id, d AS depth, up_c AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256 FROM w JOIN s USING (d, k)
"""
