"""Connected components on edge tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.session import sized, staged

#: Nodes that point at one node and are looked up by one task.
HOT = 20_000


def connected_components(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group columns, node, component) of every node of ``edges`` (group columns, src, dst); component is its least node.

    Each round every node keeps its least smaller neighbour, hands its other
    smaller neighbours to that one, and jumps to its neighbour's own. Rounds go
    on until nothing is handed over and every neighbour is a root: a number of
    rounds that follows the logarithm of the longest path. Of a node that over HOT
    point at there is a copy for every HOT of them. Self loops are nodes; null ends are left out.
    """
    g = group or []
    ends = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*g, F.greatest("src", "dst").alias("c"), F.least("src", "dst").alias("p")).distinct()
    e = staged(ends, "edges")
    nodes = e.select(*g, F.col("c").alias("node")).union(e.select(*g, F.col("p").alias("node"))).distinct()
    e = e.filter("c <> p")
    while True:
        least = e.groupBy(*g, "c").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("n"))
        best = staged(least, "least")
        handed = e.join(best.filter("n > 1").select(*g, "c", "m").hint("merge"), [*g, "c"]).filter("p <> m").select(*g, F.col("p").alias("c"), F.col("m").alias("p"))
        left, up = best.select(*g, "c", "m"), best.select(*g, F.col("c").alias("m"), F.col("m").alias("top"))
        copies = F.lit(1)
        if best.count() > HOT:  # else no node has so many
            many = best.groupBy(*g, "m").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("copies")).filter("copies > 1")
            many = sized(staged(many, "many"))  # one row for HOT edges at most
            left, up, copies = left.join(many, [*g, "m"], "left"), up.join(many, [*g, "m"], "left"), F.coalesce("copies", F.lit(1))
        left = left.select(*g, "c", "m", F.pmod(F.xxhash64("c"), copies).cast("int").alias("salt"))
        up = up.select(*g, "m", "top", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
        jumped = left.join(up.hint("merge"), [*g, "m", "salt"], "left").select(*g, "c", F.coalesce("top", "m").alias("p"), F.col("top").isNotNull().cast("int").alias("moved"))
        nxt = staged(jumped.unionByName(handed.withColumn("moved", F.lit(1))).groupBy(*g, "c", "p").agg(F.max("moved").alias("moved")), "edges")
        e = nxt.drop("moved")
        if nxt.filter("moved = 1").isEmpty():
            break
    return nodes.join(e.withColumnRenamed("c", "node").hint("merge"), [*g, "node"], "left").select(*g, "node", F.coalesce("p", "node").alias("component"))


#: Edges that one task contracts at a time.
PIECE = 200_000


def forest(src: list[int], dst: list[int]) -> tuple[list[int], list[int]]:
    """Every node of the edges and the least node of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(src, dst, strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return list(up), [top(x) for x in up]


def grouped_components(edges: DataFrame, group: list[str], piece: int = PIECE) -> DataFrame:
    """As ``connected_components`` within groups, for nodes that are whole numbers: edges are contracted to forests before they are put together.

    A group's distinct edges are counted and dealt into pieces of about ``piece`` by
    src. Each piece becomes a forest in one task. Where all groups are of one piece
    nothing is left to do; else the forests, no more edges than nodes, are joined round by round.
    """
    ends = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*group, F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    ends = staged(ends, "edges")
    counts = staged(ends.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_pieces")), "pieces")
    most = counts.agg(F.max("_pieces")).first()[0] or 0
    dealt = ends.withColumn("_piece", F.lit(0))
    if most > 1:
        dealt = ends.join(sized(counts), group).withColumn("_piece", F.pmod(F.xxhash64("src"), F.col("_pieces")).cast("int"))

    def contract(key: tuple, table: pa.Table) -> pa.Table:
        nodes, tops = forest(table.column("src").to_pylist(), table.column("dst").to_pylist())
        held = {g: pa.array([k.as_py()] * len(nodes), table.schema.field(g).type) for g, k in zip(group, key, strict=False)}
        return pa.table(held | {"node": pa.array(nodes, pa.int64()), "component": pa.array(tops, pa.int64())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ends.select(*group).schema) + ", node long, component long"
    stars = dealt.groupBy(*group, "_piece").applyInArrow(contract, schema)
    if most <= 1:
        return stars
    return connected_components(stars.select(*group, F.col("node").alias("src"), F.col("component").alias("dst")), group)
