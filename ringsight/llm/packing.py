"""Best-fit packing by a configuration linear program over the length histogram.

Each row's length is known after one pass. The histogram (at most ``capacity``
rows, whatever the corpus) goes to the driver, where the covering program "fewest
sequences such that every length is packed as often as it occurs" is solved by
multiplicative weights. A length of size l has the price l * exp(-ETA * covered
share), so prices fall as lengths are covered. In every round a knapsack dynamic
program gives the greatest price V of any configuration; the prices over V are a
feasible point of the dual program, so counts * prices / V is a lower bound for every
packing. Columns are read back from the program's table at random among the choices
within SLACK of the best, lengths in proportion to what the round may still cover of
them (STEP of their count), and none oftener than that: the knapsack is bounded by
what is there. A column is taken as often as its tightest length allows, in whole
sequences. Rounds go on until all but REST of the tokens are covered, or columns that
are near enough to the best are no longer found.

Rounding: columns that waste room are dissolved and their items go into the program
again, PASSES times in all. Of the columns left those within a limit of wasted tokens
are kept, of the exact ones all or at least half; what is in none, the residue, is
packed best fit, largest first, into their room and new sequences. Of the cuts with the
fewest sequences, or NEAR them, that with most columns is taken.

What the driver returns is a table of slots per length, at most capacity lengths times
the columns; Spark then ranks the pieces within each length and places them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.llm.bpe import blocks, default_path, text_bpe
from ringsight.llm.common import read, staged

CAPACITY = 2048
#: Share of a length's count that a round may cover; decay of the weights; slack of a column's first and last choices against the best price,
#: and growth of the latter where few columns are found; share of tokens left to best fit; times that the program is solved; tolerance of the last choice.
STEP, ETA, SLACK, LOOSE, GROW, REST, PASSES, NEAR = 0.2, 0.5, 0.05, 5e-4, 1.1, 0.01, 3, 2e-4


@dataclass
class Plan:
    """(configuration, times) that pack every item, and how the program went."""

    packed: list[tuple[dict[int, int], int]]
    columns: int  # sequences that columns of the program opened
    bound: int  # no packing has fewer sequences
    value: float  # sequences of the program's solution, scaled to cover all
    covered: float  # share of the tokens in columns

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.packed)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Greatest price that fits into each capacity from 0 on."""
    dense = np.full(capacity + 1, -np.inf)
    dense[lengths] = prices
    value = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        value[c] = max(value[c - 1], (value[c - 1 :: -1] + dense[1 : c + 1]).max())
    return value


def column(lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, room: np.ndarray, loose: float, rng: np.random.Generator) -> dict[int, int]:
    """A configuration within SLACK of the best, index of length -> times; no length oftener than ``room`` says. Empty if none was found.

    The slack is for the first choices. The last quarter of the capacity, with what
    stays free of it, may lose ``loose`` of the best price.
    """
    out: dict[int, int] = {}
    c, best, share = len(value) - 1, value[-1], np.cumsum(room)
    slack, last = SLACK * best, loose * best
    guesses = iter(np.searchsorted(share, rng.random(96) * share[-1], side="right").tolist())
    while c > 0:
        pick = -1
        if 4 * c >= len(value):  # lengths in proportion to their room, until one is near enough to the best
            for i in guesses:
                size = lengths[i]
                if size <= c and room[i] > out.get(i, 0) and value[c] - value[c - size] - prices[i] <= slack:
                    pick = i
                    break
        if pick < 0:
            k = int(np.searchsorted(lengths, c, side="right"))
            loss = np.where(room[:k] > 0, value[c] - value[c - lengths[:k]] - prices[:k], np.inf)
            for i in out:
                if i < k and room[i] <= out[i]:
                    loss[i] = np.inf
            if not k or (least := float(loss.min())) == np.inf:
                break
            near = np.flatnonzero(loss <= least + 1e-9 * best)
            pick = int(near[int(rng.random() * len(near))])
        lost = max(0.0, float(value[c] - value[c - lengths[pick]] - prices[pick]))
        if 4 * c >= len(value):
            slack -= lost
        else:
            last -= lost
        if slack < -1e-9 * best or last < -1e-9 * best:
            return {}
        out[pick] = out.get(pick, 0) + 1
        c -= int(lengths[pick])
    return out if value[c] <= last + 1e-9 * best else {}


def covering(lengths: np.ndarray, counts: np.ndarray, left: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[dict[tuple, int], float]:
    """Columns of the program, ((index of length, times), ...) -> sequences, for the open items ``left``, and a lower bound for all of ``counts``. ``left`` is changed."""
    solution: dict[tuple, int] = {}
    total, loose, bound = int((left * lengths).sum()), LOOSE, 0.0
    while (left * lengths).sum() > REST * total and loose < SLACK:
        prices = np.where(left > 0, lengths * np.exp(-ETA * (1 - left / counts)), 0.0)
        worth = knapsack(lengths, prices, capacity)
        bound = max(bound, float((counts * prices).sum() / worth[capacity]))
        room = np.minimum(left, np.maximum(capacity // lengths, (STEP * counts).astype(np.int64)))
        before, failed = int((left * lengths).sum()), 0
        while failed < 8 and room.any():
            conf = column(lengths, prices, worth, room, loose, rng)
            if not conf:
                failed += 1
                continue
            failed, at, times = 0, np.array(list(conf)), np.array(list(conf.values()))
            m = int((room[at] // times).min())
            key = tuple(sorted(conf.items()))
            solution[key] = solution.get(key, 0) + m
            room[at] -= m * times
            left[at] -= m * times
        # where the open lengths make few such columns, more loss is allowed, so that the rounds come to an end
        made = before - int((left * lengths).sum())
        loose = loose * GROW if made < 0.002 * total else max(LOOSE, loose / GROW) if made > 0.01 * total else loose
    return solution, bound


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 11) -> Plan:
    """The program over a histogram of distinct ascending lengths, rounded: see above."""
    rng, counts = np.random.default_rng(seed), counts.astype(np.int64)
    total, left = int((lengths * counts).sum()), counts.copy()
    waste = lambda key: capacity - sum(int(lengths[i]) * k for i, k in key)
    solution: dict[tuple, int] = {}
    value, bound = 0.0, total / capacity
    for again in range(PASSES if len(lengths) else 0):
        for key in [k for k in solution if waste(k)]:
            m = solution.pop(key)
            for i, k in key:
                left[i] += m * k
        made, low = covering(lengths, counts, left, capacity, rng)
        bound = max(bound, low)
        for key, m in made.items():
            solution[key] = solution.get(key, 0) + m
        if not again:
            value = sum(made.values()) * total / max(total - int((left * lengths).sum()), 1)
    plans: list[Plan] = []
    for most, share in ((capacity, 1.0), (8, 1.0), (1, 1.0), (0, 1.0), (0, 0.9), (0, 0.8), (0, 0.7), (0, 0.6), (0, 0.5)):
        kept = [(key, m) for key, m in solution.items() if waste(key) <= most]
        # where a part stays, it is that with the largest least lengths: small ones serve best fit
        kept.sort(key=lambda km: -min(lengths[i] for i, _ in km[0]))
        room, rest, packed = share * sum(m for _, m in kept), counts.copy(), []
        for key, m in kept:
            m = min(m, int(np.ceil(room)))
            room -= m
            if m > 0:
                packed.append((dict(key), m))
                for i, k in key:
                    rest[i] -= m * k
        done = best_fit(lengths, rest, capacity, packed)
        plans.append(Plan(done, sum(m for _, m in packed), int(np.ceil(bound - 1e-6)), value, float(1 - (rest * lengths).sum() / max(total, 1))))
    least = min(p.sequences for p in plans)
    return max((p for p in plans if p.sequences <= least * (1 + NEAR)), key=lambda p: (p.columns, -p.sequences))


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing into the room of ``opened`` bins and new ones, on classes of equal bins, so that its work follows the number of lengths and not of items."""
    open_bins: dict[int, list[list]] = {}  # room -> [configuration, times]
    done: list[tuple[dict[int, int], int]] = []
    for conf, times in opened:
        rest = capacity - sum(int(lengths[i]) * k for i, k in conf.items())
        if rest:
            open_bins.setdefault(rest, []).append([conf, times])
        else:
            done.append((conf, times))
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(counts[i])
        while n:
            room = min((r for r in open_bins if r >= size), default=0)
            if room:
                conf, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                conf, times, room = {}, max(1, n // (capacity // size)), capacity
            k = max(1, min(room // size, n // times))
            if times > n:
                open_bins.setdefault(room, []).append([conf, times - n])
                times, k = n, 1
            n -= times * k
            rest = room - k * size
            grown = conf | {i: conf.get(i, 0) + k}
            if rest:
                open_bins.setdefault(rest, []).append([grown, times])
            else:
                done.append((grown, times))
    return done + [(c, t) for group in open_bins.values() for c, t in group]


def slots(lengths: np.ndarray, plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """Rows (length, from_rank, to_rank, times, first_sequence, first_offset)."""
    rank, sequence, out = np.zeros(len(lengths), np.int64), 0, []
    for conf, times in plan:
        offset = 0
        for i, k in conf.items():
            size = int(lengths[i])
            out.append((size, int(rank[i]), int(rank[i]) + times * k, k, sequence, offset))
            rank[i] += times * k
            offset += k * size
        sequence += times
    return out


SLOT = "length long, a long, b long, k long, first long, at long"


def slot_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """length and its slots in order of rank; as many rows as there are lengths."""
    names = [x.split(" ")[0] for x in SLOT.split(", ")]
    table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)}) if rows else []
    made = spark.createDataFrame(table, SLOT) if rows else spark.createDataFrame([], SLOT)
    return made.groupBy("length").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("_slots"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length and any other columns) plus sequence_id and offset, which replace columns of these names.

    Lengths lie in 1..capacity; other rows (null lengths too) get null places.
    Equal rows are told apart by their rank, so each has a place of its own.
    """
    spark = pieces.sparkSession
    others = [c for c in pieces.columns if c.lower() not in ("length", "sequence_id", "offset")]
    # columns are kept in one struct under a name of our own, so that none can clash with what is made here
    rows = pieces.select(F.col("length").alias("_length"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row") if others else F.lit(None).alias("_row"))
    good = F.col("_length").between(1, capacity)
    hist = sorted((r["_length"], r["n"]) for r in rows.filter(good).groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, counts = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    table = slot_table(spark, slots(lengths, configurations(lengths, counts, capacity).packed))
    # rank within the length: counts per (length, bucket) are summed up in two levels, so that a length with most rows is ranked in parallel
    many = int(counts.sum()) // 4000 if len(counts) else 0
    fine, coarse = max(16, int(many**0.5) + 1), max(1, int(many**0.5))
    key = F.xxhash64("_row") if others else F.monotonically_increasing_id()
    dealt = rows.withColumns({"_coarse": F.pmod(key, F.lit(coarse)), "_fine": F.pmod(F.shiftrightunsigned(key, 32), F.lit(fine))})
    sizes = dealt.filter(good).groupBy("_length", "_coarse", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda part, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = sizes.select("_length", "_coarse", "_fine", before(["_length", "_coarse"], "_fine").alias("_low"))
    high = sizes.groupBy("_length", "_coarse").agg(F.sum("_n").alias("_n")).select("_length", "_coarse", before(["_length"], "_coarse").alias("_high"))
    order = Window.partitionBy("_length", "_coarse", "_fine").orderBy("_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(low.join(high.hint("merge"), ["_length", "_coarse"]).hint("merge"), ["_length", "_coarse", "_fine"], "left")
    # at most ``capacity`` rows, and as many structs as the columns of the program have lengths
    placed = ranked.join(F.broadcast(table), F.col("_length") == F.col("length"), "left").withColumn("_r", F.col("_rank") + F.col("_low") + F.col("_high"))
    slot = F.element_at(F.filter("_slots", lambda s: (F.col("_r") >= s["a"]) & (F.col("_r") < s["b"])), 1)
    got = placed.withColumn("_s", slot).withColumn("_i", F.col("_r") - F.col("_s.a"))
    return got.select(
        *[F.col("_length").alias(c) if c.lower() == "length" else F.col(f"_row.`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")],
        (F.col("_s.first") + F.floor(F.col("_i") / F.col("_s.k"))).cast("long").alias("sequence_id"),
        (F.col("_s.at") + F.pmod(F.col("_i"), F.col("_s.k")) * F.col("_length")).cast("long").alias("offset"),
    )


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of at most ``capacity`` ids of each row of docs (doc_id, text; other columns are ignored).

    A document is its ids and then ``end_id``, so null and empty texts are one
    piece of one id. Only longer documents are cut.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(path)
        for batch in batches:
            for part in blocks(batch):
                ids, ends = bpe.ids(part.column("text"))
                raw, rows, at, wide = memoryview(ids.astype("<u4").tobytes()), [], 0, 4 * capacity
                for doc, upto in zip(part.column("doc_id").to_pylist(), (4 * ends).tolist(), strict=True):
                    size = upto - at + 4
                    for k, start in enumerate(range(0, size, wide)):
                        stop = min(start + wide, size)
                        crc = zlib.crc32(raw[at + start : min(at + stop, upto)])
                        rows.append((doc, k, start // 4, (stop - start) // 4, zlib.crc32(end, crc) if stop == size else crc))
                    at = upto
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(token_pieces(docs, path, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
