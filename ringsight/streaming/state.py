"""State over the feed: peers of the last hour, first alerts of rings, rings over sliding weeks.

Peers come from windows that an aggregate holds until they are complete. Each processor
works on one key's rows in event time; what it keeps is bounded by the week or the cap,
and nothing stored is read back. Rows up to the watermark are complete: later ones with
such times are dropped by Spark and left to the batch path.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ringsight.operators import rings as R

HOUR, DAY, WEEK = 3600, 86400, 604800
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keyed(StatefulProcessor):
    """``epoch``: what is added to t to make it Unix seconds, as in the watermark."""

    def __init__(self, epoch: int):
        self.epoch = epoch

    def now(self, timers) -> int:
        """The latest t that is complete."""
        return timers.getCurrentWatermarkInMs() // 1000 - self.epoch

    def wake(self, times: list[int]) -> None:
        """Timers for these t alone: they fire once the watermark has reached them."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for t in sorted(set(times)):
            self.handle.registerTimer((t + self.epoch) * 1000 - 1)

    def keep(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


class RingAlerts(Keyed):
    """A ring of the week up to the watermark is told when it becomes flagged; again if it was not meanwhile. Its mean score is rounded to nine digits and then judged.

    Once more than ``cap`` members are seen, rows up to the last one of the member next
    to the ``cap`` latest can no longer lie in a window that counts, and are dropped: what
    is kept is of ``cap`` members, however many rows a key has.
    """

    def __init__(self, epoch: int, threshold: float, cap: int):
        super().__init__(epoch)
        self.threshold, self.cap = threshold, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t long, txn_id long, member long, score double")
        self.was = handle.getValueState("was", "flagged boolean, crowded long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()]
        known = {r[1] for r in held}
        new = {}
        for r in rows:
            if r["txn_id"] not in known:
                new[r["txn_id"]] = (r["t"], r["txn_id"], r["member"], r["score"])
        if new:
            self.rows.appendList(list(new.values()))
            self.handle.registerTimer((min(r[0] for r in new.values()) + self.epoch) * 1000 - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.now(timerValues)
        flagged, crowded = tuple(self.was.get()) if self.was.exists() else (False, None)
        held = [r for r in map(tuple, self.rows.get()) if r[0] >= now - WEEK]
        seen = [r for r in held if r[0] <= now]
        if crowded is not None and crowded < now - WEEK:
            crowded = None
        last: dict[int, int] = {}
        for t, _, member, _ in seen:
            if member is not None:
                last[member] = max(t, last.get(member, t))
        mean = round(math.fsum(r[3] for r in seen) / len(seen), 9) if seen else 0.0  # no order of sums decides a tie
        hit = crowded is None and R.LOW <= len(last) <= self.cap and mean >= self.threshold
        if hit and not flagged:
            yield Row(kind=key[0], key=key[1], t=now, members=len(last), score_mean=mean)
        if len(last) > self.cap:
            crowded = sorted(last.values())[-self.cap - 1]
            held = [r for r in held if r[0] > crowded]
        later = [min(later)] if (later := [r[0] for r in held if r[0] > now]) else []
        leave = [min(r[0] for r in held) + WEEK + 1] if held else []
        self.wake([*later, *leave, *([crowded + WEEK + 1] if crowded is not None else [])])
        self.keep(self.rows, held)
        if held or crowded is not None:
            self.was.update((hit, crowded))
        else:
            self.was.clear()


class SlidingWeeks(Keyed):
    """Rings over the weeks that begin on each day. Of a day its rows, the sum of their scores and its members are kept, members until there are more than ``cap``: a week with so many is no ring, and all smaller counts are exact."""

    def __init__(self, epoch: int, cap: int):
        super().__init__(epoch)
        self.cap = cap

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", "day long, n long, score double, members array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days = {r[0]: [r[1], r[2], set(r[3])] for r in map(tuple, self.days.get())}
        touched = set()
        for r in rows:
            day = days.setdefault(r["t"] // DAY, [0, 0.0, set()])
            day[0] += 1
            day[1] += r["score"] or 0.0
            if r["member"] is not None and len(day[2]) <= self.cap:
                day[2].add(r["member"])
            touched.add(r["t"] // DAY)
        for start in sorted({d - i for d in touched for i in range(7)}):
            week = [days[d] for d in range(start, start + 7) if d in days]
            members, n = set().union(*[d[2] for d in week]), sum(d[0] for d in week)
            yield Row(day=start, kind=key[0], key=key[1], txns=n, members=min(len(members), self.cap + 1), score_mean=sum(d[1] for d in week) / n)
        oldest = self.now(timerValues) // DAY - 6  # a row still to come lies on this day plus 6 or later
        kept = {d: x for d, x in days.items() if d >= oldest}
        self.wake([(max(kept) + 7) * DAY] if kept else [])
        self.keep(self.days, [(d, n, s, sorted(m)) for d, (n, s, m) in kept.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.days.clear()
        yield from ()


def keyed(rows: DataFrame, by: list[str], processor: Keyed, schema: str, mode: str = "Append") -> DataFrame:
    on_disk(rows)
    return rows.groupBy(*by).transformWithState(processor, schema, mode, "EventTime")


def on_disk(rows: DataFrame) -> None:
    """State goes to RocksDB, not to the heap."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Pieces into which cards and accounts are dealt; the rows of a piece and an hour are one value of the state.
PIECES = 64


def hour_peers(feed: DataFrame, epoch: int, pieces: int = PIECES) -> DataFrame:
    """txn_id, kind (card or account), others (accounts of the card or cards of the account, with the row's own) and shops of the card, of the hour before each row. Two lines a row. Rows without a card or account have no such line.

    A row lies in the window that ends with its clock hour and, to be looked back at, in
    the next. A window is told once it is complete, so that a row waits for its hour's
    end; of a card with very many rows two hours are in one place.
    """
    on_disk(feed)
    each = F.array(F.struct(F.lit("card").alias("kind"), F.col("card1").alias("key"), F.col("account").alias("other")), F.struct(F.lit("account").alias("kind"), F.col("account").alias("key"), F.col("card1").alias("other")))
    rows = feed.select("ts", F.inline(each), "t", "txn_id", "shop").filter("key is not null")
    held = rows.groupBy(F.window("ts", "2 hours", "1 hour"), F.pmod(F.xxhash64("kind", "key"), F.lit(pieces)).alias("piece")).agg(F.collect_set(F.struct("kind", "key", "t", "txn_id", "other", "shop")).alias("rows"))
    own = F.unix_timestamp("window.start") + HOUR - epoch
    return held.select(own.alias("own"), F.inline(F.sort_array("rows"))).mapInArrow(peers_told, "txn_id long, kind string, others int, shops int")


def peers_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the rows of t >= ``own``. Rows come in order of t, those of one window and key together; what is held is an hour of them."""
    at, last = None, None
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for own, kind, key, t, txn, other, shop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (own, kind, key):
                at, last, known = (own, kind, key), t, set()
                before, same, others, shops = deque(), [], Counter(), Counter()
            if txn in known:
                continue
            known.add(txn)
            if t != last:  # rows of one second are not before each other
                for r in same:
                    others[r[1]] += 1
                    shops[r[2]] += 1
                before.extend(same)
                last, same = t, []
                while before and before[0][0] < t - HOUR:
                    r = before.popleft()
                    for seen, x in ((others, r[1]), (shops, r[2])):
                        seen[x] -= 1
                        if not seen[x]:
                            del seen[x]
            if t >= own:
                of = len(others) - (None in others) + (other is not None and other not in others)
                for column, x in zip(out, (txn, kind, of, len(shops) - (None in shops)), strict=True):
                    column.append(x)
            same.append((t, other, shop))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["txn_id", "kind", "others", "shops"])


def ring_alerts(feed: DataFrame, epoch: int, threshold: float = 0.35, cap: int = R.CAP) -> DataFrame:
    """kind, key, t (the clock), members, score_mean of each live ring when it becomes flagged. ``feed`` has source."""
    rows = R.live_rows(feed).select("ts", "t", "txn_id", "kind", "key", "member", "score")
    return keyed(rows, ["kind", "key"], RingAlerts(epoch, threshold, cap), "kind string, key string, t long, members int, score_mean double")


def sliding_weeks(feed: DataFrame, epoch: int, cap: int = R.CAP) -> DataFrame:
    """day (the week's first), kind, key, txns, members (``cap`` + 1 if more), score_mean of the weeks that a batch changes."""
    rows = R.ring_rows(feed).select("ts", "t", "kind", "key", "member", "score")
    return keyed(rows, ["kind", "key"], SlidingWeeks(epoch, cap), "day long, kind string, key string, txns long, members int, score_mean double", "Update")
