"""Components of cards and devices over sliding windows of days.

Time is cut into slices. Each slice's own forest is found once, from edges written
once. What joins slices are links: a node that is active in two slices, one after
the other, joins its components there, in all windows that hold both slices. Links
are few, one for each pair of components however many nodes they share, and only
they are copied to the windows. Counts are sums over the components of slices; a
node counts where it was last active in a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.functions import keys as K
from ringsight.operators.graph import grouped_components
from ringsight.session import sized, staged

DAY, DAYS = 86400, 7
#: Components of slices up to which their labels are broadcast.
MOST = 1_000_000


def first_day(slice_: Column, causal: bool) -> Column:
    """The first day whose window holds a slice. A day has two slices: its first second, and the rest."""
    return F.floor(slice_ / 2).cast("long") + int(causal)


def last_day(slice_: Column, days: int = DAYS) -> Column:
    """The last day whose window holds a slice: the window begins after the first second of the day ``days`` before."""
    return F.floor((slice_ + 2 * days - 1) / 2).cast("long")


def windows(start: Column, end: Column) -> Column:
    """Days from start to end, none if end is before start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))


@dataclass
class Sliding:
    """active: (slice, node, is_card, id of its component there, next slice of the node); labels: (day, id, component) where it has another label than its id; parts: (id, slice, n, t0, t1, spans); people: (id, slice, account); end: the last day."""

    active: DataFrame
    labels: DataFrame
    parts: DataFrame
    people: DataFrame
    end: int
    causal: bool

    def days_of(self, slice_: str, until: Column | None = None) -> Column:
        last = F.least(last_day(F.col(slice_)), F.lit(self.end))
        return F.explode(windows(first_day(F.col(slice_), self.causal), last if until is None else F.least(last, until))).alias("day")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (day, id and more) with component in place of id."""
        out = rows.join(sized(self.labels, MOST), ["day", "id"], "left")
        return out.withColumn("component", F.coalesce("component", "id")).drop("id")


def card_node() -> Column:
    return F.xxhash64(F.lit("c"), K.composite_key("card1"))


def sliding_components(txn: DataFrame, causal: bool = False) -> Sliding:
    """Components over ``txn`` (t, card1, account, device_info, browser) for every day from the first to the last of its rows.

    The window of day d holds the rows later than d days less a week, up to the day's
    end, or with ``causal`` up to its beginning. Cards and devices are nodes, a row with
    a device is an edge; a card without one is a component of its own. A null card is a
    card like others.
    """
    card, dev = card_node(), F.xxhash64(F.lit("v"), K.device_key())
    slice_ = 2 * K.day() + (F.pmod("t", F.lit(DAY)) > 0).cast("long")
    rows = txn.select(slice_.alias("slice"), card.alias("src"), F.when(F.col("device_info").isNotNull(), dev).alias("dev"), "t", "account")
    # one row for each card, device and account of a slice: all that is asked of rows is a sum, a least or a greatest
    few = staged(rows.groupBy("slice", "src", "dev", "account").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")), "slices")
    end = few.agg(F.max(F.floor(F.col("slice") / 2).cast("long"))).first()[0]
    forest = grouped_components(few.select("slice", "src", F.coalesce("dev", "src").alias("dst")), ["slice"])
    own = Window.partitionBy("node").orderBy("slice")  # a row for a slice
    active = forest.select("slice", "node", F.xxhash64("slice", "component").alias("id"), F.lead("slice").over(own).alias("next"), F.lead(F.xxhash64("slice", "component")).over(own).alias("next_id"))
    cards = few.select("slice", F.col("src").alias("node")).distinct().withColumn("is_card", F.lit(True))
    active = staged(active.join(cards.hint("merge"), ["slice", "node"], "left").withColumn("is_card", F.coalesce("is_card", F.lit(False))), "active")
    links = active.filter("next is not null").select("slice", "next", F.col("id").alias("src"), F.col("next_id").alias("dst")).distinct()
    joined = links.select(F.explode(windows(first_day(F.col("next"), causal), F.least(last_day(F.col("slice")), F.lit(end)))).alias("day"), "src", "dst")
    labels = staged(grouped_components(joined, ["day"]).filter("node <> component").select("day", F.col("node").alias("id"), "component"), "labels")
    at = few.join(active.filter("is_card").select("slice", F.col("node").alias("src"), "id").hint("merge"), ["slice", "src"])
    people = staged(at.groupBy("slice", "id", "account").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1")), "people")
    sums = people.groupBy("slice", "id").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    until = F.coalesce(first_day(F.col("next"), causal) - 1, F.lit(1 << 40))
    spans = active.groupBy("slice", "id", F.least(until, last_day(F.col("slice"))).alias("until")).agg(F.count_if("is_card").alias("cards"), F.count_if(~F.col("is_card")).alias("devices"))
    spans = spans.groupBy("slice", "id").agg(F.collect_list(F.struct("until", "cards", "devices")).alias("spans"))  # a day each, eight at most
    parts = staged(sums.join(spans.hint("merge"), ["slice", "id"]), "parts")
    return Sliding(active, labels, parts, people, end if end is not None else -1, causal)


def component_stats(s: Sliding) -> DataFrame:
    """day, component, comp_size (rows), comp_cards, comp_devices, comp_accounts, comp_rate (rows an hour, over a minute at least) of every component of every day's window."""
    left = lambda c: F.aggregate(F.filter("spans", lambda x: x["until"] >= F.col("day")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    spread = s.parts.select(s.days_of("slice"), "id", "n", "t0", "t1", "spans").select("day", "id", "n", "t0", "t1", left("cards").alias("cards"), left("devices").alias("devices"))
    sums = s.labelled(spread).groupBy("day", "component").agg(*[F.sum(c).alias(c) for c in ("n", "cards", "devices")], F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    people = s.labelled(s.people.select(s.days_of("slice"), "id", "account")).groupBy("day", "component", "account").agg(F.lit(1))
    people = people.groupBy("day", "component").agg(F.count("account").alias("comp_accounts"))
    span = F.greatest((F.col("t1") - F.col("t0")) / 3600, F.lit(1.0 / 60))
    both = sums.join(people.hint("merge"), ["day", "component"])
    return both.select("day", "component", F.col("n").alias("comp_size"), F.col("cards").alias("comp_cards"), F.col("devices").alias("comp_devices"), "comp_accounts", (F.col("n") / span).alias("comp_rate"))


def component_days(txn: DataFrame, causal: bool = False) -> DataFrame:
    """day, src (``card_node``) and the component's figures, for each day and card of ``txn``, once; with ``causal`` without cards that the window does not have."""
    s = sliding_components(txn, causal)
    cards = s.active.filter("is_card")
    if causal:  # where a card was last active
        at = cards.select(s.days_of("slice", F.coalesce(first_day(F.col("next"), True) - 1, F.lit(s.end))), F.col("node").alias("src"), "id")
        at = at.join(txn.select(K.day().alias("day"), card_node().alias("src")).distinct().hint("merge"), ["day", "src"], "left_semi")
    else:  # a day's last slice of its own
        at = cards.groupBy(F.floor(F.col("slice") / 2).cast("long").alias("day"), F.col("node").alias("src")).agg(F.max_by("id", "slice").alias("id"))
    return s.labelled(at).join(component_stats(s).hint("merge"), ["day", "component"]).drop("component")


def component_features(txn: DataFrame, causal: bool = False) -> DataFrame:
    """Per txn_id its card's component: size in rows, cards, devices, accounts and rows an hour. Null if a causal window does not have the card."""
    rows = txn.select("txn_id", K.day().alias("day"), card_node().alias("src"))
    return rows.join(component_days(txn, causal).hint("merge"), ["day", "src"], "left").drop("day", "src")
