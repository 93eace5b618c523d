"""Wide hourly tables of published topics.

A topic is data: the rows that each of its columns takes, and columns derived from those. Intervals of any resolution become hours inside
their row, and all columns of all topics are averages of one aggregation by hour, so many topics cost one pass and one exchange that
combines before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Topic:
    """``columns``: condition on an interval row for each column. ``derived``: expressions over them. ``hidden`` columns serve derived ones only."""

    name: str
    columns: dict[str, Column]
    derived: dict[str, Column] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    @property
    def shown(self) -> list[str]:
        return [c for c in (*self.columns, *self.derived) if c not in self.hidden]


def net_flows(name: str, flows: dict[str, tuple[Column, Column]]) -> Topic:
    """Export minus import of each connection; a side without a value counts as 0, an hour without both has none."""
    columns, derived = {}, {}
    for c, sides in flows.items():
        both = [f"{c}_export", f"{c}_import"]
        columns |= dict(zip(both, sides))
        known = F.coalesce(*both).isNotNull()
        derived[c] = F.when(known, F.coalesce(both[0], F.lit(0.0)) - F.coalesce(both[1], F.lit(0.0)))
    return Topic(name, columns, derived, tuple(columns))


def forecast_errors(name: str, pairs: dict[str, tuple[Column, Column]]) -> Topic:
    """Forecast, actual value and their difference for each quantity."""
    columns, derived = {}, {}
    for c, sides in pairs.items():
        columns |= dict(zip((f"{c}_forecast", f"{c}_actual"), sides))
        derived[f"{c}_error"] = F.col(f"{c}_forecast") - F.col(f"{c}_actual")
    return Topic(name, columns, derived)


def wide_topics(intervals: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """(begin_date, end_date, all columns of all topics) from rows with begin_date, end_date and value; hours without any value are left out.

    Rows shorter than an hour are averaged in it; rows of an hour or more hold in each hour they begin in and win over shorter ones. Rows
    that say different values for the same hour are averaged. Column names must differ between topics.
    """
    names = [c for t in topics for c in (*t.columns, *t.derived)]
    if len(set(names)) < len(names):
        raise ValueError("two topics have a column of the same name")
    short = F.expr("timestampdiff(SECOND, begin_date, end_date) < 3600")
    hours = F.when(short, F.array(F.date_trunc("hour", "begin_date"))).otherwise(
        F.expr("sequence(begin_date, greatest(begin_date, end_date - INTERVAL 1 HOUR), INTERVAL 1 HOUR)")
    )
    takes = {c: cond for t in topics for c, cond in t.columns.items()}
    rows = intervals.where(F.col("value").isNotNull() & F.array_contains(F.array(*[F.coalesce(c, F.lit(False)) for c in takes.values()]), True))
    rows = rows.select(
        F.explode(hours).alias("_hour"), short.alias("_short"), F.col("value").cast("double").alias("_v"),
        *[cond.alias(f"_in_{c}") for c, cond in takes.items()],
    )

    def mean(c: str) -> Column:
        own = F.col(f"_in_{c}")
        whole, parts = (F.avg(F.when(own & side, F.col("_v"))) for side in (~F.col("_short"), F.col("_short")))
        return F.coalesce(whole, parts).alias(c)

    wide = rows.groupBy(F.col("_hour").alias("begin_date")).agg(*[mean(c) for c in takes])
    for t in topics:
        wide = wide.withColumns(t.derived) if t.derived else wide
    return wide.select("begin_date", F.expr("begin_date + INTERVAL 1 HOUR").alias("end_date"), *[c for t in topics for c in t.shown])


def topic_table(wide: DataFrame, topic: Topic) -> DataFrame:
    """One topic's own table: hours in which it has a value."""
    return wide.select("begin_date", "end_date", *topic.shown).where(F.coalesce(*topic.shown).isNotNull())
