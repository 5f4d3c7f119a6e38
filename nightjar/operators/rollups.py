"""Hourly counters per client (A-3, F-3): what the baseline rules need of the past.

The rules that compare a client's last day with the week before count rows by client in two
windows. Whole hours of both are sums of stored counters; only the two hours that the windows'
starts cut are read from the rows, so counts are exact and a run reads two hours of rows in
place of eight days.

Counters add up, so each batch stores those of its own rows and reading sums them. They go with
the retention cut-off by whole hours: rules over them need a retention longer than their
baseline (eight days by default).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..timeutil import as_ts, days, hours

KEYS = ["hour", "client", "client_name"]


def conditions() -> dict[str, Column]:
    """By counter, the rows that it counts: all, blocked ones, genuine resolution failures."""
    return {"queries": F.lit(True), "blocked": F.col("blocked"),
            "failed": (F.col("status") == "NXDOMAIN") & ~F.col("blocked")}


def hourly(dns_query: DataFrame) -> DataFrame:
    """``(hour, client, client_name, queries, blocked, failed)`` of query rows."""
    return dns_query.groupBy(F.date_trunc("hour", "ts").alias("hour"), "client", "client_name") \
        .agg(*[F.count_if(c).alias(n) for n, c in conditions().items()])


def fold(parts: DataFrame) -> DataFrame:
    """The counters of several batches in one row a key."""
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in conditions()])


def _whole(t: Column) -> Column:
    """The first full hour at or after ``t``."""
    return F.date_trunc("hour", t - F.expr("INTERVAL 1 MICROSECOND")) + hours(1)


def edges(dns_query: DataFrame, starts: list[Column]) -> DataFrame:
    """The rows of the hours that the ``starts`` cut, from each hour's beginning."""
    cut, day = F.lit(False), F.lit(False)
    for s in starts:
        cut |= (F.col("ts") >= F.date_trunc("hour", s)) & (F.col("ts") < _whole(s))
        day |= F.col("day") == F.to_date(s) if "day" in dns_query.columns else F.lit(True)
    return dns_query.filter(cut).filter(day)


def window_counts(rollup: DataFrame, dns_query: DataFrame, counter: str, as_of, baseline_days: int = 7) -> DataFrame:
    """``(client, client_name, n, p)``: rows that ``counter`` counts in the last day and in the
    ``baseline_days`` before it, as the rows themselves would give them."""
    t = as_ts(as_of)
    last, first = t - hours(24), t - days(baseline_days + 1)
    of_hours = rollup.filter(F.col("hour") >= _whole(first)).select(
        "client", "client_name",
        F.when(F.col("hour") >= _whole(last), F.col(counter)).otherwise(0).alias("n"),
        F.when(F.col("hour") < F.date_trunc("hour", last), F.col(counter)).otherwise(0).alias("p"))
    of_rows = edges(dns_query, [last, first]).filter(conditions()[counter] & (F.col("ts") >= first)).select(
        "client", "client_name", (F.col("ts") >= last).cast("long").alias("n"),
        (F.col("ts") < last).cast("long").alias("p"))
    return of_hours.unionByName(of_rows).groupBy("client", "client_name") \
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
