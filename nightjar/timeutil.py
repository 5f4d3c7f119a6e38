"""``as_of`` handling: every job takes its clock as a parameter."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_ts(as_of) -> Column:
    """datetime / ISO string / epoch-µs int / Column -> timestamp Column (UTC)."""
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, int):
        return F.timestamp_micros(F.lit(as_of))
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def max_ts_micros(df: DataFrame, col: str = "ts") -> int | None:
    """Newest timestamp of ``df`` as epoch microseconds (one tiny aggregate)."""
    return df.agg(F.unix_micros(F.max(F.col(col).cast("timestamp")))).first()[0]


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def days(n) -> Column:
    return F.make_dt_interval(F.lit(n))


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def resolve(spark, as_of) -> dt.datetime:
    """``as_of`` as an aware UTC datetime (a literal usable as a SQL argument).

    A Column is evaluated once on a one-row frame."""
    if isinstance(as_of, dt.datetime):
        return as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
    if isinstance(as_of, int):
        return _EPOCH + dt.timedelta(microseconds=as_of)
    us = spark.range(1).select(F.unix_micros(as_ts(as_of))).first()[0]
    return _EPOCH + dt.timedelta(microseconds=us)
