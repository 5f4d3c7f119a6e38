"""Generic keyed upsert and in-batch reduction.

``upsert`` is the set form of ``INSERT ... ON CONFLICT (keys) DO UPDATE SET
<some columns>``: a full outer join of state and a batch that holds at most
one row per key. Columns not named in ``update`` keep their state value.
``reduce_batch`` turns a batch with repeated keys into one row per key with
the net effect of applying its rows in input order.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S_PREFIX = "s__"
B_PREFIX = "b__"

def S(c: str) -> Column:
    """State-side column inside ``upsert`` expressions."""
    return F.col(S_PREFIX + c)


def B(c: str) -> Column:
    """Batch-side column inside ``upsert`` expressions."""
    return F.col(B_PREFIX + c)


Expr = Column | Callable[[], Column]


def _ev(e: Expr) -> Column:
    return e() if callable(e) else e


def reduce_batch(batch: DataFrame, keys: list[str], order: str | Column,
                 first: list[str] = (), last: list[str] = (),
                 count_col: str | None = None) -> DataFrame:
    """One row per key: ``first`` columns from the earliest row, ``last`` from
    the latest row (by ``order``), plus an optional occurrence count.

    A plain aggregation, so it combines map-side before the shuffle and a
    hot key never gathers its rows in one place.
    """
    order_c = F.col(order) if isinstance(order, str) else order
    aggs = []
    if first:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in first]), order_c).alias("__first"))
    if last:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in last]), order_c).alias("__last"))
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    red = batch.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys]
    cols += [F.col(f"__first.{c}").alias(c) for c in first]
    cols += [F.col(f"__last.{c}").alias(c) for c in last]
    if count_col:
        cols.append(F.col(count_col))
    return red.select(*cols)


def upsert(state: DataFrame, batch: DataFrame, keys: list[str],
           insert: Mapping[str, Expr], update: Mapping[str, Expr],
           action_col: str | None = "_action", carry: list[str] = ()) -> DataFrame:
    """Full-outer-join upsert.

    * ``state`` rows without a batch row are kept unchanged (action 'keep');
    * batch rows without state get ``insert`` (column -> expression over
      ``B(...)``; columns of ``state`` not listed become NULL), action 'insert';
    * matches keep state columns except those in ``update`` (expressions over
      ``S(...)`` and ``B(...)``), action 'update'.

    The output has exactly the columns of ``state``, plus ``action_col`` and the
    batch columns named in ``carry`` (NULL where no batch row met the key).
    ``batch`` must hold at most one row per key (see ``reduce_batch``).

    Plan: one full outer join, so state and batch are each read once and no
    job runs while the plan is built. Callers that use the result more than
    once write it first.
    """
    cols = state.columns
    s = state.select(*[F.col(c).alias(S_PREFIX + c) for c in cols]).withColumn("__s", F.lit(True))
    b = batch.select(*[F.col(c).alias(B_PREFIX + c) for c in batch.columns]).withColumn("__b", F.lit(True))
    cond = None
    for k in keys:
        c = S(k) == B(k)
        cond = c if cond is None else cond & c
    j = s.join(b, cond, "full_outer")
    in_s, in_b = F.col("__s").isNotNull(), F.col("__b").isNotNull()
    out = []
    for c in cols:
        if c in keys:
            e = F.coalesce(S(c), B(c))
        else:
            ins = _ev(insert[c]) if c in insert else F.lit(None)
            upd = _ev(update[c]) if c in update else S(c)
            e = F.when(~in_s, ins).when(in_b, upd).otherwise(S(c))
        out.append(e.cast(state.schema[c].dataType).alias(c))
    if action_col:
        out.append(F.when(~in_s, F.lit("insert")).when(in_b, F.lit("update"))
                   .otherwise(F.lit("keep")).alias(action_col))
    return j.select(*out, *[B(c).alias(c) for c in carry])
