"""DNS state: natural-key append, domain registry merge, retention prune,
incremental cursor and timeline rebase.

``dns_query`` is append-only and keyed by (ts, client, qname, qtype); it is
stored partitioned by ``day`` so the duplicate check and the prune only
touch the days a batch covers. ``dns_domain`` is the long-lived registry:
first/last seen and counters per registrable domain, never pruned.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import DNS_KEY
from ..timeutil import as_ts, days
from .upsert import B, S, reduce_batch, upsert

DEFAULT_RETENTION_DAYS = 35


def with_day(df: DataFrame) -> DataFrame:
    """Partition column of the stored dns_query table."""
    return df.withColumn("day", F.to_date("ts"))


def dedupe_batch(rows: DataFrame, order: str = "ord") -> DataFrame:
    """U-5 within a batch: first occurrence (by ``order``) of each natural key.

    An aggregation (``min_by`` on a struct), so rows combine map-side.
    """
    rest = [c for c in rows.columns if c not in DNS_KEY]
    return reduce_batch(rows, DNS_KEY, order, first=rest)


def append_new(store: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """U-5: rows whose natural key is neither stored nor earlier in the batch.

    With a ``day`` column the store is cut to the days that occur in the
    batch (one wrong clock adds one day, not a range), which prunes its
    partitions at run time; then it is anti-joined on the key.
    """
    first = dedupe_batch(rows, order)
    near = store
    if "day" in store.columns:
        near = near.join(rows.select(F.to_date("ts").alias("day")).distinct(), "day", "left_semi")
    return first.join(near.select(*DNS_KEY), DNS_KEY, "left_anti")


def domain_batch(rows: DataFrame, *by: str) -> DataFrame:
    """A-8: per-domain min/max time, queries and blocked queries of a batch (and ``by``)."""
    return rows.groupBy(F.col("registrable_domain").alias("domain"), *by).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("query_count"),
        F.count_if("blocked").alias("blocked_count"))


def merge_registry(registry: DataFrame, new_rows: DataFrame) -> DataFrame:
    """U-6: first_seen = least (it may move back on a backfill), last_seen =
    greatest, counters add. Output keeps ``_action`` ('insert' = new domain)."""
    batch = domain_batch(new_rows)
    ins = {c: B(c) for c in ["first_seen", "last_seen", "query_count", "blocked_count"]}
    upd = {"first_seen": F.least(S("first_seen"), B("first_seen")),
           "last_seen": F.greatest(S("last_seen"), B("last_seen")),
           "query_count": S("query_count") + B("query_count"),
           "blocked_count": S("blocked_count") + B("blocked_count")}
    return upsert(registry, batch, ["domain"], ins, upd)


def fold_registry(parts: DataFrame) -> DataFrame:
    """U-6 over stored parts: a domain's rows of all batches folded into one.
    Least, greatest and sums commute, so batches can be stored as they come."""
    return parts.groupBy("domain").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("query_count").alias("query_count"), F.sum("blocked_count").alias("blocked_count"))


def prune(store: DataFrame, as_of, retention_days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """U-7: keep rows with ts >= as_of - N days (N = 0 keeps only the future)."""
    cutoff = as_ts(as_of) - days(retention_days)
    kept = store.filter(F.col("ts") >= cutoff)
    if "day" in store.columns:
        kept = kept.filter(F.col("day") >= F.to_date(cutoff))
    return kept


def pruned_count(store: DataFrame, as_of, retention_days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    cutoff = as_ts(as_of) - days(retention_days)
    return store.agg(F.count_if(F.col("ts") < cutoff).alias("pruned"))


def past_cursor(rows: DataFrame, store: DataFrame) -> DataFrame:
    """S-4: entries newer than the newest stored time; entries without a
    time pass (they are counted as skipped later); an empty store passes all."""
    cursor = store.agg(F.max("ts")).scalar()             # scalar subquery
    return rows.filter(F.col("ts").isNull() | cursor.isNull() | (F.col("ts") > cursor))


def rebase(rows: DataFrame, as_of, ts_col: str = "ts", by: str | None = None) -> DataFrame:
    """P-11: shift every known time by (as_of - newest time), the newest of all rows or of those
    with the same ``by``; rows without a time stay as they are; no known time at all is a no-op."""
    if by is None:
        newest = rows.agg(F.max(ts_col)).scalar()        # scalar subquery
        rows = rows.withColumn("__newest", newest)
    else:
        rows = rows.join(rows.groupBy(by).agg(F.max(ts_col).alias("__newest")), by, "left")
    shifted = F.col(ts_col) + (as_ts(as_of) - F.col("__newest"))
    return rows.withColumn(ts_col, F.when(F.col(ts_col).isNull(), F.col(ts_col)).otherwise(shifted)).drop("__newest")


def file_metrics(mapped: DataFrame, fresh: DataFrame, registry: DataFrame, as_of,
                 retention_days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """U-4 of many files in one batch, a row for each ``run_key``, as if they had come one after
    the other by name: a domain is new in the first file that adds a row of it. ``pruned`` holds
    the file's own rows that are past retention."""
    cutoff = as_ts(as_of) - days(retention_days)
    seen = mapped.groupBy("run_key").agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("valid")).alias("skipped_entries"))
    added = fresh.groupBy("run_key").agg(F.count(F.lit(1)).alias("inserted"), F.count_if(F.col("ts") < cutoff).alias("pruned"))
    first = fresh.groupBy(F.col("registrable_domain").alias("domain")).agg(F.min("run_key").alias("run_key")) \
        .join(registry.select("domain"), "domain", "left_anti").groupBy("run_key").agg(F.count(F.lit(1)).alias("new_domains"))
    out = seen.join(added, "run_key", "left").join(first, "run_key", "left") \
        .fillna(0, ["inserted", "pruned", "new_domains"])
    return out.withColumn("duplicates", F.col("seen") - F.col("skipped_entries") - F.col("inserted"))


@dataclass
class DnsIngest:
    new_rows: DataFrame     # rows appended by this batch
    domains: DataFrame      # the batch's share of the registry
    metrics: DataFrame      # one row: seen, inserted, duplicates, skipped_entries, new_domains, pruned


def ingest_batch(store: DataFrame, registry: DataFrame, mapped: DataFrame, run_key: str,
                 as_of, retention_days: int = DEFAULT_RETENTION_DAYS,
                 order: str = "ord", write=None) -> DnsIngest:
    """U-5, U-6, U-7 for one batch of mapped entries (``valid`` flag set).

    ``write`` stores the new rows and gives them back (``store.append``), so
    that registry and metrics read what was stored instead of computing the
    batch again. The run-envelope check (U-1) is the caller's.
    """
    valid = mapped.filter("valid").drop("valid", "reject_reason").withColumn("run_key", F.lit(run_key))
    fresh = append_new(store, valid, order).select(*[c for c in store.columns if c != "day"])
    fresh = write(fresh) if write else fresh
    domains = domain_batch(fresh)
    counts = mapped.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("valid")).alias("skipped_entries"))
    cutoff = as_ts(as_of) - days(retention_days)
    ins = fresh.agg(F.count(F.lit(1))).scalar()
    newd = domains.join(registry.select("domain"), "domain", "left_anti").agg(F.count(F.lit(1))).scalar()
    old = store.select("ts").unionByName(fresh.select("ts")) if write is None else store.select("ts")
    pruned = pruned_count(old, as_of, retention_days).scalar()
    late = fresh.agg(F.count_if(F.col("ts") < cutoff)).scalar() if write else F.lit(0)
    metrics = (counts.select("seen", "skipped_entries", ins.alias("inserted"), newd.alias("new_domains"),
                             (pruned + late).alias("pruned"))
               .withColumn("duplicates", F.col("seen") - F.col("skipped_entries") - F.col("inserted")))
    return DnsIngest(fresh, domains, metrics)
