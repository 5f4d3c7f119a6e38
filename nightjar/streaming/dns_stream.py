"""Streaming DNS ingest and detections.

* ST-1/ST-4/ST-6/ST-7  ``start_ingest``: file source -> foreachBatch that
  appends new rows, adds to the domain registry, (optionally) runs the rules,
  applies retention and records the run; the checkpoint is the progress.
  ``foreachBatch`` is at-least-once: a batch that was recorded is recognised
  by its run key and skipped, one that was not replaces what it had written.
* S-4 ``start_pull``: the same from a folder of landed pages, past an offset.
* ST-2 ``dedupe``: watermark-bounded natural-key dedupe.
* ST-3 late rows: the watermark delay is a parameter (0 = drop what is behind
  the newest seen time's hour, much as the cursor pull does).
* ST-5 trailing windows: ``streaming.panes``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize
from ..functions.normalize import DNS_KEY
from ..operators import dns as dnsops, rollups, sketches
from ..sources import dnslog, pagepull
from ..sources.store import TableStore
from ..timeutil import as_ts

SOURCE_ID = "resolver"


def entry_stream(spark: SparkSession, path: str, fmt: str = "json",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Entry-per-line files (JSON lines or parquet) as a stream."""
    r = spark.readStream.schema(schemas.DNS_ENTRY).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def mapped_stream(stream: DataFrame, rules) -> DataFrame:
    """Entries -> dns_query rows (validity flagged); rule table is static."""
    return normalize.map_dns_entries(stream, rules)


def dedupe(mapped: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST-2: first arrival of each natural key within the watermark delay."""
    return (mapped.filter("valid").withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(DNS_KEY))


def process_batch(store: TableStore, batch: DataFrame, run_key: str, as_of,
                  retention_days: int = dnsops.DEFAULT_RETENTION_DAYS, rule_runner=None, rollup: bool = False) -> bool:
    """One micro-batch of mapped entries into the store: rows, registry, hourly counters and
    sketches (with ``rollup``), rule hits, retention and, last, the run envelope. Returns False
    when the run key is already recorded; a batch that died before is done again."""
    if known_run(store, run_key):
        return False
    with store.run(run_key):
        # The duplicate check and the append both read the micro-batch.
        mapped = batch.withColumn("ord", F.monotonically_increasing_id()).persist()
        try:
            append_batch(store, mapped, run_key, as_of, retention_days, rollup)
        finally:
            mapped.unpersist()
        if rule_runner is not None:
            rule_runner(store, as_of)
        record_dns_run(store, run_key, as_of, retention_days)
    return True


def known_run(store: TableStore, run_key: str) -> bool:
    """U-1: whether the batch's envelope is recorded."""
    known = store.read("scan_run").filter((F.col("source_id") == SOURCE_ID) & (F.col("run_key") == run_key))
    return bool(known.limit(1).count())


def append_batch(store: TableStore, mapped: DataFrame, run_key: str, as_of, retention_days: int,
                 rollup: bool) -> dnsops.DnsIngest:
    """The rows that a batch adds, and what is derived from them; its own earlier attempt is
    not in the state that it is compared with."""
    res = dnsops.ingest_batch(store.state("dns_query"), store.state("dns_domain"), mapped, run_key, as_of,
                              retention_days, write=lambda df: store.append("dns_query", df))
    store.append("dns_domain", res.domains)
    if rollup:
        store.append("dns_hourly", rollups.hourly(res.new_rows))
        store.append("dns_sketch", sketches.hourly(res.new_rows))
    return res


def record_dns_run(store: TableStore, run_key: str | list[str], as_of, retention_days: int) -> None:
    """The retention cut-off and, last, the envelopes of the runs of one DNS batch."""
    t = as_ts(as_of)
    keys = [run_key] if isinstance(run_key, str) else run_key
    runs = store.spark.createDataFrame([(SOURCE_ID, k) for k in keys], "source_id string, run_key string").coalesce(1)
    none = F.lit(None).cast("int")
    store.retain(runs.select((t - dnsops.days(retention_days)).cast("string")).first()[0])
    store.append("scan_run", runs.select(
        "source_id", "run_key", t.alias("started_at"), t.alias("ingested_at"),
        none.alias("images_total"), none.alias("images_scanned"), none.alias("images_skipped")))


def start_ingest(stream_entries: DataFrame, store: TableStore, rules, checkpoint: str,
                 as_of=None, retention_days: int = dnsops.DEFAULT_RETENTION_DAYS,
                 rule_runner=None, available_now: bool = True, rollup: bool = False):
    """ST-1: start the ingest stream; returns the StreamingQuery.

    A batch's run key holds the query's id, which its checkpoint keeps: a
    batch that is run again is known, one of a new checkpoint or of another
    stream on the store is not. ``as_of`` None means the clock is the batch's
    processing time."""
    mapped = mapped_stream(stream_entries, rules)

    def each(batch: DataFrame, batch_id: int):
        clock = as_of if as_of is not None else F.current_timestamp()
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        process_batch(store, batch, f"stream-{query}-{batch_id:012d}", clock, retention_days, rule_runner, rollup)

    w = mapped.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_pull(spark: SparkSession, folder: str, store: TableStore, rules, checkpoint: str, as_of=None,
               max_pages: int = pagepull.MAX_PAGES, retention_days: int = dnsops.DEFAULT_RETENTION_DAYS,
               rule_runner=None, rollup: bool = False, pulls: list | None = None):
    """S-4 / ST-1: one pull of landed pages into the store; returns the StreamingQuery. Its
    offset is the last page taken, kept by the checkpoint; a pull without new pages does
    nothing. ``pulls`` collects (pages read, pages left)."""
    spark.dataSource.register(pagepull.LandedPages)
    pages = spark.readStream.format("landed_pages").option("path", folder).option("maxPages", max_pages).load()

    def each(batch: DataFrame, batch_id: int):
        got = batch.collect()                               # at most max_pages names
        if not got:
            return
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        mapped = normalize.map_dns_entries(dnslog.read_pages(session, [r.path for r in got]).drop("run_key", "ord"), rules)
        clock = as_of if as_of is not None else F.current_timestamp()
        process_batch(store, mapped, f"pull-{query}-{batch_id:012d}", clock, retention_days, rule_runner, rollup)
        if pulls is not None:
            pulls.append((len(got), max(r.left for r in got)))

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rules_runner(rules, params_tables=None):
    """ST-7: a ``rule_runner`` for ``start_ingest`` running the rule engine on
    the stored tables after every batch and persisting rule / hit state. A store that keeps
    hourly counters serves the baseline rules from them."""
    from ..plans import engine

    def run(store: TableStore, as_of):
        spark = store.spark
        tables = {"dns_query": store.read("dns_query"),
                  "dns_domain": store.read("dns_domain"),
                  "known_bad_domain": store.read("known_bad_domain")}
        if store.has("dns_hourly"):
            tables["dns_hourly"] = store.read("dns_hourly")
        if params_tables:
            tables.update(params_tables)
        out = engine.run_rules(spark, rules, tables, store.state("rule"), store.state("rule_hit"), as_of)
        store.write("rule", out.rules)
        store.write("rule_hit", out.hits)

    return run
