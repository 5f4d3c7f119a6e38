"""End-to-end jobs over a ``TableStore``: what an operator runs on a timer.

Each job reads the current versions, applies the pure transitions, writes
new versions, and returns small metrics (one row each, safe to collect).

* ``ingest_scan_runs``  S-1/S-2 + U-1..U-4 for every new run directory
* ``ingest_dns_file``   S-3 (+ P-11 rebase) + U-1, U-5..U-7
* ``ingest_dns_folder`` the same for a folder of files in one batch
* ``load_exposure``     S-8 + U-11, and the unmapped images (Q-6)
* ``load_kev`` / ``load_epss`` / ``load_blocklist``  S-5..S-7 + U-8..U-10
* ``run_rule_engine``   R-7/R-8 over the stored tables
* ``report``            Q-1..Q-5 as DataFrames
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import dns as dnsops
from ..operators import feeds as feedops
from ..operators import findings, rollups, sketches
from ..sources import dnslog, feeds, reports
from ..sources.store import TableStore
from ..streaming import dns_stream
from ..timeutil import as_ts
from . import engine, ranking



def ingest_scan_runs(store: TableStore, root: str, as_of=None, single_run: bool = False,
                     per_run: bool = False) -> list[dict]:
    """Ingest every run under ``root`` not yet recorded.

    By default all new runs are applied in one pass (``findings.apply_runs``:
    one aggregation and one join however many runs a backfill holds) and one
    summary row is returned. ``per_run=True`` applies them one by one, oldest
    first, with the per-run metrics (images, inserted, updated, resolved). Metrics are
    counted while the state is written (``findings``: rows of the images' buckets).
    ``as_of`` None stamps each run's findings with the run's own start time;
    a value stamps all of them with it."""
    spark = store.spark
    known = {r.run_key for r in store.read("scan_run").filter(F.col("source_id") == findings.SOURCE_ID)
             .select("run_key").collect()}                  # one short key per run
    found = reports.read_runs(spark, root, single_run, known)
    if found is None:
        return []
    rows, scanned, runs = found
    if as_of is not None:
        rows, scanned = (df.withColumn("started_at", as_ts(as_of)) for df in (rows, scanned))
    clock = as_of if as_of is not None else F.current_timestamp()
    out = []
    images = store.buckets_of("vuln_finding", scanned)      # other images' findings stay as they are
    if not per_run:
        first, last = runs.agg(F.min("run_key"), F.max("run_key")).first()
        seen = Observation("findings")
        with store.run(f"{first}..{last}"):
            after = findings.apply_runs(store.state("vuln_finding", images), rows, scanned, flags=True)
            store.write("vuln_finding", after.observe(seen, *findings.backfill_metrics(first)))
            store.append("scan_run", findings.run_envelopes(runs, clock))
        n = runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("images").alias("images")).first()
        return [{**n.asDict(), **seen.get}]
    for run in runs.orderBy("run_key").collect():            # one row per run
        key, seen = run["run_key"], Observation("findings")
        with store.run(key):
            res = findings.ingest_run(store.state("vuln_finding", images), rows.filter(F.col("run_key") == key),
                                      scanned.filter(F.col("run_key") == key), key,
                                      as_of if as_of is not None else run["started_at"])
            store.write("vuln_finding", res.flagged.observe(seen, *findings.run_metrics()))
            store.append("scan_run", findings.run_envelopes(runs.filter(F.col("run_key") == key), clock))
        out.append({"run_key": key, "skipped": False, **seen.get, "images": run["images"]})
    return out


def ingest_dns_files(store: TableStore, folder: str, rules, **how) -> list[dict]:
    """Every page file of a folder, by name, each a run of its own."""
    return [ingest_dns_file(store, f, rules, **how) for f in dnslog.page_files(store.spark, folder)]


def ingest_dns_folder(store: TableStore, folder: str, rules, as_of=None, shift_to_now: bool = False,
                      retention_days: int = dnsops.DEFAULT_RETENTION_DAYS, rollup: bool = False) -> list[dict]:
    """All new page files of a folder in one batch: one read, one duplicate check, one append,
    however many files there are. The result is that of ``ingest_dns_files``, file by file: an
    entry of several files belongs to the first by name, and each file has an envelope and
    metrics of its own (rows pruned from the store count for the first)."""
    spark = store.spark
    done = {r.run_key for r in store.read("scan_run").filter(F.col("source_id") == dns_stream.SOURCE_ID)
            .select("run_key").collect()}                   # one short key per run
    files = {f.rsplit("/", 1)[-1]: f for f in dnslog.page_files(spark, folder)}
    new = [name for name in files if name not in done]
    out = {name: {"run_key": name, "skipped": True, "reason": "this file is recorded"} for name in files}
    if new:
        clock = as_ts(as_of)
        mapped = normalize.map_dns_entries(dnslog.read_pages(spark, [files[n] for n in new]), rules, keep=["ord", "run_key"])
        if shift_to_now:
            mapped = dnsops.rebase(mapped, clock, by="run_key")
        with store.run(f"{new[0]}..{new[-1]}", new):
            mapped = mapped.persist()
            try:
                before, registry = store.state("dns_query"), store.state("dns_domain")
                gone = dnsops.pruned_count(before, clock, retention_days).first()["pruned"]
                fresh = dnsops.append_new(before, mapped.filter("valid").drop("valid", "reject_reason"))
                fresh = store.append("dns_query", fresh)
                store.append("dns_domain", dnsops.domain_batch(fresh, "run_key"))
                if rollup:
                    store.append("dns_hourly", rollups.hourly(fresh))
                    store.append("dns_sketch", sketches.hourly(fresh))
                rows = dnsops.file_metrics(mapped, fresh, registry, clock, retention_days).collect()    # one row a file
            finally:
                mapped.unpersist()
            dns_stream.record_dns_run(store, new, clock, retention_days)
        none = dict.fromkeys(("seen", "skipped_entries", "inserted", "pruned", "new_domains", "duplicates"), 0)
        for name in new:
            out[name] = {"run_key": name, "skipped": False, **none}
        for r in rows:
            out[r.run_key].update(r.asDict())
        out[new[0]]["pruned"] += gone
    return list(out.values())


def ingest_dns_file(store: TableStore, path: str, rules, as_of=None, shift_to_now: bool = False,
                    retention_days: int = dnsops.DEFAULT_RETENTION_DAYS, rollup: bool = False) -> dict:
    """One query-log page file; the run key is the file name, so the same
    file twice is skipped (also after a rebase). ``rules`` are the public
    suffix rules (``dnsname.load_suffix_rules``). The run envelope is the last
    write: a job that dies is done again and replaces what it had written."""
    run_key = path.rsplit("/", 1)[-1]
    if dnslog.page_files(store.spark, path) and len(dnslog.page_files(store.spark, path)) > 1:
        raise ValueError(f"{path} holds several page files: use ingest_dns_files")
    if dns_stream.known_run(store, run_key):
        return {"run_key": run_key, "skipped": True, "reason": "this file is recorded"}
    clock = as_ts(as_of)
    ent = dnslog.read_pages(store.spark, path)
    mapped = normalize.map_dns_entries(ent, rules, keep=["ord"])
    if shift_to_now:
        mapped = dnsops.rebase(mapped, clock)
    with store.run(run_key):
        mapped = mapped.persist()
        try:
            res = dns_stream.append_batch(store, mapped, run_key, clock, retention_days, rollup)
            metrics = res.metrics.first().asDict()
        finally:
            mapped.unpersist()
        dns_stream.record_dns_run(store, run_key, clock, retention_days)
    return {"run_key": run_key, "skipped": False, **metrics}


def load_exposure(store: TableStore, path: str, as_of=None) -> DataFrame:
    """Upsert the exposure map; returns the images still unmapped."""
    rows = feeds.read_exposure(store.spark, path)       # refuses values outside the enum
    store.write("image_exposure", feedops.upsert_exposure(store.read("image_exposure"), rows, as_of))
    return ranking.unmapped_images(store.read("vuln_finding"), store.read("image_exposure"))


def load_kev(store: TableStore, path: str, as_of=None) -> int:
    rows = feeds.read_kev(store.spark, path)
    store.write("kev", feedops.upsert_kev(store.read("kev"), rows, as_of))
    return rows.count()


def load_epss(store: TableStore, path: str, as_of=None, only_known: bool = True) -> int:
    rows = feeds.read_epss(store.spark, path)
    f = store.read("vuln_finding") if only_known else None
    new, loaded = feedops.upsert_epss(store.read("epss_score"), rows, as_of, f)
    n = loaded.count()
    if n:
        store.write("epss_score", new)
    return n


def load_blocklist(store: TableStore, path: str, source: str, as_of=None) -> int:
    doms = feeds.read_hostfile(store.spark, path)
    store.write("known_bad_domain", feedops.replace_source(store.read("known_bad_domain"), doms,
                                                           source, as_of))
    return doms.count()


def run_rule_engine(store: TableStore, rules: list[engine.Rule] | None = None,
                    rules_dir: str | None = None, as_of=None) -> engine.RunOutcome:
    spark = store.spark
    rules = list(rules or engine.builtin_rules())
    if rules_dir:
        rules += engine.discover(spark, rules_dir)
    tables = {"dns_query": store.read("dns_query"), "dns_domain": store.read("dns_domain"),
              "known_bad_domain": store.read("known_bad_domain"),
              "vuln_finding": store.read("vuln_finding")}
    if store.has("dns_hourly"):
        tables["dns_hourly"] = store.read("dns_hourly")
    out = engine.run_rules(spark, rules, tables, store.read("rule"), store.read("rule_hit"), as_of)
    store.write("rule", out.rules)
    store.write("rule_hit", out.hits)
    return out


def enrich(store: TableStore, kev: str, epss: str, blocklists: dict[str, str], as_of=None) -> dict:
    """All feeds. A blocklist (by source name) that can't be read is reported
    and leaves that source as it was; the other feeds must load."""
    out = {"kev": load_kev(store, kev, as_of), "epss": load_epss(store, epss, as_of), "failed": {}}
    for source, path in blocklists.items():
        try:
            out[source] = load_blocklist(store, path, source, as_of)
        except Exception as exc:  # noqa: BLE001  (one list must not stop the others)
            out["failed"][source] = str(exc)
    return out


def report(store: TableStore, limit: int = 25) -> dict[str, DataFrame]:
    pr = ranking.vuln_priority(store.read("vuln_finding"), store.read("image_exposure"),
                               store.read("kev"), store.read("epss_score"))
    return {"headline": ranking.headline(pr), "backlog": ranking.backlog_top(pr, limit),
            "worst_images": ranking.worst_images(pr, 5), "open_hits": ranking.open_hits(store.read("rule_hit"))}
