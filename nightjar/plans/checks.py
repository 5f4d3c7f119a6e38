"""Check queries over the driver's tables: each takes (spark, sf_dir) and
returns a DataFrame; ``nightjar.plans.oracle`` holds the equivalent SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize
from ..operators import feeds, findings
from . import ranking, testviews as tv
from .render import render


# ------------------------------------------------------------ finding state

def findings_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tv.finding_rows(spark, sf_dir)
    return findings.replay_runs(rows, tv.run_images(rows))


def _before_after(spark, sf_dir):
    rows = tv.finding_rows(spark, sf_dir)
    last = rows.agg(F.max("run_key"), F.max("started_at")).first()
    run_key, started = last[0], last[1]
    prev = rows.filter(F.col("run_key") < run_key)
    cur = rows.filter(F.col("run_key") == run_key)
    state = findings.replay_runs(prev, tv.run_images(prev), dealt=True)
    return state, cur, run_key, F.lit(run_key).substr(1, 8), started


def _run_ts(run_key: str):
    return F.to_timestamp(F.lit(run_key), "yyyyMMdd-HHmmss")


def q_scan_findings_flatten(spark, sf_dir):
    docs = tv.report_docs(spark, sf_dir)
    return render(normalize.flatten_reports(docs, keep=["run_key"]))


def q_finding_normalise(spark, sf_dir):
    return render(tv.finding_rows(spark, sf_dir).drop("started_at"))


def q_finding_replay(spark, sf_dir):
    return render(findings_state(spark, sf_dir))


def q_finding_apply_runs(spark, sf_dir):
    """State of all runs but the last two, then the last two applied in one
    pass: equal to replaying every run."""
    rows = tv.finding_rows(spark, sf_dir)
    keys = [r[0] for r in rows.select("run_key").distinct().orderBy("run_key").collect()]
    cut = keys[-2] if len(keys) >= 2 else keys[0]
    prev = rows.filter(F.col("run_key") < cut)
    cur = rows.filter(F.col("run_key") >= cut)
    state = findings.replay_runs(prev, tv.run_images(prev), dealt=True)
    return render(findings.apply_runs(state, cur, tv.run_images(cur)))


def q_scan_run_envelope(spark, sf_dir):
    """U-1: runs before the newest are recorded; the incoming list holds
    every run; only the newest is new and gets an envelope."""
    rows = tv.finding_rows(spark, sf_dir)
    runs = (tv.run_images(rows).groupBy("run_key", "started_at")
            .agg(F.count(F.lit(1)).alias("images")))
    last = runs.agg(F.max("run_key")).first()[0]
    known = findings.record_runs(schemas.empty(spark, "scan_run"), runs.filter(F.col("run_key") < last),
                                 "2024-05-01 00:00:00")
    fresh = findings.new_runs(runs, known)
    return render(findings.record_runs(known, fresh, "2024-06-01 00:00:00"))


def q_finding_triage(spark, sf_dir):
    """U-14 on findings: people accept every finding of CVEs ending in 7,
    then mark those on build-only images (exposure map) false positive an
    hour later (the later decision wins); the backlog then excludes them."""
    from ..operators import hits as hitops
    st = findings_state(spark, sf_dir)
    expo = exposure_state(spark, sf_dir).filter(F.col("exposure") == "build-only").select("image")
    keys = ["image", "pkg_name", "installed_version", "cve"]
    d1 = st.filter(F.col("cve").endswith("7")).select(
        *keys, F.lit("accepted").alias("status"), F.lit("vendor says unreachable").alias("status_note"),
        F.lit("2024-06-02 09:00:00").cast("timestamp").alias("decided_at"))
    d2 = st.filter(F.col("cve").endswith("7")).join(expo, "image", "left_semi").select(
        *keys, F.lit("false_positive").alias("status"), F.lit(None).cast("string").alias("status_note"),
        F.lit("2024-06-02 10:00:00").cast("timestamp").alias("decided_at"))
    out = hitops.apply_decisions(st, d1.unionByName(d2), keys)
    pr = ranking.vuln_priority(out, exposure_state(spark, sf_dir), kev_state(spark, sf_dir),
                               epss_state(spark, sf_dir))
    counts = out.groupBy("status").agg(F.count(F.lit(1)).alias("findings"),
                                       F.count_if(F.col("status_changed_at").isNotNull()).alias("decided"))
    return render(counts.join(pr.groupBy("status").agg(F.count(F.lit(1)).alias("in_backlog")),
                              "status", "left"))


def q_finding_upsert(spark, sf_dir):
    state, cur, run_key, _, _ = _before_after(spark, sf_dir)
    up = findings.upsert_findings(state, cur, run_key, _run_ts(run_key))
    return render(up.drop("occurrences", findings.PART))


def q_finding_resolve(spark, sf_dir):
    state, cur, run_key, _, _ = _before_after(spark, sf_dir)
    res = findings.ingest_run(state, cur, cur.select("image"), run_key, _run_ts(run_key))
    return render(res.state.drop(findings.PART))


def q_finding_ingest_metrics(spark, sf_dir):
    state, cur, run_key, _, _ = _before_after(spark, sf_dir)
    res = findings.ingest_run(state, cur, cur.select("image"), run_key, _run_ts(run_key))
    return render(res.metrics)


# ------------------------------------------------------------------- feeds

def _feed_clock(spark, sf_dir):
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def kev_state(spark, sf_dir):
    feed = tv.kev_feed(spark, sf_dir)
    rows = feeds.kev_rows(feed)
    return feeds.upsert_kev(schemas.empty(spark, "kev"), rows, _feed_clock(spark, sf_dir))


def q_kev_upsert(spark, sf_dir):
    """Two pulls: sizes 1-3, then all of 1-5 with new vendor spelling and due
    dates. Known CVEs keep their first vendor/product/date_added."""
    feed = tv.kev_feed(spark, sf_dir)
    p = tv.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_size")
    first = feeds.kev_rows(feed.join(p.filter("p_size <= 3"), "ord", "left_semi"))
    s1 = feeds.upsert_kev(schemas.empty(spark, "kev"), first, "2024-05-01 00:00:00")
    second = feed.select(
        "ord", "cveID", F.upper("vendorProject").alias("vendorProject"), "product", "dateAdded",
        F.concat(F.lit("2024-03-"), F.lpad((F.col("ord") % 28 + 1).cast("string"), 2, "0")).alias("dueDate"),
        "knownRansomwareCampaignUse")
    s2 = feeds.upsert_kev(s1, feeds.kev_rows(second), "2024-06-01 00:00:00")
    return render(s2)


def epss_state(spark, sf_dir, only_known: bool = True):
    rows = feeds.epss_rows(tv.epss_feed(spark, sf_dir), "2024-05-31")
    # every CVE of any finding, resolved ones too: the CVEs of all finding rows
    f = tv.finding_rows(spark, sf_dir).select("cve") if only_known else None
    st, _ = feeds.upsert_epss(schemas.empty(spark, "epss_score"), rows, _feed_clock(spark, sf_dir), f)
    return st


def q_epss_known_only(spark, sf_dir):
    return render(epss_state(spark, sf_dir, True))


def exposure_state(spark, sf_dir):
    return feeds.upsert_exposure(schemas.empty(spark, "image_exposure"),
                                 tv.exposure_map(spark, sf_dir), _feed_clock(spark, sf_dir))


def q_exposure_upsert(spark, sf_dir):
    """Map of two thirds of the images, then one of another two thirds with
    every tailnet image moved to internal: kept, updated and new images. Each
    image is listed twice in the second, the last entry counts."""
    m = tv.exposure_map(spark, sf_dir).withColumn("n", F.substring("image", 5, 20).cast("long"))
    s1 = feeds.upsert_exposure(schemas.empty(spark, "image_exposure"), m.filter("n % 3 < 2"), "2024-05-01 00:00:00")
    m2 = m.filter("n % 3 > 0").withColumn(
        "exposure", F.when(F.col("exposure") == "tailnet", "internal").otherwise(F.col("exposure")))
    twice = m2.select("image", F.lit("unknown").alias("exposure"), F.lit("first entry").alias("note"), F.lit(1).alias("ord")) \
        .unionByName(m2.select("image", "exposure", F.lit(None).cast("string").alias("note"), F.lit(2).alias("ord")))
    return render(feeds.upsert_exposure(s1, twice, "2024-06-01 00:00:00"))


def q_epss_update(spark, sf_dir):
    """A second model run updates every value of the CVEs that it scores."""
    rows = tv.epss_feed(spark, sf_dir)
    s1, _ = feeds.upsert_epss(schemas.empty(spark, "epss_score"), feeds.epss_rows(rows, "2024-05-01"), "2024-05-02 00:00:00")
    second = rows.filter("ord % 3 = 0").withColumn("epss", F.lit("0.500000"))
    s2, _ = feeds.upsert_epss(s1, feeds.epss_rows(second, "2024-06-01"), "2024-06-02 00:00:00")
    return render(s2)


# ----------------------------------------------------------------- ranking

def priority(spark, sf_dir):
    return ranking.vuln_priority(findings_state(spark, sf_dir), exposure_state(spark, sf_dir),
                                 kev_state(spark, sf_dir), epss_state(spark, sf_dir))


def q_vuln_priority(spark, sf_dir):
    return render(priority(spark, sf_dir))


def q_headline_counts(spark, sf_dir):
    return render(ranking.headline(priority(spark, sf_dir)))


def q_backlog_topn(spark, sf_dir):
    return render(ranking.backlog_top(priority(spark, sf_dir), 25))


def q_worst_images(spark, sf_dir):
    return render(ranking.worst_images(priority(spark, sf_dir), 5))


def q_unmapped_images(spark, sf_dir):
    return render(ranking.unmapped_images(findings_state(spark, sf_dir), exposure_state(spark, sf_dir)))


def q_backlog_ageing(spark, sf_dir):
    rows = tv.finding_rows(spark, sf_dir)
    as_of = rows.agg(F.max("started_at")).first()[0]
    return render(ranking.backlog_ageing(priority(spark, sf_dir), as_of))


def _registry():
    out = {}
    for name, fn in list(globals().items()):
        if name.startswith("q_") and callable(fn):
            out[name[2:]] = fn
    return out
REGISTRY = _registry()


# --------------------------------------------------------------------- DNS

from ..operators import dns as dnsops  # noqa: E402
from ..operators import rollups, sketches  # noqa: E402
from . import detections  # noqa: E402
from .oracle import NX_FLOOR, SPIKE_FLOOR, STREAM_SLICES, TUNNEL_MIN_NAMES  # noqa: E402

DQ_OUT = ["ord", "ts", "client", "client_name", "qname", "qtype", "reason", "blocked", "status",
          "upstream", "cached", "elapsed_ms", "registrable_domain", "label_entropy"]


def _dq(spark, sf_dir):
    return tv.dns_query(spark, sf_dir)


def _dq_shared(spark, sf_dir):
    """dns_query written once, in the stored layout (Parquet partitioned by
    day, in the shared checkpoint folder), for checks that run many rules
    over it: the rules' time windows then prune day partitions and push
    ``ts`` filters into the scan, as on the real store."""
    from ..session import scratch_path
    path = scratch_path(spark, "dns_query")
    dnsops.with_day(_dq(spark, sf_dir)).write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def q_qname_normalise(spark, sf_dir):
    from ..functions.normalize import normalise_qname_or_null
    e = tv.dns_entries(spark, sf_dir)
    return e.select("ord", F.col("question.name").alias("raw_name"),
                    normalise_qname_or_null(F.col("question.name")).alias("qname"))


def q_registrable_domain(spark, sf_dir):
    return _dq(spark, sf_dir).select("qname", "registrable_domain").distinct()


def q_label_entropy(spark, sf_dir):
    return render(_dq(spark, sf_dir).select("qname", "label_entropy").distinct())


def q_dns_map_entry(spark, sf_dir):
    return render(_dq(spark, sf_dir).select(*DQ_OUT))


def q_dns_rejects(spark, sf_dir):
    return tv.dns_mapped(spark, sf_dir).filter(~F.col("valid")).select("ord", "reject_reason")


def registry(spark, sf_dir):
    q = _dq(spark, sf_dir)
    return dnsops.merge_registry(schemas.empty(spark, "dns_domain"), q).drop("_action")


def q_rule_newly_seen(spark, sf_dir):
    q = _dq_shared(spark, sf_dir)
    reg = dnsops.merge_registry(schemas.empty(spark, "dns_domain"), q).drop("_action")
    return detections.newly_seen(reg, q, tv.dns_as_of(spark, sf_dir))


def q_rule_dga_entropy(spark, sf_dir):
    return detections.dga_entropy(_dq(spark, sf_dir))


def q_rule_blocked_spike(spark, sf_dir):
    return detections.blocked_spike(_dq(spark, sf_dir), tv.dns_as_of(spark, sf_dir), floor=SPIKE_FLOOR)


def q_rule_nxdomain_burst(spark, sf_dir):
    return detections.nxdomain_burst(_dq(spark, sf_dir), tv.dns_as_of(spark, sf_dir), floor=NX_FLOOR)


def _stored_parts(spark, q, build, label):
    """``build`` over two halves of the rows, as two batches would store it."""
    from ..session import scratch_path
    path = scratch_path(spark, label)
    for half in (0, 1):
        build(q.filter(F.col("ord") % 2 == half)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def q_rule_blocked_spike_rollup(spark, sf_dir):
    """R-3 from hourly counters and the rows of two hours."""
    q = _dq_shared(spark, sf_dir)
    counters = rollups.fold(_stored_parts(spark, q, rollups.hourly, "dns_hourly"))
    return detections.blocked_spike(q, tv.dns_as_of(spark, sf_dir), floor=SPIKE_FLOOR, rollup=counters)


def q_rule_nxdomain_burst_rollup(spark, sf_dir):
    """R-5 from hourly counters and the rows of two hours."""
    q = _dq_shared(spark, sf_dir)
    counters = rollups.fold(_stored_parts(spark, q, rollups.hourly, "dns_hourly"))
    return detections.nxdomain_burst(q, tv.dns_as_of(spark, sf_dir), floor=NX_FLOOR, rollup=counters)


def q_tunnel_sketches(spark, sf_dir):
    """A-5 / R-6: the last day's distinct names and clients per domain, exact and from stored
    hourly sketches; whether each estimate is within the stated bound."""
    q, as_of = _dq_shared(spark, sf_dir), tv.dns_as_of(spark, sf_dir)
    stored = _stored_parts(spark, q, sketches.hourly, "dns_sketch")
    near = sketches.trailing(stored, q, as_of).select("registrable_domain", "n", "entropy_sum", *[
        F.col(c).alias(f"{c}_estimate") for c in ("names", "clients")])
    t = F.timestamp_micros(F.lit(as_of)) - F.expr("INTERVAL 24 HOURS")
    exact = q.filter((F.col("ts") >= t) & (F.col("day") >= F.to_date(t))).groupBy("registrable_domain").agg(
        F.count_distinct("qname").alias("names"), F.count_distinct("client").alias("clients"))
    error = {c: F.abs(F.col(f"{c}_estimate") - F.col(c)) / F.col(c) for c in ("names", "clients")}
    return render(exact.join(near, "registrable_domain").select(
        "registrable_domain", "names", "clients", "n", "entropy_sum",
        *[(e <= sketches.BOUND).alias(f"{c}_within_bound") for c, e in error.items()]))


def q_rule_known_bad(spark, sf_dir):
    return detections.known_bad(_dq(spark, sf_dir), tv.known_bad(spark, sf_dir))


def q_rule_tunnel_volume(spark, sf_dir):
    return detections.tunnel_volume(_dq(spark, sf_dir), tv.dns_as_of(spark, sf_dir),
                                    min_names=TUNNEL_MIN_NAMES)


REGISTRY = _registry()


# ---------------------------------------------------------------- DNS state

def _dns_split(spark, sf_dir, store_before_days: int, batch_from_days: int):
    """Stored rows older than as_of - a days; batch from as_of - b days (b > a
    gives an overlap of b - a days), plus a re-pulled copy of the last day."""
    as_of = tv.dns_as_of(spark, sf_dir)
    t = F.timestamp_micros(F.lit(as_of))
    q = _dq_shared(spark, sf_dir)           # the stored layout: day partitions
    store = q.filter(F.col("ts") < t - F.expr(f"INTERVAL {store_before_days} DAYS"))
    batch = q.filter(F.col("ts") >= t - F.expr(f"INTERVAL {batch_from_days} DAYS"))
    again = q.filter(F.col("ts") >= t - F.expr("INTERVAL 1 DAYS")).withColumn(
        "ord", F.col("ord") + F.lit(10_000_000_000))
    return store, batch.unionByName(again).drop("day"), as_of


def q_dns_dedupe_append(spark, sf_dir):
    store, batch, _ = _dns_split(spark, sf_dir, 10, 12)
    fresh = dnsops.append_new(store, batch)
    return render(fresh.select(*DQ_OUT))


def q_domain_registry_merge(spark, sf_dir):
    store, batch, _ = _dns_split(spark, sf_dir, 3, 5)
    reg0 = dnsops.merge_registry(schemas.empty(spark, "dns_domain"), store).drop("_action")
    fresh = dnsops.append_new(store, batch)
    return render(dnsops.merge_registry(reg0, fresh.drop("ord")))


def q_retention_prune(spark, sf_dir):
    """All rows stored, then pruned for good: what the store still holds."""
    from ..session import scratch_path
    from ..sources.store import TableStore
    clock = F.timestamp_micros(F.lit(tv.dns_as_of(spark, sf_dir))) - dnsops.days(14)
    store = TableStore(spark, scratch_path(spark, "retention"))
    q = _dq(spark, sf_dir)
    order = F.concat_ws("|", "qtype", F.col("ord").cast("string"))         # the input order travels in the type
    store.append("dns_query", q.withColumn("qtype", order).withColumn("run_key", F.lit("all")))
    store.retain(spark.range(1).select(clock.cast("string")).first()[0])
    kept = store.read("dns_query").withColumn("ord", F.split_part("qtype", F.lit("|"), F.lit(2)).cast("long")) \
        .withColumn("qtype", F.split_part("qtype", F.lit("|"), F.lit(1)))
    return render(kept.select(*DQ_OUT))


def q_incremental_cursor(spark, sf_dir):
    as_of = tv.dns_as_of(spark, sf_dir)
    t = F.timestamp_micros(F.lit(as_of))
    mapped = tv.dns_mapped(spark, sf_dir)
    store = mapped.filter("valid").filter(F.col("ts") < t - F.expr("INTERVAL 5 DAYS"))
    return render(dnsops.past_cursor(mapped, store).select("ord", "ts", "valid"))


def q_timeline_rebase(spark, sf_dir):
    mapped = tv.dns_mapped(spark, sf_dir)
    return render(dnsops.rebase(mapped, "2026-08-15 12:00:00").select("ord", "ts"))


def q_blocklist_replace(spark, sf_dir):
    """Snapshot of three lists, then list_b re-fetched: only https pages now."""
    kb = tv.known_bad(spark, sf_dir)
    st = kb.withColumn("fetched_at", F.lit("2024-05-01 00:00:00").cast("timestamp"))
    pg = tv.table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    site = F.concat_ws(".", F.concat(F.lit("site"), (pid % 40).cast("string")), tv._suffix(pid))
    lines = pg.filter(F.col("url").contains("#") & F.col("url").startswith("https")).select(
        F.concat(F.lit("0.0.0.0\t"), F.upper(site), F.lit(".")).alias("value"))
    header = spark.createDataFrame([("# blocklist",), ("",), ("one-field-only",)], "value string")
    doms = feeds.hostfile_domains(lines.unionByName(header))
    return render(feeds.replace_source(st, doms, "list_b", "2024-06-01 00:00:00"))


# ------------------------------------------------------------ rule state

def _hit_batch(spark, sf_dir):
    """Hits of all six detections over the test estate, in rule order."""
    q = _dq_shared(spark, sf_dir)
    as_of = tv.dns_as_of(spark, sf_dir)
    parts = [
        ("dns_blocked_spike", detections.blocked_spike(q, as_of, floor=SPIKE_FLOOR)),
        ("dns_dga_entropy", detections.dga_entropy(q)),
        ("dns_known_bad_domain", detections.known_bad(q, tv.known_bad(spark, sf_dir))),
        ("dns_newly_seen_domain", detections.newly_seen(
            dnsops.merge_registry(schemas.empty(spark, "dns_domain"), q).drop("_action"), q, as_of)),
        ("dns_nxdomain_burst", detections.nxdomain_burst(q, as_of, floor=NX_FLOOR)),
        ("dns_tunnel_volume", detections.tunnel_volume(q, as_of, min_names=TUNNEL_MIN_NAMES)),
    ]
    out = None
    for i, (rid, df) in enumerate(parts):
        d = df.select(F.lit(rid).alias("rule_id"), "entity", "summary", F.lit(i).alias("ord"))
        out = d if out is None else out.unionByName(d)
    return out, as_of


def q_rule_hit_upsert(spark, sf_dir):
    """Two runs: day-before clock, then the real clock; hits persist."""
    from ..operators import hits as hitops
    batch, as_of = _hit_batch(spark, sf_dir)
    first = batch.filter(F.col("rule_id").isin("dns_dga_entropy", "dns_known_bad_domain"))
    s1 = hitops.upsert_hits(schemas.empty(spark, "rule_hit"), first, "2024-01-30 00:00:00")
    s1 = s1.drop("_action", "reported")
    s2 = hitops.upsert_hits(s1, batch, F.timestamp_micros(F.lit(as_of)))
    return render(s2.drop("reported"))


def q_triage_apply(spark, sf_dir):
    """People accept every known-bad hit on a list_a name and mark the rest
    of that rule false positive later; other hits stay open."""
    from ..operators import hits as hitops
    batch, as_of = _hit_batch(spark, sf_dir)
    st = hitops.upsert_hits(schemas.empty(spark, "rule_hit"), batch, "2024-01-30 00:00:00")
    st = st.drop("_action", "reported")
    kb = st.filter(F.col("rule_id") == "dns_known_bad_domain")
    d1 = kb.select("rule_id", "entity", F.lit("false_positive").alias("status"),
                   F.lit("bulk").alias("status_note"),
                   F.lit("2024-01-31 08:00:00").cast("timestamp").alias("decided_at"))
    d2 = kb.filter(F.col("summary").contains("list_a")).select(
        "rule_id", "entity", F.lit("accepted").alias("status"),
        F.concat(F.lit("reviewed "), F.col("entity")).alias("status_note"),
        F.lit("2024-01-31 09:00:00").cast("timestamp").alias("decided_at"))
    ghost = spark.createDataFrame([("dns_dga_entropy", "no-such-entity")], "rule_id string, entity string") \
        .select("*", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("status_note"),
                F.lit("2024-01-31 10:00:00").cast("timestamp").alias("decided_at"))
    out = hitops.apply_decisions(st, d1.unionByName(d2).unionByName(ghost), ["rule_id", "entity"])
    return render(out)


def q_open_hits(spark, sf_dir):
    """Hits of two rules are older than those of the others."""
    from ..operators import hits as hitops
    batch, as_of = _hit_batch(spark, sf_dir)
    first = batch.filter(F.col("rule_id").isin("dns_dga_entropy", "dns_known_bad_domain"))
    s1 = hitops.upsert_hits(schemas.empty(spark, "rule_hit"), first, "2024-01-30 00:00:00").drop("_action", "reported")
    st = hitops.upsert_hits(s1, batch, F.timestamp_micros(F.lit(as_of)))
    return render(ranking.open_hits(st.drop("_action", "reported"), 15))


def q_rule_registry_upsert(spark, sf_dir):
    """A catalogue of the even parts, some of them switched off, refreshed by
    one of other parts with new texts."""
    from ..operators import hits as hitops
    p = tv.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    rule = F.concat(F.lit("rule-"), F.col("p_partkey").cast("string")).alias("id")
    one = p.filter("p_partkey % 2 = 0").select(rule, F.col("p_type").alias("description"), F.col("p_partkey").alias("ord"))
    st = hitops.upsert_rules(schemas.empty(spark, "rule"), one, "2024-05-01 00:00:00")
    off = F.substring("id", 6, 20).cast("long") % 4 == 0
    st = st.withColumn("enabled", F.when(off, F.lit(False)).otherwise(F.col("enabled")))
    two = p.filter("p_partkey % 3 < 2").select(rule, F.col("p_brand").alias("description"), F.col("p_partkey").alias("ord"))
    return render(hitops.upsert_rules(st, two, "2024-06-01 00:00:00"))


def q_rule_totals(spark, sf_dir):
    """A-10: one run's totals."""
    from . import engine
    return engine.run_totals(q_rule_run_results(spark, sf_dir))


REGISTRY = _registry()


# ------------------------------------------------------------- rule engine

# A user rule in Spark SQL (same logic as the built-in entropy rule, with a
# lower floor) and a broken one, to show per-rule isolation.
USER_RULE_SQL = """-- description: long high-entropy names (user SQL rule)
SELECT registrable_domain AS entity,
       concat(CAST(count(*) AS STRING), ' names over 3.4 bits/char') AS summary
FROM dns_query
WHERE label_entropy >= 3.4 AND length(qname) >= 20 AND ts <= :as_of
GROUP BY registrable_domain
"""
BROKEN_RULE_SQL = """-- description: reads a table that does not exist
SELECT entity, summary FROM missing_view
"""


def q_rule_run_results(spark, sf_dir):
    """One engine run over the test estate: six built-in rules (test-scale
    floors), a user SQL rule, a broken rule, and one rule disabled before."""
    from . import engine
    from ..operators import hits as hitops
    p = engine.RuleParams(spike_floor=SPIKE_FLOOR, nx_floor=NX_FLOOR, tunnel_min_names=TUNNEL_MIN_NAMES)
    rules = engine.builtin_rules(p) + [engine.sql_rule(spark, "user_long_entropy", USER_RULE_SQL),
                                       engine.sql_rule(spark, "zz_broken", BROKEN_RULE_SQL)]
    q = _dq_shared(spark, sf_dir)
    tables = {"dns_query": q,
              "dns_domain": dnsops.merge_registry(schemas.empty(spark, "dns_domain"), q).drop("_action"),
              "known_bad_domain": tv.known_bad(spark, sf_dir)}
    as_of = F.timestamp_micros(F.lit(tv.dns_as_of(spark, sf_dir)))
    st = spark.createDataFrame([("dns_tunnel_volume", "old text", True)], "id string, description string, enabled boolean") \
        .withColumn("added_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    st = hitops.set_enabled(st, "dns_tunnel_volume", False)
    out = engine.run_rules(spark, rules, tables, st, schemas.empty(spark, "rule_hit"), as_of)
    return out.results


# ----------------------------------------------------------------- quality

def q_quality_keys(spark, sf_dir):
    """Finding keys repeated within one scan run."""
    from ..operators import quality
    return quality.key_violations(tv.finding_rows(spark, sf_dir), ["run_key"] + normalize.FINDING_KEY)


def q_quality_enums(spark, sf_dir):
    """I-2: exposure entries outside the enum (every seventh nation's are misspelt)."""
    from ..operators import quality
    entries = tv.exposure_map(spark, sf_dir).withColumn("exposure", F.when(
        F.substring("note", 8, 5).cast("int") % 7 == 3, F.concat(F.col("exposure"), F.lit("x"))).otherwise(F.col("exposure")))
    return quality.enum_violations(entries, "exposure", schemas.EXPOSURES, keep=["image"])


def q_quality_nulls(spark, sf_dir):
    """I-3: missing values in the columns that may not be null, over all mapped entries."""
    from ..operators import quality
    return quality.null_counts(tv.dns_mapped(spark, sf_dir), ["ts", "client", "qname", "qtype", "blocked"])


def q_quality_refs(spark, sf_dir):
    """I-4: findings whose first run has no envelope (the runs of even years)."""
    from ..operators import quality
    rows = tv.finding_rows(spark, sf_dir)
    runs = tv.run_images(rows).filter(F.substring("run_key", 1, 4).cast("int") % 2 == 1)
    return quality.ref_violations(findings_state(spark, sf_dir), runs, ["first_run"], ["run_key"])


REGISTRY = _registry()


# --------------------------------------------------------------- streaming

def _slices(spark, sf_dir, files: int = STREAM_SLICES, repull: bool = True):
    """Entries in time order, cut into slices; optionally a last slice that
    re-pulls the final day (exact duplicates of stored entries)."""
    e = tv.dns_entries(spark, sf_dir)
    mx = F.lit(e.agg(F.max("ord") + 1).first()[0])          # once, not again for each slice
    cols = [c for c in e.columns if c != "ord"]
    for i in range(files):
        yield e.filter(F.floor(F.col("ord") * files / mx) == i).select(*cols)
    if repull:
        final = F.timestamp_micros(F.lit(tv.dns_as_of(spark, sf_dir))) - F.expr("INTERVAL 1 DAYS")
        # an entry's time, where it is one, is its event's: the others are not derived
        yield tv.dns_entries(spark, sf_dir, since=final).select(*cols).filter(normalize.parse_iso_ts(F.col("time")) >= final)


def _land_and_run(spark, name: str, slices, start) -> None:
    """Lands each slice (as many files as it has tasks) and runs the stream over it: a
    slice is one micro-batch. ``start(source)`` starts the query on its checkpoint."""
    from ..session import scratch_path
    from ..streaming import dns_stream
    path = scratch_path(spark, f"landing-{name}")
    for piece in slices:
        piece.write.mode("append").json(path)
        _run_stream(start(dns_stream.entry_stream(spark, path)))


def _run_stream(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _stream_store(spark, sf_dir, with_rules: bool = False):
    """Streams all slices into a store. The first attempt at the first batch
    dies after its tables are written; the stream is started again and does
    the batch once more, as if new."""
    from ..session import scratch_path
    from ..sources.store import TableStore
    from ..streaming import dns_stream
    from . import engine
    store = TableStore(spark, scratch_path(spark, "store"))
    store.write("known_bad_domain", tv.known_bad(spark, sf_dir).withColumn(
        "fetched_at", F.lit("2024-05-01 00:00:00").cast("timestamp")))
    as_of = F.timestamp_micros(F.lit(tv.dns_as_of(spark, sf_dir)))
    p = engine.RuleParams(spike_floor=SPIKE_FLOOR, nx_floor=NX_FLOOR, tunnel_min_names=TUNNEL_MIN_NAMES)
    rules = dns_stream.rules_runner(engine.builtin_rules(p)) if with_rules else None
    checkpoint, died = scratch_path(spark, "ckpt-ingest"), []

    def runner(current, clock):
        if not died:
            died.append(True)
            raise RuntimeError("the job dies here once")
        if rules is not None:
            rules(current, clock)

    def start(source):
        go = lambda: dns_stream.start_ingest(source, store, tv.suffix_rules(spark), checkpoint,
                                             as_of=as_of, rule_runner=runner)
        if not died:
            try:
                _run_stream(go())
            except Exception:  # noqa: BLE001  (it died, as it should)
                if not died:
                    raise
        return go()

    _land_and_run(spark, "ingest", _slices(spark, sf_dir), start)
    return store


def q_stream_ingest_registry(spark, sf_dir):
    """ST-1/ST-4: streamed micro-batches (one of them redone, and a re-pulled
    overlap) build the same registry as one batch over all rows."""
    return render(_stream_store(spark, sf_dir).read("dns_domain"))


def q_stream_paged_pull(spark, sf_dir):
    """S-4 / ST-1: the log landed as pages of up to 500 entries and pulled past the stored
    offset: a bounded number of pages a pull, a page that repeats an earlier one, and pulls
    that find nothing new. The registry is that of one batch over all rows."""
    from ..session import scratch_path
    from ..sources.store import TableStore
    from ..streaming import dns_stream
    e = tv.dns_entries(spark, sf_dir)
    cols = [c for c in e.columns if c != "ord"]
    number = F.floor(F.col("ord") / 500)
    pages = e.groupBy(F.format_string("%09d", number).alias("page")).agg(
        F.collect_list(F.struct(*cols)).alias("data"))
    again = pages.orderBy("page").limit(1).withColumn("page", F.lit("999999999"))      # lands once more
    folder, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "ckpt-pull")
    docs = pages.unionByName(again).select("page", F.to_json(F.struct("data", F.lit("").alias("oldest"))).alias("value"))
    docs.write.partitionBy("page").text(folder)
    store, pulls = TableStore(spark, scratch_path(spark, "store")), []
    as_of, total = F.timestamp_micros(F.lit(tv.dns_as_of(spark, sf_dir))), pages.count() + 1
    for _ in range(4):                              # a third of the pages each, then nothing
        _run_stream(dns_stream.start_pull(spark, folder, store, tv.suffix_rules(spark), checkpoint, as_of,
                                          max_pages=-(-total // 3), pulls=pulls))
    if sum(n for n, _ in pulls) != total or pulls[-1][1]:
        raise RuntimeError(f"{total} pages landed, pulled: {pulls}")
    return render(store.read("dns_domain"))


def _append_stream(spark, sf_dir, name, build, repull=True):
    """All slices through ``build(mapped)`` into a Parquet sink."""
    from ..session import scratch_path
    from ..streaming import dns_stream
    out, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"ckpt-{name}")

    def start(source):
        df = build(dns_stream.mapped_stream(source, tv.suffix_rules(spark)))
        return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(out))

    _land_and_run(spark, name, _slices(spark, sf_dir, repull=repull), start)
    return spark.read.parquet(out)


def q_stream_dedupe(spark, sf_dir):
    """ST-2: natural-key dedupe within a one-day watermark."""
    from ..streaming import dns_stream
    return render(_append_stream(spark, sf_dir, "dedupe", lambda m: dns_stream.dedupe(m, "1 day").select(
        "ts", "client", "qname", "qtype", "registrable_domain")))


def q_stream_sliding_blocked(spark, sf_dir):
    """ST-5: blocked queries per client in 24h windows sliding by 1h;
    append mode emits windows closed by the watermark."""
    from ..streaming import panes
    return render(_append_stream(spark, sf_dir, "sliding", panes.sliding_counts, repull=False))


def q_stream_sliding_domains(spark, sf_dir):
    """ST-5 / R-6: per registrable domain in the same windows, distinct names and clients (out of
    sketches, which are exact at these counts but for rounding), rows and the entropy sum."""
    from ..streaming import panes
    return render(_append_stream(spark, sf_dir, "sliding-domains", panes.sliding_names, repull=False))


def q_stream_rule_hits(spark, sf_dir):
    """ST-7: the rule engine after every micro-batch; hits accumulate."""
    return render(_stream_store(spark, sf_dir, with_rules=True).read("rule_hit"))


def q_stream_late_rows(spark, sf_dir):
    """ST-3: the later half of the log arrives first. The rows of the earlier
    half are behind the watermark when they come: their windows are closed."""
    from ..session import scratch_path
    from ..streaming import dns_stream
    from ..streaming import panes
    early, late = _slices(spark, sf_dir, files=2, repull=False)
    out, checkpoint = scratch_path(spark, "late-out"), scratch_path(spark, "ckpt-late")

    def start(source):
        df = panes.sliding_counts(dns_stream.mapped_stream(source, tv.suffix_rules(spark)))
        return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(out))

    _land_and_run(spark, "late", [late, early], start)
    return render(spark.read.parquet(out))


# ------------------------------------------------------------------- files

def q_page_files(spark, sf_dir):
    """S-3: the log written as page files of up to 500 entries and read back."""
    from ..session import scratch_path
    from ..sources import dnslog
    e = tv.dns_entries(spark, sf_dir)
    cols = [c for c in e.columns if c != "ord"]
    pages = e.groupBy(F.floor(F.col("ord") / 500).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("ord", F.struct(*cols).alias("e")))).alias("es"))
    path = scratch_path(spark, "pages")
    (pages.select("page", F.to_json(F.struct(F.col("es.e").alias("data"), F.lit("").alias("oldest"))).alias("value"))
     .write.partitionBy("page").text(path))
    back = dnslog.read_pages(spark, f"{path}/*/*")
    mapped = normalize.map_dns_entries(back, tv.suffix_rules(spark)).filter("valid")
    return render(mapped.select(*[c for c in DQ_OUT if c != "ord"]))


def q_kev_file(spark, sf_dir):
    """S-5: the exploited list written as JSON documents of up to 500 entries and read back."""
    from ..session import scratch_path
    from ..sources import feeds as feed_files
    path = scratch_path(spark, "kev")
    feed = tv.kev_feed(spark, sf_dir)
    entry = F.struct("ord", *[c for c in feed.columns if c != "ord"])
    docs = feed.groupBy(F.floor(F.col("ord") / 500).alias("doc")).agg(F.sort_array(F.collect_list(entry)).alias("vulnerabilities"))
    docs.select("doc", F.to_json(F.struct("vulnerabilities")).alias("value")).write.partitionBy("doc").text(path)
    return render(feed_files.read_kev(spark, f"{path}/*/*").drop("ord"))


def q_run_folders(spark, sf_dir):
    """S-2: every run written as a folder of report files, one document an image, and read back
    in one scan; run key and time come from the folders' names. All runs are put together in one
    pass, as their lines are written: documents are wide, and none is held."""
    from ..session import scratch_path
    from ..sources import reports
    root = scratch_path(spark, "runs")
    written = reports.write_runs(tv.report_lines(spark, sf_dir), root)
    rows, _, runs = reports.read_runs(spark, root)
    if sum(r.images for r in runs.collect()) != written:
        raise ValueError("an image of a run has more than one document")
    return render(rows.drop("ord", "file", "result_pos", "vuln_pos", "started_at"))


def q_epss_file(spark, sf_dir):
    """S-6: scores written as CSV with the columns in another order and read by their names."""
    from ..session import scratch_path
    from ..sources import feeds as feed_files
    path = scratch_path(spark, "epss")
    tv.epss_feed(spark, sf_dir).select("percentile", "cve", F.lit("x").alias("other"), "epss") \
        .write.option("header", True).csv(path)
    return render(feed_files.read_epss(spark, path).select("cve", "score", "percentile"))


REGISTRY = _registry()
