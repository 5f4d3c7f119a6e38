"""Deterministic telemetry projections of the driver's TPC-H-like tables.

Every check query reads the given parquet tables and derives its telemetry
from them, so its work grows with the data:

* ``dns_entries``  events x pages -> query-log entries (nested, as read from
  the JSON log), including malformed ones
* ``finding_rows`` lineitem -> vulnerability findings, one scan run per ship year
* ``report_docs``  lineitem -> nested scan report documents
* ``kev_feed`` / ``epss_feed`` part -> exploited / probability feeds
* ``exposure_map`` supplier -> image exposure
* ``known_bad``   pages -> blocklist entries of two sources

The same derivations are written in SQL for the DuckDB oracle
(``nightjar.plans.oracle``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dnsname, normalize
from ..timeutil import max_ts_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A file that yields fewer scan splits than the
    session's parallelism (one row group per file here) is spread
    round-robin once, so per-row work runs on every core; on large inputs
    the scan already has enough splits and this is a no-op."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in FACT_TABLES else df


# The tables whose rows drive per-row work (the others are dimensions).
FACT_TABLES = {"lineitem", "events", "orders"}


def spread(df: DataFrame) -> DataFrame:
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


# ------------------------------------------------------------------------ DNS

def _host(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)


#: Public suffix rules of the test estate: plain, two-label, wildcard,
#: exception and Unicode ones.
TEST_SUFFIXES = ["com", "net", "org", "edu", "gov", "io", "top", "de", "fr", "uk", "co.uk", "org.uk", "ac.uk",
                 "com.br", "*.ck", "!www.ck", "\u0440\u0444"]


def suffix_rules(spark: SparkSession) -> dnsname.SuffixRules:
    return dnsname.suffix_rules(spark, TEST_SUFFIXES)


def _suffix(i):
    """com, co.uk, net, org, com.br, a wildcard suffix, the exception, an IDN."""
    kinds = ["com", "co.uk", "net", "org", "com.br", "net.ck", "www.ck", "xn--p1ai"]
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), (i % 8 + 1).cast("int"))


def synthetic_qname(event_id, first_label):
    """DGA-shaped .top names, tunnel-shaped names under three cdn domains,
    and ordinary names under forty site domains."""
    h = F.md5(event_id.cast("string"))
    return (F.when(event_id % 20 == 0, F.concat(F.substring(h, 1, 12), F.lit(".top")))
            .when(event_id % 20 == 10,
                  F.concat_ws(".", F.substring(h, 1, 16), first_label,
                              F.concat(F.lit("cdn"), (event_id % 3).cast("string")), F.lit("co.uk")))
            .otherwise(F.concat_ws(".", first_label,
                                   F.concat(F.lit("site"), (event_id % 40).cast("string")),
                                   _suffix(event_id))))


def dns_entries(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """Query-log entries in the nested log shape, one per event (of ``since`` or later).

    The event's page is ``page_id = event_id % count(pages)``; the page count
    is a scalar subquery, the page side is joined on its key.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pg.agg(F.count(F.lit(1))).scalar()          # scalar subquery
    if since is not None:
        ev = ev.filter(F.col("ts").cast("timestamp") >= since)
    ev = ev.withColumn("page_id", F.col("event_id") % n_pages)
    j = ev.join(pg, "page_id")
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    first_label = F.split_part(_host(F.col("url")), F.lit("."), F.lit(1))
    name = synthetic_qname(eid, first_label)
    name = (F.when(eid % 89 == 0, F.lit("."))
            .when(eid % 7 == 3, F.concat(F.upper(name), F.lit(".")))
            .when(eid % 11 == 5, F.concat(F.lit("  "), name))
            .otherwise(name))
    iso = (F.when(eid % 97 == 0, F.lit("not-a-time"))
           .when(eid % 97 == 1, F.date_format(ts, "HH:mm:ss"))
           .when(eid % 97 == 2, F.date_format(ts, "yyyy"))
           .when(eid % 10 == 4, F.date_format(ts, "yyyyMMdd'T'HHmmss.SSSSSS'Z'"))
           .when(eid % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
           .otherwise(F.concat(F.date_format(ts - F.expr("INTERVAL 4 HOURS"),
                                             "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-04:00"))))
    et = F.col("event_type")
    uid = F.col("user_id")
    reason = (F.when(et == "error", "FilteredBlackList").when(et == "view", "Rewritten")
              .otherwise("NotFilteredNotFound"))
    return j.select(
        eid.alias("ord"),
        iso.alias("time"),
        F.concat(F.lit("c"), uid.cast("string")).alias("client"),
        F.struct(F.when(uid % 3 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("dev-"), uid.cast("string"))).alias("name")).alias("client_info"),
        F.struct(name.alias("name"),
                 F.when(eid % 5 == 0, "AAAA").otherwise("A").alias("type")).alias("question"),
        reason.alias("reason"),
        F.when(et.isin("error", "signup"), "NXDOMAIN").otherwise("NOERROR").alias("status"),
        F.when(et == "error", F.lit(None).cast("string")).otherwise("9.9.9.9:53").alias("upstream"),
        (et == "click").alias("cached"),
        F.col("value").cast("string").alias("elapsedMs"),
    )


def dns_mapped(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    rules = rules if rules is not None else suffix_rules(spark)
    return normalize.map_dns_entries(dns_entries(spark, sf_dir), rules, keep=["ord"])


def dns_query(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    """Valid mapped rows: the dns_query table of the test estate."""
    return dns_mapped(spark, sf_dir, rules).filter("valid").drop("valid", "reject_reason")


def dns_as_of(spark: SparkSession, sf_dir: str) -> int:
    """The test clock: newest event time, epoch microseconds."""
    return max_ts_micros(table(spark, sf_dir, "events"), "ts")


def known_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocklist rows (domain, source): hyphenated page hosts as full names
    (list_a), and parent site domains of pages with fragments / queries
    (list_b, list_c; some domains are on both)."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    host = _host(F.col("url"))
    first_label = F.split_part(host, F.lit("."), F.lit(1))
    site = F.concat_ws(".", F.concat(F.lit("site"), (pid % 40).cast("string")), _suffix(pid))
    a = pg.filter(host.contains("-")).select(
        F.concat_ws(".", first_label, site).alias("domain"), F.lit("list_a").alias("source"))
    b = pg.filter(F.col("url").contains("#")).select(site.alias("domain"), F.lit("list_b").alias("source"))
    c = pg.filter(F.col("url").contains("?")).select(site.alias("domain"), F.lit("list_c").alias("source"))
    return a.unionByName(b).unionByName(c).distinct()


# ------------------------------------------------------------------- findings

def _run_key(shipdate):
    return F.concat(F.year(shipdate).cast("string"), F.lit("0101-000000"))


def finding_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (un-normalised) report fields per lineitem, one run per ship year."""
    return _raw_fields(_lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")


def _raw_fields(li: DataFrame) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    version = F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))
    disc = F.round(F.col("l_discount") * 100).cast("int")
    fixed = (F.when(F.col("l_discount") == 0, F.lit(None).cast("string"))
             .when(disc == 1, F.lit("  "))
             .otherwise(F.concat((F.col("l_linenumber") + 1).cast("string"), F.lit("."),
                                 disc.cast("string"))))
    sev = (F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
           .when(F.col("l_returnflag") == "R", "CRITICAL")
           .when(F.col("l_returnflag") == "A", "HIGH")
           .when(F.col("l_linestatus") == "O", "MEDIUM").otherwise("LOW"))
    return li.select(
        _run_key(F.col("l_shipdate")).alias("run_key"),
        F.concat(*[F.lpad(F.col(c).cast("string"), w, "0") for c, w in
                   [("l_orderkey", 20), ("l_linenumber", 4), ("l_partkey", 20), ("l_suppkey", 20)]])
        .alias("ord"),
        F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.concat(F.lit("img-"), F.col("l_suppkey").cast("string")).alias("ArtifactName"),
        F.concat(F.lit("target-"), F.col("l_linestatus")).alias("Target"),
        F.when(F.col("l_linestatus") == "O", "lang-pkgs").otherwise("os-pkgs").alias("Class"),
        F.concat(F.lit("CVE-2024-"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 4, "0"))
        .alias("VulnerabilityID"),
        F.concat(F.lit("pkg-"), part).alias("PkgName"),
        version.alias("InstalledVersion"),
        fixed.alias("FixedVersion"),
        sev.alias("Severity"),
        F.concat(F.lit("pkg-"), part, F.lit(" issue in order "),
                 F.col("l_orderkey").cast("string")).alias("Title"),
        F.concat(F.lit("pkg:generic/pkg-"), part, F.lit("@"), version).alias("PURL"),
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("file"),
    )


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised finding rows with run_key, started_at and input order."""
    raw = finding_raw(spark, sf_dir)
    out = normalize.normalise_findings(raw, keep=["run_key", "ord"])
    return out.withColumn("started_at", F.to_timestamp("run_key", "yyyyMMdd-HHmmss"))


def report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested report documents: one per (run, image, order), results by line
    status, vulnerabilities by line number. Groups hold at most 7 lines.

    The table's own narrow rows are shuffled, once, by order and supplier (the
    image); fields are derived and documents put together where they arrive."""
    raw = _raw_fields(_lines(spark, sf_dir).repartition("l_orderkey", "l_suppkey"))
    vuln = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("VulnerabilityID"), F.col("PkgName"), F.col("InstalledVersion"),
        F.col("FixedVersion"), F.col("Severity"), F.col("Title"),
        F.struct(F.col("PURL").alias("PURL")).alias("PkgIdentifier"))
    lines = raw.groupBy("run_key", "ArtifactName", "l_orderkey", "l_suppkey").agg(
        F.array_sort(F.collect_list(F.struct("Target", "Class", vuln.alias("v")))).alias("lines"))
    kinds = F.array_distinct(F.transform("lines", lambda x: F.struct(x["Target"].alias("Target"), x["Class"].alias("Class"))))

    def of(k):
        mine = F.filter("lines", lambda x: x["Target"].eqNullSafe(k["Target"]) & x["Class"].eqNullSafe(k["Class"]))
        return F.struct(k["Target"].alias("Target"), k["Class"].alias("Class"),
                        F.transform(mine, lambda x: x["v"].dropFields("line", "part")).alias("Vulnerabilities"))

    return lines.select(
        "run_key",
        F.concat(F.col("ArtifactName"), F.lit("__o"),
                 F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(".json")).alias("file"),
        "ArtifactName", F.transform(kinds, of).alias("Results"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the documents that hold all orders of an image in a run, each
    document's one after the other: results by order and line status, vulnerabilities
    by line number. ``part`` is the order.

    The table's own narrow rows are shuffled by supplier (the image) and sorted; fields
    are derived where they arrive."""
    dealt = _lines(spark, sf_dir).repartition("l_suppkey").withColumn("year", F.year("l_shipdate")).sortWithinPartitions(
        "l_suppkey", "year", "l_orderkey", "l_linestatus", "l_linenumber", "l_partkey")
    return _raw_fields(dealt).withColumn("part", F.col("l_orderkey")) \
        .withColumn("PkgIdentifier", F.struct(F.col("PURL").alias("PURL")))


def run_images(finding_rows_df: DataFrame) -> DataFrame:
    """Images scanned per run (from the documents of each run)."""
    return finding_rows_df.select("run_key", "started_at", "image").distinct()


# ---------------------------------------------------------------------- feeds

def _cve(partkey):
    return F.concat(F.lit("CVE-2024-"), F.lpad((partkey % 1000).cast("string"), 4, "0"))


def kev_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploited-vulnerability feed rows (raw strings, feed order = ord)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    return p.filter(size <= 5).select(
        F.col("p_partkey").alias("ord"),
        _cve(F.col("p_partkey")).alias("cveID"),
        F.col("p_brand").alias("vendorProject"),
        F.col("p_type").alias("product"),
        F.concat(F.lit("2024-01-"), F.lpad(size.cast("string"), 2, "0")).alias("dateAdded"),
        F.when(size == 1, F.lit("")).otherwise(
            F.concat(F.lit("2024-02-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")))
        .alias("dueDate"),
        F.when(F.col("p_partkey") % 3 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
    )


def epss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploit-probability feed rows (already parsed CSV: cve, epss, percentile)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    score = (F.col("p_partkey") % 200).cast("decimal(12,6)") / 1000
    return p.select(
        F.col("p_partkey").alias("ord"),
        _cve(F.col("p_partkey")).alias("cve"),
        score.cast("decimal(8,6)").cast("string").alias("epss"),
        (F.lit(1) - score).cast("decimal(8,6)").cast("string").alias("percentile"),
    )


def exposure_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written exposure entries: suppliers with a non-negative balance."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    k = F.col("s_nationkey") % 4
    return s.filter(F.col("s_acctbal") >= 0).select(
        F.concat(F.lit("img-"), F.col("s_suppkey").cast("string")).alias("image"),
        F.when(k == 0, "tailnet").when(k == 1, "internal").when(k == 2, "build-only")
        .otherwise("unknown").alias("exposure"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("note"),
    )
