"""Explicit schemas for inputs and state tables (never inferred)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I, B, TS, D = (T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(),
                     T.TimestampType(), T.DateType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ----------------------------------------------------------------- inputs

VULN = _st(("VulnerabilityID", S), ("PkgName", S), ("InstalledVersion", S),
           ("FixedVersion", S), ("Severity", S), ("Title", S),
           ("PkgIdentifier", _st(("PURL", S))))
REPORT = _st(("ArtifactName", S),
             ("Results", T.ArrayType(_st(("Target", S), ("Class", S),
                                         ("Vulnerabilities", T.ArrayType(VULN))))))
DNS_ENTRY = _st(("time", S), ("client", S), ("client_info", _st(("name", S))),
                ("question", _st(("name", S), ("type", S))), ("reason", S),
                ("status", S), ("upstream", S), ("cached", B), ("elapsedMs", S))
DNS_PAGE = _st(("data", T.ArrayType(DNS_ENTRY)), ("oldest", S))
KEV_FEED = _st(("vulnerabilities", T.ArrayType(_st(
    ("cveID", S), ("vendorProject", S), ("product", S), ("dateAdded", S),
    ("dueDate", S), ("knownRansomwareCampaignUse", S)))))
EPSS_CSV = _st(("cve", S), ("epss", S), ("percentile", S))

# ------------------------------------------------------------------ state

SCAN_RUN = _st(("source_id", S), ("run_key", S), ("started_at", TS), ("ingested_at", TS),
               ("images_total", I), ("images_scanned", I), ("images_skipped", I))
VULN_FINDING = _st(("image", S), ("pkg_name", S), ("installed_version", S), ("cve", S),
                   ("severity", S), ("fixed_version", S), ("title", S), ("purl", S),
                   ("target", S), ("pkg_class", S), ("first_seen", TS), ("last_seen", TS),
                   ("first_run", S), ("last_run", S), ("status", S), ("status_note", S),
                   ("status_changed_at", TS), ("resolved_at", TS))
IMAGE_EXPOSURE = _st(("image", S), ("exposure", S), ("note", S), ("updated_at", TS))
KEV = _st(("cve", S), ("vendor_project", S), ("product", S), ("date_added", D),
          ("due_date", D), ("known_ransomware", B), ("fetched_at", TS))
EPSS_SCORE = _st(("cve", S), ("score", T.DecimalType(8, 6)), ("percentile", T.DecimalType(8, 6)),
                 ("model_date", D), ("fetched_at", TS))
DNS_QUERY = _st(("ts", TS), ("client", S), ("client_name", S), ("qname", S), ("qtype", S),
                ("reason", S), ("blocked", B), ("status", S), ("upstream", S), ("cached", B),
                ("elapsed_ms", T.DecimalType(18, 6)), ("registrable_domain", S),
                ("label_entropy", T.DecimalType(16, 14)), ("run_key", S))
DNS_DOMAIN = _st(("domain", S), ("first_seen", TS), ("last_seen", TS),
                 ("query_count", L), ("blocked_count", L))
DNS_HOURLY = _st(("hour", TS), ("client", S), ("client_name", S), ("queries", L), ("blocked", L), ("failed", L))
DNS_SKETCH = _st(("hour", TS), ("registrable_domain", S), ("names", T.BinaryType()), ("clients", T.BinaryType()),
                 ("rows", L), ("entropy_sum", T.DecimalType(26, 14)))
RULE = _st(("id", S), ("description", S), ("enabled", B), ("added_at", TS))
RULE_HIT = _st(("rule_id", S), ("entity", S), ("summary", S), ("first_seen", TS),
               ("last_seen", TS), ("hit_count", L), ("status", S), ("status_note", S),
               ("status_changed_at", TS))
KNOWN_BAD = _st(("domain", S), ("source", S), ("fetched_at", TS))

# Allowed status / exposure domains of the state tables.
EXPOSURES = ["tailnet", "internal", "build-only", "unknown"]
FINDING_STATUSES = ["open", "accepted", "false_positive", "fixed"]
HIT_STATUSES = ["open", "accepted", "false_positive", "resolved"]

# Natural keys of every state table.
KEYS = {
    "scan_run": ["source_id", "run_key"],
    "vuln_finding": ["image", "pkg_name", "installed_version", "cve"],
    "image_exposure": ["image"],
    "kev": ["cve"],
    "epss_score": ["cve"],
    "dns_query": ["ts", "client", "qname", "qtype"],
    "dns_domain": ["domain"],
    "dns_hourly": ["hour", "client", "client_name"],
    "dns_sketch": ["hour", "registrable_domain"],
    "rule": ["id"],
    "rule_hit": ["rule_id", "entity"],
    "known_bad_domain": ["domain", "source"],
}

STATE_SCHEMAS = {
    "scan_run": SCAN_RUN, "vuln_finding": VULN_FINDING, "image_exposure": IMAGE_EXPOSURE,
    "kev": KEV, "epss_score": EPSS_SCORE, "dns_query": DNS_QUERY, "dns_domain": DNS_DOMAIN,
    "dns_hourly": DNS_HOURLY, "dns_sketch": DNS_SKETCH,
    "rule": RULE, "rule_hit": RULE_HIT, "known_bad_domain": KNOWN_BAD,
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMAS[name])
