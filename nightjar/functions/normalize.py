"""Row transforms for the two telemetry feeds (built-in expressions only).

* ``flatten_reports``   nested scan report -> one row per vulnerability
* ``normalise_findings`` blanks/defaults/truncation of finding fields
* ``map_dns_entries``    nested query-log entry -> flat dns_query row,
                         with a validity flag for malformed entries
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dnsname

TITLE_MAX = 500

FINDING_KEY = ["image", "pkg_name", "installed_version", "cve"]
DNS_KEY = ["ts", "client", "qname", "qtype"]


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ------------------------------------------------------------------ findings

def flatten_reports(docs: DataFrame, file_col: str = "file",
                    keep: list[str] | None = None) -> DataFrame:
    """``Results[].Vulnerabilities[]`` -> rows, keeping both array positions.

    Null or empty lists yield no rows (other finding kinds are ignored).
    ``(file, result_pos, vuln_pos)`` is the input order used for
    first/last-occurrence rules.
    """
    keep = keep or []
    res = docs.select(*keep, F.col(file_col).alias("file"), "ArtifactName",
                      F.posexplode("Results").alias("result_pos", "r"))
    vul = res.select(*keep, "file", "ArtifactName", "result_pos",
                     F.col("r.Target").alias("Target"), F.col("r.Class").alias("Class"),
                     F.posexplode("r.Vulnerabilities").alias("vuln_pos", "v"))
    return vul.select(
        *keep, "file", "result_pos", "vuln_pos", "ArtifactName", "Target", "Class",
        F.col("v.VulnerabilityID").alias("VulnerabilityID"),
        F.col("v.PkgName").alias("PkgName"),
        F.col("v.InstalledVersion").alias("InstalledVersion"),
        F.col("v.FixedVersion").alias("FixedVersion"),
        F.col("v.Severity").alias("Severity"),
        F.col("v.Title").alias("Title"),
        F.col("v.PkgIdentifier.PURL").alias("PURL"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def normalise_findings(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flattened report rows -> finding rows.

    image falls back to the file stem; missing key parts become ''; missing
    severity becomes UNKNOWN; a blank fixed version is NULL; the title is cut
    to 500 characters and an empty one is NULL.
    """
    keep = keep or []
    return raw.select(
        *keep,
        F.coalesce(blank_to_null(F.col("ArtifactName")), file_stem(F.col("file"))).alias("image"),
        F.coalesce(F.col("PkgName"), F.lit("")).alias("pkg_name"),
        F.coalesce(F.col("InstalledVersion"), F.lit("")).alias("installed_version"),
        F.coalesce(F.col("VulnerabilityID"), F.lit("")).alias("cve"),
        F.coalesce(blank_to_null(F.col("Severity")), F.lit("UNKNOWN")).alias("severity"),
        blank_to_null(strip_ws(F.col("FixedVersion"))).alias("fixed_version"),
        blank_to_null(F.left(F.coalesce(F.col("Title"), F.lit("")), F.lit(TITLE_MAX))).alias("title"),
        blank_to_null(F.col("PURL")).alias("purl"),
        F.col("Target").alias("target"),
        F.col("Class").alias("pkg_class"),
    )


# ----------------------------------------------------------------------- DNS

# A full date, alone or with a time of day and an offset; extended or basic form.
_ISO = (r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})"
        r"(?:[.,]([0-9]{1,6})[0-9]*)?)?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$")


#: Stands at the start of a time that matched.
_MATCHED = "\u0001"


def parse_iso_ts(c: Column) -> Column:
    """ISO-8601 date or date and time, extended or basic form, with offset or
    Z (none: UTC) -> timestamp (µs). Bare times, bare years and anything else
    -> NULL.

    Each step has one use of the one before, so a predicate on the result that is pushed
    below this projection holds the pattern once."""
    parts = F.regexp_replace(F.replace(c, F.lit(_MATCHED), F.lit("?")), _ISO, f"{_MATCHED}$1-$2-$3T$4:$5:$6.$7@$8")
    for empty, full in (("T:", "T00:"), ("::", ":00:"), (":.", ":00."), (".@", ".0@")):
        parts = F.replace(parts, F.lit(empty), F.lit(full))
    offset = F.replace(F.regexp_replace(parts, "@$", "@Z"), F.lit("@"), F.lit(""))
    return F.regexp_extract(offset, f"^{_MATCHED}(.*)$", 1).try_cast("timestamp")


def is_blocked(reason: Column) -> Column:
    """A Filtered* verdict is a block; NotFiltered* and Rewritten* are not."""
    return F.coalesce(reason.startswith("Filtered"), F.lit(False))


def map_dns_entries(entries: DataFrame, rules,
                    keep: list[str] | None = None) -> DataFrame:
    """Query-log entries -> dns_query rows plus ``valid`` / ``reject_reason``.

    An entry without a parseable time, or whose name is missing or empty
    after normalising, is not valid; it is kept (flagged) so callers can
    count it. Registrable domain and label entropy are derived for all rows
    (NULL names give NULL parts).

    Time and name come out of a generator of one row (``stack``): a predicate
    on them stays above it, so a filter on ``valid`` does not derive them, and
    the entries below, a second time.
    """
    keep = keep or []
    ts = parse_iso_ts(F.col("time"))
    raw_name = F.col("question.name")
    qname = normalise_qname_or_null(raw_name)
    reason = blank_to_null(F.col("reason"))
    parsed = entries.select("*", F.stack(F.lit(1), ts, qname).alias("__ts", "__qname"))
    flat = parsed.select(
        *keep,
        F.col("__ts").alias("ts"),
        F.coalesce(F.col("client"), F.lit("")).alias("client"),
        blank_to_null(F.col("client_info.name")).alias("client_name"),
        F.col("__qname").alias("qname"),
        F.coalesce(F.col("question.type"), F.lit("")).alias("qtype"),
        reason.alias("reason"),
        is_blocked(F.col("reason")).alias("blocked"),
        blank_to_null(F.col("status")).alias("status"),
        blank_to_null(F.col("upstream")).alias("upstream"),
        F.col("cached").alias("cached"),
        F.col("elapsedMs").cast("string").try_cast("decimal(18,6)").alias("elapsed_ms"),
    )
    reject = (F.when(F.col("ts").isNull(), F.lit("bad_time"))
              .when(F.col("qname").isNull(), F.lit("no_name")))
    flat = flat.withColumn("reject_reason", reject).withColumn("valid", reject.isNull())
    return dnsname.with_name_parts(flat, rules)


def normalise_qname_or_null(raw: Column) -> Column:
    norm = dnsname.normalise_qname(raw)
    return F.when(raw.isNull() | (raw == ""), F.lit(None)).otherwise(blank_to_null(norm))
