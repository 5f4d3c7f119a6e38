"""Enrichment feeds as state: exploited list, probability scores, blocklists,
the exposure map. Column-selective upserts and per-source snapshot replace."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dnsname import normalise_qname
from ..timeutil import as_ts
from .upsert import B, reduce_batch, upsert


def _date(c):
    return F.nullif(c, F.lit("")).try_cast("date")


def kev_rows(feed: DataFrame, order: str = "ord") -> DataFrame:
    """S-5: raw feed entries -> kev rows. Empty dates are NULL; the ransomware
    flag is true only for 'known' (any case); rows without a CVE are dropped."""
    return feed.filter(F.col("cveID").isNotNull() & (F.col("cveID") != "")).select(
        F.col(order).alias("ord"),
        F.col("cveID").alias("cve"),
        F.col("vendorProject").alias("vendor_project"),
        F.col("product"),
        _date(F.col("dateAdded")).alias("date_added"),
        _date(F.col("dueDate")).alias("due_date"),
        F.coalesce(F.lower(F.col("knownRansomwareCampaignUse")) == "known", F.lit(False))
        .alias("known_ransomware"))


def upsert_kev(state: DataFrame, rows: DataFrame, as_of) -> DataFrame:
    """U-8: new CVEs inserted whole; known ones update only the due date, the
    ransomware flag and fetched_at. Repeated CVEs in one feed: inserted from
    the first entry, updated by the last."""
    t = as_ts(as_of)
    batch = reduce_batch(rows, ["cve"], "ord", first=["vendor_project", "product", "date_added"],
                         last=["due_date", "known_ransomware"])
    ins = {c: B(c) for c in ["vendor_project", "product", "date_added", "due_date", "known_ransomware"]}
    ins["fetched_at"] = t
    upd = {"due_date": B("due_date"), "known_ransomware": B("known_ransomware"), "fetched_at": t}
    return upsert(state, batch, ["cve"], ins, upd, action_col=None)


def epss_rows(csv: DataFrame, model_date=None, order: str = "ord") -> DataFrame:
    """S-6: parsed CSV rows -> score rows; rows without a CVE are dropped."""
    md = F.lit(model_date).try_cast("date") if not hasattr(model_date, "_jc") else model_date
    return csv.filter(F.col("cve").isNotNull() & (F.col("cve") != "")).select(
        F.col(order).alias("ord"), "cve",
        F.col("epss").try_cast("decimal(8,6)").alias("score"),
        F.col("percentile").try_cast("decimal(8,6)").alias("percentile"),
        md.alias("model_date"))


def upsert_epss(state: DataFrame, rows: DataFrame, as_of,
                findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """U-9: upsert all value columns; with ``findings`` given, only CVEs that
    appear in any finding (resolved too) are loaded: a left-semi join, so the
    feed's other rows never leave the scan side. Returns (state, loaded rows)."""
    t = as_ts(as_of)
    if findings is not None:
        rows = rows.join(findings.select("cve").distinct(), "cve", "left_semi")
    batch = reduce_batch(rows, ["cve"], "ord", last=["score", "percentile", "model_date"])
    vals = {c: B(c) for c in ["score", "percentile", "model_date"]}
    new = upsert(state, batch, ["cve"], {**vals, "fetched_at": t}, {**vals, "fetched_at": t},
                 action_col=None)
    return new, rows


def hostfile_domains(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """S-7: hostfile text lines -> distinct domains. Blank, '#' and one-field
    lines are skipped; the second field is stripped of trailing dots and
    lower-cased."""
    ln = F.regexp_replace(F.col(line_col), r"^\s+|\s+$", "")
    fields = F.split(ln, r"\s+")
    dom = normalise_qname(fields.getItem(1))
    return (lines.select(ln.alias("l"), fields.alias("f"), dom.alias("domain"))
            .filter((F.col("l") != "") & ~F.col("l").startswith("#") & (F.size("f") >= 2))
            .select("domain").filter(F.col("domain") != "").distinct())


def replace_source(state: DataFrame, domains: DataFrame, source: str, as_of) -> DataFrame:
    """U-10: the source's rows become exactly the current distinct domains;
    other sources are untouched. (Stored partitioned by source, this is a
    dynamic partition overwrite of one partition.)"""
    fresh = domains.select("domain").distinct().select(
        "domain", F.lit(source).alias("source"), as_ts(as_of).alias("fetched_at"))
    return state.filter(F.col("source") != source).unionByName(fresh)


def exposure_rows(entries: DataFrame) -> DataFrame:
    """S-8: (image, exposure?, note?) with exposure defaulting to 'unknown';
    ``ord`` keeps the order of the entries."""
    order = F.col("ord") if "ord" in entries.columns else F.monotonically_increasing_id()
    return entries.select("image", F.coalesce(F.col("exposure"), F.lit("unknown")).alias("exposure"),
                          F.col("note"), order.alias("ord"))


def upsert_exposure(state: DataFrame, entries: DataFrame, as_of) -> DataFrame:
    """U-11: update exposure, note, updated_at; images dropped from the map
    stay; an image listed twice takes its last entry."""
    t = as_ts(as_of)
    batch = reduce_batch(exposure_rows(entries), ["image"], "ord", last=["exposure", "note"])
    vals = {"exposure": B("exposure"), "note": B("note"), "updated_at": t}
    return upsert(state, batch, ["image"], vals, vals, action_col=None)
