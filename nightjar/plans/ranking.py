"""Vulnerability backlog reports: priority view, headline, top-N, ageing.

The priority score is a transparent sum:
  fixable 1000 + in exploited list 500 + exploit probability >= 0.1 250
  + exposure (tailnet 120, internal 60, unknown 30, build-only 0)
  + severity (CRITICAL 40, HIGH 20, otherwise 0)
All weights are parameters with these defaults.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..timeutil import as_ts

# The exposure map, exploited list and score table are keyed dimension tables.
# They are joined without hints: AQE broadcasts those that it finds small, so
# the findings don't shuffle for them in the normal case.


@dataclass(frozen=True)
class PriorityWeights:
    # The published default weights of the priority score.
    fixable: int = 1000
    kev: int = 500
    epss_hot: int = 250
    epss_threshold: str = "0.1"
    exposure: dict = field(default_factory=lambda: {
        "tailnet": 120, "internal": 60, "unknown": 30, "build-only": 0})
    severity: dict = field(default_factory=lambda: {"CRITICAL": 40, "HIGH": 20})


DEFAULT_WEIGHTS = PriorityWeights()


def _case(col, mapping: dict, default=0):
    e = None
    for k, v in mapping.items():
        e = (F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v)))
    return F.lit(default) if e is None else e.otherwise(F.lit(default))


def vuln_priority(findings: DataFrame, exposure: DataFrame, kev: DataFrame,
                  epss: DataFrame, weights: PriorityWeights = DEFAULT_WEIGHTS) -> DataFrame:
    """Q-1: open findings (not resolved, status open) with flags and score."""
    f = findings.filter(F.col("resolved_at").isNull() & (F.col("status") == "open"))
    # no hints: AQE broadcasts a side by its measured size
    e = exposure.select("image", F.col("exposure").alias("__exp"))
    k = kev.select("cve", F.lit(True).alias("__kev"))
    s = epss.select("cve", F.col("score").alias("epss"))
    j = f.join(e, "image", "left").join(k, "cve", "left").join(s, "cve", "left")
    exp = F.coalesce(F.col("__exp"), F.lit("unknown"))
    fixable = F.col("fixed_version").isNotNull() & (F.col("fixed_version") != "")
    in_kev = F.col("__kev").isNotNull()
    thr = F.lit(weights.epss_threshold).cast("decimal(8,6)")
    hot = F.coalesce(F.col("epss"), F.lit(0).cast("decimal(8,6)")) >= thr
    prio = (F.when(fixable, weights.fixable).otherwise(0)
            + F.when(in_kev, weights.kev).otherwise(0)
            + F.when(hot, weights.epss_hot).otherwise(0)
            + _case(exp, weights.exposure, None)
            + _case(F.col("severity"), weights.severity, 0))
    return j.select(
        "image", exp.alias("exposure"), "cve", "severity", "pkg_name", "installed_version",
        "fixed_version", fixable.alias("fixable"), in_kev.alias("in_kev"), "epss",
        "first_seen", "last_seen", "status", "title", prio.alias("priority"))


def headline(priority: DataFrame, epss_threshold: str = "0.1") -> DataFrame:
    """Q-2 / A-1: fixable, no fix, in exploited list, hot probability (one pass)."""
    thr = F.lit(epss_threshold).cast("decimal(8,6)")
    return priority.agg(
        F.count_if("fixable").alias("fixable"),
        F.count_if(~F.col("fixable")).alias("unfixable"),
        F.count_if("in_kev").alias("in_kev"),
        F.count_if(F.col("epss") >= thr).alias("epss_hot"))


def backlog_top(priority: DataFrame, limit: int = 25, epss_threshold: str = "0.1") -> DataFrame:
    """Q-3 / O-1 / P-14: top-N by priority, ties by cve, image, package, version.

    Plans as TakeOrderedAndProject: each partition keeps its own top N, only
    N rows per partition reach the final merge.
    """
    thr = F.lit(epss_threshold).cast("decimal(8,6)")
    top = priority.orderBy(F.col("priority").desc(), "cve", "image", "pkg_name",
                           "installed_version").limit(limit)
    flags = F.array_compact(F.array(
        F.when(F.col("in_kev"), F.lit("KEV")),
        F.when(F.col("epss") >= thr, F.concat(F.lit("EPSS "), F.bround("epss", 2).cast("string")))))
    arrow = F.when(F.col("fixed_version").isNotNull() & (F.col("fixed_version") != ""),
                   F.concat_ws(" -> ", "installed_version", "fixed_version")) \
        .otherwise(F.concat(F.col("installed_version"), F.lit(" (no fix)")))
    return top.select(
        "priority", F.left(F.col("image"), F.lit(34)).alias("image_short"), "image", "exposure",
        "cve", "severity", "pkg_name", arrow.alias("version_change"),
        F.array_join(flags, ", ").alias("flags"))


def worst_images(priority: DataFrame, limit: int = 5) -> DataFrame:
    """Q-4 / A-2 / O-2: images by fixable open findings, top N (ties by image)."""
    return (priority.filter("fixable").groupBy("image")
            .agg(F.count(F.lit(1)).alias("fixable_count"))
            .orderBy(F.col("fixable_count").desc(), "image").limit(limit))


def unmapped_images(findings: DataFrame, exposure: DataFrame) -> DataFrame:
    """Q-6 / J-7: distinct finding images missing from the exposure map."""
    imgs = findings.select("image").distinct()
    return imgs.join(exposure.select("image"), "image", "left_anti").orderBy("image")


# Ageing buckets (upper bound in days, label) for Q-7.
AGE_BUCKETS = [(7, "0-7d"), (21, "8-21d"), (90, "22-90d"), (None, "90d+")]


def backlog_ageing(priority: DataFrame, as_of) -> DataFrame:
    """Q-7: open backlog by age since first seen: rows and fixable rows per bucket."""
    age = F.datediff(as_ts(as_of), F.col("first_seen"))
    b = None
    for hi, label in AGE_BUCKETS:
        if hi is None:
            b = b.otherwise(F.lit(label))
        else:
            b = F.when(age <= hi, F.lit(label)) if b is None else b.when(age <= hi, F.lit(label))
    return (priority.withColumn("age_bucket", b).groupBy("age_bucket")
            .agg(F.count(F.lit(1)).alias("findings"), F.count_if("fixable").alias("fixable"),
                 F.max(age).alias("oldest_days")))


def open_hits(hits: DataFrame, limit: int = 15) -> DataFrame:
    """Q-5 / O-3 / A-10: newest open rule hits plus the open total."""
    op = hits.filter(F.col("status") == "open")
    total = op.agg(F.count(F.lit(1))).scalar()
    return (op.orderBy(F.col("first_seen").desc(), "rule_id", "entity").limit(limit)
            .select("rule_id", "entity", "summary", "first_seen", "hit_count",
                    total.alias("open_total")))
