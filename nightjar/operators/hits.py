"""Rule registry and rule-hit state, and human triage decisions.

A hit persists per (rule_id, entity): first_seen is set once, a re-hit
moves last_seen, bumps hit_count and replaces the summary; the status is
owned by people and never changed by the engine, which never closes a hit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..timeutil import as_ts
from .upsert import B, S, reduce_batch, upsert


def upsert_rules(state: DataFrame, catalogue: DataFrame, as_of) -> DataFrame:
    """U-12: (id, description) rows; description refreshed, ``enabled`` and
    ``added_at`` kept; new rules enabled; of an id listed twice the last counts."""
    t = as_ts(as_of)
    order = F.col("ord") if "ord" in catalogue.columns else F.monotonically_increasing_id()
    batch = reduce_batch(catalogue.select("id", "description", order.alias("ord")), ["id"], "ord", last=["description"])
    return upsert(state, batch, ["id"], {"description": B("description"), "enabled": F.lit(True),
                                          "added_at": t},
                  {"description": B("description")}, action_col=None)


def upsert_hits(state: DataFrame, hits: DataFrame, as_of, order: str = "ord") -> DataFrame:
    """U-13: ``hits`` = (rule_id, entity, summary, ord). An entity reported n
    times in one run counts n (the last summary wins). Output keeps
    ``_action`` and ``reported`` (n) for the run metrics."""
    t = as_ts(as_of)
    batch = reduce_batch(hits, ["rule_id", "entity"], order, last=["summary"], count_col="reported")
    ins = {"summary": B("summary"), "first_seen": t, "last_seen": t,
           "hit_count": B("reported"), "status": F.lit("open")}
    upd = {"summary": B("summary"), "last_seen": t, "hit_count": S("hit_count") + B("reported")}
    return upsert(state, batch, ["rule_id", "entity"], ins, upd, carry=["reported"])


def hit_metrics(upserted: DataFrame) -> DataFrame:
    """Per rule: hits (rows reported), new (first-time keys), re_reported."""
    n = F.coalesce(F.col("reported"), F.lit(0))
    return (upserted.filter(F.col("_action") != "keep").groupBy("rule_id")
            .agg(F.sum(n).cast("long").alias("hits"),
                 F.count_if(F.col("_action") == "insert").alias("new"),
                 (F.sum(n) - F.count_if(F.col("_action") == "insert")).cast("long").alias("re_reported")))


def apply_decisions(state: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """U-14: human triage. ``decisions`` = keys + status, status_note,
    decided_at; the latest decision per key wins; unknown keys are ignored
    (an update, never an insert)."""
    latest = reduce_batch(decisions, keys, "decided_at", last=["status", "status_note", "decided_at"])
    upd = {"status": B("status"), "status_note": B("status_note"),
           "status_changed_at": B("decided_at")}
    out = upsert(state, latest, keys, {}, upd)
    return out.filter(F.col("_action") != "insert").drop("_action")


def set_enabled(rules: DataFrame, rule_id: str, enabled: bool) -> DataFrame:
    """Disable / enable a rule by id (a state update, not a file change)."""
    return rules.withColumn("enabled", F.when(F.col("id") == rule_id, F.lit(enabled))
                            .otherwise(F.col("enabled")))
