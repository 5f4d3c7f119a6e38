"""Data-quality jobs re-aiming the reference's table constraints."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """I-1: keys occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def enum_violations(df: DataFrame, col: str, allowed: list[str], keep: list[str] = ()) -> DataFrame:
    """I-2: rows whose ``col`` is NULL or outside ``allowed``."""
    bad = F.col(col).isNull() | ~F.col(col).isin(*allowed)
    return df.filter(bad).select(*keep, F.col(col).alias("value"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """I-3: one row, NULL count per column (one pass)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def ref_violations(child: DataFrame, parent: DataFrame, child_cols: list[str],
                   parent_cols: list[str] | None = None) -> DataFrame:
    """I-4: child references with no parent row, with their row count."""
    parent_cols = parent_cols or child_cols
    p = parent.select(*[F.col(pc).alias(cc) for pc, cc in zip(parent_cols, child_cols)]).distinct()
    return (child.join(p, child_cols, "left_anti").groupBy(*child_cols)
            .agg(F.count(F.lit(1)).alias("rows")))


def run_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Key, enum and NOT NULL checks for every state table present, as one
    small DataFrame (table, check, violations)."""
    from .. import schemas
    enums = {("image_exposure", "exposure"): schemas.EXPOSURES,
             ("vuln_finding", "status"): schemas.FINDING_STATUSES,
             ("rule_hit", "status"): schemas.HIT_STATUSES}
    parts = []
    for name, df in tables.items():
        keys = schemas.KEYS.get(name)
        if keys:
            parts.append(key_violations(df, keys).agg(F.count(F.lit(1)).alias("violations"))
                         .select(F.lit(name).alias("table"), F.lit("key:" + ",".join(keys)).alias("check"),
                                 "violations"))
            nulls = null_counts(df, keys)
            parts.append(nulls.select(F.lit(name).alias("table"), F.lit("not_null:key").alias("check"),
                                      sum((F.col(k) for k in keys), F.lit(0)).alias("violations")))
        for (t, c), allowed in enums.items():
            if t == name:
                parts.append(enum_violations(df, c, allowed).agg(F.count(F.lit(1)).alias("violations"))
                             .select(F.lit(name).alias("table"), F.lit(f"enum:{c}").alias("check"),
                                     "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
