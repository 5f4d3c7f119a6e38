"""Rule catalogue and rule runs.

A rule is ``(id, description, build)`` where ``build(tables, as_of)``
returns a DataFrame of exactly ``(entity, summary)``. Built-in rules wrap
``detections``; user rules are Spark SQL files whose first line is
``-- description: <text>`` and whose id is the file stem; they read the
temp views named after the state tables and the ``:as_of`` parameter.

A run refreshes the rule registry, skips disabled rules, materialises each
enabled rule's hits on its own (so a failing rule fails alone), checks the
column contract and non-null entities, and upserts all hits in one join.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import hits as hitops
from ..session import scratch_path
from ..timeutil import resolve
from . import detections

DESCRIPTION_PREFIX = "-- description:"
Tables = Mapping[str, DataFrame]


@dataclass
class Rule:
    id: str
    description: str
    build: Callable[[Tables, object], DataFrame]


@dataclass
class RuleParams:
    # Published default thresholds of the six DNS rules.
    new_window_hours: int = 24
    dga_min_entropy: str = "3.5"
    dga_min_length: int = 12
    spike_floor: int = 20
    spike_multiple: int = 3
    nx_floor: int = 30
    nx_multiple: int = 3
    tunnel_min_names: int = 50
    tunnel_min_avg_entropy: str = "3.0"


def builtin_rules(p: RuleParams | None = None) -> list[Rule]:
    """The six DNS rules. The rule ids, so that hit history
    carries over by id."""
    p = p or RuleParams()
    return sorted([
        Rule("dns_blocked_spike", "a client's blocked queries far above its own past week",
             lambda t, a: detections.blocked_spike(t["dns_query"], a, p.spike_floor, p.spike_multiple,
                                               t.get("dns_hourly"))),
        Rule("dns_dga_entropy", "names whose labels look random, as generated or tunnelled ones do",
             lambda t, a: detections.dga_entropy(t["dns_query"], p.dga_min_entropy, p.dga_min_length)),
        Rule("dns_known_bad_domain", "a listed domain was asked for",
             lambda t, a: detections.known_bad(t["dns_query"], t["known_bad_domain"])),
        Rule("dns_newly_seen_domain", "a domain that was never asked for before the last day",
             lambda t, a: detections.newly_seen(t["dns_domain"], t["dns_query"], a, p.new_window_hours)),
        Rule("dns_nxdomain_burst", "a client whose lookups fail far more often than in its past week",
             lambda t, a: detections.nxdomain_burst(t["dns_query"], a, p.nx_floor, p.nx_multiple,
                                                t.get("dns_hourly"))),
        Rule("dns_tunnel_volume", "a domain with very many random-looking names in a day",
             lambda t, a: detections.tunnel_volume(t["dns_query"], a, p.tunnel_min_names,
                                                   p.tunnel_min_avg_entropy)),
    ], key=lambda r: r.id)


def sql_rule(spark: SparkSession, rule_id: str, text: str) -> Rule:
    """A rule from Spark SQL text; the first line carries the description."""
    first = text.splitlines()[0].strip() if text else ""
    if not first.startswith(DESCRIPTION_PREFIX):
        raise ValueError(f"rule {rule_id} does not open with a '{DESCRIPTION_PREFIX}' line but with {first!r}")
    desc = first[len(DESCRIPTION_PREFIX):].strip()

    def build(tables: Tables, as_of):
        clock, mine, kept = resolve(spark, as_of), [], {}
        for name, df in tables.items():
            if spark.catalog.tableExists(name):             # the caller's own view comes back below
                kept[name] = spark.table(name)
            df.createOrReplaceTempView(name)
            mine.append(name)
        try:
            return spark.sql(text, args={"as_of": clock})   # resolved here; it needs the views no more
        finally:
            for name in mine:
                spark.catalog.dropTempView(name)
            for name, df in kept.items():
                df.createOrReplaceTempView(name)

    return Rule(rule_id, desc, build)


def discover(spark: SparkSession, path: str) -> list[Rule]:
    """R-7: every ``*.sql`` in ``path`` (sorted), id = file stem. Rule files are small texts that
    Spark reads from whatever store holds them; a missing header is an error."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql").select(F.regexp_extract(
        "_metadata.file_name", r"^(.*)\.sql$", 1).alias("id"), "value").collect()
    return [sql_rule(spark, r.id, r.value) for r in sorted(files)]


@dataclass
class RunOutcome:
    rules: DataFrame                 # rule registry after the run
    hits: DataFrame                  # rule_hit state after the run
    results: DataFrame               # per rule: id, description, enabled, outcome, hits, new, re_reported
    failures: dict = field(default_factory=dict)

    @property
    def any_failed(self) -> bool:
        return bool(self.failures)


def _execute(spark: SparkSession, rule: Rule, group: str, hits: DataFrame) -> DataFrame:
    """One rule's hits, written by jobs of its own group and scheduler pool. Null entities are
    counted during the write."""
    spark.sparkContext.setJobGroup(group, f"rule {rule.id}", interruptOnCancel=True)
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", rule.id)
    path, seen = scratch_path(spark, f"hits-{rule.id}"), Observation(group)
    rows = hits.select(F.col("entity").cast("string"), F.col("summary").cast("string"))
    rows.observe(seen, F.count_if(F.col("entity").isNull()).alias("nulls")).write.parquet(path)
    if seen.get["nulls"]:
        raise ValueError("rule returned a NULL entity")
    return spark.read.schema(rows.schema).parquet(path)


def run_rules(spark: SparkSession, rules: list[Rule], tables: Tables, rule_state: DataFrame,
              hit_state: DataFrame, as_of, side_by_side: int = 4, limit_seconds: float | None = None) -> RunOutcome:
    """R-8. Each enabled rule's hits are written to the shared checkpoint
    folder as their own job: the write is the rule's execution, a failure
    (analysis or runtime) is caught for that rule only, and the union of the
    written hits feeds one upsert. Up to ``side_by_side`` rules run at a time (with the FAIR
    scheduler each in a pool of its own); one that takes over ``limit_seconds`` is cancelled
    and counts as failed."""
    cat = spark.createDataFrame([(r.id, r.description) for r in rules], "id string, description string")
    new_rules = hitops.upsert_rules(rule_state, cat, as_of)
    ids = [r.id for r in rules]
    enabled = {row["id"]: row["enabled"] for row in
               new_rules.filter(F.col("id").isin(ids)).select("id", "enabled").collect()}
    failures: dict[str, str] = {}
    outcome: dict[str, str] = {}
    written: list[DataFrame] = []
    running: dict[int, tuple] = {}
    pool = ThreadPoolExecutor(max(1, side_by_side))

    def start(hits: DataFrame, rule: Rule, group: str, began: list):
        began.append(time.monotonic())
        return _execute(spark, rule, group, hits)

    for i, r in enumerate(rules):
        if not enabled.get(r.id, True):
            outcome[r.id] = "skipped"
            continue
        try:
            df = r.build(tables, as_of)
            if df.columns != ["entity", "summary"]:
                raise ValueError(f"expected columns (entity, summary), got {df.columns}")
            group, began = f"rule-{r.id}-{uuid.uuid4().hex}", []
            running[i] = (pool.submit(start, df, r, group, began), group, began)
        except (AnalysisException, ValueError, Exception) as exc:  # noqa: BLE001
            failures[r.id] = str(exc)
            outcome[r.id] = "failed"
    for i, (job, group, began) in running.items():
        r = rules[i]
        try:
            while not job.done() and limit_seconds is not None:
                if began and time.monotonic() - began[0] > limit_seconds:
                    spark.sparkContext.cancelJobGroup(group)
                    raise TimeoutError(f"over its limit of {limit_seconds} s")
                wait([job], timeout=0.2)
            got = job.result()
            written.append(got.select(F.lit(r.id).alias("rule_id"), "entity", "summary",
                                      F.struct(F.lit(i), F.monotonically_increasing_id()).alias("ord")))
            outcome[r.id] = "ok"
        except Exception as exc:  # noqa: BLE001  (this rule alone has failed)
            failures[r.id] = str(exc)
            outcome[r.id] = "failed"
    pool.shutdown(wait=False)
    if written:
        batch = written[0]
        for w in written[1:]:
            batch = batch.unionByName(w)
        up = hitops.upsert_hits(hit_state, batch, as_of)
        metrics = hitops.hit_metrics(up)
        new_hits = up.drop("_action", "reported")
    else:
        metrics = spark.createDataFrame([], "rule_id string, hits long, new long, re_reported long")
        new_hits = hit_state
    status = spark.createDataFrame([(r.id, outcome[r.id]) for r in rules], "rule_id string, outcome string")
    results = (status.join(metrics, "rule_id", "left")
               .join(new_rules.select(F.col("id").alias("rule_id"), "description", "enabled"), "rule_id")
               .select("rule_id", "description", "enabled", "outcome",
                       *[F.when(F.col("outcome") == "ok", F.coalesce(F.col(c), F.lit(0)))
                         .cast("long").alias(c) for c in ["hits", "new", "re_reported"]]))
    return RunOutcome(new_rules, new_hits, results, failures)


def run_totals(results: DataFrame) -> DataFrame:
    """A-10: rules, hits, new hits and failed rules of one run (one row)."""
    return results.agg(F.count(F.lit(1)).alias("rules"),
                       F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"),
                       F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("new"),
                       F.count_if(F.col("outcome") == "failed").alias("failed"))
