"""Vulnerability finding state: run envelope, upsert, scoped resolve, replay.

A finding persists across scans. Re-seen: ``last_seen``/``last_run`` move,
severity and fixed version follow the scan, ``resolved_at`` is cleared;
first_seen, status and descriptive fields stay. Not re-seen although its
image was scanned: resolved. Image not scanned: untouched.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import FINDING_KEY
from ..timeutil import as_ts
from .upsert import B, reduce_batch, upsert

FIRST_COLS = ["title", "purl", "target", "pkg_class"]
LAST_COLS = ["severity", "fixed_version"]
SOURCE_ID = "scanner"

# Findings are shuffled once, by their image and one of PARTS parts of its
# keys (``deal``). Everything after that (aggregation, the join with what is
# known of an image, the join of state and batch) needs rows of one key
# together and finds them so. What is known of an image has a row for each
# part; it goes to the findings, which neither move nor are sorted again.
# Images grow with the estate, so nothing here is broadcast by a hint.
PART = "__part"
PARTS = 16
DEALT = ["image", PART, *FINDING_KEY[1:]]


def deal(df: DataFrame) -> DataFrame:
    """Rows by image and part; what has a part is dealt already. A key's rows (one for each
    time that a scan reports it) meet in one task, an image's don't."""
    if PART in df.columns:
        return df
    return df.withColumn(PART, F.pmod(F.xxhash64(*FINDING_KEY[1:]), F.lit(PARTS)).cast("int")) \
        .repartition("image", PART)


def _by_image(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """Dealt rows with the columns of ``known``, which has at most one row an image."""
    parts = known.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(parts.hint("shuffle_hash"), ["image", PART], "left")


def new_runs(incoming: DataFrame, scan_run: DataFrame, source_id: str = SOURCE_ID) -> DataFrame:
    """U-1: incoming ``run_key`` rows not yet recorded for ``source_id``."""
    seen = scan_run.filter(F.col("source_id") == source_id).select("run_key")
    return incoming.join(seen, "run_key", "left_anti")


def record_runs(scan_run: DataFrame, runs: DataFrame, as_of, source_id: str = SOURCE_ID) -> DataFrame:
    """Append run envelopes (run_key, started_at, images) insert-if-absent."""
    return scan_run.unionByName(run_envelopes(new_runs(runs, scan_run, source_id), as_of, source_id))


def run_envelopes(runs: DataFrame, as_of, source_id: str = SOURCE_ID) -> DataFrame:
    """Envelope rows of runs (run_key, started_at, images)."""
    return runs.select(
        F.lit(source_id).alias("source_id"), "run_key", "started_at",
        as_ts(as_of).alias("ingested_at"),
        F.col("images").cast("int").alias("images_total"),
        F.col("images").cast("int").alias("images_scanned"),
        F.lit(None).cast("int").alias("images_skipped"))


def reduce_run(rows: DataFrame, order: str = "ord") -> DataFrame:
    """T-2: one row per finding key for one run: descriptive fields from the
    first occurrence, severity / fixed version from the last, and the number
    of occurrences (each occurrence after an insert counts as an update)."""
    return reduce_batch(deal(rows), DEALT, order, first=FIRST_COLS, last=LAST_COLS,
                        count_col="occurrences")


def upsert_findings(state: DataFrame, rows: DataFrame, run_key: str, as_of,
                    order: str = "ord") -> DataFrame:
    """U-2 for one run. Output = state schema + ``_action`` + ``occurrences``."""
    t = as_ts(as_of)
    batch = reduce_run(rows, order)
    ins = {c: B(c) for c in LAST_COLS + FIRST_COLS}
    ins.update(first_seen=t, last_seen=t, first_run=F.lit(run_key), last_run=F.lit(run_key),
               status=F.lit("open"))
    upd = {"last_seen": t, "last_run": F.lit(run_key), "severity": B("severity"),
           "fixed_version": B("fixed_version"), "resolved_at": F.lit(None)}
    up = upsert(deal(state), batch, DEALT, ins, upd, carry=["occurrences"])
    return up.select(*state.columns, "_action", "occurrences")


def resolve_findings(state: DataFrame, scanned_images: DataFrame, run_key: str, as_of) -> DataFrame:
    """U-3: open rows of images scanned in this run that this run did not
    report get ``resolved_at = as_of``. Adds boolean ``_resolved``."""
    cols = state.columns
    return _resolve(_mark_scanned(state, scanned_images), run_key, as_of).select(*cols, "_resolved")


def _mark_scanned(state: DataFrame, scanned_images: DataFrame) -> DataFrame:
    return _by_image(deal(state), scanned_images.select("image").distinct().withColumn("__scanned", F.lit(True)))


def _resolve(marked: DataFrame, run_key: str, as_of) -> DataFrame:
    hit = (F.col("__scanned").isNotNull() & F.col("resolved_at").isNull()
           & ~F.col("last_run").eqNullSafe(F.lit(run_key)))
    return (marked.withColumn("_resolved", F.coalesce(hit, F.lit(False)))
            .withColumn("resolved_at", F.when(F.col("_resolved"), as_ts(as_of))
                        .otherwise(F.col("resolved_at"))))


@dataclass
class RunResult:
    state: DataFrame          # new vuln_finding state (state schema only)
    metrics: DataFrame        # one row: images, inserted, updated, resolved
    flagged: DataFrame        # the state with what ``run_metrics`` counts


def run_metrics() -> list[Column]:
    """U-4: aggregates over a flagged state, for ``agg`` or for ``observe`` during its write."""
    occ, new = F.coalesce(F.col("occurrences"), F.lit(0)), F.col("_action") == "insert"
    return [F.count_if(new).alias("inserted"),
            F.coalesce(F.sum(F.when(new, occ - 1).otherwise(occ)), F.lit(0)).cast("long").alias("updated"),
            F.count_if("_resolved").alias("resolved")]


def backfill_metrics(first_run: str) -> list[Column]:
    """The same of many runs in one pass (``apply_runs`` with flags)."""
    return [F.count_if(~F.col("_old")).alias("inserted"),
            F.count_if(F.col("_old") & (F.col("last_run") >= first_run)).alias("updated"),
            F.count_if(F.col("resolved_at").isNotNull() & F.col("_was").isNull()).alias("resolved"),
            F.count(F.lit(1)).alias("findings")]


def ingest_run(state: DataFrame, rows: DataFrame, scanned_images: DataFrame,
               run_key: str, as_of, order: str = "ord") -> RunResult:
    """U-2 + U-3 + U-4 for one run (the envelope check U-1 is the caller's)."""
    cols = state.columns
    # A row of this run is not resolved by it: what the state held is marked, before it meets the batch.
    up = upsert_findings(_mark_scanned(state, scanned_images), rows, run_key, as_of, order)
    res = _resolve(up, run_key, as_of).select(*cols, "_action", "occurrences", "_resolved")
    metrics = res.agg(*run_metrics())
    n_img = scanned_images.select("image").distinct().agg(F.count(F.lit(1))).scalar()
    metrics = metrics.select(n_img.alias("images"), "*")
    return RunResult(res.select(*cols), metrics, res)


def replay_runs(rows: DataFrame, scanned: DataFrame, order: str = "ord", dealt: bool = False) -> DataFrame:
    """Set-based backfill: the state after ingesting every run in ``rows``,
    in run_key order, into an empty store, computed in one pass.

    ``rows`` carries run_key, started_at (the as_of of that run's ingest) and
    ``order``; ``scanned`` is (run_key, started_at, image) per scanned image.
    Per key: first/last run and times, severity / fix of the last occurrence,
    descriptive fields of the first; ``resolved_at`` is the start of the next
    run that scanned the image after the key's last run (NULL if none). A
    ``dealt`` result keeps its part, so that a run can be applied to it where
    it is.
    """
    ordc = F.struct(F.col("run_key"), F.col(order))
    agg = deal(rows).groupBy(*DEALT).agg(
        F.min("run_key").alias("first_run"), F.max("run_key").alias("last_run"),
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
        F.max_by(F.struct(*LAST_COLS), ordc).alias("__l"),
        F.min_by(F.struct(*FIRST_COLS), ordc).alias("__f"))
    runs = (scanned.select("image", F.struct("run_key", "started_at").alias("run")).distinct()
            .groupBy("image").agg(F.array_sort(F.collect_list("run")).alias("__runs")))
    later = F.filter("__runs", lambda r: r["run_key"] > F.col("last_run"))
    j = _by_image(agg, runs).withColumn("resolved_at", F.get(later, F.lit(0))["started_at"])
    return j.select(
        *FINDING_KEY, *([PART] if dealt else []),
        *[F.col(f"__l.{c}").alias(c) for c in LAST_COLS],
        *[F.col(f"__f.{c}").alias(c) for c in FIRST_COLS],
        "first_seen", "last_seen", "first_run", "last_run",
        F.lit("open").alias("status"), F.lit(None).cast("string").alias("status_note"),
        F.lit(None).cast("timestamp").alias("status_changed_at"), "resolved_at")


def apply_runs(state: DataFrame, rows: DataFrame, scanned: DataFrame, order: str = "ord",
               flags: bool = False) -> DataFrame:
    """Set-based form of ``ingest_run`` applied to every new run in
    run_key order, on top of an existing ``state``, in one pass.

    * keys only in ``state``: unchanged, except that an open one whose image
      is scanned by any new run is resolved at the first such run;
    * keys only in the new runs: as ``replay_runs``;
    * keys in both: first_seen, first_run, status, note and descriptive
      fields stay; last_seen / last_run / severity / fix follow the new runs;
      resolved_at is the next scan of the image after the key's last new run.

    Equal to looping ``ingest_run`` over the runs (tested), at the cost of
    one aggregation and one full outer join instead of one per run. With
    ``flags`` a row tells whether its key is an old one (``_old``) and when it
    was resolved before (``_was``).
    """
    new = replay_runs(rows, scanned, order, dealt=True)
    first_scan = scanned.groupBy("image").agg(F.min("started_at").alias("__first_scan"))
    s = _by_image(deal(state), first_scan)      # resolves only what the state holds
    s = s.select(*[F.col(c).alias(f"s_{c}") for c in s.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    cond = None
    for k in DEALT:
        c = F.col(f"s_{k}") == F.col(f"n_{k}")
        cond = c if cond is None else cond & c
    j = s.join(n, cond, "full_outer").withColumnRenamed("s___first_scan", "__first_scan")
    in_s, in_n = F.col("s_image").isNotNull(), F.col("n_image").isNotNull()

    def pick(c, from_state_when_both: bool):
        sc, nc = F.col(f"s_{c}"), F.col(f"n_{c}")
        return F.when(~in_s, nc).when(~in_n, sc).otherwise(sc if from_state_when_both else nc)

    out = [F.coalesce(F.col(f"s_{k}"), F.col(f"n_{k}")).alias(k) for k in FINDING_KEY]
    keep_state = ["title", "purl", "target", "pkg_class", "first_seen", "first_run", "status",
                  "status_note", "status_changed_at"]
    for c in state.columns:
        if c in DEALT:
            continue
        if c == "resolved_at":
            e = (F.when(~in_s, F.col("n_resolved_at"))
                 .when(~in_n, F.coalesce(F.col("s_resolved_at"), F.col("__first_scan")))
                 .otherwise(F.col("n_resolved_at")))
        else:
            e = pick(c, c in keep_state)
        out.append(e.cast(state.schema[c].dataType).alias(c))
    if flags:
        out += [in_s.alias("_old"), F.col("s_resolved_at").alias("_was")]
    return j.select(*out)
