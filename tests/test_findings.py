"""Finding state: duplicates within a run, resolve scope, reappearance, replay."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import findings

T1 = dt.datetime(2026, 1, 1, 12)
T2 = dt.datetime(2026, 1, 8, 12)
T3 = dt.datetime(2026, 1, 15, 12)
COLS = ("run_key string, started_at timestamp, ord int, image string, pkg_name string, "
        "installed_version string, cve string, severity string, fixed_version string, title string, "
        "purl string, target string, pkg_class string")


def rows(spark, data):
    return spark.createDataFrame(data, COLS)


def f(run, t, o, img, pkg, cve, sev="HIGH", fix=None, title="t"):
    return (run, t, o, img, pkg, "1.0", cve, sev, fix, title, None, "tgt", "os-pkgs")


def state_map(df):
    return {(r["image"], r["pkg_name"], r["cve"]): r for r in df.collect()}


def test_duplicate_key_in_one_run(spark):
    r = rows(spark, [f("r1", T1, 1, "img", "p", "CVE-1", "LOW", None, "first title"),
                     f("r1", T1, 2, "img", "p", "CVE-1", "CRITICAL", "2.0", "second title")])
    res = findings.ingest_run(schemas.empty(spark, "vuln_finding"), r, r.select("image"), "r1", T1)
    s = res.state.first()
    assert s["severity"] == "CRITICAL" and s["fixed_version"] == "2.0" and s["title"] == "first title"
    m = res.metrics.first()
    assert (m["images"], m["inserted"], m["updated"], m["resolved"]) == (1, 1, 1, 0)


def test_resolve_scope_and_return(spark):
    empty = schemas.empty(spark, "vuln_finding")
    r1 = rows(spark, [f("r1", T1, 1, "a", "p", "CVE-1"), f("r1", T1, 2, "a", "q", "CVE-2"),
                      f("r1", T1, 3, "b", "p", "CVE-3")])
    s1 = findings.ingest_run(empty, r1, r1.select("image"), "r1", T1).state
    # run 2 scans only image a, and q/CVE-2 is gone
    r2 = rows(spark, [f("r2", T2, 1, "a", "p", "CVE-1", "CRITICAL")])
    res2 = findings.ingest_run(s1, r2, r2.select("image"), "r2", T2)
    s2 = state_map(res2.state)
    assert s2[("a", "q", "CVE-2")]["resolved_at"] == T2
    assert s2[("b", "p", "CVE-3")]["resolved_at"] is None          # not scanned: untouched
    assert s2[("a", "p", "CVE-1")]["severity"] == "CRITICAL"
    assert res2.metrics.first()["resolved"] == 1
    # someone accepts CVE-2; it comes back in run 3
    s2df = res2.state.withColumn("status", F.when(F.col("cve") == "CVE-2", "accepted")
                                 .otherwise(F.col("status")))
    r3 = rows(spark, [f("r3", T3, 1, "a", "q", "CVE-2")])
    s3 = state_map(findings.ingest_run(s2df, r3, r3.select("image"), "r3", T3).state)
    back = s3[("a", "q", "CVE-2")]
    assert back["resolved_at"] is None and back["first_seen"] == T1 and back["status"] == "accepted"
    assert s3[("a", "p", "CVE-1")]["resolved_at"] == T3


def test_image_with_zero_findings_resolves_everything(spark):
    r1 = rows(spark, [f("r1", T1, 1, "a", "p", "CVE-1"), f("r1", T1, 2, "a", "q", "CVE-2")])
    s1 = findings.ingest_run(schemas.empty(spark, "vuln_finding"), r1, r1.select("image"), "r1", T1).state
    scanned = spark.createDataFrame([("a",)], "image string")
    res = findings.ingest_run(s1, rows(spark, []), scanned, "r2", T2)
    assert res.metrics.first()["resolved"] == 2
    assert all(r["resolved_at"] == T2 for r in res.state.collect())


def test_replay_equals_sequential_ingest(spark):
    data = [f("r1", T1, 1, "a", "p", "CVE-1", "LOW", None, "x"), f("r1", T1, 2, "a", "p", "CVE-1", "HIGH", "1", "y"),
            f("r1", T1, 3, "b", "p", "CVE-3"),
            f("r2", T2, 1, "a", "q", "CVE-2"), f("r2", T2, 2, "b", "p", "CVE-3", "CRITICAL"),
            f("r3", T3, 1, "a", "p", "CVE-1", "MEDIUM", None, "z")]
    all_rows = rows(spark, data)
    st = schemas.empty(spark, "vuln_finding")
    for run, t in [("r1", T1), ("r2", T2), ("r3", T3)]:
        cur = all_rows.filter(F.col("run_key") == run)
        st = findings.ingest_run(st, cur, cur.select("image"), run, t).state
    scanned = all_rows.select("run_key", "started_at", "image").distinct()
    rep = findings.replay_runs(all_rows, scanned)
    cols = schemas.VULN_FINDING.fieldNames()
    assert sorted(map(tuple, st.select(*cols).collect())) == sorted(map(tuple, rep.select(*cols).collect()))


def test_new_runs_and_envelope(spark):
    sr = schemas.empty(spark, "scan_run")
    runs = spark.createDataFrame([("20260101-120000", T1, 3)], "run_key string, started_at timestamp, images long")
    sr1 = findings.record_runs(sr, runs, T1)
    assert findings.new_runs(runs, sr1).count() == 0
    assert sr1.first()["images_total"] == 3


def test_apply_runs_on_existing_state_equals_loop(spark):
    T4 = dt.datetime(2026, 1, 22, 12)
    base = rows(spark, [f("r1", T1, 1, "a", "p", "CVE-1"), f("r1", T1, 2, "a", "q", "CVE-2"),
                        f("r1", T1, 3, "b", "p", "CVE-3"), f("r1", T1, 4, "c", "p", "CVE-4")])
    s0 = findings.ingest_run(schemas.empty(spark, "vuln_finding"), base, base.select("image"), "r1", T1).state
    s0 = s0.withColumn("status", F.when(F.col("cve") == "CVE-2", "accepted").otherwise(F.col("status")))
    later = rows(spark, [
        f("r2", T2, 1, "a", "p", "CVE-1", "LOW"),                     # a: q/CVE-2 disappears
        f("r3", T3, 1, "a", "q", "CVE-2", "CRITICAL", "9", "new title"),  # comes back
        f("r3", T3, 2, "a", "n", "CVE-9"),                             # new key; p/CVE-1 gone
        f("r4", T4, 1, "b", "z", "CVE-7")])                            # b scanned: CVE-3 resolved
    scanned = later.select("run_key", "started_at", "image").distinct()
    st = s0
    for run, t in [("r2", T2), ("r3", T3), ("r4", T4)]:
        cur = later.filter(F.col("run_key") == run)
        st = findings.ingest_run(st, cur, scanned.filter(F.col("run_key") == run), run, t).state
    one = findings.apply_runs(s0, later, scanned)
    cols = schemas.VULN_FINDING.fieldNames()
    assert sorted(map(tuple, st.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))
    got = state_map(one)
    assert got[("a", "q", "CVE-2")]["status"] == "accepted" and got[("a", "q", "CVE-2")]["title"] == "t"
    assert got[("c", "p", "CVE-4")]["resolved_at"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_and_batch_meet_without_another_shuffle(spark):
    """Rows are dealt once by image and part. What joined on an image, or on the state's image
    alone (null for new keys, all in one task), moved every row again."""
    r = rows(spark, [f(run, t, o, f"i{o % 5}", f"p{o}", f"CVE-{o % 7}") for run, t in (("r1", T1), ("r2", T2))
                     for o in range(40) if (o + t.day) % 3])
    old, new = r.filter("run_key = 'r1'"), r.filter("run_key = 'r2'")
    images = r.select("run_key", "started_at", "image").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = findings.replay_runs(old, images.filter("run_key = 'r1'"), dealt=True)
        scanned = images.filter("run_key = 'r2'")
        up = findings.upsert_findings(state, new, "r2", T2)
        done = findings.ingest_run(state, new, new.select("image"), "r2", T2).state
        both = findings.apply_runs(state, new, scanned)
        for df in (up, done, both, findings.replay_runs(r, images)):
            wide = [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning" in line
                    and any(c in line for c in ("pkg_name", "last_run", "s_image", "s__image"))]
            assert not wide, wide
        everything = {tuple(x) for x in findings.replay_runs(r, images).collect()}
        assert {tuple(x) for x in done.drop(findings.PART).collect()} == everything
        assert {tuple(x) for x in both.drop(findings.PART).collect()} == everything
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_image_is_dealt_among_tasks(spark):
    r = rows(spark, [f("r1", T1, o, "one", f"p{o}", "CVE-1") for o in range(400)])
    assert findings.deal(r).select(findings.PART).distinct().count() == findings.PARTS
    assert "__part" not in findings.replay_runs(r, r.select("run_key", "started_at", "image")).columns
