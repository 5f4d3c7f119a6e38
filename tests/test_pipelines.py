"""End-to-end jobs on a table store: scan runs, DNS file, feeds, rules, report."""
from __future__ import annotations

import json

import pytest

from test_sources import write_run

from nightjar.plans import engine, pipelines
from nightjar.plans.testviews import suffix_rules
from nightjar.sources.store import TableStore


def test_scan_to_report_and_dns_rules(spark, tmp_path):
    runs = tmp_path / "runs"
    write_run(runs, bad_run=False)
    store = TableStore(spark, str(tmp_path / "store"))
    out = pipelines.ingest_scan_runs(store, str(runs), per_run=True)
    assert out[0]["inserted"] == 6 and out[0]["images"] == 4
    assert pipelines.ingest_scan_runs(store, str(runs)) == []          # known run: nothing to do
    (tmp_path / "exp.json").write_text("\n".join(json.dumps(r) for r in [
        {"image": "gate:7", "exposure": "tailnet"}, {"image": "mill:3", "exposure": "internal"}]))
    unmapped = [r["image"] for r in pipelines.load_exposure(store, str(tmp_path / "exp.json"),
                                                            "2026-01-02 00:00:00").collect()]
    assert unmapped == ["forge:0"]
    rep = pipelines.report(store)
    assert rep["headline"].first()["fixable"] == 5
    assert rep["backlog"].first()["priority"] == 1160

    rules = suffix_rules(spark)
    pages = tmp_path / "pages"
    pages.mkdir()
    for n, names in enumerate((["a.example.com", "b.example.org"], ["q7w2e9r4t1y8.top"])):
        page = {"data": [{"time": f"2026-08-15T0{7 + n}:{m:02d}:00Z", "client": "10.0.0.9",
                          "question": {"name": name, "type": "A"}, "reason": "NotFilteredNotFound"}
                         for m, name in enumerate(names)]}
        (pages / f"log{n}.json").write_text(json.dumps(page))
    r1 = pipelines.ingest_dns_files(store, str(pages), rules, as_of="2030-01-01 00:00:00", shift_to_now=True)
    assert [(r["run_key"], r["inserted"], r["new_domains"]) for r in r1] == [("log0.json", 2, 2), ("log1.json", 1, 1)]
    assert all(r["skipped"] for r in pipelines.ingest_dns_files(store, str(pages), rules, as_of="2030-01-01 00:00:00"))
    res = pipelines.run_rule_engine(store, as_of="2030-01-01 00:00:00")
    got = {r["rule_id"]: r["hits"] for r in res.results.collect()}
    assert got["dns_newly_seen_domain"] == 3 and got["dns_dga_entropy"] == 1
    t = engine.run_totals(res.results).first()
    assert t["rules"] == 6 and t["failed"] == 0 and t["hits"] == 4


def test_enrich_isolates_blocklists_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    write_run(tmp_path / "runs", bad_run=False)
    pipelines.ingest_scan_runs(store, str(tmp_path / "runs"))
    (tmp_path / "kev.json").write_text('{"vulnerabilities": [{"cveID": "CVE-2031-0001", "dateAdded": "2025-01-01"}]}')
    (tmp_path / "epss.csv").write_text("cve,epss,percentile\nCVE-2031-0002,0.3,0.9\nCVE-9,0.1,0.1\n")
    (tmp_path / "hosts").write_text("0.0.0.0 bad.example\n")
    out = pipelines.enrich(store, str(tmp_path / "kev.json"), str(tmp_path / "epss.csv"),
                           {"one": str(tmp_path / "hosts"), "two": str(tmp_path / "nowhere")}, "2026-01-01 00:00:00")
    assert (out["kev"], out["epss"], out["one"]) == (1, 1, 1) and list(out["failed"]) == ["two"]
    with pytest.raises(Exception):
        pipelines.enrich(store, str(tmp_path / "nothing.json"), str(tmp_path / "epss.csv"), {})


def test_backfill_in_one_pass_equals_per_run(spark, tmp_path):
    runs = tmp_path / "runs"
    write_run(runs, bad_run=False)
    second = runs / "20251110-041500"
    second.mkdir()
    (second / "gate.json").write_text(json.dumps({"ArtifactName": "gate:7", "Results": [
        {"Target": "base", "Class": "os-pkgs", "Vulnerabilities": [
            {"VulnerabilityID": "CVE-2031-0001", "PkgName": "alpha", "InstalledVersion": "1.1",
             "Severity": "CRITICAL", "FixedVersion": "1.3"}]}]}))
    a = TableStore(spark, str(tmp_path / "a"))
    b = TableStore(spark, str(tmp_path / "b"))
    one = pipelines.ingest_scan_runs(a, str(runs))[0]
    assert (one["runs"], one["images"], one["inserted"], one["findings"]) == (2, 5, 6, 6)
    per = pipelines.ingest_scan_runs(b, str(runs), per_run=True)
    assert [(r["inserted"], r["updated"], r["resolved"]) for r in per] == [(6, 0, 0), (0, 1, 2)]
    ka = sorted(map(tuple, a.read("vuln_finding").collect()))
    kb = sorted(map(tuple, b.read("vuln_finding").collect()))
    assert ka == kb
    assert sum(1 for r in ka if r[-1] is not None) == 2       # gate's two other findings resolved


def test_a_folder_in_one_batch_equals_file_by_file(spark, tmp_path):
    """U-1, U-5..U-7: entries of several files, rejects, late rows, and files that come later."""
    rules, as_of = suffix_rules(spark), "2026-08-15 12:00:00"
    pages = tmp_path / "pages"
    pages.mkdir()

    def page(name, entries):
        (pages / name).write_text(json.dumps({"data": [
            {"time": t, "client": "10.0.0.9", "question": {"name": n, "type": "A"}, "reason": "FilteredBlackList"}
            for t, n in entries]}))

    page("log0.json", [("2026-08-15T07:00:00Z", "a.example.com"), ("2026-08-15T07:01:00Z", "b.example.org"), ("bad", "c.com")])
    page("log1.json", [("2026-08-15T07:01:00Z", "b.example.org"), ("2026-08-15T08:00:00Z", "d.example.net"),
                       ("2026-08-15T08:00:00Z", "d.example.net"), ("2026-06-01T08:00:00Z", "old.example.io")])
    page("log2.json", [])

    def state(st):
        return {t: sorted(map(str, st.read(t).collect())) for t in ("dns_query", "dns_domain", "scan_run", "dns_hourly")}

    a, b = TableStore(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "b"))
    for later in (False, True):
        if later:
            page("log3.json", [("2026-08-15T07:00:00Z", "a.example.com"), ("2026-08-15T11:00:00Z", "e.example.com")])
        one = pipelines.ingest_dns_folder(a, str(pages), rules, as_of=as_of, rollup=True)
        each = pipelines.ingest_dns_files(b, str(pages), rules, as_of=as_of, rollup=True)
        assert one == each and state(a) == state(b)
    assert [(r["skipped"], r.get("inserted")) for r in one] == [(True, None)] * 3 + [(False, 1)]
    assert a.read("dns_query").count() == 4
    c, d = TableStore(spark, str(tmp_path / "c")), TableStore(spark, str(tmp_path / "d"))
    how = dict(as_of=as_of, shift_to_now=True)
    assert pipelines.ingest_dns_folder(c, str(pages), rules, **how) == pipelines.ingest_dns_files(d, str(pages), rules, **how)
    assert sorted(map(str, c.read("dns_query").collect())) == sorted(map(str, d.read("dns_query").collect()))


def test_rules_over_a_store_with_counters(spark, tmp_path):
    """A-3: with hourly counters in the store the baseline rules give the same hits."""
    from nightjar.plans import engine
    rules, pages = suffix_rules(spark), tmp_path / "pages"
    pages.mkdir()
    day = ["2026-08-15T%02d:%02d:00Z", "2026-08-14T%02d:%02d:30Z", "2026-08-10T%02d:%02d:00Z"]
    entries = [{"time": day[k] % (h, m), "client": f"10.0.0.{h % 3}", "question": {"name": f"x{m}.example.com", "type": "A"},
                "reason": "FilteredBlackList" if m % 2 else "NotFilteredNotFound", "status": "NXDOMAIN"}
               for k in range(3) for h in range(24) for m in range(0, 60, 7 + 9 * k)]
    (pages / "log.json").write_text(json.dumps({"data": entries}))
    hits = []
    for rollup in (False, True):
        st = TableStore(spark, str(tmp_path / f"s{rollup}"))
        pipelines.ingest_dns_folder(st, str(pages), rules, as_of="2026-08-15 12:30:00", rollup=rollup)
        some = [r for r in engine.builtin_rules(engine.RuleParams(spike_floor=2, nx_floor=2, spike_multiple=1, nx_multiple=1))
                if r.id in ("dns_blocked_spike", "dns_nxdomain_burst")]
        pipelines.run_rule_engine(st, some, as_of="2026-08-15 12:30:00")
        hits.append(sorted((r.rule_id, r.entity, r.summary) for r in st.read("rule_hit").collect()))
        assert st.has("dns_hourly") == rollup
    assert hits[0] == hits[1] and len(hits[0]) >= 4
