"""File sources on fixtures written here, end to end to the ranked backlog."""
from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import feeds as feedops
from nightjar.operators import findings
from nightjar.plans import pipelines, ranking
from nightjar.plans.testviews import suffix_rules
from nightjar.sources import dnslog, feeds, reports
from nightjar.sources.store import TableStore

T = "2026-01-01 12:00:00"


def _vuln(cve, pkg, inst, fix, sev, title="t"):
    v = {"VulnerabilityID": cve, "PkgName": pkg, "InstalledVersion": inst, "Severity": sev,
         "Title": title, "PkgIdentifier": {"PURL": f"pkg:deb/{pkg}@{inst}"}}
    if fix is not None:
        v["FixedVersion"] = fix
    return v


STAMP = "20251103-041500"


def write_run(root, bad_run=True):
    run = root / STAMP
    run.mkdir(parents=True)
    docs = {
        "gate.json": {"ArtifactName": "gate:7", "Results": [
            {"Target": "base", "Class": "os-pkgs", "Vulnerabilities": [
                _vuln("CVE-2031-0001", "alpha", "1.1", "1.2", "CRITICAL"),
                _vuln("CVE-2031-0002", "beta", "4.0", "4.1", "HIGH"),
                _vuln("CVE-2031-0003", "gamma", "9", "  ", "HIGH")]},
            {"Target": "app", "Class": "lang-pkgs", "Vulnerabilities": None}]},
        "mill.json": {"ArtifactName": "mill:3", "Results": [
            {"Target": "base", "Class": "os-pkgs", "Vulnerabilities": [
                _vuln("CVE-2031-0002", "beta", "4.0", "4.1", "HIGH"),
                _vuln("CVE-2031-0004", "delta", "2.5", "2.6", "MEDIUM")]}]},
        "forge.json": {"ArtifactName": "forge:0", "Results": [
            {"Target": "base", "Class": "os-pkgs", "Vulnerabilities": [
                _vuln("CVE-2031-0005", "epsilon", "0.3", "0.4", "CRITICAL")]}]},
        "bare.json": {"ArtifactName": "", "Results": None},
    }
    for name, doc in docs.items():
        (run / name).write_text(json.dumps(doc))
    if not bad_run:
        return
    bad = root / "latest"
    bad.mkdir()
    (bad / "x.json").write_text(json.dumps({"ArtifactName": "x", "Results": []}))


def test_report_runs_to_ranked_backlog(spark, tmp_path):
    write_run(tmp_path, bad_run=False)
    rows, scanned, runs = reports.read_runs(spark, str(tmp_path))
    assert runs.first()["images"] == 4
    assert {r["image"] for r in scanned.collect()} == {"gate:7", "mill:3", "forge:0", "bare"}
    res = findings.ingest_run(schemas.empty(spark, "vuln_finding"), rows, scanned, STAMP, T)
    exposure = spark.createDataFrame(
        [("gate:7", "public", None), ("gate:7", "tailnet", None), ("mill:3", "internal", None),
         ("forge:0", "build-only", "ci")], "image string, exposure string, note string").coalesce(1)
    expo = feedops.upsert_exposure(schemas.empty(spark, "image_exposure"), exposure, T)
    pr = ranking.vuln_priority(res.state, expo, schemas.empty(spark, "kev"), schemas.empty(spark, "epss_score"))
    got = sorted(((r["image"], r["cve"][-1], r["priority"]) for r in pr.collect()), key=lambda x: (-x[2], x[1], x[0]))
    assert got == [("gate:7", "1", 1160), ("gate:7", "2", 1140), ("mill:3", "2", 1080), ("mill:3", "4", 1060),
                   ("forge:0", "5", 1040), ("gate:7", "3", 140)]
    h = ranking.headline(pr).first()
    assert (h["fixable"], h["unfixable"], h["in_kev"], h["epss_hot"]) == (5, 1, 0, 0)
    top = ranking.backlog_top(pr, 25).collect()
    assert top[-1]["version_change"] == "9 (no fix)" and top[0]["version_change"] == "1.1 -> 1.2"


def test_known_runs_are_not_read(spark, tmp_path):
    write_run(tmp_path, bad_run=False)
    (tmp_path / STAMP / "gate.json").write_text("{ not json")
    assert reports.read_runs(spark, str(tmp_path), known={STAMP}) is None


def test_unreadable_runs_are_refused(spark, tmp_path):
    write_run(tmp_path / "a")
    with pytest.raises(ValueError, match="latest"):
        reports.read_runs(spark, str(tmp_path / "a"))
    (tmp_path / "b" / STAMP).mkdir(parents=True)
    with pytest.raises(ValueError, match="without any report"):
        reports.read_runs(spark, str(tmp_path / "b"))
    for n, text in enumerate(('{"ArtifactName": "gate:7", "Results": [{"Target": "ba', "")):
        write_run(tmp_path / f"c{n}", bad_run=False)
        (tmp_path / f"c{n}" / STAMP / "gate.json").write_text(text)
        store = TableStore(spark, str(tmp_path / f"store{n}"))
        with pytest.raises(Exception):
            pipelines.ingest_scan_runs(store, str(tmp_path / f"c{n}"))
        assert store.read("scan_run").count() == 0 and store.read("vuln_finding").count() == 0


def test_truncated_pages_and_feeds_are_refused(spark, tmp_path):
    page, store = tmp_path / "page.json", TableStore(spark, str(tmp_path / "store"))
    for text in ('{"data": [{"time": "2026-08-15T07:00:00Z", "cli', '{"oldest": ""}'):
        page.write_text(text)
        with pytest.raises(Exception):
            pipelines.ingest_dns_file(store, str(page), suffix_rules(spark), as_of=T)
        assert store.read("scan_run").count() == 0
    page.write_text('{"data": [{"time": "2025-12-31T07:00:00Z", "client": "c", "question": {"name": "a.example.com"}}]}')
    assert pipelines.ingest_dns_file(store, str(page), suffix_rules(spark), as_of=T)["inserted"] == 1
    for text in ('{"vulnerabilities": [{"cveID": "CVE-1"', "{}"):
        (tmp_path / "kev.json").write_text(text)
        with pytest.raises(Exception):
            feeds.read_kev(spark, str(tmp_path / "kev.json")).collect()
    (tmp_path / "epss.csv").write_text("percentile,cve,epss\n0.9,CVE-1,0.2\n")
    row = feeds.read_epss(spark, str(tmp_path / "epss.csv")).first()
    assert (row["cve"], float(row["score"]), float(row["percentile"])) == ("CVE-1", 0.2, 0.9)
    (tmp_path / "epss.csv").write_text("cve,percentile\nCVE-1,0.2\n")
    with pytest.raises(ValueError, match="epss"):
        feeds.read_epss(spark, str(tmp_path / "epss.csv"))
    (tmp_path / "exp.csv").write_text("note,image,exposure\n,web,publik\n")
    with pytest.raises(ValueError, match="publik"):
        feeds.read_exposure(spark, str(tmp_path / "exp.csv"))


def test_dns_page_file(spark, tmp_path):
    page = {"data": [
        {"time": "2026-08-15T07:00:55.123456-04:00", "client": "10.0.0.5", "client_info": {"name": "phone"},
         "question": {"name": "Q7W2E9R4T1Y8.top.", "type": "A"}, "reason": "NotFilteredNotFound",
         "status": "NOERROR", "upstream": "9.9.9.9:53", "cached": False, "elapsedMs": "12.5"},
        {"time": "bad", "client": "10.0.0.5", "question": {"name": "a.com", "type": "A"}},
        {"time": "2026-08-15T07:01:00Z", "client": "10.0.0.6", "question": {"name": "."},
         "reason": "FilteredBlackList", "elapsedMs": 3},
        {"time": "2026-08-15T07:02:00Z", "question": {"name": "ads.example.com", "type": "AAAA"},
         "reason": "FilteredBlackList", "client_info": {"name": ""}}], "oldest": ""}
    f = tmp_path / "querylog.json"
    f.write_text(json.dumps(page))
    from nightjar.functions import normalize
    ent = dnslog.read_pages(spark, str(f))
    m = normalize.map_dns_entries(ent, suffix_rules(spark), keep=["run_key", "ord"])
    rows = {r["ord"]["pos"]: r for r in m.collect()}
    assert rows[0]["valid"] and rows[0]["qname"] == "q7w2e9r4t1y8.top" and rows[0]["client_name"] == "phone"
    assert str(rows[0]["ts"]) == "2026-08-15 11:00:55.123456" and float(rows[0]["elapsed_ms"]) == 12.5
    assert rows[1]["reject_reason"] == "bad_time" and rows[2]["reject_reason"] == "no_name"
    assert rows[3]["blocked"] and rows[3]["client"] == "" and rows[3]["client_name"] is None
    assert rows[3]["registrable_domain"] == "example.com" and rows[0]["run_key"] == "querylog.json"


def test_feed_files(spark, tmp_path):
    kev = {"vulnerabilities": [
        {"cveID": "CVE-1", "vendorProject": "v", "product": "p", "dateAdded": "2024-01-02", "dueDate": "",
         "knownRansomwareCampaignUse": "Known"},
        {"cveID": "CVE-2", "vendorProject": "v", "product": "p", "dateAdded": "2024-01-03",
         "dueDate": "2024-02-01", "knownRansomwareCampaignUse": None},
        {"cveID": None}]}
    (tmp_path / "kev.json").write_text(json.dumps(kev))
    k = {r["cve"]: r for r in feeds.read_kev(spark, str(tmp_path / "kev.json")).collect()}
    assert set(k) == {"CVE-1", "CVE-2"} and k["CVE-1"]["due_date"] is None
    assert k["CVE-1"]["known_ransomware"] is True and k["CVE-2"]["known_ransomware"] is False
    with gzip.open(tmp_path / "epss.csv.gz", "wt") as fh:
        fh.write("#model_version:v2025,score_date:2026-08-14T00:00:00+0000\ncve,epss,percentile\n"
                 "CVE-1,0.100000,0.9\nCVE-2,0.0001,0.1\n,0.5,0.5\n")
    e = {r["cve"]: r for r in feeds.read_epss(spark, str(tmp_path / "epss.csv.gz")).collect()}
    assert set(e) == {"CVE-1", "CVE-2"} and str(e["CVE-1"]["model_date"]) == "2026-08-14"
    (tmp_path / "hosts.txt").write_text("# comment\n\n127.0.0.1\tEvil.Example.\n127.0.0.1 evil.example\n"
                                        "lonely\n0.0.0.0   other.test\n")
    assert sorted(r[0] for r in feeds.read_hostfile(spark, str(tmp_path / "hosts.txt")).collect()) == \
        ["evil.example", "other.test"]
    (tmp_path / "exp.csv").write_text("image,exposure,note\nweb,tailnet,x\nold,,\n")
    ex = {r["image"]: r["exposure"] for r in feeds.read_exposure(spark, str(tmp_path / "exp.csv")).collect()}
    assert ex == {"web": "tailnet", "old": "unknown"}


def test_feed_state_rules(spark):
    T2 = "2026-02-01 00:00:00"
    rows1 = spark.createDataFrame([(1, "CVE-1", "v", "p", None, None, False)],
                                  "ord int, cve string, vendor_project string, product string, "
                                  "date_added date, due_date date, known_ransomware boolean")
    s1 = feedops.upsert_kev(schemas.empty(spark, "kev"), rows1, T)
    rows2 = rows1.select("ord", "cve", F.lit("NEW").alias("vendor_project"), "product", "date_added",
                         F.to_date(F.lit("2026-03-01")).alias("due_date"), F.lit(True).alias("known_ransomware"))
    s2 = feedops.upsert_kev(s1, rows2, T2).first()
    assert s2["vendor_project"] == "v" and str(s2["due_date"]) == "2026-03-01" and s2["known_ransomware"]
    ep = spark.createDataFrame([(1, "CVE-1", "0.100000", "0.5")], "ord int, cve string, epss string, percentile string")
    erows = feedops.epss_rows(ep, "2026-01-01")
    st, loaded = feedops.upsert_epss(schemas.empty(spark, "epss_score"), erows, T,
                                     findings=schemas.empty(spark, "vuln_finding"))
    assert st.count() == 0 and loaded.count() == 0
    st, _ = feedops.upsert_epss(schemas.empty(spark, "epss_score"), erows, T)
    fnd = spark.createDataFrame([("img", "p", "1", "CVE-1", "LOW", "2", None, None, None, None, None, None,
                                  None, None, "open", None, None, None)], schemas.VULN_FINDING)
    pr = ranking.vuln_priority(fnd, schemas.empty(spark, "image_exposure"), schemas.empty(spark, "kev"), st)
    assert pr.first()["priority"] == 1000 + 250 + 30
    kb = spark.createDataFrame([("a.test", "s1", None), ("b.test", "s1", None), ("a.test", "s2", None)],
                               schemas.KNOWN_BAD)
    new = feedops.replace_source(kb, spark.createDataFrame([("c.test",)], "domain string"), "s1", T)
    assert sorted((r["domain"], r["source"]) for r in new.collect()) == [("a.test", "s2"), ("c.test", "s1")]


def _line(run, image, part, target, kind, cve):
    return run, image, part, target, kind, cve, "p", "1", None, None, 'a "b"', ("pkg:x@1",)


LINES = "run_key string, ArtifactName string, part long, Target string, Class string, VulnerabilityID string, PkgName string, " \
        "InstalledVersion string, FixedVersion string, Severity string, Title string, PkgIdentifier struct<PURL: string>"


@pytest.mark.parametrize("batch", ["1", "2", "10000"])
def test_runs_are_written_as_their_lines_come(spark, tmp_path, batch):
    """A document may come in many batches, and a batch hold many documents."""
    a, b = "20250101-000000", "20250102-000000"
    lines = [_line(a, "x/y:1", 1, "t", "c", "1"), _line(a, "x/y:1", 1, "t", "c", "2"), _line(a, "x/y:1", 1, "u\"", None, "3"),
             _line(a, "x/y:1", 2, "u\"", None, "4"), _line(a, "x/y:1", None, "u\"", None, "5"), _line(a, "_z", None, None, None, "6"),
             _line(a, None, None, None, None, "7"), _line(b, None, None, None, None, "8"), _line(b, "é", 0, "", "", "9")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert reports.write_runs(spark.createDataFrame(lines, LINES).coalesce(1), f"file:{tmp_path}") == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {f"{p.parent.name}/{p.name}": json.loads(p.read_text(encoding="utf-8")) for p in tmp_path.glob("*/*")}

    def v(cve):
        return {"VulnerabilityID": cve, "PkgName": "p", "InstalledVersion": "1", "Title": 'a "b"', "PkgIdentifier": {"PURL": "pkg:x@1"}}

    assert got == {
        f"{a}/x%2Fy%3A1.json": {"ArtifactName": "x/y:1", "Results": [
            {"Target": "t", "Class": "c", "Vulnerabilities": [v("1"), v("2")]}, {"Target": "u\"", "Vulnerabilities": [v("3")]},
            {"Target": "u\"", "Vulnerabilities": [v("4")]}, {"Target": "u\"", "Vulnerabilities": [v("5")]}]},
        f"{a}/%5Fz.json": {"ArtifactName": "_z", "Results": [{"Vulnerabilities": [v("6")]}]},
        f"{a}/+unnamed.json": {"Results": [{"Vulnerabilities": [v("7")]}]},
        f"{b}/+unnamed.json": {"Results": [{"Vulnerabilities": [v("8")]}]},
        f"{b}/é.json".replace("é", "%C3%A9"): {"ArtifactName": "é", "Results": [{"Target": "", "Class": "", "Vulnerabilities": [v("9")]}]}}
    rows, scanned, runs = reports.read_runs(spark, str(tmp_path))
    assert sorted(r.cve for r in rows.collect()) == list("123456789")
    assert {(r.run_key, r.images) for r in runs.collect()} == {(a, 3), (b, 2)}
    assert {r.image for r in scanned.collect()} == {"x/y:1", "_z", "+unnamed", "é"}


def test_reports_in_no_run_and_reports_apart_refuse_the_write(spark, tmp_path):
    for lines, why in (([_line(None, "x", 1, "t", "c", "1")], "no run"),
                       ([_line(STAMP, n, 1, "t", "c", "1") for n in "xyx"], "apart")):
        with pytest.raises(Exception, match=why):
            reports.write_runs(spark.createDataFrame(lines, LINES).coalesce(1), str(tmp_path))


def test_reports_are_read_alike_from_stores_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    write_run(tmp_path, bad_run=False)
    run = tmp_path / STAMP
    for name, coding in (("wide.json", "utf-16"), ("marked.json", "utf-8-sig"), ("odd #1 é%20[x].json", "utf-32-be")):
        run.joinpath(name).write_bytes(json.dumps({"Results": [{"Target": "é", "Vulnerabilities": [
            _vuln("CVE-2031-0009", "zeta", "1", "2", "LOW")]}]}, ensure_ascii=False).encode(coding))
    run.joinpath(".hidden").write_text("{")

    def read():
        rows, scanned, runs = reports.read_runs(spark, str(tmp_path))
        return [sorted(map(repr, df.collect())) for df in (rows, scanned, runs)], reports.list_runs(spark, str(tmp_path))

    got = read()
    monkeypatch.setattr(reports, "_known", lambda path: False)
    assert got == read() and len(got[0][0]) == 9 and got[1][0][2] == 7
