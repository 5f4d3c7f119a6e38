"""Detections on and next to each threshold, with an explicit clock."""
from __future__ import annotations

from conftest import AS_OF, ago, dns_rows, domain_rows, known_bad_rows

from nightjar.plans import detections as d


def _spike_rows(spark, baseline, last, blocked=True, status=None, name=None):
    rows = [dict(ts=ago(days=4, minutes=i), qname="tracker.example.com", blocked=blocked,
                 status=status, client_name=name) for i in range(baseline)]
    rows += [dict(ts=ago(hours=1, minutes=i), qname="tracker.example.com", blocked=blocked,
                  status=status, client_name=name) for i in range(last)]
    return dns_rows(spark, [{k: v for k, v in r.items() if v is not None} for r in rows])


def test_blocked_spike_at_its_thresholds(spark):
    # floor 20 in the last day, and three times the daily average of the week before
    cases = {(0, 19): 0, (0, 20): 1, (49, 21): 1, (49, 20): 0, (50, 21): 0}
    for (baseline, last), fires in cases.items():
        assert d.blocked_spike(_spike_rows(spark, baseline, last), AS_OF).count() == fires, (baseline, last)
    got = d.blocked_spike(_spike_rows(spark, 49, 21, name="printer-2"), AS_OF).first()["summary"]
    assert got == "21 blocked queries in the last 24h vs a 7.0/day average over the prior week, device printer-2"


def test_window_boundaries(spark):
    rows = [dict(ts=ago(hours=24), qname="x.com", blocked=True)] * 1 + \
           [dict(ts=ago(days=8), qname="x.com", blocked=True)]
    q = dns_rows(spark, rows)
    got = d.blocked_spike(q, AS_OF, floor=1, multiple=7).collect()
    # exactly as_of-24h is in the last day; exactly as_of-8d is baseline (1/7 per day)
    assert got[0]["summary"].startswith("1 blocked queries in the last 24h vs a 0.1/day")


def test_dga_entropy_at_its_thresholds(spark):
    rows = [("q7w2e9r4t1y8.top", 3.5), ("q7w2e9r4t1y.top", 3.49999999999999), ("r4t1y8q7.top", 3.5), ("r4t1y8q.top", 9.0)]
    q = dns_rows(spark, [dict(ts=ago(hours=1), qname=n, registrable_domain=n, label_entropy=e) for n, e in rows])
    got = {r["entity"]: r["summary"] for r in d.dga_entropy(q).collect()}
    assert set(got) == {"q7w2e9r4t1y8.top", "r4t1y8q7.top"}        # 12 characters and 3.5 bits are enough
    assert got["r4t1y8q7.top"] == "max entropy 3.50 bits/char, e.g. r4t1y8q7.top, 1 query from 1 client"


def test_known_bad(spark):
    q = dns_rows(spark, [
        dict(ts=ago(hours=1), qname="www.evil.example", registrable_domain="evil.example", blocked=True),
        dict(ts=ago(hours=2), qname="cdn.evil.example", registrable_domain="evil.example"),
        dict(ts=ago(hours=1), qname="bad.host.example.org", registrable_domain="example.org"),
        dict(ts=ago(hours=1), qname="fine.example.net", registrable_domain="example.net")])
    kb = known_bad_rows(spark, [("evil.example", "list-x"), ("evil.example", "other"),
                                ("bad.host.example.org", "list-x")])
    got = {r["entity"]: r["summary"] for r in d.known_bad(q, kb).collect()}
    assert got["evil.example"] == ("listed by list-x, other: 2 queries from 1 client, "
                                   "1 blocked / 1 NOT blocked")
    assert got["bad.host.example.org"].endswith("1 query from 1 client, 0 blocked / 1 NOT blocked")
    assert "example.net" not in got


def test_newly_seen(spark):
    reg = domain_rows(spark, [dict(domain="new.example", first_seen=ago(hours=2)),
                              dict(domain="old.example", first_seen=ago(days=30), last_seen=ago(hours=1))])
    q = dns_rows(spark, [dict(ts=ago(hours=2), qname="new.example")])
    got = d.newly_seen(reg, q, AS_OF).collect()
    assert [r["entity"] for r in got] == ["new.example"]
    assert got[0]["summary"] == "first seen 2026-08-15 10:00, 1 query from 1 client, 0 blocked"


def test_newly_seen_counts_zero_clients_after_prune(spark):
    reg = domain_rows(spark, [dict(domain="gone.example", first_seen=ago(hours=3), query_count=4)])
    got = d.newly_seen(reg, dns_rows(spark, [dict(ts=ago(hours=1), qname="x.com")]), AS_OF).collect()
    assert got[0]["summary"] == "first seen 2026-08-15 09:00, 4 queries from 0 clients, 0 blocked"


def test_nxdomain_burst(spark):
    def rows(base, last, blocked=False):
        return _spike_rows(spark, base, last, blocked=blocked, status="NXDOMAIN")
    cases = {(0, 29): 0, (0, 30): 1, (70, 30): 1, (71, 30): 0, (77, 33): 1}     # floor 30, three times the average
    for (base, last), fires in cases.items():
        assert d.nxdomain_burst(rows(base, last), AS_OF).count() == fires, (base, last)
    assert d.nxdomain_burst(rows(0, 90, blocked=True), AS_OF).count() == 0


def test_tunnel_volume(spark):
    def rows(n, e):
        return dns_rows(spark, [dict(ts=ago(hours=1), qname=f"n{i}.t.example", registrable_domain="t.example",
                                     label_entropy=e) for i in range(n)])
    got = d.tunnel_volume(rows(50, 3.0), AS_OF).collect()
    assert got[0]["summary"] == "50 distinct names in 24h, avg entropy 3.00 bits/char, 1 client"
    assert d.tunnel_volume(rows(49, 3.9), AS_OF).count() == 0
    assert d.tunnel_volume(rows(80, 2.99), AS_OF).count() == 0
