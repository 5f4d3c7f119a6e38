"""DNS store, registry, retention, cursor, rebase; streaming replay."""
from __future__ import annotations

import datetime as dt

from conftest import AS_OF, ago, dns_rows
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import dns
from nightjar.plans.testviews import suffix_rules


def _with_ord(df):
    return df.withColumn("ord", F.monotonically_increasing_id())


def test_overlap_does_not_inflate_registry(spark):
    a = _with_ord(dns_rows(spark, [dict(ts=ago(hours=h), qname="x.example") for h in (5, 4, 3)]))
    b = _with_ord(dns_rows(spark, [dict(ts=ago(hours=h), qname="x.example") for h in (3, 2, 2)]))
    store = schemas.empty(spark, "dns_query")
    reg = schemas.empty(spark, "dns_domain")
    new_a = dns.append_new(store, a)
    reg = dns.merge_registry(reg, new_a.drop("ord")).drop("_action")
    store = store.unionByName(new_a.drop("ord"))
    new_b = dns.append_new(store, b)
    assert new_b.count() == 1                         # ago(2h), once
    reg = dns.merge_registry(reg, new_b.drop("ord")).first()
    assert reg["query_count"] == 4 and reg["first_seen"] == ago(hours=5) and reg["last_seen"] == ago(hours=2)


def test_backfill_moves_first_seen_back_and_prune(spark):
    reg = spark.createDataFrame([("x.example", ago(days=1), ago(hours=1), 3, 0)], schemas.DNS_DOMAIN)
    old = dns_rows(spark, [dict(ts=ago(days=40), qname="x.example", blocked=True)])
    r = dns.merge_registry(reg, old).first()
    assert r["first_seen"] == ago(days=40) and r["query_count"] == 4 and r["blocked_count"] == 1
    store = dns.with_day(old.unionByName(dns_rows(spark, [dict(ts=ago(days=1), qname="x.example")])))
    assert dns.prune(store, AS_OF, 35).count() == 1
    assert dns.pruned_count(store, AS_OF, 35).first()["pruned"] == 1
    assert dns.prune(store, AS_OF, 0).count() == 0


def test_cursor_and_rebase(spark):
    store = dns_rows(spark, [dict(ts=ago(hours=3), qname="a.com")])
    rows = spark.createDataFrame([(ago(hours=4),), (ago(hours=1),), (None,)], "ts timestamp")
    assert dns.past_cursor(rows, store).count() == 2
    assert dns.past_cursor(rows, schemas.empty(spark, "dns_query")).count() == 3
    base = spark.createDataFrame([(dt.datetime(2020, 1, 1, 10),), (dt.datetime(2020, 1, 1, 12),), (None,)],
                                 "ts timestamp")
    got = [r["ts"] for r in dns.rebase(base, AS_OF).collect()]
    assert got == [AS_OF - dt.timedelta(hours=2), AS_OF, None]


def test_ingest_batch_metrics_and_idempotence(spark):
    from nightjar.functions import normalize
    ent = spark.createDataFrame(
        [(i, t, "10.0.0.1", None, (n, "A"), r, "NOERROR", None, None, "1")
         for i, (t, n, r) in enumerate([("2026-08-15T10:00:00Z", "a.example.com", "NotFilteredNotFound"),
                                        ("2026-08-15T10:00:00Z", "a.example.com", "NotFilteredNotFound"),
                                        ("2026-08-15T11:00:00Z", "b.example.org", "FilteredBlackList"),
                                        (None, "c.example.com", None),
                                        ("2026-06-01T00:00:00Z", "old.example.net", None)])],
        "ord int, time string, client string, client_info struct<name:string>, "
        "question struct<name:string,type:string>, reason string, status string, upstream string, "
        "cached boolean, elapsedMs string")
    m = normalize.map_dns_entries(ent, suffix_rules(spark), keep=["ord"])
    res = dns.ingest_batch(schemas.empty(spark, "dns_query"), schemas.empty(spark, "dns_domain"), m,
                           "r1", AS_OF, retention_days=35)
    mt = res.metrics.first()
    assert (mt["seen"], mt["inserted"], mt["duplicates"], mt["skipped_entries"], mt["new_domains"],
            mt["pruned"]) == (5, 3, 1, 1, 3, 1)
    stored = dns.prune(res.new_rows, AS_OF, 35)
    assert stored.count() == 2 and res.domains.count() == 3
    again = dns.ingest_batch(stored, res.domains, m, "r2", AS_OF, 35)
    assert again.metrics.first()["inserted"] == 1      # only the pruned old row comes back (T-6)


def test_stream_batch_replay_is_noop(spark, tmp_path):
    from nightjar.functions import normalize
    from nightjar.sources.store import TableStore
    from nightjar.streaming import dns_stream
    store = TableStore(spark, str(tmp_path / "store"))
    ent = spark.createDataFrame(
        [("2026-08-15T10:00:00Z", "10.0.0.1", None, ("a.example.com", "A"), "NotFilteredNotFound",
          "NOERROR", None, None, "1")], schemas.DNS_ENTRY)
    batch = normalize.map_dns_entries(ent, suffix_rules(spark))
    assert dns_stream.process_batch(store, batch, "stream-0", AS_OF) is True
    assert dns_stream.process_batch(store, batch, "stream-0", AS_OF) is False
    assert dns_stream.process_batch(store, batch, "stream-1", AS_OF) is True
    assert store.read("dns_query").count() == 1
    assert store.read("dns_domain").first()["query_count"] == 1
    assert store.read("scan_run").count() == 2


def _store(spark, tmp_path):
    from nightjar.sources.store import TableStore
    return TableStore(spark, str(tmp_path / "s"))


def _domains(spark, *names):
    return spark.createDataFrame([(n, AS_OF, AS_OF, 1, 0) for n in names], schemas.DNS_DOMAIN)


def _append(st, run, table, rows):
    with st.run(run):
        return st.append(table, rows)


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


def test_store_replaces_appends_and_folds(spark, tmp_path):
    st = _store(spark, tmp_path)
    assert st.read("kev").count() == 0 and not st.has("kev")
    _append(st, "1", "dns_domain", _domains(spark, "a"))
    _append(st, "2", "dns_domain", _domains(spark, "a", "b"))
    assert {r["domain"]: r["query_count"] for r in st.read("dns_domain").collect()} == {"a": 2, "b": 1}
    rules = spark.createDataFrame([("x", "d", True, AS_OF)], schemas.RULE)
    st.write("rule", rules)
    st.write("rule", rules.limit(0))
    assert st.read("rule").count() == 0
    try:
        st.append("dns_domain", _domains(spark, "a"))
        raise AssertionError("whose rows are these?")
    except RuntimeError:
        pass


def test_a_batch_done_again_replaces_its_first_attempt(spark, tmp_path):
    st = _store(spark, tmp_path)
    _append(st, "1", "dns_domain", _domains(spark, "a"))
    rule = lambda d: spark.createDataFrame([("x", d, True, AS_OF)], schemas.RULE)
    st.write("rule", rule("old"))
    try:
        with st.run("2/odd key"):
            st.append("dns_domain", _domains(spark, "b"))
            st.append("dns_query", dns_rows(spark, [dict(ts=ago(hours=1), qname="n.com")]).withColumn("run_key", F.lit("2/odd key")))
            st.write("rule", rule("new"))
            raise RuntimeError("dies")
    except RuntimeError:
        pass
    for again in (st, _store(spark, tmp_path)):
        with again.run("2/odd key"):
            assert [r["domain"] for r in again.state("dns_domain").collect()] == ["a"]
            assert again.state("dns_query").count() == 0 and again.state("rule").first()["description"] == "old"
            again.append("dns_domain", _domains(spark, "b"))
            again.write("rule", rule("newer"))
        assert {r["domain"]: r["query_count"] for r in again.read("dns_domain").collect()} == {"a": 1, "b": 1}
        assert again.read("rule").first()["description"] == "newer"


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    st = _store(spark, tmp_path)
    st.write("rule", spark.createDataFrame([("x", "d", True, AS_OF)], schemas.RULE))
    half = tmp_path / "s" / "rule" / "version=000000000002@"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")
    assert st.read("rule").count() == 1
    st.write("rule", st.read("rule"))
    assert st.read("rule").count() == 1


def test_retention_deletes_days(spark, tmp_path):
    st = _store(spark, tmp_path)
    rows = lambda *a: dns_rows(spark, list(a))
    _append(st, "1", "dns_query", rows(dict(ts=ago(days=40), qname="o.com"), dict(ts=ago(hours=1), qname="n.com"))
            .withColumn("run_key", F.lit("1")))
    _append(st, "2", "dns_query", rows(dict(ts=ago(days=41), qname="p.com"), dict(ts=ago(days=35, hours=1), qname="q.com"))
            .withColumn("run_key", F.lit("2")))
    st.retain(str(AS_OF - dt.timedelta(days=35)))
    st.retain(str(AS_OF - dt.timedelta(days=36)))           # never moves back
    assert [r["qname"] for r in st.read("dns_query").collect()] == ["n.com"]
    assert sorted(d.name for d in (tmp_path / "s" / "dns_query").glob("day=*")) == [
        f"day={AS_OF - dt.timedelta(days=35):%Y-%m-%d}", f"day={AS_OF:%Y-%m-%d}"]


def test_files_do_not_grow_with_batches(spark, tmp_path, monkeypatch):
    """Batches of a day each, with a retention of three days: files on disk stay as many."""
    from nightjar.sources import store as module
    monkeypatch.setattr(module, "SETTLE", 6)
    st, sizes = _store(spark, tmp_path), []
    for i in range(50):
        day = AS_OF + dt.timedelta(days=i)
        with st.run(f"k{i:02d}"):
            st.append("dns_query", dns_rows(spark, [dict(ts=day, qname="n.com")]).withColumn("run_key", F.lit(f"k{i:02d}")))
            st.append("dns_domain", _domains(spark, f"d{i % 3}").coalesce(1))
            st.write("rule", spark.createDataFrame([("x", f"d{i}", True, AS_OF)], schemas.RULE).coalesce(1))
            st.retain(str(day - dt.timedelta(days=3)))
            st.append("scan_run", spark.createDataFrame([("resolver", f"k{i:02d}", day, day, None, None, None)],
                                                        schemas.SCAN_RUN).coalesce(1))
        sizes.append(len(_files(tmp_path / "s")))
    assert max(sizes) < 60 and min(sizes[-8:]) <= max(sizes[8:16])
    assert {r["domain"]: r["query_count"] for r in st.read("dns_domain").collect()} == {"d0": 17, "d1": 17, "d2": 16}
    assert st.read("scan_run").count() == 50 and st.read("dns_query").count() == 4
    assert st.read("rule").first()["description"] == "d49"


def test_a_crash_while_settling_counts_nothing_twice(spark, tmp_path, monkeypatch):
    from nightjar.sources import store as module
    st = _store(spark, tmp_path)
    for i in range(3):
        with st.run(f"k{i}"):
            st.append("dns_domain", _domains(spark, "a"))
            st.append("scan_run", spark.createDataFrame([("resolver", f"k{i}", AS_OF, AS_OF, None, None, None)], schemas.SCAN_RUN))
    _append(st, "open", "dns_domain", _domains(spark, "a"))     # a batch without an envelope stays beside
    monkeypatch.setattr(module, "SETTLE", 2)
    monkeypatch.setattr(module, "drop_path", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
    try:
        with st.run("k4"):
            raise AssertionError("it should have died")
    except RuntimeError:
        pass
    monkeypatch.undo()
    monkeypatch.setattr(module, "SETTLE", 2)
    assert st.read("dns_domain").first()["query_count"] == 4
    with st.run("open"):
        assert st.state("dns_domain").first()["query_count"] == 3
    assert st.read("dns_domain").first()["query_count"] == 4 and st.read("scan_run").count() == 3


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    """U-2, U-3: a run rewrites the buckets of its images alone."""
    st = _store(spark, tmp_path)
    images = [f"img-{i}" for i in range(40)]
    row = lambda i, s: (i, "p", "1", "CVE-1", s, *[None] * 5, AS_OF, AS_OF, "r1", "r1", "open", None, None, None)
    st.write("vuln_finding", spark.createDataFrame([row(i, "LOW") for i in images], schemas.VULN_FINDING))
    before = {f: (tmp_path / "s" / f).stat().st_mtime_ns for f in _files(tmp_path / "s")}
    one = spark.createDataFrame([("img-7",)], "image string")
    mine = st.buckets_of("vuln_finding", one)
    with st.run("r2"):
        state = st.state("vuln_finding", mine)
        assert state.count() < 40
        st.write("vuln_finding", state.withColumn("severity", F.when(F.col("image") == "img-7", "HIGH").otherwise(F.col("severity"))))
    after = _files(tmp_path / "s")
    same = [f for f in after if f in before and before[f] == (tmp_path / "s" / f).stat().st_mtime_ns]
    touched = f"bucket={mine[0]}/"
    assert len(mine) == 1 and same == [f for f in before if touched not in f] and len(same) >= 20
    assert {r.image: r.severity for r in st.read("vuln_finding").collect()} == {
        i: "HIGH" if i == "img-7" else "LOW" for i in images}


def test_a_hot_day_is_written_by_many_tasks(spark, tmp_path):
    """U-5: all rows of a batch on one day."""
    st = _store(spark, tmp_path)
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(200_000, numPartitions=16).select(
            (F.lit(AS_OF) + F.make_dt_interval(secs=F.col("id") / 1000)).alias("ts"), F.md5(F.col("id").cast("string")).alias("client"))
        full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit("k" if f.name == "run_key" else None)
                             .cast(f.dataType).alias(f.name) for f in schemas.DNS_QUERY.fields])
        assert _append(st, "k", "dns_query", full).count() == 200_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(_files(tmp_path / "s" / "dns_query")) >= 8
    assert len(list((tmp_path / "s" / "dns_query").glob("day=*"))) == 1


def test_every_crash_point_of_a_batch_is_harmless(spark, tmp_path, monkeypatch):
    """The job dies after each of its writes in turn and is run again: the
    tables are those of an undisturbed run, hit counts included."""
    from nightjar.functions import normalize
    from nightjar.plans import engine
    from nightjar.sources.store import TableStore
    from nightjar.streaming import dns_stream
    names = ["q7w2e9r4t1y8.top", "a.example.com", "b.example.co.uk"]
    ent = spark.createDataFrame(
        [(f"2026-08-15T1{i}:00:00Z", "10.0.0.1", None, (n, "A"), "NotFilteredNotFound", "NOERROR", None, None, "1")
         for i, n in enumerate(names * 2)], schemas.DNS_ENTRY)
    batch = normalize.map_dns_entries(ent, suffix_rules(spark))
    rules = dns_stream.rules_runner(engine.builtin_rules())

    def tables(st):
        return {t: sorted(map(str, st.read(t).drop("day").collect())) for t in
                ("dns_query", "dns_domain", "scan_run", "rule", "rule_hit")}

    calm = TableStore(spark, str(tmp_path / "calm"))
    dns_stream.process_batch(calm, batch, "k", AS_OF, rule_runner=rules)
    want, writes = tables(calm), ("_overwrite", "_replace")
    real = {w: getattr(TableStore, w) for w in writes}
    assert want["rule_hit"]
    for dies_at in range(1, 5):                 # rows, registry, rules, hits; the envelope is the last write
        st, count = TableStore(spark, str(tmp_path / f"s{dies_at}")), [0]

        def failing(write):
            def run(self, *a):
                count[0] += 1
                out = real[write](self, *a)
                if count[0] == dies_at:
                    raise RuntimeError("dies")
                return out
            return run

        for w in writes:
            monkeypatch.setattr(TableStore, w, failing(w))
        try:
            dns_stream.process_batch(st, batch, "k", AS_OF, rule_runner=rules)
            raise AssertionError("it should have died")
        except RuntimeError:
            pass
        for w in writes:
            monkeypatch.setattr(TableStore, w, real[w])
        assert dns_stream.process_batch(st, batch, "k", AS_OF, rule_runner=rules)
        assert not dns_stream.process_batch(st, batch, "k", AS_OF, rule_runner=rules)
        assert tables(st) == want


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    import json

    from nightjar.streaming import dns_stream
    st = _store(spark, tmp_path)
    for n in (1, 2):                                    # two streams, each with a checkpoint of its own
        land = tmp_path / f"land{n}"
        land.mkdir()
        (land / "f.json").write_text(json.dumps({"time": f"2026-08-15T1{n}:00:00Z", "client": "c", "question": {
            "name": f"n{n}.example.com", "type": "A"}}) + "\n")
        q = dns_stream.start_ingest(dns_stream.entry_stream(spark, str(land)), st, suffix_rules(spark),
                                    str(tmp_path / f"ckpt{n}"), as_of=F.lit(AS_OF))
        q.awaitTermination()
    assert sorted(r["qname"] for r in st.read("dns_query").collect()) == ["n1.example.com", "n2.example.com"]
    assert st.read("dns_domain").first()["query_count"] == 2
