"""Quality jobs, approximate distinct mode, streaming windows on a small landing."""
from __future__ import annotations

import json

from conftest import AS_OF, ago, dns_rows
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import quality
from nightjar.plans import detections as d


def test_quality_jobs(spark):
    q = dns_rows(spark, [dict(ts=ago(hours=1), qname="a.com"), dict(ts=ago(hours=1), qname="a.com"),
                         dict(ts=ago(hours=2), qname="b.com", client_name="x")])
    assert quality.key_violations(q, schemas.KEYS["dns_query"]).first()["rows"] == 2
    assert quality.null_counts(q, ["client_name"]).first()["client_name"] == 2
    expo = spark.createDataFrame([("i1", "tailnet", None, AS_OF), ("i2", "public", None, AS_OF)],
                                 schemas.IMAGE_EXPOSURE)
    assert [r["value"] for r in quality.enum_violations(expo, "exposure", schemas.EXPOSURES).collect()] == ["public"]
    hits = spark.createDataFrame([("r1", "e", None, AS_OF, AS_OF, 1, "open", None, None)], schemas.RULE_HIT)
    rules = spark.createDataFrame([("r2", "x", True, AS_OF)], schemas.RULE)
    refs = quality.ref_violations(hits, rules, ["rule_id"], ["id"]).collect()
    assert [(r["rule_id"], r["rows"]) for r in refs] == [("r1", 1)]
    allc = {(r["table"], r["check"]): r["violations"] for r in
            quality.run_all({"dns_query": q, "image_exposure": expo}).collect()}
    assert allc[("dns_query", "key:ts,client,qname,qtype")] == 1
    assert allc[("image_exposure", "enum:exposure")] == 1


def test_approx_tunnel_close_to_exact(spark):
    q = dns_rows(spark, [dict(ts=ago(minutes=i), qname=f"n{i}.t.example", registrable_domain="t.example",
                              client=f"10.0.0.{i % 7}", label_entropy=3.6) for i in range(300)])
    exact = d.tunnel_volume(q, AS_OF).first()["summary"]
    approx = d.tunnel_volume(q, AS_OF, approx=True).first()["summary"]
    assert exact.startswith("300 distinct names")
    n = int(approx.split()[0])
    assert abs(n - 300) <= 30 and approx.endswith("7 clients")


def test_streaming_windows(spark, tmp_path):
    from nightjar.plans.testviews import suffix_rules
    from nightjar.streaming import dns_stream, panes
    land = tmp_path / "land"
    land.mkdir()
    for i, hour in enumerate([1, 2, 30]):
        ent = {"time": f"2026-08-1{5 if hour < 24 else 6}T{hour % 24:02d}:10:00Z", "client": "c1",
               "question": {"name": f"x{i}.tun.example.com", "type": "A"}, "reason": "FilteredBlackList"}
        (land / f"f{i}.json").write_text(json.dumps(ent) + "\n")
    src = dns_stream.entry_stream(spark, str(land), max_files_per_trigger=1)
    mapped = dns_stream.mapped_stream(src, suffix_rules(spark))
    out = tmp_path / "out"
    q = (panes.sliding_names(mapped, 2).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out)))
    q.awaitTermination()
    got = spark.read.parquet(str(out)).orderBy("window_start").collect()
    # windows closed by the 06:10 event on the 16th: [00,02) [01,03) [02,04)
    assert [(r["window_start"].hour, r["names"]) for r in got] == [(0, 1), (1, 2), (2, 1)]
    assert all(r["registrable_domain"] == "example.com" for r in got)


def test_slices_take_one_maximum_and_repull_the_last_day_alone(spark, tmp_path):
    """stream_dedupe: a slice's plan holds no second pass for the largest event, and the re-pull
    reads the last day's events only; their rows are those of a full derivation."""
    from nightjar.functions import normalize
    from nightjar.plans import checks, testviews as tv

    spark.sql("""select id as event_id, timestamp_micros(1714521600000000 + id * 777000001) as ts, id % 7 as user_id,
                 if(id % 3 = 0, 'error', 'view') as event_type, id * 0.5D as value from range(400)
                 union all select 400, null, 1, 'click', null""").write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("select id as page_id, concat('https://a', id, '.example.com/x') as url from range(9)") \
        .write.parquet(str(tmp_path / "pages.parquet"))
    *slices, again = checks._slices(spark, str(tmp_path))
    entries = tv.dns_entries(spark, str(tmp_path))
    kept = [c for c in entries.columns if c != "ord"]
    assert sorted(map(str, (r for s in slices for r in s.collect()))) == sorted(map(str, entries.select(*kept).collect()))
    final = F.timestamp_micros(F.lit(tv.dns_as_of(spark, str(tmp_path)))) - F.expr("INTERVAL 1 DAYS")
    whole = entries.select(*kept).filter(normalize.parse_iso_ts(F.col("time")) >= final).collect()
    assert sorted(map(str, again.collect())) == sorted(map(str, whole)) and whole

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert all("max(" not in plan(s) for s in slices)
    assert any("Filter" in x and "ts#" in x and ">=" in x for x in plan(again).split("Join")[1].splitlines())
