"""Rule runs: what a hit keeps between runs, what people decide, what fails alone."""
from __future__ import annotations

import pytest
from conftest import AS_OF, ago, dns_rows

from nightjar import schemas
from nightjar.operators import hits as hitops
from nightjar.plans import engine

BUSY = """-- description: clients with at least two queries before the clock
SELECT client AS entity, concat(CAST(count(*) AS STRING), ' queries') AS summary
FROM dns_query WHERE ts <= :as_of GROUP BY client HAVING count(*) >= 2
"""
LONG = """-- description: names of twenty characters or more
SELECT DISTINCT qname AS entity, CAST(length(qname) AS STRING) AS summary FROM dns_query WHERE length(qname) >= 20
"""
#: Each breaks another part of the contract.
FAULTY = {
    "no_such_view": "SELECT entity, summary FROM nowhere_view",
    "fails_on_a_row": "SELECT client AS entity, CAST(1 / (length(client) - length(client)) AS STRING) AS summary FROM dns_query",
    "no_entity": "SELECT client_name AS entity, qname AS summary FROM dns_query",
    "one_column": "SELECT client AS entity FROM dns_query",
    "other_names": "SELECT client AS who, qname AS what FROM dns_query",
}


@pytest.fixture(scope="module")
def log(spark):
    rows = [dict(ts=ago(hours=h), client=f"10.1.0.{c}", qname=n) for h, c, n in
            [(30, 1, "a.example.com"), (20, 1, "b.example.com"), (10, 1, "c.example.com"), (10, 2, "a.example.com"),
             (2, 2, "quite-a-long-name.example.com"), (1, 3, "a.example.com")]]
    return {"dns_query": dns_rows(spark, rows)}


def run(spark, log, texts, state=None, as_of=AS_OF):
    rules = [engine.sql_rule(spark, k, t) for k, t in texts.items()]
    before = state or (schemas.empty(spark, "rule"), schemas.empty(spark, "rule_hit"))
    return engine.run_rules(spark, rules, log, *before, as_of)


def outcome(out):
    return {r["rule_id"]: (r["outcome"], r["hits"], r["new"], r["re_reported"]) for r in out.results.collect()}


def test_hits_accumulate_over_runs(spark, log):
    texts = {"busy": BUSY, "long": LONG}
    early = run(spark, log, texts, as_of=ago(hours=5))
    assert outcome(early) == {"busy": ("ok", 1, 1, 0), "long": ("ok", 1, 1, 0)}
    late = run(spark, log, texts, (early.rules, early.hits))
    assert outcome(late) == {"busy": ("ok", 2, 1, 1), "long": ("ok", 1, 0, 1)}
    hits = {(r["rule_id"], r["entity"]): r for r in late.hits.collect()}
    assert set(hits) == {("busy", "10.1.0.1"), ("busy", "10.1.0.2"), ("long", "quite-a-long-name.example.com")}
    old, new = hits["busy", "10.1.0.1"], hits["busy", "10.1.0.2"]
    assert (old["hit_count"], old["first_seen"], old["last_seen"]) == (2, ago(hours=5), AS_OF)
    assert (new["hit_count"], new["first_seen"], new["summary"]) == (1, AS_OF, "2 queries")


def test_decisions_are_never_overwritten(spark, log):
    first = run(spark, log, {"busy": BUSY})
    said = spark.createDataFrame(
        [("busy", "10.1.0.1", "false_positive", "backup host", ago(hours=3)), ("busy", "10.1.0.1", "accepted", "later", ago(hours=2)),
         ("busy", "10.9.9.9", "accepted", "unknown", ago(hours=1))],
        "rule_id string, entity string, status string, status_note string, decided_at timestamp")
    decided = hitops.apply_decisions(first.hits, said, ["rule_id", "entity"])
    again = run(spark, log, {"busy": BUSY}, (first.rules, decided))
    got = {r["entity"]: (r["status"], r["status_note"], r["hit_count"]) for r in again.hits.collect()}
    assert got == {"10.1.0.1": ("accepted", "later", 2), "10.1.0.2": ("open", None, 2)}


def test_each_fault_stays_with_its_rule(spark, log):
    texts = {k: f"-- description: {k}\n{v}" for k, v in FAULTY.items()}
    out = run(spark, log, {"busy": BUSY, **texts, "long": LONG})
    assert {k for k, v in outcome(out).items() if v[0] == "failed"} == set(FAULTY) == set(out.failures)
    assert outcome(out)["busy"][:2] == ("ok", 2) and outcome(out)["long"][:2] == ("ok", 1)
    assert "nowhere_view" in out.failures["no_such_view"] and out.any_failed
    assert {r["rule_id"] for r in out.hits.collect()} == {"busy", "long"}
    t = engine.run_totals(out.results).first()
    assert (t["rules"], t["hits"], t["new"], t["failed"]) == (7, 3, 3, 5)


def test_a_rule_that_is_off_does_not_run(spark, log):
    first = run(spark, log, {"busy": BUSY, "long": LONG})
    off = hitops.set_enabled(first.rules, "long", False)
    second = run(spark, log, {"busy": BUSY, "long": LONG}, (off, first.hits))
    assert outcome(second)["long"] == ("skipped", None, None, None)
    assert {(r["rule_id"], r["hit_count"]) for r in second.hits.collect()} == {("busy", 2), ("long", 1)}
    assert {r["id"]: r["enabled"] for r in second.rules.collect()} == {"busy": True, "long": False}


def test_an_entity_reported_twice_counts_twice(spark):
    batch = spark.createDataFrame([("r", "x", "earlier", 1), ("r", "x", "later", 2), ("r", "y", "only", 3)],
                                  "rule_id string, entity string, summary string, ord int")
    got = {r["entity"]: (r["hit_count"], r["summary"]) for r in
           hitops.upsert_hits(schemas.empty(spark, "rule_hit"), batch, AS_OF).collect()}
    assert got == {"x": (2, "later"), "y": (1, "only")}


def test_rules_come_from_files_with_a_description(spark, tmp_path):
    (tmp_path / "zeta.sql").write_text(LONG)
    (tmp_path / "beta.sql").write_text(BUSY)
    (tmp_path / "notes.txt").write_text("no rule")
    found = engine.discover(spark, str(tmp_path))
    assert [(r.id, r.description[:7]) for r in found] == [("beta", "clients"), ("zeta", "names o")]
    (tmp_path / "eta.sql").write_text("SELECT 1 AS entity, 2 AS summary")
    with pytest.raises(ValueError, match="eta"):
        engine.discover(spark, str(tmp_path))


def test_the_registry_keeps_what_people_set(spark):
    def catalogue(*rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, id string, description string")

    one = hitops.upsert_rules(schemas.empty(spark, "rule"), catalogue(("p", "old text"), ("q", "q")), ago(days=3))
    one = hitops.set_enabled(one, "p", False)
    two = hitops.upsert_rules(one, catalogue(("p", "draft"), ("p", "new text"), ("s", "s")), AS_OF)
    got = {r["id"]: (r["description"], r["enabled"], r["added_at"]) for r in two.collect()}
    assert got == {"p": ("new text", False, ago(days=3)), "q": ("q", True, ago(days=3)), "s": ("s", True, AS_OF)}


def _sleepy(spark, seconds):
    def nap(batches):
        import time
        time.sleep(seconds)
        yield from batches

    return lambda t, a: spark.range(1).selectExpr("'x' as entity", "'slept' as summary") \
        .mapInPandas(nap, "entity string, summary string")


def test_rules_run_side_by_side_and_a_slow_one_is_cancelled(spark):
    import time

    from nightjar import schemas
    rules = [engine.Rule(f"nap{i}", "naps", _sleepy(spark, 3)) for i in range(4)] + [engine.Rule("slow", "never ends", _sleepy(spark, 120))]
    began = time.monotonic()
    out = engine.run_rules(spark, rules, {}, schemas.empty(spark, "rule"), schemas.empty(spark, "rule_hit"), AS_OF,
                           side_by_side=5, limit_seconds=25)
    got = {r["rule_id"]: (r["outcome"], r["hits"]) for r in out.results.collect()}
    assert got == {**{f"nap{i}": ("ok", 1) for i in range(4)}, "slow": ("failed", None)}
    assert time.monotonic() - began < 100 and "limit" in out.failures["slow"]


def test_a_users_views_survive_a_rule(spark):
    spark.range(3).createOrReplaceTempView("dns_query")
    rule = engine.sql_rule(spark, "r", "-- description: d\nSELECT qname AS entity, 's' AS summary FROM dns_query WHERE ts <= :as_of")
    mine = spark.createDataFrame([("a.com", AS_OF)], "qname string, ts timestamp")
    assert rule.build({"dns_query": mine, "dns_domain": mine}, AS_OF).first()["entity"] == "a.com"
    assert spark.table("dns_query").count() == 3 and not spark.catalog.tableExists("dns_domain")
    spark.catalog.dropTempView("dns_query")
