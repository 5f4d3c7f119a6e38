"""Property tests (few examples each: every example runs Spark jobs)."""
from __future__ import annotations

import datetime as dt

import duckdb
from conftest import AS_OF, dns_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions import dnsname
from nightjar.operators import dns
from nightjar.plans import detections as d

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

names = st.sampled_from(["a.x.com", "b.x.com", "x.com", "evil.org", "a.evil.org", "c.y.net"])
rows_st = st.lists(st.tuples(st.integers(0, 500), st.integers(0, 3), names, st.booleans()),
                   min_size=1, max_size=40)


def _df(spark, rows):
    return dns_rows(spark, [dict(ts=AS_OF - dt.timedelta(minutes=m), client=f"10.0.0.{c}", qname=q,
                                 registrable_domain=".".join(q.split(".")[-2:]), blocked=b)
                            for m, c, q, b in rows])


@SETTINGS
@given(rows=rows_st, cut=st.integers(0, 40))
def test_split_batches_equal_one_batch(spark, rows, cut):
    """Registry after two batches (with overlap) == registry after one."""
    a, b = rows[:cut], rows[max(0, cut - 3):]
    one_new = dns.append_new(schemas.empty(spark, "dns_query"),
                                _df(spark, rows).withColumn("ord", F.monotonically_increasing_id()))
    r_one = dns.merge_registry(schemas.empty(spark, "dns_domain"), one_new.drop("ord")).drop("_action")
    store, reg = schemas.empty(spark, "dns_query"), schemas.empty(spark, "dns_domain")
    for part in (a, b):
        if not part:
            continue
        new = dns.append_new(store, _df(spark, part).withColumn("ord", F.monotonically_increasing_id()))
        new = new.drop("ord")
        reg = dns.merge_registry(reg, new).drop("_action")
        store = store.unionByName(new)
    assert sorted(map(tuple, reg.collect())) == sorted(map(tuple, r_one.collect()))


@SETTINGS
@given(rows=rows_st, listed=st.lists(st.tuples(st.sampled_from(["x.com", "evil.org", "a.evil.org", "b.x.com"]),
                                               st.sampled_from(["s1", "s2"])), min_size=1, max_size=6))
def test_known_bad_equals_or_join(spark, rows, listed):
    q = _df(spark, rows).withColumn("id", F.monotonically_increasing_id())
    kb = spark.createDataFrame([(dm, s, AS_OF) for dm, s in set(listed)], schemas.KNOWN_BAD)
    got = {r["entity"]: r["summary"] for r in d.known_bad(q.drop("id"), kb).collect()}
    # brute force: the OR join with distinct query ids
    j = kb.alias("k").join(q.alias("q"), (F.col("q.registrable_domain") == F.col("k.domain"))
                           | (F.col("q.qname") == F.col("k.domain")))
    brute = {r["domain"]: (r["n"], r["c"], r["nb"]) for r in j.groupBy("k.domain").agg(
        F.count_distinct("q.id").alias("n"), F.count_distinct("q.client").alias("c"),
        F.count_distinct(F.when(F.col("q.blocked"), F.col("q.id"))).alias("nb")).collect()}
    assert set(got) == set(brute)
    for dom, (n, c, nb) in brute.items():
        assert f": {n} quer" in got[dom] and f"from {c} client" in got[dom] and f", {nb} blocked /" in got[dom]


@SETTINGS
@given(words=st.lists(st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-", min_size=1, max_size=30),
                      min_size=1, max_size=10))
def test_entropy_matches_duckdb(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r["s"]: r["e"] for r in df.select("s", dnsname.shannon_entropy(F.col("s")).alias("e")).collect()}
    con = duckdb.connect()
    for w in words:
        exp = con.execute("SELECT list_aggregate(string_split(?, ''), 'entropy')", [w]).fetchone()[0]
        assert abs(got[w] - exp) < 1e-12


def test_hot_domain_third_of_rows(spark):
    """One domain holds a third of all rows; results equal brute force."""
    rows = []
    for i in range(600):
        hot = i % 3 == 0
        rows.append(dict(ts=AS_OF - dt.timedelta(minutes=i % 600), client=f"10.0.{i % 5}.{i % 11}",
                         qname=(f"h{i}.hot.example" if hot else f"n{i % 40}.cold{i % 7}.example"),
                         registrable_domain=("hot.example" if hot else f"cold{i % 7}.example"),
                         label_entropy=3.2 if hot else 2.0, blocked=(i % 4 == 0)))
    q = dns_rows(spark, rows)
    got = {r["entity"]: r["summary"] for r in d.tunnel_volume(q, AS_OF, min_names=10).collect()}
    assert got == {"hot.example": "200 distinct names in 24h, avg entropy 3.20 bits/char, 55 clients"}
    kb = spark.createDataFrame([("hot.example", "s1", AS_OF), ("hot.example", "s2", AS_OF)], schemas.KNOWN_BAD)
    kbs = d.known_bad(q, kb).first()["summary"]
    assert kbs.startswith("listed by s1, s2: 200 queries from 55 clients, 50 blocked / 150 NOT blocked")
