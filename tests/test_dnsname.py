from pyspark.sql import functions as F

from nightjar.functions import dnsname
from nightjar.plans.testviews import suffix_rules


def _parts(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    out = dnsname.with_name_parts(df, suffix_rules(spark)).collect()
    return {r["qname"]: (r["registrable_domain"], float(r["label_entropy"])) for r in out}


def test_registrable_domain_rules(spark):
    p = _parts(spark, ["a.b.example.co.uk", "co.uk", "router.lan", "localhost", "192.168.1.1",
                       "x.y.foo.ck", "a.www.ck", "q7w2e9r4t1y8.top", "www.google.com"])
    assert p["a.b.example.co.uk"][0] == "example.co.uk"
    assert p["co.uk"] == ("co.uk", 0.0)
    assert p["router.lan"][0] == "router.lan"
    assert p["localhost"][0] == "localhost"
    assert p["192.168.1.1"][0] == "192.168.1.1"
    assert p["x.y.foo.ck"][0] == "y.foo.ck"
    assert p["a.www.ck"][0] == "www.ck"
    assert p["www.google.com"][0] == "google.com"
    assert abs(p["q7w2e9r4t1y8.top"][1] - 3.584962500721156) < 1e-13


def test_unknown_suffix_counts_all_labels(spark):
    p = _parts(spark, ["abcd.lan"])
    # labels abcd (2 bits) and lan (log2 3): the max is 2
    assert p["abcd.lan"] == ("abcd.lan", 2.0)


def test_entropy_values(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("q7w2e9r4t1y8",)], "s string")
    got = {r["s"]: r["e"] for r in df.select("s", dnsname.shannon_entropy(F.col("s")).alias("e")).collect()}
    assert got[""] == 0.0 and got["aaaa"] == 0.0 and got["abcd"] == 2.0
    assert abs(got["q7w2e9r4t1y8"] - 3.584962500721156) < 1e-12


def test_normalise_qname(spark):
    df = spark.createDataFrame([("  WWW.Example.COM.. ",), ("\tfoo.bar.\n",)], "n string")
    got = [r[0] for r in df.select(dnsname.normalise_qname(F.col("n"))).collect()]
    assert got == ["www.example.com", "foo.bar"]


def test_load_suffix_list_file(spark, tmp_path):
    f = tmp_path / "list.dat"
    f.write_text("// header\n// ===BEGIN ICANN DOMAINS===\ncom\n\n*.ck\n!www.ck\nco.uk\n"
                 "// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n")
    rules = dnsname.load_suffix_rules(spark, str(f))
    keys = {r["rule_key"] for r in rules.df.collect()}
    assert rules.count == 4 and rules.max_depth == 2
    assert keys == {"com", "ck", "www.ck", "co.uk"}
    df = spark.createDataFrame([("me.blogspot.com",)], "qname string")
    out = dnsname.with_name_parts(df, rules).first()
    assert out["registrable_domain"] == "blogspot.com"


def test_two_label_and_idn_suffixes(spark):
    p = _parts(spark, ["cdn.site.com.br", "a.b.\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444", "x.y.shop.xn--p1ai", "xn--p1ai"])
    assert p["cdn.site.com.br"][0] == "site.com.br"
    assert p["a.b.\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444"][0] == "\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444"
    assert p["x.y.shop.xn--p1ai"][0] == "shop.xn--p1ai" and p["xn--p1ai"] == ("xn--p1ai", 0.0)


def test_there_is_no_default_list(spark, tmp_path):
    import pytest
    with pytest.raises(TypeError):
        dnsname.suffix_rules(spark)
    empty = tmp_path / "none.dat"
    empty.write_text("// nothing\n")
    with pytest.raises(ValueError):
        dnsname.load_suffix_rules(spark, str(empty))


def test_iso_times(spark):
    from nightjar.functions.normalize import parse_iso_ts
    cases = {"2026-08-15T07:00:55.123456789Z": "2026-08-15 07:00:55.123456", "20260815T070055Z": "2026-08-15 07:00:55",
             "07:00:55": None, "2026": None, "2026-08": None, "2026-08-15": "2026-08-15 00:00:00", "now": None,
             "2026-08-15T07:00:55+0530": "2026-08-15 01:30:55", "2026-13-01": None, "2026-08-15T07:00-04": "2026-08-15 11:00:00"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", parse_iso_ts(F.col("t")).cast("string").alias("p")).collect()}
    assert got == cases


def test_valid_entries_are_parsed_once(spark):
    """A filter on ``valid`` does not put the time's and the name's patterns into the plan a second time."""
    from nightjar.functions.normalize import map_dns_entries
    rows = [(1, "2024-01-01T00:00:00Z", "  WWW.Example.co.uk. "), (2, "not-a-time", "a.example.com"), (3, None, "b.com"),
            (4, "2024-01-01T00:00:00Z", " . "), (5, "2024-01-01T00:00:00Z", None), (1, "2024-01-01T00:00:00Z", "www.example.co.uk")]
    entries = spark.createDataFrame(rows, "ord long, time string, name string").selectExpr(
        "ord", "time", "'c' as client", "named_struct('name', 'd') as client_info", "named_struct('name', name, 'type', 'A') as question",
        "'Filtered' as reason", "'NOERROR' as status", "'u' as upstream", "false as cached", "'1' as elapsedMs")
    mapped = map_dns_entries(entries, suffix_rules(spark), keep=["ord"])
    assert mapped.columns[:5] == ["ord", "ts", "client", "client_name", "qname"]
    assert sorted((r.ord, r.reject_reason) for r in mapped.filter("not valid").collect()) == \
        [(2, "bad_time"), (3, "bad_time"), (4, "no_name"), (5, "no_name")]
    valid = mapped.filter("valid")
    assert [(r.ord, r.qname, r.registrable_domain) for r in valid.collect()] == [(1, "www.example.co.uk", "example.co.uk")] * 2
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([0-9]{4})") == 1 and plan.count(r"\.+$") <= 2


def test_a_character_is_counted_once(spark):
    """Each distinct character's share is derived once, then used twice."""
    df = spark.createDataFrame([("aab",), ("",), (None,), ("日本日",)], "s string")
    got = df.select(dnsname.to_entropy_decimal(dnsname.shannon_entropy(F.col("s"))).cast("string").alias("h"))
    assert [r.h for r in got.collect()] == ["0.91829583405449", "0.00000000000000", None, "0.91829583405449"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 1
