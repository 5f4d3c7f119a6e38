"""Detections over DNS state. Each returns exactly (entity, summary).

Thresholds are parameters; their defaults are the published ones. Windows
are relative to an explicit ``as_of``: last day = [as_of - 24h, ...),
baseline = [as_of - 8d, as_of - 24h), disjoint from the last day.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rollups, sketches
from ..timeutil import as_ts, days, hours


def _since(df: DataFrame, start: Column) -> DataFrame:
    """Rows at or after ``start``; on the stored layout (a ``day`` partition
    column) whole older days are pruned before the scan."""
    out = df.filter(F.col("ts") >= start)
    if "day" in df.columns:
        out = out.filter(F.col("day") >= F.to_date(start))
    return out


def _distinct(c: str, approx: bool) -> Column:
    """Exact distinct count, or HyperLogLog++ (one small sketch per group,
    no Expand / second shuffle) when ``approx``."""
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def _s(c: Column) -> Column:
    """Text of a value as SQL format('%s') renders it (NULL -> '')."""
    return F.coalesce(c.cast("string"), F.lit(""))


def newly_seen(dns_domain: DataFrame, dns_query: DataFrame, as_of, window_hours: int = 24,
               approx: bool = False) -> DataFrame:
    """R-1: registry domains first seen in the window. Query and blocked
    counts are registry lifetime; distinct clients come from retained rows
    (0 when the rows are already pruned)."""
    t = as_ts(as_of)
    new = dns_domain.filter(F.col("first_seen") >= t - hours(window_hours))
    # the new-domain list is derived (a filtered registry): AQE sizes it. A
    # domain first seen in the window has no older rows.
    keys = new.select(F.col("domain").alias("registrable_domain"))
    clients = (_since(dns_query, t - hours(window_hours)).join(keys, "registrable_domain", "left_semi")
               .groupBy(F.col("registrable_domain").alias("domain"))
               .agg(_distinct("client", approx).alias("client_count")))
    j = new.join(clients, "domain", "left")
    cc = F.coalesce(F.col("client_count"), F.lit(0))
    qc = F.col("query_count")
    summary = F.concat(
        F.lit("first seen "), _s(F.date_format("first_seen", "yyyy-MM-dd HH:mm")),
        F.lit(", "), _s(qc), F.lit(" quer"), _plural(qc, "y", "ies"),
        F.lit(" from "), _s(cc), F.lit(" client"), _plural(cc, "", "s"),
        F.lit(", "), _s(F.col("blocked_count")), F.lit(" blocked"))
    return j.select(F.col("domain").alias("entity"), summary.alias("summary"))


def dga_entropy(dns_query: DataFrame, min_entropy: str = "3.5", min_length: int = 12,
                approx: bool = False) -> DataFrame:
    """R-2: names at or above the entropy and length floors, per registrable
    domain; blocked rows included; no time window."""
    q = dns_query.filter((F.col("label_entropy") >= F.lit(Decimal(min_entropy)))
                         & (F.length("qname") >= min_length))
    g = q.groupBy("registrable_domain").agg(
        F.max("label_entropy").alias("mx"), F.min("qname").alias("example"),
        F.count(F.lit(1)).alias("n"), _distinct("client", approx).alias("clients"))
    n, c = F.col("n"), F.col("clients")
    summary = F.concat(
        F.lit("max entropy "), _s(F.round("mx", 2)), F.lit(" bits/char, e.g. "), _s(F.col("example")),
        F.lit(", "), _s(n), F.lit(" quer"), _plural(n, "y", "ies"),
        F.lit(" from "), _s(c), F.lit(" client"), _plural(c, "", "s"))
    return g.select(F.col("registrable_domain").alias("entity"), summary.alias("summary"))


def _burst_counts(dns_query: DataFrame, pred: Column, as_of, baseline_days: int = 7) -> DataFrame:
    """One pass over the rows: last-day and baseline counts by client and device name."""
    t = as_ts(as_of)
    last = F.col("ts") >= t - hours(24)
    prior = (F.col("ts") >= t - days(baseline_days + 1)) & (F.col("ts") < t - hours(24))
    return _since(dns_query, t - days(baseline_days + 1)).filter(pred) \
        .groupBy("client", "client_name").agg(F.count_if(last).alias("n"), F.count_if(prior).alias("p"))


def _burst(counts: DataFrame, floor: int, multiple, noun: str, baseline_days: int = 7) -> DataFrame:
    """Clients whose last day has at least ``floor`` rows and ``multiple`` times the baseline's
    daily mean. ``counts``: (client, client_name, n, p)."""
    # counts are by client and device name (hash aggregate); the last
    # name by text is then taken over the few names of a client
    g = counts.groupBy("client").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("client_name"))).alias("name"),
        F.sum("p").alias("p"))
    mult = F.lit(Decimal(str(multiple)))
    fire = ((F.col("n") > 0) & (F.col("n") >= floor)
            & (F.col("n") * baseline_days >= mult * F.col("p")))
    avg = F.round(F.col("p").cast("decimal(20,0)") / F.lit(Decimal(f"{baseline_days}.0")), 1)
    summary = F.concat(
        _s(F.col("n")), F.lit(f" {noun} in the last 24h vs a "), _s(avg),
        F.lit("/day average over the prior week"),
        F.coalesce(F.concat(F.lit(", device "), F.col("name")), F.lit("")))
    return g.filter(fire).select(F.col("client").alias("entity"), summary.alias("summary"))


def blocked_spike(dns_query: DataFrame, as_of, floor: int = 20, multiple=3, rollup: DataFrame | None = None) -> DataFrame:
    """R-3: a client's blocked queries in the last day vs its own baseline. With the hourly
    counters (``rollups.hourly``) the rows of two hours are read, with the same result."""
    return _burst(_client_counts(dns_query, "blocked", as_of, rollup), floor, multiple, "blocked queries")


def nxdomain_burst(dns_query: DataFrame, as_of, floor: int = 30, multiple=3, rollup: DataFrame | None = None) -> DataFrame:
    """R-5: genuine resolution failures (NXDOMAIN and not blocked)."""
    return _burst(_client_counts(dns_query, "failed", as_of, rollup), floor, multiple, "NXDOMAIN answers")


def _client_counts(dns_query: DataFrame, counter: str, as_of, rollup: DataFrame | None) -> DataFrame:
    if rollup is not None:
        return rollups.window_counts(rollup, dns_query, counter, as_of)
    return _burst_counts(dns_query, rollups.conditions()[counter], as_of)


def known_bad(dns_query: DataFrame, known_bad_domain: DataFrame, approx: bool = False) -> DataFrame:
    """R-4: queries whose registrable domain or full name is listed.

    The OR-join is rewritten as an equi-join: each query contributes its
    distinct {registrable_domain, qname} keys, and listings are reduced to
    one row per domain first, so no query is counted twice per domain.
    """
    lists = (known_bad_domain.groupBy("domain")
             .agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources")))
    q = dns_query.select(
        F.explode(F.array_distinct(F.array("registrable_domain", "qname"))).alias("domain"),
        "client", "blocked")
    # Counts only in the aggregation (fixed-width buffers, hash aggregate);
    # the source names are attached afterwards from the same small side.
    g = (q.join(lists.select("domain"), "domain").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), _distinct("client", approx).alias("clients"),
        F.count_if("blocked").alias("nb"), F.count_if(~F.col("blocked")).alias("nnb"))
        .join(lists, "domain"))
    n, c = F.col("n"), F.col("clients")
    summary = F.concat(
        F.lit("listed by "), _s(F.col("sources")), F.lit(": "), _s(n), F.lit(" quer"),
        _plural(n, "y", "ies"), F.lit(" from "), _s(c), F.lit(" client"), _plural(c, "", "s"),
        F.lit(", "), _s(F.col("nb")), F.lit(" blocked / "), _s(F.col("nnb")), F.lit(" NOT blocked"))
    return g.select(F.col("domain").alias("entity"), summary.alias("summary"))


def tunnel_volume(dns_query: DataFrame, as_of, min_names: int = 50,
                  min_avg_entropy: str = "3.0", approx: bool = False, sketched: DataFrame | None = None) -> DataFrame:
    """R-6: last day, per registrable domain: many distinct names and a high
    average entropy over query rows (exact decimal comparison). With hourly sketches
    (``sketches.hourly``) names and clients are estimates within ``sketches.BOUND``, and the
    rows of one hour are read."""
    if sketched is not None:
        g = sketches.trailing(sketched, dns_query, as_of)
    else:
        g = _since(dns_query, as_ts(as_of) - hours(24)).groupBy("registrable_domain").agg(
            _distinct("qname", approx).alias("names"), F.sum("label_entropy").alias("entropy_sum"),
            F.count(F.lit(1)).alias("n"), _distinct("client", approx).alias("clients"))
    fire = (F.col("names") >= min_names) & (F.col("entropy_sum") >= F.lit(Decimal(min_avg_entropy)) * F.col("n"))
    nm, c = F.col("names"), F.col("clients")
    mean = F.col("entropy_sum").cast("decimal(27,14)") / F.col("n").cast("decimal(11,0)")
    summary = F.concat(
        _s(nm), F.lit(" distinct name"), _plural(nm, "", "s"), F.lit(" in 24h, avg entropy "),
        _s(F.round(mean, 2)), F.lit(" bits/char, "), _s(c), F.lit(" client"), _plural(c, "", "s"))
    return g.filter(fire).select(F.col("registrable_domain").alias("entity"), summary.alias("summary"))
