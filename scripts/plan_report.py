"""Summarise the physical plan of every check query (no execution).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md

Counts exchanges, join strategies and aggregate kinds from
``explain("formatted")`` and lists the pushed filters / read schemas, so
regressions (an unexpected nested-loop join, a scan without pruning) show.
The streaming checks and the rule run execute while they are planned; their
rows here are the plan of what they return, and the rows ``micro-batch: ...``
are the steps that each micro-batch runs against a store.
"""
from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, ".")
from nightjar.operators import dns  # noqa: E402
from nightjar.plans import checks  # noqa: E402
from nightjar.plans import testviews as tv  # noqa: E402
from nightjar.session import build_session, scratch_path  # noqa: E402
from nightjar.sources.store import TableStore  # noqa: E402

OPS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
       "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
       "ObjectHashAggregate", "Window", "Generate", "TakeOrderedAndProject"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def micro_batch(spark, sf):
    """New rows, registry share and registry read of a batch on a store with rows of its own."""
    store = TableStore(spark, scratch_path(spark, "plans"))
    rows = tv.dns_query(spark, sf)
    store.append("dns_query", rows.withColumn("run_key", checks.F.lit("one")))
    for key in ("one", "two", "three"):
        with store.run(key):
            store.append("dns_domain", dns.domain_batch(rows))
    fresh = lambda s, d: dns.append_new(store.read("dns_query"), rows)
    return [("micro-batch: new rows", fresh),
            ("micro-batch: registry share", lambda s, d: dns.domain_batch(store.read("dns_query"))),
            ("micro-batch: registry, folded", lambda s, d: store.read("dns_domain"))]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    print("# Physical plan summary of the check queries\n")
    print(f"Planned on `{sf}` with AQE on (initial plans; AQE may still turn a shuffle join "
          "into a broadcast at run time). Counts are operator nodes in `explain('formatted')`.\n")
    print("| query | " + " | ".join(OPS) + " |")
    print("| --- | " + " | ".join("---" for _ in OPS) + " |")
    details = []
    for name, fn in [*checks.REGISTRY.items(), *micro_batch(spark, sf)]:
        txt = plan_text(fn(spark, sf))
        tree = txt.split("\n\n")[0]
        counts = [len(re.findall(rf"[\s+-]{op}( [A-Za-z]+)* \(\d+\)", tree)) for op in OPS]
        print(f"| {name} | " + " | ".join(str(c) if c else "" for c in counts) + " |")
        pushed = sorted(set(re.findall(r"PushedFilters: (\[.*?\])", txt)) - {"[]"})
        pushed += sorted(set(re.findall(r"PartitionFilters: (\[.*?\])", txt)) - {"[]"})
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<.*?>)\n", txt)))
        details.append((name, pushed, schemas))
    print("\n## Scans\n")
    for name, pushed, schemas in details:
        print(f"- **{name}**: read " + "; ".join(f"`{s}`" for s in schemas)
              + (("; pushed " + "; ".join(f"`{p}`" for p in pushed)) if pushed else ""))


if __name__ == "__main__":
    main()
