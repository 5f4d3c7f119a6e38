"""Driver contract: entry smoke, registry/oracle coverage, and a DuckDB
comparison of a sample of check queries on the smallest test tables."""
from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "scripts"))

import __spark_entry__ as E  # noqa: E402
from nightjar.plans import checks  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["finding_replay", "backlog_topn", "kev_upsert", "rule_dga_entropy", "rule_known_bad",
          "rule_tunnel_volume", "domain_registry_merge", "quality_nulls", "page_files", "epss_file",
          "rule_registry_upsert", "retention_prune", "stream_ingest_registry"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "priority"
    assert df.count() > 0


def test_every_check_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(checks.REGISTRY) <= set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_duckdb(spark, name):
    import duckdb
    from check_oracle import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def _lineitem(spark, folder, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz") \
        .write.parquet(f"{folder}/lineitem.parquet")


def test_report_documents_take_one_shuffle_of_narrow_rows(spark, tmp_path):
    import datetime as dt
    from nightjar.plans import testviews as tv
    day = [dt.datetime(1994 + i % 2, 3, 1) for i in range(12)]
    _lineitem(spark, tmp_path, [(i // 6, 100 - i, 1 + i % 2, i, 0.05, 0.0, "R", "OF"[i % 3 == 0], day[i // 2]) for i in range(12)])
    docs = tv.report_docs(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 1 and "l_orderkey" in moved[0], moved
    got = {(d.run_key, d.file): [(r.Target, r.Class, [v.PkgName for v in r.Vulnerabilities]) for r in d.Results]
           for d in docs.collect()}
    raw, want = tv.finding_raw(spark, str(tmp_path)).orderBy("Target", "l_linenumber").collect(), {}
    for r in raw:
        results = want.setdefault((r.run_key, f"{r.ArtifactName}__o{r.l_orderkey:012d}.json"), {})
        results.setdefault((r.Target, r.Class), []).append(r.PkgName)
    assert got == {k: [(*kind, names) for kind, names in v.items()] for k, v in want.items()}
    assert max(len(r) for r in got.values()) == 2


def test_run_folders_holds_no_documents(spark, tmp_path, monkeypatch):
    """Wide documents were held in columns of thousands of rows, which took an executor's memory."""
    import datetime as dt
    from pyspark.sql.classic.dataframe import DataFrame
    _lineitem(spark, tmp_path, [(i, i, i % 3, 1, 0.05, 0.02, "A", "F", dt.datetime(1994 + i % 2, 3, 1)) for i in range(30)])

    def refuse(self, *a):
        raise AssertionError("documents are held")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    monkeypatch.setattr(DataFrame, "cache", refuse)
    assert checks.q_run_folders(spark, str(tmp_path)).count() == 30


def test_run_folders_are_written_and_read_file_by_file_on_executors(spark, tmp_path, monkeypatch):
    """Spark's JSON writer changed each file's mode by a process of its own, once for every run's
    pass, and its reader held every file's name on the driver: minutes for some ten thousand images."""
    import datetime as dt
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameReader, DataFrameWriter
    from nightjar.plans import testviews as tv
    days = [dt.datetime(1994 + i % 2, 3, 1) for i in range(60)]
    _lineitem(spark, tmp_path, [(i // 6, i, None if i % 7 == 6 else i % 7, i % 3, 0.05, 0.02, "A", "OF"[i % 5 == 0], days[i])
                                for i in range(60)])

    def refuse(self, *a, **k):
        raise AssertionError("a pass of Spark's own files")

    monkeypatch.setattr(DataFrameReader, "json", refuse)
    monkeypatch.setattr(DataFrameWriter, "json", refuse)
    got = checks.q_run_folders(spark, str(tmp_path))
    want = tv.finding_rows(spark, str(tmp_path)).select(
        *[F.coalesce("image", F.lit("")).alias("image") if c == "image" else c for c in got.columns])
    named = got.withColumn("image", F.when(F.col("image").startswith("img-"), F.col("image")).otherwise("r"))
    want = want.withColumn("image", F.when(F.col("image").startswith("img-"), F.col("image")).otherwise("r"))
    assert sorted(map(repr, named.collect())) == sorted(map(repr, want.collect())) and got.count() == 60
