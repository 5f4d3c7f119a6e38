"""State tables as plain Parquet folders (S-9), written by Spark's own commits.

* **Runs** (query rows, registry, envelopes, hourly counters and sketches): partitioned by run
  key, query rows by day too. A batch writes its own partitions with dynamic partition
  overwrite, so a batch that is done again replaces what its first attempt left. Registry,
  counters and sketches are folded when read, as their aggregates commute.
* **Buckets** (findings): partitioned by a hash of the image. A scan run rewrites the buckets of
  its images and leaves the others' files alone.
* **Versions** (small tables that are replaced whole): the newest folder with Spark's success
  marker counts; the one before it is kept, older ones are deleted.

``run(key)`` opens a batch: what it writes carries its key, and ``state`` reads tables as they
were before the batch, without what an attempt that died has left. A batch's last write is
its envelope in ``scan_run``: with it the batch is done, without it the batch is done again,
with the same result. One writer per store.

Once more than ``SETTLE`` finished runs of a folded table stand side by side, they are folded
into a version that also names them, and then deleted; a run that a version names is never
read beside it. So the files of a store grow with its rows, not with its batches.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import rollups, sketches
from ..operators.dns import fold_registry
from ..session import drop_path

SETTLE = 32
BUCKETS = 64            # of the findings
RUNS = {"dns_query": ["day", "run_key"], "dns_domain": ["run_key"], "scan_run": ["run_key"],
        "dns_hourly": ["run_key"], "dns_sketch": ["run_key"]}
FOLD = {"dns_domain": fold_registry, "scan_run": lambda x: x, "dns_hourly": rollups.fold, "dns_sketch": sketches.fold}
BUCKETED = {"vuln_finding": "image"}


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._run: str | None = None          # the open batch
        self._keys: set[str] = set()          # and all runs that it writes

    def _names(self, folder: str) -> list[str]:
        """Sub-folders of a folder, from metadata."""
        path = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path) if f.isDirectory()
                      and not f.getPath().getName().startswith((".", "_"))) if self._fs.exists(path) else []

    @contextmanager
    def run(self, key: str, members: list[str] = ()) -> Iterator[TableStore]:
        """The batch ``key``: all that is written inside is its own. ``members`` are runs that it
        writes besides, by rows that carry their key."""
        if self._run is not None:
            raise RuntimeError(f"batch {self._run} is open")
        keys = {key, *members}
        for table in FOLD:
            self._settle(table, keys)
        self._run, self._keys = key, keys
        try:
            yield self
        finally:
            self._run, self._keys = None, set()

    # ------------------------------------------------------------------ read
    def read(self, table: str) -> DataFrame:
        return self._read(table, None)

    def has(self, table: str) -> bool:
        """Whether the table was ever written."""
        return bool(self._names(table) or self._names(f"{table}_base"))

    def state(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as it was before the open batch; of findings, some buckets alone."""
        return self._read(table, self._run, buckets)

    def _read(self, table: str, but: str | None, buckets: list[int] | None = None) -> DataFrame:
        schema = schemas.STATE_SCHEMAS[table]
        if table in RUNS:
            return self._runs(table, set() if but is None else self._keys)
        if table in BUCKETED and self._names(table):
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])) \
                .parquet(f"{self.root}/{table}")
            return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).select(*schema.names)
        newest = self._newest(table, but)
        return self._version(newest, schema) if newest else self.spark.createDataFrame([], schema)

    def _runs(self, table: str, but: set[str]) -> DataFrame:
        schema, by = schemas.STATE_SCHEMAS[table], RUNS[table]
        extra = [T.StructField(c, T.DateType() if c == "day" else T.StringType()) for c in by if c not in schema.names]
        names = schema.names + (["day"] if "day" in by else [])
        full = T.StructType([*schema.fields, *extra])
        rows = self.spark.createDataFrame([], full)
        base, covered = self._base(table)
        if self._names(table):
            rows = self.spark.read.schema(full).parquet(f"{self.root}/{table}")
            if covered | but:                   # run keys are partitions: what is left out is not read
                rows = rows.filter(~F.col("run_key").isin(sorted(covered | but)))
        cut = max(map(unquote, self._names("retention")), default=None)
        if cut and table == "dns_query":
            clock = F.lit(cut).cast("timestamp")
            rows = rows.filter((F.col("day") >= F.to_date(clock)) & (F.col("ts") >= clock))
        if cut and table in ("dns_hourly", "dns_sketch"):
            rows = rows.filter(F.col("hour") >= F.date_trunc("hour", F.lit(cut).cast("timestamp")))
        rows = rows.select(*names)
        return FOLD.get(table, lambda x: x)(rows.unionByName(base) if base is not None else rows)

    # -------------------------------------------------------------- versions
    def _newest(self, table: str, but: str | None = None) -> str | None:
        """Path of the newest complete version (not of the batch ``but``)."""
        for name in reversed(self._names(table)):
            whole = self._fs.exists(self._path(f"{self.root}/{table}/{name}/_SUCCESS"))
            if whole and (but is None or name.partition("@")[2] != quote(but, safe="")):
                return f"{self.root}/{table}/{name}"
        return None

    def _version(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _replace(self, table: str, df: DataFrame) -> str:
        names = self._names(table)
        own = f"@{quote(self._run or '', safe='')}"
        again = bool(names) and self._run is not None and names[-1].endswith(own)
        n = int(names[-1][8:20]) + (not again) if names else 1
        path = f"{self.root}/{table}/version={n:012d}{own}"
        df.write.mode("overwrite").parquet(path)
        for old in names:
            if int(old[8:20]) < n - 1:
                drop_path(self.spark, f"{self.root}/{table}/{old}")
        return path

    # --------------------------------------------------------------- folding
    def _base(self, table: str) -> tuple[DataFrame | None, set[str]]:
        """The folded version of a runs table, and the runs that it holds."""
        newest = self._newest(f"{table}_base")
        if newest is None:
            return None, set()
        schema = schemas.STATE_SCHEMAS[table]
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("covered", T.StringType())])).parquet(newest)
        return rows.filter("covered IS NULL").select(*schema.names), \
            {r.covered for r in rows.filter("covered IS NOT NULL").select("covered").collect()}

    def _settle(self, table: str, opening: set[str]) -> None:
        """Folds finished runs into a version once there are many."""
        folders = {unquote(n.partition("=")[2]): n for n in self._names(table)}
        if len(folders) <= SETTLE:
            return
        done = {r.run_key for r in self.read("scan_run").select("run_key").collect()} - opening     # short keys
        named = self.spark.createDataFrame([(k,) for k in folders if k in done], "covered string")
        rows = self._runs(table, set(folders) - done)
        self._replace(f"{table}_base", rows.unionByName(named, allowMissingColumns=True))
        for key in folders.keys() & done:
            drop_path(self.spark, f"{self.root}/{table}/{folders[key]}")

    # ----------------------------------------------------------------- write
    def _typed(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.STATE_SCHEMAS[table].fields])

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Replaces a table (findings: the buckets that ``df`` holds); gives what was written."""
        out = self._typed(table, df)
        if table in BUCKETED:
            return self._overwrite(table, out.withColumn("bucket", self.bucket(table)), ["bucket"])
        return self._version(self._replace(table, out), schemas.STATE_SCHEMAS[table])

    def append(self, table: str, df: DataFrame) -> DataFrame:
        """Adds the open batch's rows, to the run that their ``run_key`` names if they have one;
        gives them as written."""
        out = self._typed(table, df)
        if "run_key" not in out.columns:
            if self._run is None:
                raise RuntimeError(f"rows of {table} belong to a batch: open one with run()")
            own = F.col("run_key") if "run_key" in df.columns else F.lit(self._run)
            fields = [F.col(f.name).cast(f.dataType) for f in schemas.STATE_SCHEMAS[table].fields]
            out = df.select(*fields, own.alias("run_key"))
        by = RUNS[table]
        if "day" in by:         # a hot day is split among tasks by its size, a small one is one file
            out = out.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
        written = self._overwrite(table, out, by)
        if self._run is not None:
            written = written.filter(F.col("run_key").isin(sorted(self._keys)))
        return written.select(*schemas.STATE_SCHEMAS[table].names)

    def _overwrite(self, table: str, df: DataFrame, by: list[str]) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def bucket(table: str):
        return F.pmod(F.xxhash64(BUCKETED[table]), F.lit(BUCKETS)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of some key values: ``BUCKETS`` numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket(table).alias("b")).distinct().collect())

    def retain(self, cutoff: str) -> None:
        """U-7: query rows before ``cutoff`` (a timestamp's text) are gone from now on; folders
        of days before it are deleted."""
        known = self._names("retention")
        cutoff = max([cutoff, *map(unquote, known)])
        self._fs.mkdirs(self._path(f"{self.root}/retention/{quote(cutoff)}"))
        for old in known:
            if unquote(old) < cutoff:
                drop_path(self.spark, f"{self.root}/retention/{old}")
        for day in self._names("dns_query"):
            if day.partition("=")[2] < cutoff[:10]:
                drop_path(self.spark, f"{self.root}/dns_query/{day}")
