"""S-3: query-log pages ``{"data": [entry, ...]}`` landed as JSON files.

The run key of a file is its name. ``elapsedMs`` is read as a string so
numbers and numeric strings both load.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def page_files(spark: SparkSession, path: str) -> list[str]:
    """The page files of a folder (or the file itself), by name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile()
                  and not f.getPath().getName().startswith(("_", ".")))


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of the page files at ``path``, with run_key (file name) and
    input order ``ord = (file, position)``. A file that is not one whole JSON
    document with a ``data`` list fails the read."""
    pages = (spark.read.schema(schemas.DNS_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
             .select("data", F.col("_metadata.file_path").alias("file")))
    data = F.coalesce("data", F.raise_error(F.concat(F.lit("no list of entries in "), F.col("file"))))
    ent = pages.select("file", F.posexplode(data).alias("pos", "e"))
    return ent.select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("run_key"),
        F.struct("file", "pos").alias("ord"),
        "e.*")
