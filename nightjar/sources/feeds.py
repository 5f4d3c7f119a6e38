"""S-5 .. S-8: landed feed files (exploited list, probability scores,
hostfile blocklist, exposure map)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import feeds as feedops
from ..operators import quality


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """Exploited-vulnerability JSON -> kev rows (feed order kept as ord). A
    feed that is cut off or lists nothing fails the read."""
    doc = spark.read.schema(schemas.KEV_FEED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if doc.filter(F.size("vulnerabilities") > 0).limit(1).count() == 0:
        raise ValueError(f"{path} lists no vulnerabilities")
    ent = doc.select(F.posexplode("vulnerabilities").alias("ord", "v")).select("ord", "v.*")
    return feedops.kev_rows(ent)


def epss_model_date(spark: SparkSession, path: str):
    """``score_date`` of the leading comment line, cut to 10 characters, as
    a date Column value; NULL when there is no such line."""
    lines = spark.read.text(path).filter(F.col("value").startswith("#")).limit(1)
    val = lines.select(F.left(F.trim(F.regexp_extract("value", r"score_date:([^,]*)", 1)), F.lit(10))
                       .alias("d")).first()
    return val["d"] if val and val["d"] else None


def csv_columns(spark: SparkSession, path: str, required: list[str], optional: list[str] = (),
                comment: str | None = None) -> DataFrame:
    """Columns of a CSV file by the names in its header, as text."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*required, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional])


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """Probability CSV (gzip ok) -> score rows. A gzip file is one split,
    so the rows are spread over the cluster right after the read."""
    csv = csv_columns(spark, path, schemas.EPSS_CSV.names, comment="#")
    csv = csv.withColumn("ord", F.monotonically_increasing_id())
    parts = spark.sparkContext.defaultParallelism
    return feedops.epss_rows(csv, epss_model_date(spark, path)).repartition(parts, "cve")


def read_hostfile(spark: SparkSession, path: str) -> DataFrame:
    """Hostfile blocklist -> distinct domains."""
    return feedops.hostfile_domains(spark.read.text(path))


def read_exposure(spark: SparkSession, path: str) -> DataFrame:
    """Exposure map: YAML ``images: {image: {exposure, note}}`` (a small
    hand-written file, parsed on the driver), or JSON/CSV/parquet rows of
    (image, exposure, note)."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover
            raise RuntimeError("PyYAML is needed for YAML exposure maps; use JSON/CSV instead") from exc
        doc = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
        rows = [(img, (spec or {}).get("exposure", "unknown"), (spec or {}).get("note"))
                for img, spec in (doc.get("images") or {}).items()]
        df = spark.createDataFrame(rows, "image string, exposure string, note string")
    elif path.endswith(".csv"):
        df = csv_columns(spark, path, ["image"], ["exposure", "note"])
    elif path.endswith(".json"):
        df = spark.read.schema("image string, exposure string, note string").option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.parquet(path)
    out = feedops.exposure_rows(df)
    bad = quality.enum_violations(out, "exposure", schemas.EXPOSURES, keep=["image"]).limit(5).collect()
    if bad:
        raise ValueError(f"{path}: exposure must be one of {schemas.EXPOSURES}: {[tuple(r) for r in bad]}")
    return out
