"""The landing zone: JSON documents by partition, the dead-letter queue, change markers, config."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import files
from touchline.schemas import CONFIG_TREE, DLQ_ENTRY, FAILURE, LANDED_FIXTURE, schema


def land_fixtures(df: DataFrame, root: str, ds: str, full: bool = True) -> str:
    """Write flat fixtures as JSON lines below ``root``, by league and season, or as one increment."""
    stamped = df.withColumn("ds", F.lit(ds))
    if full:
        path = f"{root}/full_load"
        # only the partitions of this load are replaced
        parts = stamped.withColumns({"league": F.col("api_league_id"), "season_year": F.col("season")})
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league", "season_year", "ds").json(path)
    else:
        path = f"{root}/incremental"
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ds").json(path)
    return path


def read_landed(spark: SparkSession, path: str, ddl: str = LANDED_FIXTURE) -> DataFrame:
    """Landed JSON with its declared schema; values found in folder names come as columns, a null ``ds`` where nothing landed yet."""
    rows = spark.read.schema(ddl).json(path)
    return rows if "ds" in rows.columns else rows.withColumn("ds", F.lit(None).cast("string"))


def read_json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Documents that each hold one JSON array, a row per element."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def path_parts(df: DataFrame, names: dict[str, int]) -> DataFrame:
    """Columns taken from a file's path: output name by position from the end, 1 being the file."""
    split = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", *[F.element_at(split, -at).alias(n) for n, at in names.items()])


def read_seed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV seed with a header and declared types."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The tree of countries and leagues of a YAML file, a small one."""
    import yaml

    text = files.read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    tree = (yaml.safe_load(text) or {}).get("countries") or []
    rows = [(c.get("country"), [(lg.get("name"),) for lg in c.get("leagues") or []]) for c in tree]
    return spark.createDataFrame(rows, T.StructType.fromDDL(CONFIG_TREE))


def put_dead_letters(entries: DataFrame, root: str) -> str:
    """Append failed units (api_league_id, season_year, league_name, ds, error, traceback, timestamp)."""
    path = f"{root}/dlq"
    columns = [f.name for f in T.StructType.fromDDL(DLQ_ENTRY)]
    keyed = entries.select(*columns).withColumns({"league": F.col("api_league_id"), "year": F.col("season_year"), "day": F.col("ds")})
    keyed.write.mode("append").partitionBy("league", "year", "day").json(path)
    return path


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Open dead letters with the folder each lies in; no rows where there is no queue."""
    path = f"{root}/dlq"
    if not files.exists(spark, path):
        return spark.createDataFrame([], DLQ_ENTRY + ", folder string")
    rows = spark.read.schema(DLQ_ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def put_failures(entries: DataFrame, root: str) -> int:
    """Append failed requests and rejected payloads (pipeline, request, error, body, timestamp); their number."""
    rows = entries.select(*T.StructType.fromDDL(FAILURE).names)
    n = rows.count()
    if n:
        rows.write.mode("append").json(f"{root}/failures")
    return n


def failures(spark: SparkSession, root: str) -> DataFrame:
    """All failed requests and rejected payloads so far; no rows where there are none."""
    if not files.exists(spark, f"{root}/failures"):
        return spark.createDataFrame([], FAILURE)
    return spark.read.schema(FAILURE).json(f"{root}/failures")


def drop_dead_letters(spark: SparkSession, folders: list[str]) -> None:
    """Remove the folders of dead letters that were replayed."""
    for folder in folders:
        files.delete(spark, folder)


def residual(spark: SparkSession, root: str) -> DataFrame:
    """What is still in the queue: one row per league and season with the day, time and error of its last failure."""
    last = F.max_by(F.struct("league_name", "ds", "timestamp", "error"), F.struct("timestamp", "ds")).alias("r")
    return dead_letters(spark, root).groupBy("api_league_id", "season_year").agg(F.count(F.lit(1)).alias("n_failures"), last).select("api_league_id", "season_year", "n_failures", "r.*")


def changed_since(spark: SparkSession, path: str, marker: str) -> tuple[bool, float]:
    """Whether a file is newer than the time kept in ``marker``; call ``commit_marker`` after success."""
    seen, now = float(files.read_text(spark, marker) or 0), files.modified_at(spark, path)
    return now > seen, now


def commit_marker(spark: SparkSession, marker: str, at: float) -> None:
    files.write_text(spark, marker, repr(at))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has, in one job commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bulk_csv(df: DataFrame, path: str) -> None:
    """Delimited text with nulls as empty fields, for bulk loaders; blanks at the ends of a text stay."""
    exact = {"nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**exact).csv(path)


def publish(df: DataFrame, root: str, name: str, keep: int = 2) -> str:
    """Write a new version of a table beside the old ones and point to it by a marker file.

    Readers of an older version aren't disturbed and no path is overwritten while it is read. All
    lies in the file system of ``root``, where any driver finds it again; a version that was begun
    and not finished is never pointed to, and its number is not used again.
    """
    spark, home = df.sparkSession, f"{root}/{name}"
    versions = sorted(int(v[1:]) for v in files.children(spark, home) if v[:1] == "v" and v[1:].isdigit())
    new = (versions[-1] if versions else 0) + 1
    df.write.parquet(f"{home}/v{new}")
    files.write_text(spark, f"{home}/CURRENT", str(new))
    for old in versions[: max(0, len(versions) - keep + 1)]:
        files.delete(spark, f"{home}/v{old}")
    return f"{home}/v{new}"


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The version of a table that is in force, or None before the first."""
    version = files.read_text(spark, f"{root}/{name}/CURRENT")
    return None if version is None else spark.read.parquet(f"{root}/{name}/v{version}")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published version of a table; an empty one with the declared schema before the first."""
    held = published(spark, root, name)
    return spark.createDataFrame([], schema(name)) if held is None else held
