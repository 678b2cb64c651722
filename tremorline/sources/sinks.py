"""Writing tables.  Tables are Parquet; ``append_events`` partitions incidents by day so time windows prune."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.timefn import instant
from tremorline.operators.dedup import exact_dedup
from tremorline.schemas import INGEST_RUN, conform


def new_rows(batch: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a batch to append: their id is neither stored nor repeated within the batch."""
    return exact_dedup(batch, events, order)


def append_events(df: DataFrame, path: str) -> None:
    (df.withColumn("event_date", F.to_date("occurred_at")).write.mode("append").partitionBy("event_date")
     .parquet(path))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a whole table as a new version next to the old ones, which readers may still hold; returns its path."""
    target = f"{path}/version={version:012d}"
    df.write.mode("overwrite").parquet(target)
    return target


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table written by ``replace_snapshot``; it may be an empty one."""
    return spark.read.parquet(_versions(spark, path)[-1])


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(folder) if fs.exists(fs_path(f.getPath(), "_SUCCESS")))


def run_entry(spark: SparkSession, run_id: int, started_at: datetime | str | Column, source: str, status: str,
              finished_at: datetime | str | Column | None = None, inserted: int = 0, error: str | None = None,
              error_chars: int | None = C.ERROR_CHARS) -> DataFrame:
    """One row of the run log.  A run appends ``running`` first and its outcome later."""
    if error is not None and error_chars is not None:
        error = error[:error_chars]
    row = spark.range(1).select(
        F.lit(run_id).alias("id"), instant(started_at).alias("started_at"),
        (instant(finished_at) if finished_at is not None else F.lit(None).cast("timestamp")).alias("finished_at"),
        F.lit(status).alias("status"), F.lit(inserted).alias("events_inserted"),
        F.lit(error).cast("string").alias("error_message"),
        F.lit(source).alias("ingest_source"))
    return conform(row, INGEST_RUN)


def current_runs(log: DataFrame) -> DataFrame:
    """State of each run: its last entry, where an outcome comes after ``running`` and a retry's success after its failure."""
    rest = [c for c in log.columns if c != "id"]
    order = F.struct((F.col("status") != "running").alias("over"), F.col("finished_at"),
                     (F.col("status") == "success").alias("done"))
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")


def checkpoint_of(runs: DataFrame, source: str) -> DataFrame:
    """``since``: finish time of the last successful run of a source, null for a first run."""
    return runs.filter((F.col("ingest_source") == source) & (F.col("status") == "success")).agg(
        F.max("finished_at").alias("since"))


def _feature(key: str, lon: str, lat: str, properties: list[Column]) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), geometry.alias("geometry"),
                              F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def events_geojson(events: DataFrame) -> DataFrame:
    """One GeoJSON point feature per incident (``write.text`` gives newline-delimited GeoJSON)."""
    return events.select("id", _feature("id", "longitude", "latitude", [
        F.col("id"), F.col("severity_score"), F.col("event_type")]).alias("feature"))


def hotspots_geojson(hotspots: DataFrame) -> DataFrame:
    return hotspots.select("id", _feature("id", "centroid_lon", "centroid_lat", [
        F.col("id"), F.coalesce("trend_state", F.lit("stable")).alias("trend_state")]).alias("feature"))
