"""Coded-event exports: 61 tab-separated columns without a header, one file per quarter hour."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tremorline.functions import constants as C
from tremorline.functions.geo import adm1_state, first_place
from tremorline.functions.nested import payload
from tremorline.functions.scores import geo_type_precision, goldstein_severity, source_count, source_count_confidence
from tremorline.functions.text import coded_title, empty_to_null
from tremorline.functions.timefn import day_noon, floor_15, hours, instant
from tremorline.schemas import NEW_EVENT, conform

EXPORT = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(C.EXPORT_WIDTH)]
                      + [T.StructField("_bad_row", T.StringType())])


def _reader_options(reader):
    # Rows whose number of fields is not 61 are flagged, which the reader only notices when it parses all columns.
    return (reader.schema(EXPORT).option("sep", "\t").option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad_row")
            .option("columnPruning", "false").option("encoding", "UTF-8"))


def _complete() -> Column:
    # The last field is missing from a short row, however many tabs its quoted fields hold; an empty one is ''.  A
    # longer row is flagged too, but all its first 61 fields are there.
    return F.col("_bad_row").isNull() | F.col(f"c{C.EXPORT_WIDTH - 1}").isNotNull()


def named_columns(raw: DataFrame) -> DataFrame:
    """Rows with at least 61 fields, reduced to the 14 columns in use; empty fields are empty text."""
    return raw.filter(_complete()).select(*[
        F.coalesce(F.col(f"c{i}"), F.lit("")).alias(name) for name, i in C.EXPORT_COLUMNS.items()])


def read_export_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed export files, plain or gzip."""
    return named_columns(_reader_options(spark.read).csv(path))


def stream_export_tsv(spark: SparkSession, path: str, files_per_trigger: int = C.MAX_WINDOWS) -> DataFrame:
    """Export files as they land."""
    return named_columns(_reader_options(spark.readStream).option("maxFilesPerTrigger", files_per_trigger).csv(path))


def stream_landed(spark: SparkSession, path: str, files_per_trigger: int = C.MAX_WINDOWS) -> DataFrame:
    """Paths of export files as they land, plain, gzip or zip; what is in them is not read yet."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("maxFilesPerTrigger", files_per_trigger).load(path).select("path"))


def _unzipped(content: bytes, rows_at_once: int = 10_000) -> Iterator[tuple[list[list[str]], int]]:
    """Rows of the export in a zip, some at a time, with the number of short rows among them."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        inner = [n for n in archive.namelist() if n.upper().endswith(".CSV")][0]
        picked, short = [], 0
        for row in csv.reader(io.TextIOWrapper(archive.open(inner), encoding="utf-8", newline=""), delimiter="\t"):
            if len(row) >= C.EXPORT_WIDTH:
                picked.append(row)
            else:
                short += 1
            if len(picked) + short >= rows_at_once:
                yield picked, short
                picked, short = [], 0
        yield picked, short


def _unreadable() -> tuple:
    import csv
    import zipfile
    import zlib

    return zipfile.BadZipFile, IndexError, UnicodeDecodeError, csv.Error, zlib.error, EOFError


def read_export_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed ``.zip`` exports.  A zip holds one quarter hour and cannot be split, so files are the unit of work.

    Rows of an unreadable zip up to its fault are kept, as of a broken plain file; ``audit_landed`` reports it.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    columns = dict(C.EXPORT_COLUMNS)

    def unzip(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                try:
                    for rows, _ in _unzipped(content):
                        yield pd.DataFrame([[row[i] for i in columns.values()] for row in rows], columns=list(columns), dtype="str")
                except _unreadable():
                    continue  # one unreadable file does not stop the run

    return files.mapInPandas(unzip, ", ".join(f"{name} string" for name in columns))


def read_landed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Landed exports of either kind."""
    zips = [p for p in paths if p.lower().endswith(".zip")]
    plain = [p for p in paths if p not in zips]
    parts = [read(spark, some) for read, some in ((read_export_tsv, plain), (read_export_zip, zips)) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def audit_landed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, rows, short_rows, error``: complete rows, rows of too few fields, and why a zip could not be read to its end."""
    zips = [p for p in paths if p.lower().endswith(".zip")]
    plain = [p for p in paths if p not in zips]
    schema = "file string, rows long, short_rows long, error string"
    out = spark.createDataFrame([], schema)
    if plain:
        raw = _reader_options(spark.read).csv(plain).withColumn("file", F.col("_metadata.file_path"))
        out = out.unionByName(raw.groupBy("file").agg(F.count_if(_complete()).alias("rows"), F.count_if(~_complete()).alias("short_rows"))
                              .withColumn("error", F.lit(None).cast("string")))
    if zips:
        def audit(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    rows, short, error = 0, 0, None
                    try:
                        for some, missed in _unzipped(content):
                            rows, short = rows + len(some), short + missed
                    except _unreadable() as e:
                        error = f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"file": [path], "rows": [rows], "short_rows": [short], "error": pd.array([error], "string")})

        out = out.unionByName(spark.read.format("binaryFile").load(zips).select("path", "content").mapInPandas(audit, schema))
    return out


def filter_export(rows: DataFrame) -> DataFrame:
    """US rows of the three unrest root codes with real coordinates and a valid day."""
    lat, lon = F.col("geo_lat").try_cast("double"), F.col("geo_long").try_cast("double")
    return rows.filter(
        (F.col("geo_country") == "US") & F.trim("root_code").isin(list(C.ROOT_CODES))
        & lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0.0) & (lon == 0.0))
        & day_noon(F.col("day")).isNotNull())


def normalize_export(rows: DataFrame) -> DataFrame:
    """Canonical rows; rows that cannot be used are dropped.  One projection over the scan, no shuffle."""
    root, city = F.trim("root_code"), first_place(F.trim("geo_name"))
    event_type = F.lit("unrest")
    for code, (kind, _) in C.ROOT_CODES.items():
        event_type = F.when(root == code, F.lit(kind)).otherwise(event_type)
    scale = F.coalesce(F.col("goldstein").try_cast("double"), F.lit(0.0))
    out = filter_export(rows).select(
        F.concat(F.lit(f"{C.CODED_FEED}-"), F.trim("global_event_id")).alias("source_id"),
        coded_title(root, city, F.trim("geo_name")).alias("title"),
        F.lit(None).cast("string").alias("summary"), event_type.alias("event_type"), city.alias("city"),
        adm1_state(F.trim("geo_adm1")).alias("state"), F.lit("US").alias("country"),
        F.col("geo_lat").try_cast("double").alias("latitude"),
        F.col("geo_long").try_cast("double").alias("longitude"), day_noon(F.col("day")).alias("occurred_at"),
        empty_to_null(F.trim("source_url")).alias("source_url"), F.lit(C.CODED_FEED).alias("source_name"),
        source_count(F.col("num_sources")).alias("source_count"),
        source_count_confidence(F.col("num_sources")).alias("confidence_score"),
        goldstein_severity(F.col("goldstein")).alias("severity_score"),
        geo_type_precision(F.trim("geo_type")).alias("location_precision"),
        payload(event_code=F.trim("event_code"), root_code=root, actor1=F.trim("actor1_name"), goldstein=scale)
        .alias("raw_payload_json"))
    return conform(out, NEW_EVENT)


def pending_windows(runs: DataFrame, now: datetime | str | Column, landed: DataFrame | None = None,
                    source: str = C.CODED_FEED, max_windows: int | None = C.MAX_WINDOWS) -> DataFrame:
    """Quarter hours still to be read: ``window_start, file_name``.

    From the last successful run of the source to one quarter hour before ``now``, at most ``max_windows`` of them
    (None: the whole gap; a first run then starts 96 windows back); those whose file name is in ``landed`` are left out.
    ``skipped_windows`` tells what a bound leaves behind.
    """
    quarter = F.expr("INTERVAL 15 MINUTES")
    done = runs.filter((F.col("ingest_source") == source) & (F.col("status") == "success")).agg(
        F.max("finished_at").alias("since"))
    upper = floor_15(instant(now)) - quarter
    oldest = upper - hours((C.MAX_WINDOWS - 1) / 4)
    since = F.coalesce(floor_15(F.col("since")), oldest)
    lower = since if max_windows is None else F.greatest(since, upper - hours((max_windows - 1) / 4))
    windows = done.select(F.explode(F.when(lower <= upper, F.sequence(lower, upper, quarter))).alias("window_start"))
    named = windows.withColumn("file_name", F.concat(
        F.date_format("window_start", C.EXPORT_FILE_FORMAT), F.lit(C.EXPORT_FILE_SUFFIX)))
    return named if landed is None else named.join(landed.select("file_name"), "file_name", "left_anti")


def skipped_windows(runs: DataFrame, now: datetime | str | Column, source: str = C.CODED_FEED,
                    max_windows: int = C.MAX_WINDOWS) -> DataFrame:
    """How many quarter hours since the last successful run are older than the catch-up bound: ``skipped``."""
    upper = floor_15(instant(now)) - F.expr("INTERVAL 15 MINUTES")
    lower = upper - hours((max_windows - 1) / 4)
    return runs.filter((F.col("ingest_source") == source) & (F.col("status") == "success")).agg(
        F.max("finished_at").alias("since")).select(
        F.greatest(F.lit(0), F.coalesce((F.unix_seconds(lower) - F.unix_seconds(floor_15(F.col("since")))) / 900, F.lit(0)))
        .cast("long").alias("skipped"))
