"""Structured Streaming feeds over the same operators.

Every batch appends under its batch number, so a batch that is run again after a failure replaces its own output.  A
failed batch is logged and raises: its files stay uncommitted, and the next run of the feed reads them again.
Nothing is updated in place: confidence follows from the appended provenance rows when incidents are read.

What a batch or a reader needs of the past is kept beside the tables in ledgers (``sources.ledger``): the source ids of
each feed by hash bucket, and the corroboration counts per incident.  So a batch reads the ids of its buckets instead of
the incidents stored so far, and a reader of confidence sums counts instead of all sources.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tremorline.functions import constants as C
from tremorline.functions.timefn import hours, instant
from tremorline.operators.classify import DEFAULT_LEXICON, Lexicon
from tremorline.operators.corroboration import apply_corroboration, corroboration_counts, provenance_rows
from tremorline.operators.dedup import exact_dedup
from tremorline.operators.discovery import discover_novel
from tremorline.operators.hotspots import assign_clusters, compute_hotspots
from tremorline.operators.matching import best_match
from tremorline.operators.numbering import numbered
from tremorline.operators.syndication import syndication_rules
from tremorline.schemas import EVENT, EVENT_SOURCE, INGEST_RUN, as_events
from tremorline.session import cut_lineage
from tremorline.sources import articles as A
from tremorline.sources import exports as X
from tremorline.sources import sinks
from tremorline.sources.ledger import Ledger, publish, published
from tremorline.sources.samples import sample_events


LATE = "stream string, at timestamp, n long"
COUNTS = "event_id long, independent long, syndicated long"
IDS, ID_BUCKETS = "source_id string, bucket int", 64


def summed_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("event_id").agg(F.sum("independent").alias("independent"), F.sum("syndicated").alias("syndicated"))


def id_bucket(source_id: Column) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(ID_BUCKETS)).cast("int")


def id_rows(events: DataFrame) -> DataFrame:
    """What the ledger of ids keeps of incidents; incidents without an id are never repeated ones."""
    return events.where(F.length("source_id") > 0).select("source_id", id_bucket(F.col("source_id")).alias("bucket")).distinct()


def corroborating(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources without the articles that opened their incident, which are no corroboration of it."""
    def article(*columns: str) -> Column:
        """64 bits of id, title and time.  A source meets one incident, so titles need not travel to be compared."""
        return F.when(F.col(columns[1]).isNotNull() & F.col(columns[2]).isNotNull(), F.xxhash64(*columns))

    openers = events.filter(F.col("source_name") == C.ARTICLE_FEED).select(
        F.col("id").alias("event_id"), article("source_id", "title", "occurred_at").alias("_article"))
    marked = sources.withColumn("_article", article("source_record_id", "source_title", "source_published_at"))
    return marked.join(openers, ["event_id", "_article"], "left_anti").drop("_article")


@dataclass(frozen=True)
class Store:
    """Folders of the tables: ``events`` and ``sources`` grow by batch, ``runs`` is a log, hotspots are snapshots.

    Inside a batch, incidents are partitioned by day, so reads of a time window skip the other days.
    """

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        """A table, or no rows when nothing was written yet."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(self.path(name))

    def events(self, spark: SparkSession, since: Column | None = None) -> DataFrame:
        """Incidents, or those of the days from ``since`` on; other days are not read."""
        stored = self._read(spark, "events", EVENT)
        if since is not None and "event_date" in stored.columns:
            stored = stored.filter(F.col("event_date") >= F.to_date(since))
        return stored.select(*EVENT.fieldNames())

    def sources(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "sources", EVENT_SOURCE).select(*EVENT_SOURCE.fieldNames())

    def runs(self, spark: SparkSession) -> DataFrame:
        return sinks.current_runs(self._read(spark, "runs", INGEST_RUN).select(*INGEST_RUN.fieldNames()))

    def attempts(self, spark: SparkSession) -> DataFrame:
        """Failures of single files: ``batch, file, at, error``."""
        return self._read(spark, "attempts", StructType.fromDDL(ATTEMPTS))

    def rejected(self, spark: SparkSession) -> DataFrame:
        """Files with rows of too few fields, and zips that break off: ``file, rows, short_rows, error``."""
        columns = StructType.fromDDL(REJECTED)
        return self._read(spark, "rejected", columns).select(*columns.fieldNames())

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came behind the watermark of a stream and were not counted: ``stream, at, n``."""
        return self._read(spark, "late", StructType.fromDDL(LATE))

    def corroborated_events(self, spark: SparkSession, since: Column | None = None) -> DataFrame:
        """Incidents (from the day of ``since`` on) with the source counts and confidence their provenance gives them.

        Counts come from the ledger: one row per incident for what was merged, and those of the batches since.
        """
        events, counts = self.events(spark, since), self.counts.read(spark)
        if since is not None:
            counts = counts.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        return apply_corroboration(events, summed_counts(counts))

    @property
    def counts(self) -> Ledger:
        """``event_id, independent, syndicated`` per batch of articles."""
        return Ledger(self.path("_counts"), COUNTS, summed_counts)

    def ids(self, feed: str) -> Ledger:
        """Source ids of the stored incidents of a feed, by hash bucket."""
        return Ledger(self.path(f"_ids/{feed}"), IDS, DataFrame.distinct, "bucket")

    def stored_ids(self, batch_rows: DataFrame, feed: str, batch: int) -> DataFrame:
        """``source_id`` of what earlier batches of the feed have stored, read from the buckets of this batch only."""
        spark = batch_rows.sparkSession
        asked = batch_rows.where(F.length("source_id") > 0).select(id_bucket(F.col("source_id")).alias("b")).distinct()
        buckets = [r["b"] for r in asked.collect()]  # at most ID_BUCKETS numbers
        return self.ids(feed).read(spark, buckets, without=batch).select("source_id")

    def merge_ledgers(self, spark: SparkSession) -> None:
        """Fold finished batches into new bases; run it now and then.  What is read stays the same."""
        self.counts.merge(spark)
        for feed in FEED_NUMBER:
            self.ids(feed).merge(spark)

    def rebuild_ledgers(self, spark: SparkSession) -> None:
        """Derive the ledgers from incidents and sources, for a store that was written without them."""
        self.counts.clear(spark)
        events, sources = self.events(spark), self.sources(spark)
        of_batch = lambda n: F.floor(F.col("id") / F.lit(4 * ROWS_PER_BATCH))
        for r in sources.select(of_batch("id").alias("n")).distinct().orderBy("n").collect():  # one row per batch
            own = sources.where(of_batch("id") == r["n"])
            self.counts.add(corroboration_counts(corroborating(own, events)), r["n"])
        for feed in FEED_NUMBER:
            self.ids(feed).clear(spark)
            own = events.where(F.col("source_name") == feed)
            newest = own.agg(F.max(of_batch("id"))).first()[0]
            if newest is not None:
                self.ids(feed).add(id_rows(own), newest)

    def trends(self, spark: SparkSession) -> DataFrame:
        """Eight-hour counts as ``run_trend_windows`` keeps them."""
        return spark.read.parquet(self.path("trend_windows")).drop("window_date")

    def batch_path(self, name: str, feed: str, batch: int) -> str:
        return f"{self.path(name)}/batch={feed}-{batch:012d}"

    def write_batch(self, df: DataFrame, name: str, feed: str, batch: int) -> None:
        writer = df.write.mode("overwrite")
        if name == "events":
            writer = df.withColumn("event_date", F.to_date("occurred_at")).write.mode("overwrite").partitionBy("event_date")
        writer.option("compression", "zstd").parquet(self.batch_path(name, feed, batch))
        if name == "events":
            written = df.sparkSession.read.schema(EVENT).parquet(self.batch_path(name, feed, batch))
            self.ids(feed).add(id_rows(written), batch)

    def latest(self, spark: SparkSession, name: str) -> DataFrame:
        """The version of a published table that the last manifest names."""
        found = published(spark, self.root, name)
        if found is None:
            raise ValueError(f"{name} was not published yet")
        return found


def run_once(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that has landed, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows the stateful operators of a finished run dropped because they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def log_late(spark: SparkSession, store: Store, stream: str, query: StreamingQuery, now: Clock) -> int:
    """Keep the number of late rows of a run in the store, if there are any."""
    n = late_rows(query)
    if n:
        row = spark.range(1).select(F.lit(stream).alias("stream"), instant(_time(now)).alias("at"), F.lit(n).cast("long").alias("n"))
        sinks.append_rows(row, store.path("late"))
    return n


def dedup_stream(df: DataFrame, keep: str = "24 hours", key: str = "source_id", ts: str = "occurred_at") -> DataFrame:
    """First row of each key, with state bounded by the watermark.  Rows later than ``keep`` are dropped."""
    return df.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


FEED_NUMBER = {C.CODED_FEED: 0, C.ARTICLE_FEED: 1, C.SAMPLE_FEED: 2}
ROWS_PER_BATCH = 1 << 40


def batch_number(feed: str, batch: int) -> int:
    """Number of a batch among those of all feeds."""
    return batch * 4 + FEED_NUMBER[feed]


def with_ids(rows: DataFrame, feed: str, batch: int) -> DataFrame:
    """Give new incidents unique ids: the batch in the high bits, then a running number within the batch."""
    return numbered(rows.drop("id"), [], "id", batch_number(feed, batch) * ROWS_PER_BATCH)


def of_other_batches(events: DataFrame, feed: str, batch: int) -> DataFrame:
    """Incidents without those an earlier attempt at this batch has written."""
    return events.filter(F.floor(F.col("id") / F.lit(ROWS_PER_BATCH)) != batch_number(feed, batch))


Clock = datetime | str | Column | Callable[[], datetime | str | Column]


def _time(now: Clock) -> datetime | str | Column:
    """A feed that runs on takes a callable, which is asked again for every batch."""
    return now() if callable(now) else now


def _logged(spark: SparkSession, store: Store, batch: int, source: str, now: Clock,
            work: Callable[[datetime | str | Column], int]) -> None:
    """Run ``work(started) -> rows inserted`` between log entries; a failure is recorded and raised again.

    Raising keeps the batch uncommitted, so no landed file is lost.
    """
    run_id, started = batch_number(source, batch), _time(now)
    sinks.append_rows(sinks.run_entry(spark, run_id, started, source, "running"), store.path("runs"))
    try:
        inserted = work(started)
    except Exception as e:
        sinks.append_rows(sinks.run_entry(spark, run_id, started, source, "failed", _time(now), 0, str(e)), store.path("runs"))
        raise
    sinks.append_rows(sinks.run_entry(spark, run_id, started, source, "success", _time(now), inserted), store.path("runs"))


def _append(fresh: DataFrame, store: Store, feed: str, batch: int) -> int:
    store.write_batch(with_ids(fresh, feed, batch).select(*EVENT.fieldNames()), "events", feed, batch)
    return fresh.sparkSession.read.schema(EVENT).parquet(store.batch_path("events", feed, batch)).count()


def ingest_exports(rows: DataFrame, store: Store, batch: int, now: datetime | str | Column) -> int:
    """Normalise a batch of export rows and append what is new; returns the number of new incidents."""
    normal = cut_lineage(X.normalize_export(rows))
    fresh = exact_dedup(normal, store.stored_ids(normal, C.CODED_FEED, batch), ["occurred_at", "title", "source_url"])
    return _append(as_events(fresh, instant(now)), store, C.CODED_FEED, batch)


def ingest_samples(spark: SparkSession, store: Store, batch: int, now: datetime | str | Column) -> int:
    """Append the sample incidents that are not stored yet."""
    samples = sample_events(spark, now)
    fresh = exact_dedup(samples, store.stored_ids(samples, C.SAMPLE_FEED, batch), ["occurred_at"])
    return _append(as_events(fresh, instant(now)), store, C.SAMPLE_FEED, batch)


def reset_and_seed(spark: SparkSession, store: Store, now: datetime | str | Column) -> DataFrame:
    """Replace all incidents by the samples and recompute hotspots; provenance and run log stay."""
    samples = with_ids(as_events(sample_events(spark, now), instant(now)), C.SAMPLE_FEED, 0).select(*EVENT.fieldNames())
    (samples.withColumns({"batch": F.lit(f"{C.SAMPLE_FEED}-{0:012d}"), "event_date": F.to_date("occurred_at")})
     .write.mode("overwrite").partitionBy("batch", "event_date").parquet(store.path("events")))
    for feed in FEED_NUMBER:
        store.ids(feed).clear(spark)
    store.ids(C.SAMPLE_FEED).add(id_rows(samples), 0)
    return refresh_hotspots(spark, store, now)


REJECTED = "file string, rows long, short_rows long, error string"
ATTEMPTS = "batch long, file string, at timestamp, error string"


def _culprits(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Files that cannot be read on their own, with the error; a batch has a bounded number of files."""
    found = {}
    for file in files:
        try:
            X.normalize_export(X.read_landed(spark, [file])).write.format("noop").mode("overwrite").save()
        except Exception as e:
            found[file] = str(e)[:C.ERROR_CHARS]
    return found


def ingest_landed(spark: SparkSession, files: list[str], store: Store, batch: int, now: datetime | str | Column,
                  attempts: int = 3) -> int:
    """Append what is new in landed export files; returns the number of new incidents.

    If the batch fails, files that cannot be read on their own are noted.  The batch is tried again as a whole until such
    a file has failed ``attempts`` times; then it is set aside and the others go on.  Files with rejected rows, and zips
    that break off, are counted in the table ``rejected``.
    """
    tried = store.attempts(spark).groupBy("file").agg(F.count("*").alias("n"))
    failed = {r["file"]: r["n"] for r in tried.where(F.col("file").isin(files)).collect()}
    files = [f for f in files if failed.get(f, 0) < attempts]

    def work() -> int:
        if not files:
            return 0
        inserted = ingest_exports(X.read_landed(spark, files), store, batch, now)
        audit = X.audit_landed(spark, files).where("short_rows > 0 or error is not null")
        store.write_batch(audit, "rejected", C.CODED_FEED, batch)
        return inserted

    try:
        return work()
    except Exception:
        bad = _culprits(spark, files)
        if not bad:
            raise
        noted = spark.createDataFrame([(batch, f, e) for f, e in bad.items()], "batch long, file string, error string")
        sinks.append_rows(noted.select("batch", "file", instant(now).alias("at"), "error"), store.path("attempts"))
        if any(failed.get(f, 0) + 1 < attempts for f in bad):
            raise
        files = [f for f in files if f not in bad]
        return work()


def run_export_feed(spark: SparkSession, landed: str, store: Store, now: Clock,
                    files_per_trigger: int = C.MAX_WINDOWS, once: bool = True, attempts: int = 3):
    """Follow a folder of landed exports, plain, gzip or zip.  ``once`` processes what is there; otherwise polls every 30
    minutes.  A file that failed ``attempts`` times is set aside."""

    def handle(rows: DataFrame, batch: int) -> None:
        files = sorted(r["path"] for r in rows.collect())  # at most files_per_trigger
        _logged(rows.sparkSession, store, batch, C.CODED_FEED, now,
                lambda started: ingest_landed(rows.sparkSession, files, store, batch, started, attempts))

    writer = (X.stream_landed(spark, landed, files_per_trigger).writeStream.foreachBatch(handle)
              .option("checkpointLocation", store.path("_exports_checkpoint")))
    if once:
        return run_once(writer)
    return writer.trigger(processingTime=f"{C.POLL_SECONDS} seconds").start()


def ingest_articles(rows: DataFrame, store: Store, batch: int, now: datetime | str | Column,
                    lexicon: Lexicon = DEFAULT_LEXICON, min_precision: str = "city", create_new: bool = False,
                    max_new: int | None = C.MAX_NEW_EVENTS) -> int:
    """Classify a batch of articles, match them to stored incidents and append their provenance.

    With ``create_new``, articles that match nothing open new incidents, at most ``max_new`` (None: all) per batch; their number
    is returned.  Without a feed position ``ord``, newer articles come first.
    """
    spark = rows.sparkSession
    fed = "ord" in rows.columns
    if not fed:
        rows = rows.withColumn("ord", F.xxhash64("uri", "url", "title"))
    normal = cut_lineage(A.normalize_articles(rows, now, lexicon, min_precision=min_precision))
    span = normal.agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi")).first()
    if span["lo"] is None:
        return 0
    known = of_other_batches(store.events(spark, F.lit(span["lo"]) - hours(C.MATCH_HOURS)), C.ARTICLE_FEED, batch)
    near = known.filter(F.col("occurred_at").between(F.lit(span["lo"]) - hours(C.MATCH_HOURS),
                                                     F.lit(span["hi"]) + hours(C.MATCH_HOURS)))
    new = exact_dedup(normal, store.stored_ids(normal, C.ARTICLE_FEED, batch), ["ord"])
    if not fed:
        new = numbered(new.drop("ord"), [F.desc("occurred_at"), F.asc("source_id"), F.asc("title")], "ord", 1)
    new = cut_lineage(new)
    inserted, may_open = 0, near
    if create_new:
        base = batch_number(C.ARTICLE_FEED, batch) * ROWS_PER_BATCH
        opened, matches = discover_novel(new, near, max_new, id_offset=base)
        opened = cut_lineage(opened)
        inserted = opened.count()
        store.write_batch(as_events(opened, instant(now)), "events", C.ARTICLE_FEED, batch)
        may_open = near.unionByName(as_events(opened, instant(now)).select(*EVENT.fieldNames()))
        matches = matches.select("ord", "event_id").unionByName(opened.select("ord", F.col("id").alias("event_id")))
    else:
        matches = best_match(new, near).select("ord", "event_id")
    number = F.lit(batch_number(C.ARTICLE_FEED, batch)).cast("long")
    arrived = new.join(matches, "ord").select(
        "event_id", F.struct(number.alias("batch"), "ord").alias("position"),
        F.col("source_id").alias("source_record_id"), F.col("outlet").alias("source_name"), "source_url",
        F.col("title").alias("source_title"), F.col("occurred_at").alias("source_published_at"), "event_uri",
        "location_precision", F.col("raw_payload_json").alias("metadata_json"))
    stored = of_other_batches(store.sources(spark), C.ARTICLE_FEED, batch)
    # A source that is already recorded for the incident is not recorded again.
    arrived = arrived.join(stored.select("event_id", "source_record_id"), ["event_id", "source_record_id"], "left_anti")
    earlier = stored.join(arrived.select("event_id").distinct(), "event_id", "left_semi").select(
        "event_id", F.struct(F.floor(F.col("id") / F.lit(ROWS_PER_BATCH)).alias("batch"),
                             (F.col("id") % F.lit(ROWS_PER_BATCH)).alias("ord")).alias("position"),
        "source_record_id", "source_name", "source_url", "source_title", "source_published_at",
        F.get_json_object("metadata_json", "$.er_event_uri").alias("event_uri"), "location_precision", "metadata_json")
    judged = syndication_rules(arrived.unionByName(earlier)).filter(F.col("position.batch") == number)
    first = batch_number(C.ARTICLE_FEED, batch) * ROWS_PER_BATCH  # ids follow the order of the feed
    rows_out = provenance_rows(numbered(judged, [F.asc("position"), F.asc("event_id")], "id", first), now)
    store.write_batch(rows_out, "sources", C.ARTICLE_FEED, batch)
    written = spark.read.schema(EVENT_SOURCE).parquet(store.batch_path("sources", C.ARTICLE_FEED, batch))
    store.counts.add(corroboration_counts(corroborating(written, may_open)), batch)
    return inserted


def run_article_feed(spark: SparkSession, landed: str, store: Store, now: Clock,
                     lexicon: Lexicon = DEFAULT_LEXICON, min_precision: str = "city", create_new: bool = False,
                     once: bool = True, max_new: int | None = C.MAX_NEW_EVENTS):
    """Follow a folder of landed articles."""

    def handle(rows: DataFrame, batch: int) -> None:
        _logged(rows.sparkSession, store, batch, C.ARTICLE_FEED, now,
                lambda started: ingest_articles(rows, store, batch, started, lexicon, min_precision, create_new, max_new))

    writer = (A.stream_articles(spark, landed).writeStream.foreachBatch(handle)
              .option("checkpointLocation", store.path("_articles_checkpoint")))
    if once:
        return run_once(writer)
    return writer.trigger(processingTime=f"{C.POLL_SECONDS} seconds").start()


def refresh_hotspots(spark: SparkSession, store: Store, now: datetime | str | Column, keep: int = 3) -> DataFrame:
    """Recompute hotspots from the stored incidents and publish them and their members together, under one manifest."""
    window = instant(now) - hours(C.CLUSTER_HOURS)
    hotspots, membership = compute_hotspots(store.corroborated_events(spark, window), now)
    publish(spark, store.root, {"hotspots": hotspots, "hotspot_members": membership}, keep)
    return store.latest(spark, "hotspots")


def clustered_events(spark: SparkSession, store: Store) -> DataFrame:
    """Incidents with their current cluster and trend."""
    return assign_clusters(store.corroborated_events(spark), store.latest(spark, "hotspot_members"))


def trend_windows(df: DataFrame, by: list[str], late: str = "24 hours", ts: str = "occurred_at") -> DataFrame:
    """Counts per eight-hour window; rows up to ``late`` behind are still counted."""
    counted = df.withWatermark(ts, late).groupBy(F.window(ts, "8 hours"), *by).agg(F.count("*").alias("event_count"))
    return counted.select(*by, F.col("window.start").alias("window_start"), "event_count")


def run_trend_windows(df: DataFrame, store: Store, by: list[str], late: str = "24 hours", now: Clock | None = None) -> int:
    """Keep the eight-hour counts in ``trend_windows`` up to date, one partition per day of the windows' start.

    A batch brings the windows it changed.  Only the days of those are read and written again; windows older than
    ``late`` leave the state of the stream and keep their last count.  Returns how many rows came too late to be counted;
    with ``now`` that number is kept in the store.
    """

    def upsert(counts: DataFrame, batch: int) -> None:
        keys = [*by, "window_start"]
        changed = cut_lineage(counts.withColumn("window_date", F.to_date("window_start")))
        days = [r["window_date"] for r in changed.select("window_date").distinct().collect()]
        if not days:
            return
        earlier = store._read(counts.sparkSession, "trend_windows", changed.schema).where(F.col("window_date").isin(days))
        kept = cut_lineage(earlier.join(changed.select(*keys), keys, "left_anti"))
        (kept.unionByName(changed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("window_date").parquet(store.path("trend_windows")))

    query = run_once(trend_windows(df, by, late).writeStream.outputMode("update").foreachBatch(upsert)
                     .option("checkpointLocation", store.path("_trend_checkpoint")))
    return late_rows(query) if now is None else log_late(df.sparkSession, store, "trend_windows", query, now)
