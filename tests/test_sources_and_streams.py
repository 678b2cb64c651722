"""Reading files, the source contract, and the streaming feeds."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tremorline.functions import constants as C
from tremorline.operators import serving as S
from tremorline.schemas import ARTICLE, EVENT, NEW_EVENT, assert_schema, conform
from tremorline.sources import articles as A
from tremorline.sources import exports as X
from tremorline.sources import sinks
from tremorline.sources.contract import fetch
from tremorline.sources.samples import sample_events
from tremorline.streaming import live

NOW = "2025-03-16 00:00:00"


def export_line(**fields):
    base = dict(global_event_id="1", day="20250315", actor1_name="CROWD", event_code="145", root_code="14", goldstein="-6.5",
                num_sources="3", geo_type="3", geo_name="Seattle, Washington, United States", geo_country="US",
                geo_adm1="USWA", geo_lat="47.6", geo_long="-122.3", source_url="https://news.example/1")
    base.update(fields)
    row = ["x"] * C.EXPORT_WIDTH
    for name, at in C.EXPORT_COLUMNS.items():
        row[at] = base[name]
    return "\t".join(row)


LINES = [export_line(), export_line(global_event_id="2", root_code="19"), export_line(global_event_id="3", geo_country="CA"),
         export_line(global_event_id="4", geo_lat="0", geo_long="0.0"), export_line(global_event_id="5", day="20259999"),
         export_line(global_event_id="6", geo_name="", source_url="", num_sources="", goldstein="?", geo_adm1="US",
                     root_code=" 18 ", geo_type="9"),
         "\t".join(export_line(global_event_id="7").split("\t")[:60]), export_line(global_event_id="8") + "\textra",
         export_line(global_event_id="9", geo_lat="nan")]


def normal_ids(df):
    return sorted(r["source_id"] for r in X.normalize_export(df).collect())


def test_read_export(spark, tmp_path):
    (tmp_path / "20250315120000.export.CSV").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    raw = X.read_export_tsv(spark, str(tmp_path))
    assert normal_ids(raw) == ["gdelt-1", "gdelt-6", "gdelt-8"]
    rows = {r["source_id"]: r for r in X.normalize_export(raw).collect()}
    one, six = rows["gdelt-1"], rows["gdelt-6"]
    assert (one["title"], one["event_type"], one["city"], one["state"], one["location_precision"], one["source_count"]) == (
        "Protest — Seattle", "protest", "Seattle", "WA", "city", 3)
    assert (one["confidence_score"], one["severity_score"]) == (pytest.approx(0.7), pytest.approx(0.825))
    assert one["occurred_at"] == datetime(2025, 3, 15, 12)
    assert json.loads(one["raw_payload_json"]) == {"event_code": "145", "root_code": "14", "actor1": "CROWD", "goldstein": -6.5}
    assert (six["title"], six["city"], six["state"], six["source_url"], six["source_count"], six["severity_score"]) == (
        "Violence — unknown location", None, None, None, 1, 0.5)


def test_read_export_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "20250315120000.export.CSV.zip", "w") as z:
        z.writestr("20250315120000.export.CSV", "\n".join(LINES))
    (tmp_path / "20250315121500.export.CSV.zip").write_bytes(b"broken")
    assert normal_ids(X.read_export_zip(spark, str(tmp_path))) == ["gdelt-1", "gdelt-6", "gdelt-8"]


def test_quoted_tabs(spark, tmp_path):
    line = export_line(actor1_name='"A\tB"')
    (tmp_path / "a.CSV").write_text(line + "\n", encoding="utf-8")
    assert normal_ids(X.read_export_tsv(spark, str(tmp_path))) == ["gdelt-1"]


def article(uri="1", title="Police clash with protesters in Seattle", ts="2025-03-15T12:10:00Z", outlet="Seattle Times", **more):
    base = {"uri": uri, "title": title, "body": "Tear gas was used.", "url": f"https://seattletimes.com/{uri}",
            "eventUri": "eng-1", "dateTimePub": ts, "source": {"title": outlet, "uri": "s"},
            "location": {"type": {"type": "city"}, "label": {"eng": "Seattle, Washington, United States"}, "lat": 47.61, "long": -122.33},
            "categories": [{"uri": "dmoz/news/conflict", "label": f"c{i}"} for i in range(7)],
            "concepts": [{"uri": "en/protest"}]}
    base.update(more)
    return base


def test_articles(spark, tmp_path):
    rows = [article(), article("2", title="  "), article("3", location={"type": "country", "label": "United States"}),
            article("4", location={"type": "city", "label": "St. Paul, Minnesota"}), article("", body=None, source=None),
            article("6", title="Council meets", body="Nothing", categories=[], concepts=[])]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r["source_id"]: r for r in A.normalize_articles(A.read_articles(spark, str(tmp_path)), NOW).collect()}
    assert set(got) == {"er-1", None}
    one = got["er-1"]
    assert (one["event_type"], one["city"], one["state"], one["location_precision"], one["outlet"]) == (
        "police_clash", "Seattle", "WA", "city", "Seattle Times")
    assert one["confidence_score"] == pytest.approx(0.58) and one["severity_score"] == 0.7
    payload = json.loads(one["raw_payload_json"])
    assert payload["categories"] == ["c0", "c1", "c2", "c3", "c4"] and payload["er_event_uri"] == "eng-1"
    assert got[None]["summary"] is None
    loose = A.normalize_articles(A.read_articles(spark, str(tmp_path)), NOW, min_precision="state")
    assert loose.filter("source_id = 'er-4'").first()["latitude"] == 46.4
    assert_schema(loose.select(*NEW_EVENT.fieldNames()), NEW_EVENT)


def test_article_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"articles": {"results": [article("1"), article("2")], "totalResults": 2}}))
    df = A.read_articles(spark, str(tmp_path / "p.json"), pages=True)
    assert df.columns == ARTICLE.fieldNames() and A.normalize_articles(df, NOW).count() == 2


def test_contract(spark):
    assert fetch(spark, lambda s: sample_events(s, NOW)).count() == 16
    with pytest.raises(ValueError, match="severity_score: missing"):
        fetch(spark, lambda s: sample_events(s, NOW).drop("severity_score"))


def test_conform_adds_later_columns(spark):
    old = spark.createDataFrame([(1, "t")], "id int, title string")
    row = conform(old, EVENT, {"country": "US", "is_active": True}).first()
    assert (row["id"], row["title"], row["country"], row["is_active"], row["raw_payload_json"]) == (1, "t", "US", True, None)


def test_pending_windows(spark):
    def runs(*rows):
        return spark.createDataFrame(list(rows), "ingest_source string, status string, finished_at timestamp")

    first = X.pending_windows(runs(), "2025-03-15 12:07:00")
    names = sorted(r["file_name"] for r in first.collect())
    assert len(names) == 96 and names[-1] == "20250315114500.export.CSV.zip" and names[0] == "20250314120000.export.CSV.zip"
    recent = runs(("gdelt", "success", datetime(2025, 3, 15, 11, 20)), ("gdelt", "failed", datetime(2025, 3, 15, 11, 59)),
                  ("mock", "success", datetime(2025, 3, 15, 11, 59)))
    assert sorted(r["file_name"][:12] for r in X.pending_windows(recent, "2025-03-15 12:07:00").collect()) == [
        "202503151115", "202503151130", "202503151145"]
    landed = spark.createDataFrame([("20250315113000.export.CSV.zip",)], "file_name string")
    assert X.pending_windows(recent, "2025-03-15 12:07:00", landed).count() == 2
    ahead = runs(("gdelt", "success", datetime(2025, 3, 15, 12, 5)))
    assert X.pending_windows(ahead, "2025-03-15 12:07:00").count() == 0


def test_feeds(spark, tmp_path):
    """Exports and articles through the streams, then hotspots; repeating a feed changes nothing."""
    landed, news = tmp_path / "exports", tmp_path / "news"
    landed.mkdir(), news.mkdir()
    (landed / "1.CSV").write_text("\n".join(export_line(global_event_id=str(i)) for i in (1, 2, 3)) + "\n", encoding="utf-8")
    store = live.Store(str(tmp_path / "store"))
    live.run_export_feed(spark, str(landed), store, NOW)
    (landed / "2.CSV").write_text("\n".join(export_line(global_event_id=str(i)) for i in (3, 4, 4)) + "\n", encoding="utf-8")
    live.run_export_feed(spark, str(landed), store, NOW)
    events = store.events(spark)
    assert sorted(r["source_id"] for r in events.collect()) == ["gdelt-1", "gdelt-2", "gdelt-3", "gdelt-4"]
    assert events.select("id").distinct().count() == 4
    titles = {"title": "Protest — Seattle", "location": {"type": "city", "label": "Seattle, WA", "lat": 47.6, "long": -122.3}}
    (news / "1.json").write_text("\n".join(json.dumps(a) for a in [
        article("1", outlet="Times", **titles), article("2", outlet="times", url="https://x.com/2", **titles)]))
    live.run_article_feed(spark, str(news), store, NOW)
    # The second file repeats an article and brings a copy of an earlier one under another name.
    (news / "2.json").write_text("\n".join(json.dumps(a) for a in [
        article("1", outlet="Times", **titles), article("3", outlet="Globe", url="https://y.com/3", **titles)]))
    live.run_article_feed(spark, str(news), store, NOW)
    sources = {r["source_record_id"]: r["source_trust_weight"] for r in store.sources(spark).collect()}
    assert sorted(sources) == ["er-1", "er-2", "er-3"] and sorted(sources.values()) == [0.0, 0.0, 1.0]
    lifted = [r for r in store.corroborated_events(spark).collect() if r["source_count"] == 4]
    assert len(lifted) == 1 and lifted[0]["confidence_score"] == pytest.approx(0.78)
    assert {r["status"] for r in store.runs(spark).collect()} == {"success"}
    before = sorted(store.corroborated_events(spark).collect())
    store.merge_ledgers(spark)
    assert sorted(store.corroborated_events(spark).collect()) == before
    store.rebuild_ledgers(spark)
    assert sorted(store.corroborated_events(spark).collect()) == before
    (landed / "3.CSV").write_text(export_line(global_event_id="2") + "\n", encoding="utf-8")
    live.run_export_feed(spark, str(landed), store, NOW)
    assert store.events(spark).count() == 4
    hotspots = live.refresh_hotspots(spark, store, "2025-03-15 18:00:00").collect()
    assert [(r["name"], r["event_count"]) for r in hotspots] == [("Seattle, WA", 4)]
    assert live.clustered_events(spark, store).filter("cluster_id = 1").count() == 4
    live.refresh_hotspots(spark, store, "2025-04-15 18:00:00")
    assert store.latest(spark, "hotspots").count() == 0


def test_new_incidents_from_articles(spark, tmp_path):
    news = tmp_path / "news"
    news.mkdir()
    place = {"type": "city", "label": "Reno, NV", "lat": 39.5, "long": -119.8}
    (news / "1.json").write_text("\n".join(json.dumps(a) for a in [
        article("1", outlet="Times", ts="2025-03-15T10:00:00Z", location=place),
        article("2", outlet="Globe", ts="2025-03-15T11:00:00Z", location=place),
        article("3", title="Looting reported near market hall", outlet="Globe", location=place)]))
    store = live.Store(str(tmp_path / "store"))
    live.run_article_feed(spark, str(news), store, NOW, create_new=True)
    assert {r["source_id"] for r in store.events(spark).collect()} == {"er-2", "er-3"}   # newest first opens
    # The article that opened an incident does not corroborate it, and er-1 is a copy.
    assert [(r["source_count"], r["confidence_score"]) for r in store.corroborated_events(spark).collect()] == [(1, 0.58)] * 2
    assert {r["source_record_id"]: r["source_trust_weight"] for r in store.sources(spark).collect()} == {
        "er-1": 0.0, "er-2": 1.0, "er-3": 1.0}
    assert store.runs(spark).first()["events_inserted"] == 2


def test_reset_and_samples(spark, tmp_path):
    store = live.Store(str(tmp_path / "store"))
    assert live.ingest_samples(spark, store, 1, NOW) == 16
    assert live.ingest_samples(spark, store, 2, NOW) == 0
    assert live.reset_and_seed(spark, store, NOW).count() == 2
    assert store.events(spark).count() == 16 and store.events(spark).select("id").distinct().count() == 16


def test_failed_batch_is_recorded(spark, tmp_path):
    store = live.Store(str(tmp_path))

    def fail(started):
        raise RuntimeError("x" * 2000)

    with pytest.raises(RuntimeError):
        live._logged(spark, store, 0, C.CODED_FEED, NOW, fail)
    row = store.runs(spark).first()
    assert (row["status"], len(row["error_message"])) == ("failed", 1000)


def test_failed_batch_is_read_again(spark, tmp_path, monkeypatch):
    landed, store, work = tmp_path / "landed", live.Store(str(tmp_path / "store")), live.ingest_exports
    landed.mkdir()
    (landed / "a.csv").write_text("\n".join(export_line(global_event_id=str(i)) for i in range(5)) + "\n", encoding="utf-8")
    clock = iter(datetime(2025, 3, 16, 0, m) for m in range(60))

    def broken(*args):
        raise RuntimeError("no store")

    monkeypatch.setattr(live, "ingest_exports", broken)
    with pytest.raises(Exception, match="no store"):
        live.run_export_feed(spark, str(landed), store, lambda: next(clock))
    assert store.runs(spark).first()["status"] == "failed"
    monkeypatch.setattr(live, "ingest_exports", work)
    live.run_export_feed(spark, str(landed), store, lambda: next(clock))
    assert store.events(spark).count() == 5
    run = store.runs(spark).first()
    assert (run["status"], run["events_inserted"]) == ("success", 5) and run["finished_at"] > run["started_at"]


def test_caps_are_parameters(spark):
    runs = spark.createDataFrame([(C.CODED_FEED, "success", datetime(2025, 3, 10))], "ingest_source string, status string, finished_at timestamp")
    assert X.pending_windows(runs, NOW).count() == 96
    whole = X.pending_windows(runs, NOW, max_windows=None)
    assert whole.count() == 6 * 96 and whole.count() - 96 == X.skipped_windows(runs, NOW).first()["skipped"]


def test_run_log(spark):
    log = (sinks.run_entry(spark, 1, NOW, "gdelt", "running")
           .unionByName(sinks.run_entry(spark, 1, NOW, "gdelt", "success", "2025-03-16 00:05:00", 7))
           .unionByName(sinks.run_entry(spark, 2, "2025-03-16 01:00:00", "gdelt", "running")))
    runs = sinks.current_runs(log)
    assert {(r["id"], r["status"], r["events_inserted"]) for r in runs.collect()} == {(1, "success", 7), (2, "running", 0)}
    assert S.latest_run(runs, "gdelt").first()["id"] == 2
    assert S.latest_success(runs, "mock").first()["last_success_at"] is None


def test_by_id_and_limits(spark):
    df = spark.createDataFrame([(1, True, datetime(2025, 1, 1))], "id long, is_active boolean, occurred_at timestamp")
    assert S.by_id(df, 1).count() == 1
    with pytest.raises(LookupError):
        S.by_id(df, 2)
    with pytest.raises(ValueError):
        S.list_events(df, limit=1001)
    with pytest.raises(ValueError):
        S.list_events(df, limit=-1)
    assert S.page_total(df, 500, 0).first()["has_more"] is False


def test_filters_reach_the_scan(spark, tmp_path):
    from tremorline.operators.hotspots import cluster_window

    rows = spark.range(100).select("id", (F.col("id") % 2 == 0).alias("is_active"),
                                   F.timestamp_seconds(F.col("id") * 3600).alias("occurred_at"), F.lit("x").alias("title"))
    rows.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = cluster_window(spark.read.parquet(str(tmp_path / "t")), "1970-01-05 00:00:00").select(
        "id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(occurred_at" in plan and "title" not in plan.split("ReadSchema")[1]
    top = S.priorities(spark.range(10).select("id", F.rand(1).alias("priority_score")))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_refresh_reads_the_days_of_the_window(spark, tmp_path):
    store = live.Store(str(tmp_path / "store"))
    live.ingest_samples(spark, store, 0, NOW)
    live.ingest_samples(spark, store, 1, "2025-03-01 00:00:00")  # nothing new, and no file
    window = F.lit("2025-03-15 20:00:00").cast("timestamp")
    recent = store.corroborated_events(spark, window)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert store.events(spark).count() == 16
    assert recent.count() == store.events(spark).filter(F.to_date("occurred_at") >= F.to_date(window)).count()


def test_short_rows_with_quoted_tabs_and_counts(spark, tmp_path):
    """A row of 60 real fields is dropped however many tabs it quotes; counting rows works without naming columns."""
    fields = export_line(global_event_id="1").split("\t")
    fields[2] = '"a\tb"'
    short = "\t".join(fields[:60])
    (tmp_path / "a.CSV").write_text("\n".join([short, "\t".join(fields), export_line(global_event_id="2")]) + "\n", encoding="utf-8")
    raw = X.read_export_tsv(spark, str(tmp_path))
    assert normal_ids(raw) == ["gdelt-1", "gdelt-2"]
    assert raw.count() == 2


def test_zips_in_the_stream_and_counts_of_what_was_rejected(spark, tmp_path):
    landed, store = tmp_path / "landed", live.Store(str(tmp_path / "store"))
    landed.mkdir()
    short = "\t".join(export_line(global_event_id="9").split("\t")[:60])
    (landed / "a.export.CSV").write_text("\n".join([export_line(global_event_id="1"), short]) + "\n", encoding="utf-8")
    with zipfile.ZipFile(landed / "b.export.CSV.zip", "w") as z:
        z.writestr("b.export.CSV", "\n".join([export_line(global_event_id="2"), short, short]))
    (landed / "c.export.CSV.zip").write_bytes(b"broken")
    live.run_export_feed(spark, str(landed), store, NOW)
    assert sorted(r["source_id"] for r in store.events(spark).collect()) == ["gdelt-1", "gdelt-2"]
    got = {r["file"].rpartition("/")[2]: (r["rows"], r["short_rows"], (r["error"] or "")[:10]) for r in store.rejected(spark).collect()}
    assert got == {"a.export.CSV": (1, 1, ""), "b.export.CSV.zip": (1, 2, ""), "c.export.CSV.zip": (0, 0, "BadZipFile")}
    assert live.run_export_feed(spark, str(landed), store, NOW) is not None and store.events(spark).count() == 2


def test_a_file_that_always_fails_is_set_aside(spark, tmp_path):
    landed, store = tmp_path / "landed", live.Store(str(tmp_path / "store"))
    landed.mkdir()
    (landed / "a.CSV").write_text(export_line(global_event_id="1") + "\n", encoding="utf-8")
    (landed / "b.CSV.gz").write_bytes(b"no gzip at all")
    for _ in range(2):
        with pytest.raises(Exception):
            live.run_export_feed(spark, str(landed), store, NOW, attempts=3)
        assert store.events(spark).count() == 0
    live.run_export_feed(spark, str(landed), store, NOW, attempts=3)
    assert [r["source_id"] for r in store.events(spark).collect()] == ["gdelt-1"]
    (landed / "c.CSV").write_text(export_line(global_event_id="3") + "\n", encoding="utf-8")
    live.run_export_feed(spark, str(landed), store, NOW, attempts=3)
    assert sorted(r["source_id"] for r in store.events(spark).collect()) == ["gdelt-1", "gdelt-3"]
    tried = store.attempts(spark).collect()
    assert len(tried) == 3 and {r["file"].rpartition("/")[2] for r in tried} == {"b.CSV.gz"} and all(r["error"] for r in tried)


def test_late_rows_are_counted(spark, tmp_path):
    store, landed = live.Store(str(tmp_path / "store")), tmp_path / "landed"
    schema = "event_type string, occurred_at timestamp"

    def run(*times):
        rows = spark.createDataFrame([("protest", t) for t in times], "event_type string, t string")
        rows.select("event_type", F.col("t").cast("timestamp").alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(landed))
        return live.run_trend_windows(spark.readStream.schema(schema).parquet(str(landed)), store, ["event_type"], "1 day", NOW)

    assert run("2025-03-15 01:00:00") == 0
    assert run("2025-03-15 02:00:00", "2025-03-11 01:00:00") == 1
    assert [(r["stream"], r["n"]) for r in store.late(spark).collect()] == [("trend_windows", 1)]
    assert [(str(r["window_start"]), r["event_count"]) for r in store.trends(spark).collect()] == [("2025-03-15 00:00:00", 2)]


def test_openers_are_no_corroboration_whatever_is_null(spark):
    """Fails if openers are compared by their titles, which then travel."""
    from tremorline.streaming.live import corroborating

    t = datetime(2025, 3, 15, 12)
    events = spark.createDataFrame([(1, "er-1", "a", t, "eventregistry"), (2, None, "b", t, "eventregistry"), (3, "er-3", None, t, "eventregistry"),
                                    (4, "er-4", "d", t, "gdelt")], "id long, source_id string, title string, occurred_at timestamp, source_name string")
    rows = [(1, "er-1", "a", t), (1, "er-2", "a", t), (1, "er-1", "x", t), (2, None, "b", t), (2, "", "b", t), (3, "er-3", None, t),
            (4, "er-4", "d", t), (1, "er-1", "a", None)]
    sources = spark.createDataFrame(rows, "event_id long, source_record_id string, source_title string, source_published_at timestamp")
    kept = corroborating(sources, events)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (r for i, r in enumerate(rows) if i not in (0, 3))))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan.split("Join LeftAnti", 1)[1].split("\n", 1)[0]


def test_places_are_broadcast_and_sources_read_documents_once(spark):
    """Fails if titles are shuffled for 24 places, or for the source of their own document."""
    from tremorline.plans.views import provenance

    plan = provenance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join ") == 2
