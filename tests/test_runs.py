import json
from datetime import datetime

from conftest import AREAS, RUN_TS, SPECS, TODAY

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from salesmerge.schema import ingest_seq, page_record_ord
from salesmerge.operators import runs
from salesmerge.operators.places import extract_reports_from_text, known_places
from salesmerge.plans import collect
from salesmerge.plans.collect import collect_and_store, collect_landed, collect_named, collect_run
from salesmerge.schema import RUN_SCHEMA, SOURCE_RUN_SCHEMA, SourceSpec
from salesmerge.sources.by_name import SourceMisconfigured, TypedSource, register_source
from salesmerge.sources.feature_json import feature_reports, scan_feature_json
from salesmerge.sources.feeds import scan_feed_xml
from salesmerge.sources.html_rows import html_reports, scan_html_rows
from salesmerge.sources.tables import read_sales


def log(spark):
    at = lambda h: datetime(2026, 3, 1, h)
    return spark.createDataFrame(
        [(1, "run1", "county", "ok", at(1), at(1), 10, 4, None),
         (2, "run1", "deedbox", "blocked", at(1), at(1), 0, 0, "key expired on 2026-02-27"),
         (3, "run2", "county", "error", at(2), at(2), 0, 0, "page 12 is cut off"),
         (4, "run3", "news", "skipped", at(3), at(3), 0, 0, None)],
        SOURCE_RUN_SCHEMA)


def test_latest_status_wins(spark):
    latest = {r.source: r for r in runs.latest_source_status(log(spark)).collect()}
    assert latest["county"].status == "error" and latest["deedbox"].message == "key expired on 2026-02-27"
    assert list(latest) == ["county", "deedbox", "news"]


def test_run_ok(spark):
    assert {r.run_id: r.ok for r in runs.run_ok(log(spark)).collect()} == {
        "run1": False, "run2": False, "run3": True}


def test_last_run(spark):
    table = spark.createDataFrame(
        [("a", datetime(2026, 3, 1), None, 1, 0), ("b", datetime(2026, 3, 8), None, 2, 1)], RUN_SCHEMA)
    assert runs.last_run(table).first().run_id == "b"
    assert runs.last_run(table.filter("run_id = 'x'")).count() == 0


def test_listing_and_health(spark):
    listed = runs.source_listing([SourceSpec("news", 10), SourceSpec("new", 5, enabled=False)], log(spark)).collect()
    assert [(r.source, r.enabled, r.status) for r in listed] == [("news", True, "skipped"), ("new", False, None)]
    table = spark.createDataFrame([("b", datetime(2026, 3, 8), None, 2, 1)], RUN_SCHEMA)
    health = runs.health_summary(spark.range(7), table, log(spark)).first()
    assert health.tracked_sales == 7 and health.last_run.run_id == "b"
    assert [s.source for s in health.sources] == ["county", "deedbox", "news"]
    empty = runs.health_summary(spark.range(0), table.limit(0), log(spark).limit(0)).first()
    assert empty.tracked_sales == 0 and empty.last_run is None and empty.sources == []


def raw(spark, *rows):
    fields = "record_ord BIGINT, source STRING, address STRING, price_text STRING, sale_date_text STRING, zip_code STRING"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], fields)


SALE = ("123 N Wayne Ave", "1500000", "2026-03-01", "19087")


def test_run_accounts_for_everything(spark):
    frame = raw(spark, ("county", *SALE), ("county", "2 Low St", "900000", "2026-03-01", "19087"),
                ("news", "123 North Wayne Avenue", "1490000", "2026-03-05", "19087"))
    result = collect_run([frame], SPECS, AREAS, TODAY, RUN_TS, "run1")
    assert (result.run.first().new_sales, result.run.first().updated_sales) == (1, 1)
    assert result.sales.first().price == 1_500_000
    by_source = {r.source: r for r in result.source_runs.collect()}
    assert (by_source["county"].status, by_source["county"].fetched, by_source["county"].kept) == ("ok", 2, 1)
    assert by_source["county"].message == "dropped: below_price=1"
    assert [r.source for r in runs.dry_run_preview(result.kept).collect()] == ["county", "news"]


def test_failed_source_contributes_nothing(spark):
    frame = raw(spark, ("county", *SALE), ("news", "9 Other Rd", "1490000", "2026-03-05", "19087"))
    failures = spark.createDataFrame(
        [("news", 1, "misconfigured", "bad page")], "source STRING, page_no BIGINT, status STRING, message STRING")
    result = collect_run([frame], SPECS, AREAS, TODAY, RUN_TS, "run1", failures=failures)
    assert result.sales.count() == 1
    by_source = {r.source: r for r in result.source_runs.collect()}
    assert (by_source["news"].status, by_source["news"].fetched, by_source["news"].message) == (
        "misconfigured", 0, "bad page")
    assert not runs.run_ok(result.source_runs).first().ok


def test_source_without_records_is_logged(spark):
    result = collect_run([raw(spark, ("county", *SALE))], SPECS, AREAS, TODAY, RUN_TS, "r", only=["county"])
    assert [r.source for r in result.source_runs.collect()] == ["county"]
    result = collect_run([raw(spark, ("county", *SALE))], SPECS, AREAS, TODAY, RUN_TS, "r")
    assert {r.source: r.fetched for r in result.source_runs.collect()} == {"county": 1, "news": 0}


def test_second_run_updates_the_stored_sales(spark, tmp_path):
    folder = str(tmp_path)
    first = raw(spark, ("news", "123 North Wayne Avenue", "1490000", "2026-03-05", "19087"))
    second = raw(spark, ("county", *SALE))
    collect_and_store(folder, [first], SPECS, AREAS, TODAY, RUN_TS, "run1")
    collect_and_store(folder, [second], SPECS, AREAS, TODAY, datetime(2026, 3, 21), "run2")
    (sale,) = read_sales(spark, f"{folder}/sales").collect()
    assert (sale.price, sale.source) == (1_500_000, "county")
    assert (sale.first_seen, sale.last_seen) == (RUN_TS, datetime(2026, 3, 21))
    totals = {r.run_id: (r.new_sales, r.updated_sales) for r in spark.read.parquet(f"{folder}/runs").collect()}
    assert totals == {"run1": (1, 0), "run2": (0, 1)}


def test_rerun_of_the_same_input_updates_only(spark, tmp_path):
    folder = str(tmp_path)
    frame = raw(spark, ("county", *SALE), ("news", "9 Other Rd", "1490000", "2026-03-05", "19087"))
    for run in ("run1", "run2"):
        collect_and_store(folder, [frame], SPECS, AREAS, TODAY, RUN_TS, run)
    totals = {r.run_id: (r.new_sales, r.updated_sales) for r in spark.read.parquet(f"{folder}/runs").collect()}
    assert totals == {"run1": (2, 0), "run2": (0, 2)}
    log = spark.read.parquet(f"{folder}/source_runs")
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 4]
    assert {r.run_id for r in runs.latest_source_status(log).collect()} == {"run2"}
    assert all(r.started_at < r.finished_at for r in log.collect())


def test_order_numbers_that_do_not_fit_fail(spark):
    fits = spark.range(1).select(
        ingest_seq(F.lit(5000), F.lit(3), page_record_ord(F.lit(20260314), F.lit(100_000))).alias("a"),
        ingest_seq(F.lit(5000), F.lit(4), page_record_ord(F.lit(0), F.lit(0))).alias("b"),
    ).first()
    assert 0 < fits.a < fits.b
    with pytest.raises(Exception, match="run number"):
        spark.range(1).select(ingest_seq(F.col("id") + 9000, F.lit(0), F.lit(0))).collect()
    with pytest.raises(Exception, match="place on a page"):
        spark.range(1).select(page_record_ord(F.lit(1), F.col("id") + 200_000)).collect()


def test_landed_run(spark, tmp_path):
    specs = [SourceSpec("county", 90, county="Delaware"), SourceSpec("news", 10), SourceSpec("site", 40)]
    good = {"features": [{"attributes": {"LINE": "48 S Ivy Ln", "TOWN": "Radnor Township", "P": 1500000, "D": "2026-03-01"}}]}
    rss = "<rss><channel><item><title>31 Fern Hill Lane, Villanova, $2 million</title><pubDate>Fri, 06 Mar 2026 09:30:00 -0500</pubDate></item></channel></rss>"
    for name, body in {
        "county/20260301.json": json.dumps(good), "news/1.xml": rss, "news/2.xml": "<rss><broken",
        "site/1.html": "<table><tr><td>9 Elm St<td>$1,300,000<td>03/03/2026<td>Wayne",
    }.items():
        file = tmp_path / "landed" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)

    def county(pages):
        rows, failed = scan_feature_json(pages)
        return feature_reports(rows, "P", "D", {"address": "LINE", "municipality": "TOWN"}), failed

    def news(pages):
        rows, failed = scan_feed_xml(pages)
        return extract_reports_from_text(rows, "news", known_places(spark, AREAS), "Delaware"), failed

    def site(pages):
        cells = dict(zip(("address", "price", "sale_date", "municipality"), ("td:nth-child(%d)" % k for k in range(1, 5))))
        rows, failed = scan_html_rows(pages, "tr", cells)
        return html_reports(rows).withColumn("county", F.lit("Delaware")), failed

    folder = str(tmp_path / "out")
    scans = {"county": county, "news": news, "site": site}
    for run in ("run1", "run2"):
        collect_landed(spark, str(tmp_path / "landed"), folder, scans, specs, AREAS, TODAY, RUN_TS, run)
    assert {(r.address, r.source) for r in read_sales(spark, f"{folder}/sales").collect()} == {
        ("48 S Ivy Ln", "county"), ("9 Elm St", "site")}
    status = runs.latest_source_status(spark.read.parquet(f"{folder}/source_runs")).collect()
    assert [(r.run_id, r.source, r.status, r.kept) for r in status] == [
        ("run2", "county", "ok", 1), ("run2", "news", "misconfigured", 0), ("run2", "site", "ok", 1)]


def _state(spark, folder):
    sales = [(r.address, r.price, r.source, r.event_seq) for r in read_sales(spark, f"{folder}/sales").collect()]
    log = [(r.id, r.run_id, r.source, r.status, r.fetched, r.kept) for r in spark.read.parquet(f"{folder}/source_runs").collect()]
    totals = [(r.run_id, r.new_sales, r.updated_sales) for r in spark.read.parquet(f"{folder}/runs").collect()]
    return sorted(sales), sorted(log), sorted(totals)


@pytest.mark.parametrize("lost", ["write_sales", "source_runs", "runs"])
def test_a_crashed_run_can_be_repeated(spark, tmp_path, monkeypatch, lost):
    """Each of the three writes fails once; the run is called again and all is as without the crash."""
    first = raw(spark, ("news", "123 North Wayne Avenue", "1490000", "2026-03-05", "19087"))
    second = raw(spark, ("county", *SALE), ("county", "9 Other Rd", "1700000", "2026-03-02", "19087"))
    third = raw(spark, ("news", "9 Other Road", "1650000", "2026-03-04", "19087"))
    states = []
    for crash in (False, True):
        folder = str(tmp_path / f"crash-{crash}")
        collect_and_store(folder, [first], SPECS, AREAS, TODAY, RUN_TS, "run1")
        if crash:
            with monkeypatch.context() as patch:
                def fail(rows, path, *rest, real=getattr(collect, "write_sales" if lost == "write_sales" else "append_log")):
                    if lost == "write_sales" or path.endswith(f"/{lost}"):
                        raise OSError("disk gone")
                    return real(rows, path, *rest)

                patch.setattr(collect, "write_sales" if lost == "write_sales" else "append_log", fail)
                with pytest.raises(OSError):
                    collect_and_store(folder, [second], SPECS, AREAS, TODAY, datetime(2026, 3, 21), "run2")
        collect_and_store(folder, [second], SPECS, AREAS, TODAY, datetime(2026, 3, 21), "run2")
        collect_and_store(folder, [third], SPECS, AREAS, TODAY, datetime(2026, 3, 22), "run3")
        states.append(_state(spark, folder))
    assert states[0] == states[1]
    assert states[0][2] == [("run1", 1, 0), ("run2", 1, 1), ("run3", 0, 1)]


def test_a_run_overtaken_after_its_crash_comes_last(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    frame = raw(spark, ("news", "123 North Wayne Avenue", "1490000", "2026-03-05", "19087"))
    with monkeypatch.context() as patch:
        patch.setattr(collect, "write_sales", lambda *_: (_ for _ in ()).throw(OSError("disk gone")))
        with pytest.raises(OSError):
            collect_and_store(folder, [frame], SPECS, AREAS, TODAY, RUN_TS, "run1")
    collect_and_store(folder, [raw(spark, ("county", *SALE))], SPECS, AREAS, TODAY, RUN_TS, "run2")
    collect_and_store(folder, [frame], SPECS, AREAS, TODAY, RUN_TS, "run1")
    assert _state(spark, folder)[2] == [("run1", 0, 1), ("run2", 1, 0)]


def test_reports_before_the_stored_events_are_refused(spark):
    frame = raw(spark, ("county", *SALE))
    stored = collect_run([frame], SPECS, AREAS, TODAY, RUN_TS, "run1", run_no=3).sales
    with pytest.raises(ValueError, match="higher number"):
        collect_run([frame], SPECS, AREAS, TODAY, RUN_TS, "run2", stored=stored)
    assert collect_run([frame], SPECS, AREAS, TODAY, RUN_TS, "run2", run_no=4, stored=stored).sales.count() == 1


def given_sales():
    """A reader class made here, so that workers get it by value."""

    class GivenSales(DataSource):
        """Records out of the options, in two partitions."""

        @classmethod
        def name(cls):
            return "given_sales"

        def schema(self):
            return self.options.get("columns", "record_ord BIGINT, address STRING, price_text STRING, sale_date_text STRING, zip_code STRING")

        def reader(self, schema):
            if "rows" not in self.options:
                raise SourceMisconfigured("rows is missing")
            return GivenReader(json.loads(self.options["rows"]), self.options.get("breaks"))

    class GivenReader(DataSourceReader):
        def __init__(self, rows, breaks):
            self.rows, self.breaks = rows, breaks

        def partitions(self):
            return [InputPartition(k) for k in range(2)]

        def read(self, partition):
            if self.breaks:
                raise ValueError("page 3 is cut off")
            for k, row in enumerate(self.rows):
                if k % 2 == partition.value:
                    yield (k, *row)

    return GivenSales


def test_sources_by_name(spark, tmp_path):
    register_source(spark, given_sales())
    rows = lambda *r: {"rows": json.dumps(r)}
    sources = [
        TypedSource(SourceSpec("county", 90, county="Delaware"), "given_sales", rows(SALE, ("9 Other Rd", "1700000", "2026-03-02", "19087"))),
        TypedSource(SourceSpec("broken", 50), "given_sales", rows(SALE) | {"breaks": "1"}),
        TypedSource(SourceSpec("bare", 40), "given_sales"),
        TypedSource(SourceSpec("typo", 30), "no_such_reader"),
        TypedSource(SourceSpec("odd", 20), "given_sales", rows(SALE) | {"columns": "record_ord BIGINT, address INT"}),
        TypedSource(SourceSpec("off", 10, enabled=False), "given_sales"),
    ]
    result = collect_named(spark, str(tmp_path), sources, AREAS, TODAY, RUN_TS, "run1")
    assert {r.address for r in result.sales.collect()} == {"123 N Wayne Ave", "9 Other Rd"}
    log = {r.source: r for r in result.source_runs.collect()}
    assert {name: r.status for name, r in log.items()} == {
        "county": "ok", "broken": "error", "bare": "misconfigured", "typo": "misconfigured", "odd": "misconfigured"}
    assert "page 3 is cut off" in log["broken"].message and "no_such_reader" in log["typo"].message
    assert "address is int, not string" in log["odd"].message
    only = collect_named(spark, str(tmp_path), sources, AREAS, TODAY, RUN_TS, "run2", only=["bare"])
    assert [(r.source, r.kept) for r in only.source_runs.collect()] == [("bare", 0)]
