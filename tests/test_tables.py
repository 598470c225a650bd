import json
from datetime import date

import pytest
from conftest import SPECS
from pyspark.errors import AnalysisException

from salesmerge.operators.query import export_rows, query_sales
from salesmerge.operators.resolve import resolve_events
from salesmerge.sources.tables import read_sales, write_csv, write_sales
from salesmerge.streaming.incremental import apply_batch, incremental_resolve

FIRST = {"raw": '{"PARCEL":"36-01-0042","nested":{"a":1}}', "buyer": 'A "B", C'}


def test_round_trip_and_versions(spark, make_reports, tmp_path):
    path = str(tmp_path / "sales")
    assert read_sales(spark, path).count() == 0
    sales = resolve_events(make_reports(FIRST, {"address": "9 Old Gulph Rd"}), SPECS)
    assert write_sales(sales, path, buckets=4) == 0
    assert sorted(r.address for r in read_sales(spark, path).collect()) == ["123 N Wayne Ave", "9 Old Gulph Rd"]
    # A version without its commit is invisible.
    sales.limit(0).write.parquet(f"{path}/data/version=1")
    assert read_sales(spark, path).count() == 2


def test_csv_bytes(spark, make_reports, tmp_path):
    sales = resolve_events(make_reports(FIRST, {"address": "9 Old Gulph Rd Apt 2", "price": "2000000"}), SPECS)
    write_csv(export_rows(query_sales(sales)).coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    lines = part.read_bytes().split(b"\r\n")
    assert lines[0].startswith(b"sale_date,price,address,unit,municipality")
    assert lines[1].startswith(b"2026-03-01,2000000,9 Old Gulph Rd,2,Radnor Township,Delaware,19087,,")
    assert b'"A ""B"", C"' in lines[2] and lines[3] == b""


def test_stream_applies_each_file_once(spark, make_reports, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "sales")

    def run():
        incremental_resolve(
            spark, landed, table, SPECS, str(tmp_path / "checkpoint"), buckets=4
        ).awaitTermination()
        return {r.address: (r.price, r.source, r.beds) for r in read_sales(spark, table).collect()}

    news = {"source": "news", "price": "1490000", "beds": "4", "sale_date": "2026-03-05"}
    both = make_reports({}, news, {"address": "9 Old Gulph Rd", "source": "news"}).cache()
    both.filter("source = 'county'").write.parquet(landed)
    assert run() == {"123 N Wayne Ave": (1_500_000, "county", None)}
    both.filter("source = 'news'").write.mode("append").parquet(landed)
    after = {"123 N Wayne Ave": (1_500_000, "county", 4.0), "9 Old Gulph Rd": (1_500_000, "news", None)}
    assert run() == after
    assert run() == after


def test_committed_batch_is_not_applied_again(spark, make_reports, tmp_path):
    table = str(tmp_path / "sales")
    apply_batch(make_reports({}), table, SPECS, buckets=4, batch_id=0)
    apply_batch(make_reports({"price": "9000000", "sale_date": "2020-01-01"}), table, SPECS, buckets=4, batch_id=0)
    assert [r.sale_date for r in read_sales(spark, table).collect()] == [date(2026, 3, 1)]


def test_retry_after_a_crash_before_the_commit(spark, make_reports, tmp_path):
    path = str(tmp_path / "sales")
    sales = resolve_events(make_reports({}), SPECS)
    write_sales(sales, path, buckets=4)
    # What a crash leaves: files of the next version, without a commit.
    sales.write.parquet(f"{path}/data/version=1-crashed")
    assert write_sales(sales, path) == 1
    assert read_sales(spark, path).count() == 1


def test_bucket_count_belongs_to_the_table(spark, make_reports, tmp_path):
    path = str(tmp_path / "sales")
    apply_batch(make_reports({}), path, SPECS, buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        write_sales(read_sales(spark, path), path, buckets=8)


def test_absent_committed_version_is_an_error(spark, make_reports, tmp_path):
    path = tmp_path / "sales"
    write_sales(resolve_events(make_reports({}), SPECS), str(path), buckets=4)
    (version,) = (path / "data").iterdir()
    version.rename(tmp_path / "gone")
    with pytest.raises(AnalysisException):
        read_sales(spark, str(path)).count()


def test_two_streams_into_one_table(spark, make_reports, tmp_path):
    path = str(tmp_path / "sales")
    for k, address in enumerate(["9 Old Gulph Rd", "11 Old Gulph Rd"]):
        landed = str(tmp_path / f"landed{k}")
        make_reports({"address": address}).write.parquet(landed)
        incremental_resolve(
            spark, landed, path, SPECS, str(tmp_path / f"checkpoint{k}"), buckets=4
        ).awaitTermination()
    assert sorted(r.address for r in read_sales(spark, path).collect()) == ["11 Old Gulph Rd", "9 Old Gulph Rd"]


def test_older_reports_are_refused(spark, make_reports, tmp_path):
    path = str(tmp_path / "sales")
    apply_batch(make_reports({}), path, SPECS, buckets=4)
    with pytest.raises(ValueError, match="doesn't come after"):
        apply_batch(make_reports({}), path, SPECS)


def test_a_stream_is_known_by_its_checkpoint_s_id(spark, make_reports, tmp_path):
    """Not by its place: a checkpoint made anew there counts its batches from 0 again."""
    landed, table, checkpoint = (str(tmp_path / name) for name in ("landed", "sales", "checkpoint"))
    make_reports({}).write.parquet(landed)
    incremental_resolve(spark, landed, table, SPECS, checkpoint, buckets=4).awaitTermination()
    made = json.loads((tmp_path / "checkpoint" / "metadata").read_text())["id"]
    assert {r.stream_id for r in spark.read.parquet(f"{table}/commits").collect()} == {made}
