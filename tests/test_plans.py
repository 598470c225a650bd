"""Plans: what isn't asked for isn't read, and conditions reach the scan."""

from conftest import RUN_TS
from pyspark.sql import functions as F

from salesmerge.operators.reports import build_report
from salesmerge.plans import catalog
from salesmerge.schema import RAW_REPORT_SCHEMA
from salesmerge import session


def test_report_columns_are_pruned_and_conditions_pushed(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [tuple(None if f.name != "source" else "county" for f in RAW_REPORT_SCHEMA.fields)]
    spark.createDataFrame(rows, RAW_REPORT_SCHEMA).write.parquet(path)
    reports = build_report(spark.read.parquet(path), RUN_TS)
    narrow = reports.filter(F.col("source") == "county").select("seq", "price")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    for name in ("parcel_id", "buyer", "raw#", "municipality", "latitude"):
        assert name not in plan
    assert "EqualTo(source,county)" in plan


def test_documents_grow_in_number_and_records_are_numbered_in_shares(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_DOCUMENT_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("record_ord"), F.col("id").cast("string").alias("text"))
    lines = catalog._documents(rows, "[", ",", "]")
    assert lines.rdd.getNumPartitions() == 10  # four before, whatever the rows
    parts = lines.rdd.glom().collect()
    assert [x for p in parts for x in "".join(r.value for r in p).strip("[]").split(",")] == [str(k) for k in range(1000)]

    order = [0, 1, 5, 8, 9, 10, 31, 40]
    found = spark.createDataFrame([(s, o) for s in ("rss", "atom") for o in order], "source string, record_ord bigint")
    placed = catalog._placed(found, share=4)
    got = {(r.source, r.record_ord): r.place for r in placed.collect()}
    assert got == {(s, o): k for s in ("rss", "atom") for k, o in enumerate(order, 1)}
    windows = [w for w in placed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in w]
    assert windows and all("share" in w for w in windows)  # no task holds a source


def test_spread_tables_have_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = spark.range(0, 2000, 1, 5)
    assert session.spread(rows, "id").rdd.getNumPartitions() == 20  # as many as cores before
    assert session.spread(rows.repartition(30), "id").rdd.getNumPartitions() == 30
    assert sorted(r.id for r in session.spread(rows, "id").collect()) == list(range(2000))
