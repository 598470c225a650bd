from datetime import datetime, timedelta

from conftest import AREAS, SPECS, TODAY
from pyspark.sql import functions as F

from salesmerge.operators.qualify import kept_reports, label_reports, qualify, reject_counts, source_counts
from salesmerge.operators.reports import build_report, parse_reports, quarantine, reports_union
from salesmerge.schema import SourceSpec

RUN_TS = datetime(2026, 1, 1)


def test_messy_record_is_normalized(make_reports):
    row = make_reports(
        {"address": "  123 north wayne avenue apt 2  ", "price": "$1,850,000",
         "sale_date": "03/01/2026", "zip_code": "19087-1234", "sqft": "4,200", "beds": "five"}
    ).first()
    assert (row.address, row.unit, row.zip_code, row.price) == (
        "123 North Wayne Avenue", "2", "19087", 1_850_000)
    assert (row.sqft, row.beds, row.state) == (4200, None, "PA")


def test_unusable_records_are_kept_apart(spark):
    rows = spark.createDataFrame(
        [(0, "county", "", "1500000", "2026-03-01"), (1, "county", "1 Elm St", None, "2026-03-01"),
         (2, "county", "1 Elm St", "1500000", None), (3, "county", "Wayne PA", "1500000", "2026-03-01"),
         (4, "county", "1 Elm St", "1500000", "2026-03-01")],
        "record_ord BIGINT, source STRING, address STRING, price_text STRING, sale_date_text STRING",
    )
    raw = reports_union([rows], SPECS)
    reasons = [r.unusable for r in quarantine(raw).orderBy("seq").collect()]
    assert reasons == ["no_address", "no_price", "no_date", "no_house_number"]
    assert parse_reports(raw).filter("unusable IS NULL").count() == 1


def test_union_orders_and_filters_sources(spark):
    def frame(source):
        return spark.createDataFrame([(5, source, "1 A St"), (2, source, "2 B St")],
                                     "record_ord BIGINT, source STRING, address STRING")

    specs = [SourceSpec("b", 1, county="Chester"), SourceSpec("a", 2), SourceSpec("off", 3, enabled=False)]
    frames = [frame("a"), frame("b"), frame("off"), frame("unknown")]
    rows = reports_union(frames, specs).orderBy("seq").collect()
    assert [(r.source, r.address) for r in rows] == [
        ("b", "2 B St"), ("b", "1 A St"), ("a", "2 B St"), ("a", "1 A St")]
    assert rows[0].county == "Chester" and rows[2].county is None
    only = reports_union(frames, specs, only=["a"]).select("source").distinct().collect()
    assert [r.source for r in only] == ["a"]


def test_reasons_and_labels(make_reports):
    day = lambda n: (TODAY + timedelta(days=n)).isoformat()
    cases = [
        ({}, None, "Radnor Township"),
        ({"price": "999999"}, "below_price", None),
        ({"price": "1000000"}, None, "Radnor Township"),
        ({"county": "Bucks", "municipality": "Doylestown", "zip_code": "18901"}, "outside_area", None),
        ({"sale_date": day(-50)}, "too_old", None),
        ({"sale_date": day(-45)}, None, "Radnor Township"),
        ({"sale_date": day(10)}, "future_date", None),
        ({"sale_date": day(1)}, None, "Radnor Township"),
        ({"municipality": "Wayne"}, None, "Radnor Township"),
        ({"municipality": "Media", "zip_code": "19063"}, None, "Delaware County"),
        ({"county": "Chester", "municipality": "West Chester", "zip_code": "19380"}, None, "Chester County"),
        ({"county": "Montgomery County", "municipality": "Lower Merion", "zip_code": "19035"}, None,
         "Montgomery County"),
        ({"county": None, "municipality": None, "zip_code": "19085"}, None, "Radnor Township"),
        ({"county": "Chester", "municipality": "Wayne", "zip_code": None}, None, "Radnor Township"),
        ({"price": "1", "sale_date": day(-99)}, "below_price", None),
    ]
    labelled = label_reports(make_reports(*[c[0] for c in cases]), AREAS, TODAY)
    got = labelled.orderBy("seq").collect()
    assert [(r.reject_reason, r.area) for r in got] == [(c[1], c[2]) for c in cases]
    assert qualify(labelled).count() == sum(c[1] is None for c in cases)


def test_accounting(make_reports):
    labelled = label_reports(
        make_reports({}, {"price": "5"}, {"price": "6"}, {"sale_date": "2020-01-01"}, {"source": "news"}),
        AREAS, TODAY,
    )
    counts = {r.source: r for r in source_counts(labelled).collect()}
    assert (counts["county"].fetched, counts["county"].kept) == (4, 1)
    assert counts["county"].message == "dropped: below_price=2, too_old=1"
    assert counts["news"].message is None
    assert {(r.source, r.reject_reason): r.n for r in reject_counts(labelled).collect()} == {
        ("county", "below_price"): 2, ("county", "too_old"): 1}


def test_area_side_is_broadcast(make_reports):
    plan = label_reports(make_reports({}), AREAS, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_fields_parse_once(make_reports):
    """The usable-record filter must not repeat the parsing below the projection."""
    plan = make_reports({})._jdf.queryExecution().executedPlan().toString()
    # One pattern of the date layouts stands for the whole expression.
    assert plan.count("69|[7-9]") == 1


def test_only_known_json_zip_numbers(spark):
    from salesmerge.sources.landed import map_fields

    rows = spark.createDataFrame(
        [(0, '{"z":19087}'), (1, '{"z":19087.0}'), (2, '{"z":"19087-1"}')], "pos INT, body STRING"
    ).select(F.lit("s").alias("source"), F.lit(0).alias("page_no"), "pos", F.parse_json("body").alias("record"))
    got = map_fields(rows, {"zip_code": "z", "nonsense": "z"}).orderBy("record_ord").collect()
    assert [r.zip_code for r in got] == ["19087", None, "19087-1"]
    assert "nonsense" not in got[0]


def test_addresses_of_dropped_reports_are_not_taken_apart(spark):
    """The same reports stay, and their keys are computed above the filter that drops the others."""
    day = TODAY.isoformat()
    rows = spark.createDataFrame(
        [(0, "county", "1 Elm St Apt 2", "1500000", day, "19087-1234"), (1, "county", "2 Elm St", "5", day, "19087"),
         (2, "county", "3 Elm St", "1500000", "1990-01-01", "19087"), (3, "county", "4 Elm St", "1500000", day, "99999"),
         (3, "county", "4 Elm St", "1500000", day, None), (0, "county", "1 Elm St Apt 2", "1500000", day, "19087-1234")],
        "record_ord BIGINT, source STRING, address STRING, price_text STRING, sale_date_text STRING, zip_code STRING",
    )
    raw = reports_union([rows], SPECS)
    wanted = qualify(label_reports(build_report(raw, RUN_TS), AREAS, TODAY))
    kept = kept_reports(raw, AREAS, TODAY, RUN_TS)
    assert kept.schema == wanted.schema and kept.count() == 2
    assert kept.drop("raw").exceptAll(wanted.drop("raw")).isEmpty()
    plan = kept.select("property_key")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    key = max(k for k, line in enumerate(plan) if "sha1" in line.lower())
    assert key < min(k for k, line in enumerate(plan) if "Filter" in line)
