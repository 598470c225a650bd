import glob
import random
from datetime import date

import pytest
from conftest import SPECS
from pyspark.sql import functions as F

from salesmerge.operators import query
from salesmerge.operators.resolve import resolve_events


@pytest.fixture(scope="module")
def sales(make_reports):
    rows = make_reports(
        {"price": "1200000", "buyer": "Smith John", "beds": "5", "sqft": "4200"},
        {"address": "9 Old Gulph Rd", "price": "3000000", "sale_date": "2026-02-01",
         "municipality": "Lower Merion", "county": "Montgomery", "zip_code": "19035"},
        {"address": "1 Percent% St Apt 3", "price": "1300000", "sale_date": "2026-03-01"},
        {"address": "2 Last St", "price": "1500001", "sale_date": "2026-01-15"},
    )
    area = F.when(F.col("county") == "Delaware", "Radnor Township").otherwise("Montgomery County")
    return resolve_events(rows.withColumn("area", area), SPECS)


def test_filters(sales):
    n = lambda **kw: query.query_sales(sales, **kw).count()
    assert n() == 4
    assert n(min_price=2_000_000) == 1
    assert n(since=date(2026, 2, 15)) == 2
    assert n(area="Montgomery County") == 1
    assert n(county="Montgomery") == 1
    assert n(search="gulph") == 1
    assert n(search="Radnor") == 3
    assert n(search="%") == 1  # a literal character, no wildcard
    assert n(search="_") == 0


def test_newest_first_and_paging(sales):
    rows = query.query_sales(sales).collect()
    assert [r.price for r in rows] == [1_300_000, 1_200_000, 3_000_000, 1_500_001]
    page = query.query_sales(sales, limit=2, offset=1).collect()
    assert [r.price for r in page] == [1_200_000, 3_000_000]


def test_long_page_equals_short_page(sales):
    long = query.newest_first(sales, limit=query.TOP_K_ROWS, offset=1).collect()
    short = query.newest_first(sales, limit=100, offset=1).collect()
    assert [r.event_id for r in long] == [r.event_id for r in short]


def test_long_pages_are_bounded_by_counting(spark, monkeypatch):
    """Any offset and limit, with ties in date and price, against a plain sort; nothing is written."""
    rng = random.Random(3)
    rows = [(date(2026, 1, rng.choice([1, 2, 2, 2, 9])), rng.choice([1, 5, 5, 7, 10**9, 10**12]), f"{k * 7919 % 10007:020x}")
            for k in range(600)]
    sales = spark.createDataFrame(rows, "sale_date DATE, price BIGINT, event_id STRING")
    ordered = sorted(rows, key=lambda r: (-r[0].toordinal(), -r[1], r[2]))
    monkeypatch.setattr(query, "TOP_K_ROWS", 8)
    monkeypatch.setattr(query, "BINS", 4)
    written = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/staged/*"))
    for limit, offset in [(9, 0), (1, 599), (50, 100), (600, 0), (1000, 590), (3, 600), (0, 20)]:
        page = query.newest_first(sales, limit, offset).collect()
        assert list(map(tuple, page)) == ordered[offset : offset + limit]
    assert set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/staged/*")) == written


def test_area_month_sketches_merge(spark):
    from salesmerge.operators.market import area_month_stats, bucket_sketches

    rows = [(f"k{k}", ["North", "South"][k % 3 == 0], date(2026, 1 + k % 2, 3), 1_000_000 + (k * 7919) % 50_021) for k in range(20_000)]
    sales = spark.createDataFrame(rows, "property_key STRING, area STRING, sale_date DATE, price BIGINT").repartition(5)
    stats = {(r.level, r.area, r.month): r for r in area_month_stats(bucket_sketches(sales, 4)).collect()}
    assert len(stats) == 4 + 2 + 1
    for (level, area, month), found in stats.items():
        own = sorted(r[3] for r in rows if level == 2 or r[1] == area and (level == 1 or f"{r[2]:%Y-%m}" == month))
        assert (found.n, found.volume) == (len(own), sum(own))
        rank = sum(p <= found.median_price for p in own) / len(own)
        assert abs(rank - 0.5) < 0.001


def test_counts_values_and_stats(sales):
    assert query.count_sales(sales, min_price=1_300_000).first().n == 3
    assert [r.value for r in query.distinct_values(sales, "area").collect()] == [
        "Montgomery County", "Radnor Township"]
    with pytest.raises(ValueError):
        query.distinct_values(sales, "price; DROP TABLE sales")
    stats = query.market_stats(query.query_sales(sales, min_price=1_250_000), sales, 1_300_001).first()
    assert (stats.matching, stats.median_price, stats.total_volume, stats.tracked) == (3, 1_500_001, 5_800_001, 2)
    even = query.market_stats(query.query_sales(sales), sales).first()
    assert even.median_price == (1_300_000 + 1_500_001) // 2
    none = query.market_stats(query.query_sales(sales, area="x"), sales).first()
    assert (none.matching, none.median_price, none.total_volume) == (0, None, 0)


def test_display(sales):
    rows = {r.price: r for r in query.presentation(sales).collect()}
    smith = rows["$1,200,000"]
    assert smith.sold == "Mar 1, 2026" and smith.details == "5 bd · 4,200 sqft"
    assert smith.place == "Radnor Township, Delaware County 19087"
    assert rows["$1,300,000"].property == "1 Percent% St #3"


def test_filters_reach_the_scan(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    sales.write.parquet(path)
    stored = spark.read.parquet(path)
    found = query.query_sales(stored, min_price=2_000_000, since=date(2026, 1, 1), area="x").select("event_id", "price")
    plan = found._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(price,2000000)", "GreaterThanOrEqual(sale_date", "EqualTo(area,x)"):
        assert pushed in plan
    assert "TakeOrderedAndProject" in plan
    assert "municipality" not in plan.split("ReadSchema")[1]
