import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from salesmerge.operators.reports import build_report, reports_union  # noqa: E402
from salesmerge.schema import Area, SourceSpec  # noqa: E402
from salesmerge.session import configure  # noqa: E402

SPECS = [SourceSpec("county", 90), SourceSpec("news", 10)]
AREAS = [
    Area("Radnor Township", ("Delaware",), ("Radnor", "Wayne", "Villanova", "St Davids", "Bryn Mawr"),
         ("19087", "19085", "19010")),
    Area("Chester County", ("Chester",)),
    Area("Montgomery County", ("Montgomery",)),
    Area("Delaware County", ("Delaware",)),
]
TODAY = date(2026, 3, 20)
RUN_TS = datetime(2026, 3, 20, 6, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("salesmerge-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a text function over a list of texts."""

    def run(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i INT, v STRING")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]

    return run


@pytest.fixture(scope="session")
def make_reports(spark):
    """Usable reports out of plain dicts, in the order given."""
    defaults = {
        "address": "123 N Wayne Ave", "price": "1500000", "sale_date": "2026-03-01",
        "source": "county", "county": "Delaware", "municipality": "Radnor Township",
        "zip_code": "19087",
    }
    names = {"price": "price_text", "sale_date": "sale_date_text"}
    optional = ("unit", "buyer", "seller", "beds", "sqft", "raw", "source_url")

    def run(*rows, specs=SPECS):
        fields = [*defaults, *optional]
        data = [
            (i, *[{**defaults, **row}.get(f) for f in fields]) for i, row in enumerate(rows)
        ]
        schema = "record_ord BIGINT, " + ", ".join(f"{names.get(f, f)} STRING" for f in fields)
        return build_report(reports_union([spark.createDataFrame(data, schema)], specs), RUN_TS)

    return run
