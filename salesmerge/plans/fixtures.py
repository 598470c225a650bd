"""Property-sale inputs derived from the driver's tables.

Each text runs unchanged on Spark and on DuckDB, so both sides of a check start
from the same rows. Braces name the tables.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from ..schema import Area, SourceSpec
from ..session import spread

TODAY = date(2001, 8, 1)
RUN_TS = datetime(2001, 8, 1, 6, 0, 0)
LONG_LOOKBACK_DAYS = 2500

SPECS = (
    SourceSpec("county", 90),
    SourceSpec("vendor_a", 65),
    SourceSpec("vendor_b", 60),
    SourceSpec("page", 40),
    SourceSpec("news", 10),
)
# The same sources collected in the opposite order: every merge may change the leader.
REVERSED_SPECS = tuple(reversed(SPECS))

AREAS = (
    Area("Old Town", ("Alder",), ("Town0", "Town6"), ("19011", "19012")),
    Area("Alder County", ("Alder",)),
    Area("Birch County", ("Birch",)),
    Area("Cedar County", ("Cedar",)),
)

# One property per customer, reported by five sources in varying spellings.
RAW_REPORTS = """
SELECT o.o_orderkey AS record_ord,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'county' WHEN '2-HIGH' THEN 'vendor_a'
    WHEN '3-MEDIUM' THEN 'vendor_b' WHEN '4-NOT SPECIFIED' THEN 'page' ELSE 'news' END AS source,
  concat(cast(o.o_custkey + 1 AS string), ' ',
    CASE o.o_orderkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'N.' ELSE 'n' END, ' ',
    CASE o.o_custkey % 3 WHEN 0 THEN 'Wayne'
      WHEN 1 THEN CASE o.o_orderkey % 2 WHEN 0 THEN 'Second' ELSE '2nd' END
      ELSE 'Gulph-Mill & Sons' END, ' ',
    CASE o.o_orderkey % 4 WHEN 0 THEN 'Avenue' WHEN 1 THEN 'Ave.' WHEN 2 THEN 'AVE' ELSE ' Av,' END,
    CASE WHEN o.o_custkey % 7 = 3 AND o.o_orderkey % 2 = 0 THEN ' West' ELSE '' END,
    CASE WHEN o.o_custkey % 5 <> 0 THEN ''
      WHEN o.o_orderkey % 2 = 0 THEN concat(' Apt ', cast(o.o_custkey % 7 + 1 AS string))
      ELSE concat(' #', cast(o.o_custkey % 7 + 1 AS string)) END) AS address,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'n/a'
    WHEN o.o_orderkey % 4 = 0 THEN concat('$', cast(cast(floor(o.o_totalprice * 10) AS bigint) AS string))
    WHEN o.o_orderkey % 4 = 1 THEN concat(cast(cast(floor(o.o_totalprice / 100) AS bigint) AS string), 'K')
    WHEN o.o_orderkey % 4 = 2 THEN concat(cast(cast(floor(o.o_totalprice * 10) AS bigint) AS string), '.00')
    ELSE cast(cast(floor(o.o_totalprice * 10) AS bigint) AS string) END AS price_text,
  CASE WHEN o.o_orderkey % 101 = 0 THEN 'pending'
    WHEN o.o_orderkey % 2 = 0 THEN cast(cast(o.o_orderdate AS date) AS string)
    ELSE concat(cast(month(o.o_orderdate) AS string), '/', cast(day(o.o_orderdate) AS string), '/',
                cast(year(o.o_orderdate) AS string)) END AS sale_date_text,
  CASE WHEN o.o_custkey % 11 = 4 THEN '' ELSE concat(cast(19000 + c.c_nationkey AS string),
    CASE WHEN o.o_orderkey % 3 = 0 THEN '-1234' ELSE '' END) END AS zip_code,
  concat('Town', cast(c.c_nationkey AS string),
    CASE WHEN o.o_orderkey % 2 = 0 THEN ' Township' ELSE ' TWP' END) AS municipality,
  concat(CASE c.c_nationkey % 5 WHEN 0 THEN 'Alder' WHEN 1 THEN 'Birch' WHEN 2 THEN 'Cedar'
    WHEN 3 THEN 'Dogwood' ELSE 'Elm' END, ' County') AS county,
  CASE WHEN o.o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN cast(o.o_custkey % 6 AS string) END AS beds,
  CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN concat(cast(1 + o.o_custkey % 5 AS string), ',',
    cast(100 + o.o_orderkey % 900 AS string)) END AS sqft,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN concat('Buyer', cast(o.o_orderkey % 50 AS string))
    WHEN o.o_orderpriority = '5-LOW' THEN '' END AS buyer,
  concat('{{"SEQ":', cast(o.o_orderkey AS string),
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN concat(',"PARCEL":"p', cast(o.o_custkey AS string), '"')
      ELSE '' END,
    CASE o.o_orderkey % 5 WHEN 0 THEN ',"NOTE":null'
      WHEN 1 THEN concat(',"NOTE":"n', cast(o.o_orderkey AS string), '"') ELSE '' END, '}}') AS raw
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# Run log: seven sources, ten source runs per run.
RUN_LOG = """
SELECT event_id AS id,
  concat('run', cast(cast(floor(event_id / 10) AS bigint) AS string)) AS run_id,
  concat('s', cast(user_id % 7 AS string)) AS source,
  CASE event_type WHEN 'signup' THEN 'misconfigured' WHEN 'purchase' THEN 'blocked'
    WHEN 'error' THEN 'error' ELSE 'ok' END AS status,
  cast(ts AS timestamp) AS started_at,
  cast(ts AS timestamp) AS finished_at,
  cast(floor(value * 10) AS bigint) AS fetched,
  cast(floor(value) AS bigint) AS kept,
  CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN concat(event_type, ': boom') END AS message
FROM {events}
"""

# Columns of map layers: one layer per customer, column names from a fixed pool.
LAYER_COLUMNS = """
SELECT concat('layer', cast(o_custkey AS string)) AS layer,
  o_orderkey AS ordinal,
  CASE o_orderkey % 23 WHEN 0 THEN 'SALE_PRICE' WHEN 1 THEN 'LAST_PRICE' WHEN 2 THEN 'Sale Date'
    WHEN 3 THEN 'PROP_ADDRESS' WHEN 4 THEN 'MUNICIPALITY' WHEN 5 THEN 'PROP_ZIP' WHEN 6 THEN 'GRANTEE'
    WHEN 7 THEN 'GRANTOR' WHEN 8 THEN 'PARCEL_ID' WHEN 9 THEN 'YEAR_BUILT' WHEN 10 THEN 'OBJECTID'
    WHEN 11 THEN 'AMOUNT' WHEN 12 THEN 'saleDate' WHEN 13 THEN 'TransferDate' WHEN 14 THEN 'situs.address'
    WHEN 15 THEN 'County Name' WHEN 16 THEN 'NUM_BEDS' WHEN 17 THEN 'FULL-BATHS' WHEN 18 THEN 'LivingArea'
    WHEN 19 THEN 'ACREAGE' WHEN 20 THEN 'LAND_USE_CODE' WHEN 21 THEN 'OWNER_PREV' ELSE 'DATE' END AS name,
  CASE cast(floor(o_orderkey / 23) AS bigint) % 5 WHEN 0 THEN 'esriFieldTypeString'
    WHEN 1 THEN 'esriFieldTypeDouble' WHEN 2 THEN 'esriFieldTypeDate'
    WHEN 3 THEN 'esriFieldTypeInteger' ELSE 'esriFieldTypeOID' END AS type
FROM {orders}
"""

# Headlines about the same sales, as a press feed would carry them.
HEADLINES = """
SELECT o_orderkey AS record_ord,
  concat('Estate at ', cast(o_custkey + 1 AS string), ' N. Old Gulph Road sells for $',
    CASE o_orderkey % 3 WHEN 0 THEN concat(cast(1 + o_orderkey % 8 AS string), '.5 million')
      WHEN 1 THEN concat(cast(300 + o_orderkey % 600 AS string), 'k')
      ELSE concat(cast(1 + o_orderkey % 9 AS string), ',250,000') END) AS title,
  concat('<p>The ', CASE o_custkey % 5 WHEN 0 THEN 'Villanova' WHEN 1 THEN 'Bryn Mawr'
      WHEN 2 THEN 'Radnor Township' WHEN 3 THEN 'St. Davids' ELSE 'Nowhere' END,
    ' home near Wayne &amp; Devon; <b>taxes</b> $12,000&nbsp;a year.</p>') AS summary,
  concat('https://news.example.com/story/', cast(o_orderkey AS string)) AS link,
  CASE WHEN o_orderkey % 2 = 0 THEN concat(cast(cast(o_orderdate AS date) AS string), 'T10:00:00Z')
    ELSE concat('Wed, ', cast(day(o_orderdate) AS string), ' ',
      CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr'
        WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep'
        WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END, ' ',
      cast(year(o_orderdate) AS string), ' 23:30:00 -0500') END AS published
FROM {orders}
"""

PLACES = ("Radnor", "Wayne", "Villanova", "St Davids", "Bryn Mawr", "Devon")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run one of the texts above over the Parquet tables in `folder`."""
    keys = {"orders": "o_orderkey", "customer": None, "events": "event_id", "pages": "page_id"}
    tables = {}
    for name, key in keys.items():
        if "{" + name + "}" in text:
            read = table(spark, folder, name)
            tables[name] = spread(read, key) if key else read
    return spark.sql(text, **tables)


def duck(text: str) -> str:
    """The same text for DuckDB, where the tables are views of their own name."""
    return text.format(orders="orders", customer="customer", events="events", pages="pages")


def raw_reports(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, RAW_REPORTS)


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, RUN_LOG)
