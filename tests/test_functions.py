from datetime import date

import pytest
from pyspark.sql import functions as F

from salesmerge.functions import addresses, amounts, paths, places, prose


def test_address_spellings_collapse(values):
    spellings = {
        "123 North Wayne Avenue": "123 N WAYNE AVE",
        "123 N. Wayne Ave.": "123 N WAYNE AVE",
        "  123   n wayne   avenue  ": "123 N WAYNE AVE",
        "45 Second Street": "45 2ND ST",
        "45 2nd St": "45 2ND ST",
        "800 King of Prussia Road": "800 KING OF PRUSSIA RD",
        "100 Main St Apt 4B": "100 MAIN ST",
        "100 Main St #4B": "100 MAIN ST",
        "12 Main St W N": "12 MAIN ST",
        "1 N W": "1 N",
        "12 A & B-C -x- - St": "12 A AND B-C X ST",
        "9 A- -B Rd": "9 A B RD",
        "": "",
    }
    assert values(addresses.normalize_address, spellings) == list(spellings.values())


def test_unit_split(values):
    cases = {
        "100 Main St Apt 4B": ("100 MAIN ST", "4B"),
        "100 Main St #12": ("100 MAIN ST", "12"),
        "100 Main St, Unit 7": ("100 MAIN ST,", "7"),
        "100 Main St": ("100 MAIN ST", None),
        "floor 2 x": ("2 X", "OOR"),
        "12 Florence Ave": ("12   AVE", "ORENCE"),
        "1 A St Apt 2 Unit 3": ("1 A ST   UNIT 3", "2"),
    }
    split = lambda v: F.struct(*addresses.split_unit(v))
    got = values(split, cases)
    assert [(g[0].split(), g[1]) for g in got] == [(b.split(), u) for b, u in cases.values()]


def test_strict_units_need_a_gap(values):
    unit = lambda v: addresses.split_unit(v, strict=True)[1]
    assert values(unit, ["12 Florence Ave", "1 A St Apt 4", "1 A St apt.4", "1 A St #4"]) == [
        None, "4", "4", "4",
    ]


def test_title_case(values):
    cases = {
        "123 NORTH WAYNE AVE": "123 North Wayne Ave",
        "5 SE 42ND ST": "5 SE 42ND St",
        "7 ne o'brien NORTH-WEST": "7 NE O'brien North-west",
        " ": "",
    }
    assert values(addresses.title_case_address, cases) == list(cases.values())


def test_places(values):
    cases = {
        "Radnor Township": "RADNOR", "RADNOR TWP": "RADNOR", "Radnor": "RADNOR",
        "Lower Merion Township": "LOWER MERION", "West Chester Borough": "WEST CHESTER",
        "City of Chester": "CHESTER", "Chester City": "CHESTER", "St. Davids": "ST DAVIDS",
    }
    assert values(places.normalize_municipality, cases) == list(cases.values())
    assert values(places.normalize_county, ["Delaware County", "DELAWARE", None]) == [
        "DELAWARE", "DELAWARE", "",
    ]
    assert values(places.normalize_zip, ["19087", "19087-1234", " 1908 ", "PA", "190871", None]) == [
        "19087", "19087", "01908", None, None, None,
    ]


def test_prices(values):
    cases = {
        "$1,250,000": 1_250_000, "1250000": 1_250_000, "1250000.00": 1_250_000,
        "$1.85 million": 1_850_000, "1.85M": 1_850_000, "$950K": 950_000, "": None,
        "no price here": None, "0": None, "-5": 5, ".5M": 5_000_000, "123 Main": 123_000_000,
        "2.5 thousand": 2_500,
    }
    assert values(amounts.parse_price, cases) == list(cases.values())
    number = lambda v: amounts.parse_price_number(v.cast("double"))
    assert values(number, ["1250000.49", "0", "-5", "2.5", "3.5", "NaN", None]) == [
        1_250_000, None, None, 2, 4, None, None,
    ]


def test_dates(values):
    cases = {
        "2026-03-14": date(2026, 3, 14), "03/14/2026": date(2026, 3, 14),
        "3/4/26": date(2026, 3, 4), "3/4/75": date(1975, 3, 4), "2026/3/4": date(2026, 3, 4),
        "March 14, 2026": date(2026, 3, 14), "Mar 14, 2026": date(2026, 3, 14),
        "Mar. 4, 2026": None, "14 March 2026": date(2026, 3, 14), "14 Mar 2026": None,
        "2026-03-14T00:00:00Z": date(2026, 3, 14), "2026-03-14 10:00:00.123": date(2026, 3, 14),
        "2026-03-14T23:00:00-05:00": date(2026, 3, 14), "20260314": date(2026, 3, 14),
        "2026-W11-6": date(2026, 3, 14), "2025-W53-1": None, "1773446400000": date(2026, 3, 14),
        "1773446400": date(2026, 3, 14), "2026-02-30": None, "2026-03-14T25:00:00": None,
        "2026-03": None, "2026-03-14 soon": None, "not a date": None, "": None,
        " 2026-03-14 ": date(2026, 3, 14),
    }
    assert dict(zip(cases, values(amounts.parse_date, cases))) == cases
    number = lambda v: amounts.parse_date_number(v.cast("double"))
    assert values(number, ["1773446400000", "0", "-1", "1e18"]) == [date(2026, 3, 14), None, None, None]


def test_property_key(values):
    def key(zip_code, place):
        return lambda v: addresses.property_key(
            v, F.lit(zip_code).cast("string"), F.lit(place).cast("string")
        )

    long, short = values(key("19087", "Radnor Township"), ["123 North Wayne Avenue", "123 N. Wayne Ave."])
    (plus4,) = values(key("19087-0000", "RADNOR TWP"), ["123 n wayne ave"])
    assert long == short == plus4
    one, two = values(key("19010", None), ["500 Lancaster Ave Apt 1", "500 Lancaster Ave Apt 2"])
    assert one != two
    (a,), (b,) = values(key(None, "Radnor Township"), ["1 Elm St"]), values(key(None, "RADNOR"), ["1 ELM STREET"])
    assert a == b


def test_prose(values):
    assert values(
        prose.extract_price,
        [
            "Listed at $1.9 million, it last sold for $780,000 in 2011 and closed at $2,150,000.",
            "sold for $2.4M", "annual taxes of $12,000", "no dollar figures at all", "$150k then $12a",
        ],
    ) == [2_150_000, 2_400_000, None, None, 150_000]
    assert values(
        prose.extract_address,
        ["The home at 123 N Wayne Ave sold Tuesday", "No address in this sentence",
         "estate at 9  Old Gulph Road. Sold"],
    ) == ["123 N Wayne Ave", None, "9 Old Gulph Road"]
    assert values(prose.strip_html, ["<p>a &amp; b&nbsp;&eacute;</p>", "x", None]) == [" a & b é ", "x", ""]
    assert values(
        prose.parse_feed_date,
        ["Wed, 04 Mar 2026 23:30:00 -0500", "4 Mar 26 12:00 GMT", "2026-03-02T10:00:00Z", "31 Feb 2026 12:00", None],
    ) == [date(2026, 3, 4), date(2026, 3, 4), date(2026, 3, 2), None, None]


@pytest.mark.parametrize(
    "path, expected",
    [("a.b.0.c", "7"), ("a.0.x", "y"), ("a.missing.c", None), ("n", "17"), ("a.b.5.c", None)],
)
def test_json_path(spark, path, expected):
    payload = F.parse_json(F.lit('{"a":{"b":[{"c":7}],"0":{"x":"y"}},"n":17}'))
    assert spark.range(1).select(paths.json_path(payload, path, "string")).first()[0] == expected


def test_column_names(values):
    assert values(paths.normalize_column_name, ["Sale Date", "__A--b..C_", None]) == ["sale_date", "a_b_c", ""]
