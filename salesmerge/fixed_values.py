"""Fixed values.

Word lists, lookup tables, patterns and default thresholds whose exact content
decides the results. They are data, stated once here and used everywhere else.
"""

# --- fixed values: thresholds ------------------------------------------------
MIN_PRICE = 1_000_000
LOOKBACK_DAYS = 45
DEDUPE_WINDOW_DAYS = 14
DEFAULT_STATE = "PA"
QUERY_LIMIT = 500
DRY_RUN_LIMIT = 20
DASHBOARD_EXPORT_LIMIT = 100_000
COMMAND_EXPORT_LIMIT = 1_000_000
ROW_TEXT_CHARS = 500
PROSE_PRICE_FLOOR = 100_000
EPOCH_MILLIS_ABOVE = 1e11

# --- fixed values: address words ---------------------------------------------
DIRECTIONS = {
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "NORTHEAST": "NE",
    "NORTHWEST": "NW",
    "SOUTHEAST": "SE",
    "SOUTHWEST": "SW",
}

STREET_TYPES = {
    "STREET": "ST",
    "AVENUE": "AVE",
    "AV": "AVE",
    "ROAD": "RD",
    "DRIVE": "DR",
    "LANE": "LN",
    "COURT": "CT",
    "CIRCLE": "CIR",
    "BOULEVARD": "BLVD",
    "PLACE": "PL",
    "TERRACE": "TER",
    "PARKWAY": "PKWY",
    "HIGHWAY": "HWY",
    "TRAIL": "TRL",
    "SQUARE": "SQ",
    "TURNPIKE": "TPKE",
    "CRESCENT": "CRES",
    "COMMONS": "CMNS",
    "EXTENSION": "EXT",
    "HEIGHTS": "HTS",
    "LOOP": "LOOP",
    "RUN": "RUN",
    "WAY": "WAY",
}

ORDINALS = {
    "FIRST": "1ST",
    "SECOND": "2ND",
    "THIRD": "3RD",
    "FOURTH": "4TH",
    "FIFTH": "5TH",
    "SIXTH": "6TH",
    "SEVENTH": "7TH",
    "EIGHTH": "8TH",
    "NINTH": "9TH",
    "TENTH": "10TH",
}

UNIT_WORDS = ("APT", "APARTMENT", "UNIT", "STE", "SUITE", "LOT", "FL", "FLOOR")

PLACE_CLASS_WORDS = ("TOWNSHIP", "TWP", "BOROUGH", "BORO", "CITY", "TOWN", "VILLAGE")

# --- fixed values: prices and dates ------------------------------------------
PRICE_PATTERN = r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(K|M|MM|MILLION|THOUSAND)?"

PRICE_SUFFIXES = {
    "K": 1_000,
    "THOUSAND": 1_000,
    "M": 1_000_000,
    "MM": 1_000_000,
    "MILLION": 1_000_000,
}

MONTHS = (
    "JANUARY",
    "FEBRUARY",
    "MARCH",
    "APRIL",
    "MAY",
    "JUNE",
    "JULY",
    "AUGUST",
    "SEPTEMBER",
    "OCTOBER",
    "NOVEMBER",
    "DECEMBER",
)

# --- fixed values: prose -------------------------------------------------------
PROSE_STREET_SUFFIXES = (
    "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Boulevard|Blvd|"
    "Place|Pl|Terrace|Ter|Way|Trail|Trl|Pike|Parkway|Pkwy|Square|Sq|Row|Run|Crescent"
)

PROSE_ADDRESS_PATTERN = (
    r"\b(\d{1,6}\s+(?:[NSEW]\.?\s+)?(?:[A-Z][A-Za-z'\-\.]*\s+){0,4}(?:"
    + PROSE_STREET_SUFFIXES
    + r")\b\.?)"
)

PROSE_PRICE_PATTERN = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|mil|m|k|thousand)?\b"

# --- fixed values: record shape ------------------------------------------------
FEATURE_OPTIONAL_FIELDS = (
    "municipality",
    "zip_code",
    "county",
    "parcel_id",
    "buyer",
    "seller",
    "beds",
    "baths",
    "sqft",
    "lot_acres",
    "year_built",
    "property_type",
    "unit",
)

ADDRESS_OBJECT_KEYS = ("line1", "street", "full")

COMMAND_EXPORT_COLUMNS = (
    "sale_date", "price", "address", "unit", "municipality", "county", "zip_code",
    "area", "beds", "baths", "sqft", "lot_acres", "year_built", "buyer", "seller",
    "parcel_id", "source", "source_url",
)

DASHBOARD_EXPORT_COLUMNS = (
    "sale_date", "price", "address", "unit", "municipality", "county",
    "zip_code", "area", "beds", "baths", "sqft", "buyer", "seller",
    "parcel_id", "source", "source_url",
)

LISTABLE_COLUMNS = ("area", "county", "municipality", "source")

REJECT_REASONS = ("below_price", "too_old", "future_date", "outside_area")

# --- fixed values: column-name hints, best guess first ---------------------------
COLUMN_HINTS = {
    "price": ("sale_price", "saleprice", "sales_price", "consideration", "amount", "price"),
    "sale_date": ("sale_date", "saledate", "deed_date", "transfer_date", "recorded", "date"),
    "address": ("prop_addr", "situs", "site_address", "property_address", "full_address",
                "address", "addr", "location"),
    "municipality": ("municipality", "muni", "township", "boro", "city", "town", "place"),
    "zip_code": ("zip", "postal"),
    "county": ("county",),
    "parcel_id": ("parcel", "pin", "apn", "folio", "uid", "map_no", "tax_id"),
    "buyer": ("grantee", "buyer", "owner_new", "new_owner"),
    "seller": ("grantor", "seller", "owner_prev", "prior_owner"),
    "beds": ("bed",),
    "baths": ("bath",),
    "sqft": ("sq_ft", "sqft", "square_feet", "living_area", "finished_area"),
    "lot_acres": ("acre", "lot_size"),
    "year_built": ("year_built", "yearbuilt", "yr_built", "actual_year"),
    "property_type": ("land_use", "use_code", "property_type", "class", "descr"),
}

NUMERIC_TARGETS = ("price", "beds", "baths", "sqft", "lot_acres", "year_built")

NUMERIC_COLUMN_TYPES = (
    "esriFieldTypeDouble",
    "esriFieldTypeSingle",
    "esriFieldTypeInteger",
    "esriFieldTypeSmallInteger",
    "esriFieldTypeBigInteger",
)
DATE_COLUMN_TYPES = ("esriFieldTypeDate", "esriFieldTypeDateOnly", "esriFieldTypeTimestampOffset")
TEXT_COLUMN_TYPES = ("esriFieldTypeString",)

EXACT_HINT_SCORE = 100
EDGE_HINT_SCORE = 60
INNER_HINT_SCORE = 30
