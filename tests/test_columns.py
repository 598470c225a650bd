from salesmerge.operators.columns import date_encoding, match_columns

FIELDS = [
    ("OBJECTID", "OID"), ("PROP_ADDRESS", "String"), ("MUNICIPALITY", "String"), ("PROP_ZIP", "String"),
    ("SALE_PRICE", "Double"), ("LAST_PRICE", "Double"), ("SALE_DATE", "Date"), ("GRANTEE", "String"),
    ("GRANTOR", "String"), ("PARCEL_ID", "String"), ("YEAR_BUILT", "Integer"),
]


def layers(spark, **by_name):
    rows = [
        (layer, i, name, f"esriFieldType{kind}")
        for layer, fields in by_name.items() for i, (name, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(rows, "layer STRING, ordinal INT, name STRING, type STRING")


def test_best_columns(spark):
    columns = layers(spark, full=FIELDS, typed=[("PRICE", "String"), ("AMOUNT", "Double")],
                     ties=[("x_price", "Double"), ("y_price", "Double")])
    found = {(r.layer, r.target): r.column for r in match_columns(columns).collect()}
    assert {t: c for (layer, t), c in found.items() if layer == "full"} == {
        "price": "SALE_PRICE", "sale_date": "SALE_DATE", "address": "PROP_ADDRESS",
        "municipality": "MUNICIPALITY", "zip_code": "PROP_ZIP", "parcel_id": "PARCEL_ID",
        "buyer": "GRANTEE", "seller": "GRANTOR", "year_built": "YEAR_BUILT",
    }
    assert found["typed", "price"] == "AMOUNT"
    assert found["ties", "price"] == "x_price"


def test_date_encodings(spark):
    columns = layers(spark, n=[("SALE_DATE", "Double")], t=[("SALE_DATE", "String")],
                     d=[("SALE_DATE", "Date")], none=[("X", "String")])
    got = {r.layer: r.encoding for r in date_encoding(columns, match_columns(columns)).collect()}
    assert got == {"n": "epoch_ms", "t": "string", "d": "date", "none": "date"}
