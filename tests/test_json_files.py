"""Large JSON files read in ranges, against reading them whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from salesmerge.operators.reports import reports_union
from salesmerge.schema import SourceSpec
from salesmerge.sources.json_files import scan_json_files
from salesmerge.sources.json_records import record_reports


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def landed(tmp_path, **pages):
    for name, body in pages.items():
        source, page = name.split("_")
        file = tmp_path / source / f"{page}.json"
        file.parent.mkdir(exist_ok=True)
        file.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, indent=1 if name[-1] in "24" else None))
    return f"{tmp_path}/*/*"


def value(rng, depth=0):
    kinds = [rng.randint(-5, 5), 'q"u\\o}te{[', "}" * rng.randint(0, 5), "\\", "é{日", None, True, 1.5, "", "\\\\"]
    if depth < 3 and rng.random() < 0.4:
        if rng.random() < 0.5:
            return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", "data", "items", 'k"}', "{"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return rng.choice(kinds)


def found(records):
    rows = records.select("source", "page_no", "record_ord", F.to_json("record").alias("text")).collect()
    ordered = sorted(rows, key=lambda r: (r.source, r.record_ord))
    assert len({(r.source, r.record_ord) for r in rows}) == len(rows)
    return [(r.source, r.page_no, json.loads(r.text)) for r in ordered]


@pytest.mark.parametrize("path", ["data.items", ""])
def test_ranges_give_the_records_of_the_whole(spark, tmp_path, small_ranges, path):
    rng = random.Random(len(path))
    bodies, expected = {}, []
    for page in range(6):
        items = [{"n": page * 1000 + k, "v": value(rng)} for k in range(rng.choice([0, 1, 40]))]
        if page == 4:
            items.append({"n": 1, "long": "x{" * 2000})  # longer than several ranges
            items += [{"n": k} for k in range(5)]
        mixed = [x for item in items for x in (item, rng.choice([3, "s{", [{"n": 1}], None]))]
        around = {"meta": {"items": [{"n": -1}] * 3, "data": {"items": [{"n": -2}]}}, "data": {"x": [1], "items": mixed, "y": {}}, "items": [{}]}
        bodies[f"v_{page}"] = around if path else mixed
        expected += [("v", page, item) for item in items]
    records, failures = scan_json_files(spark, landed(tmp_path, **bodies), path)
    assert failures.count() == 0
    assert found(records) == expected
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/*/*").rdd.getNumPartitions() > 8


def test_other_payloads(spark, tmp_path, small_ranges):
    good = {"d": [{"n": k, "pad": "y" * 50} for k in range(30)]}
    text = json.dumps(good)
    pages = {
        "a_1": good, "a_2": {"d": {"n": "one"}}, "a_3": {"d": []}, "a_4": {"e": 1}, "b_1": {"d": "text"}, "c_1": text[:-40],
        "e_1": "", "f_1": text.replace('"n": 7', '"n": x'), "g_1": {"d": [{"n": 1}], "z": 1, "d ": []},
    }
    records, failures = scan_json_files(spark, landed(tmp_path, **pages), "d")
    status = {r.source: (r.page_no, r.status) for r in failures.collect()}
    assert status == {"b": (1, "misconfigured"), "c": (1, "error"), "f": (1, "error")}
    healthy = [x for x in found(records) if x[0] in "ag"]
    assert healthy == [*(("a", 1, x) for x in good["d"]), ("a", 2, {"n": "one"}), ("g", 1, {"n": 1})]
    with pytest.raises(ValueError, match="list index"):
        scan_json_files(spark, f"{tmp_path}/a/*", "d.0")


def test_order_has_no_limit_by_page(spark, tmp_path):
    """More records on one page than positions fit in a packed page order."""
    n = 140_000
    body = '{"rows":[' + ",".join(f'{{"a":"{k} Elm St","p":{k + 1},"d":"2026-03-01"}}' for k in range(n)) + "]}"
    records, _ = scan_json_files(spark, landed(tmp_path, s_1=body), "rows")
    rows = reports_union([record_reports(records, {"address": "a", "price": "p", "sale_date": "d"})], [SourceSpec("s", 1)])
    last = rows.orderBy(F.desc("seq")).first()
    assert rows.count() == rows.select("seq").distinct().count() == n and last.address == f"{n - 1} Elm St"
