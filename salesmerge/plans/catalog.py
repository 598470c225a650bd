"""One runnable query per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import (
    COMMAND_EXPORT_COLUMNS,
    COMMAND_EXPORT_LIMIT,
    DASHBOARD_EXPORT_COLUMNS,
    DASHBOARD_EXPORT_LIMIT,
    LISTABLE_COLUMNS,
    LOOKBACK_DAYS,
)
from ..functions import addresses, amounts, paths, places, prose
from ..operators import columns as layer_columns
from ..operators import query, runs
from ..operators.areas import match_area
from ..operators.market import area_month_stats, bucket_sketches
from ..operators.nearest import nearest_event
from ..operators.places import extract_reports_from_text, gazetteer_match, known_places
from ..operators.qualify import kept_reports, label_reports, qualify, reject_counts, source_counts
from ..operators.reports import build_report, parse_reports, quarantine, reports_union
from ..operators.resolve import (
    assign_events,
    merge_events,
    rank_lookup,
    resolve_events,
    run_totals,
)
from ..operators.sessions import sessionize_events
from ..schema import PAGE_RECORD_BITS, RECORD_BITS, SourceSpec, local_frame, page_record_ord
from ..session import configure, shared_folder, spread, stage
from ..sources.feature_json import feature_reports, scan_feature_json
from ..sources.feed_files import scan_feed_files
from ..sources.feeds import scan_feed_xml
from ..sources.floors import source_pushdown as price_and_date_floor
from ..sources.html_rows import html_reports, scan_html_rows
from ..sources.json_files import scan_json_files
from ..sources.json_records import record_reports, scan_json_records
from ..sources.landed import as_text
from ..sources.tables import read_sales, write_csv, write_sales
from ..streaming.incremental import incremental_resolve
from . import fixtures as X
from .collect import collect_and_store, collect_run

Query = Callable[[SparkSession, str], DataFrame]


# --- shared inputs ----------------------------------------------------------------------


def raw(spark: SparkSession, folder: str, specs=X.SPECS) -> DataFrame:
    return reports_union([X.raw_reports(spark, folder)], specs)


def reports(spark: SparkSession, folder: str, specs=X.SPECS) -> DataFrame:
    return build_report(raw(spark, folder, specs), X.RUN_TS)


def labelled(
    spark: SparkSession, folder: str, specs=X.SPECS, lookback: int = X.LONG_LOOKBACK_DAYS
) -> DataFrame:
    return label_reports(
        reports(spark, folder, specs), X.AREAS, X.TODAY, lookback_days=lookback
    )


def kept(spark: SparkSession, folder: str, specs=X.SPECS) -> DataFrame:
    return kept_reports(
        raw(spark, folder, specs), X.AREAS, X.TODAY, X.RUN_TS, lookback_days=X.LONG_LOOKBACK_DAYS
    )


_stored: dict[tuple[str, str], DataFrame] = {}


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """The stored sales of a folder: resolved once per session, then read."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        path = f"{shared_folder(spark)}/sales-{uuid.uuid4().hex}"
        write_sales(resolve_events(kept(spark, folder), X.SPECS), path, buckets=_BUCKETS)
        _stored[key] = read_sales(spark, path)
    return _stored[key]


def run_table(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.sum("kept").alias("new_sales"),
        F.sum(F.col("fetched") - F.col("kept")).alias("updated_sales"),
    )


def shown_sales(rows: DataFrame) -> DataFrame:
    """Sale columns to compare, with the payload's keys read out of `raw`."""
    payload = F.try_parse_json("raw")
    entries = payload.cast("map<string,variant>")
    note = F.when(
        F.map_contains_key(entries, "NOTE"),
        F.coalesce(F.try_variant_get(payload, "$.NOTE", "string"), F.lit("null")),
    ).otherwise("absent")
    return rows.select(
        "event_id", "property_key", "event_seq", "address", "unit", "municipality", "county",
        "zip_code", "price", "sale_date", "beds", "sqft", "buyer", "source", "area",
        F.try_variant_get(payload, "$.SEQ", "bigint").alias("raw_seq"),
        F.try_variant_get(payload, "$.PARCEL", "string").alias("raw_parcel"),
        note.alias("raw_note"),
    )


def scalar(name: str, function: Callable[..., Column], *inputs: str) -> Query:
    """A function over the whole raw-report view."""
    return lambda spark, folder: X.raw_reports(spark, folder).select(
        "record_ord", function(*[F.col(i) for i in inputs]).alias(name)
    )


def _split_unit(spark, folder):
    base, unit = addresses.split_unit(F.col("address"))
    return X.raw_reports(spark, folder).select("record_ord", base.alias("base"), unit.alias("unit"))


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    return X.view(spark, folder, X.HEADLINES)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    plain = headlines(spark, folder).withColumn("summary", prose.strip_html(F.col("summary")))
    return plain.select(
        "record_ord", "published", F.concat("title", F.lit(". "), "summary").alias("text")
    )


# --- pages built from the tables ---------------------------------------------------------

_PAGE_ROWS = 100
_BUCKETS = 8  # of the small sales tables written here


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reports with the typed order columns, filed on pages of a hundred."""
    orders = spread(X.table(spark, folder, "orders"), "o_orderkey")
    return (
        X.raw_reports(spark, folder)
        .join(orders, F.col("record_ord") == F.col("o_orderkey"))
        .withColumns(
            {
                "page_no": F.floor(F.col("record_ord") / _PAGE_ROWS),
                "amount": F.floor(F.col("o_totalprice") * 10).cast("bigint"),
                "sold": F.col("o_orderdate").cast("date"),
            }
        )
    )


def _pages(rows: DataFrame, record, head: str, tail: str, glue: str = ",") -> DataFrame:
    """Payloads (source, page_no, body) of a hundred records each, in record order."""
    listed = rows.groupBy("page_no").agg(
        F.sort_array(F.collect_list(F.struct("record_ord", record.alias("text")))).alias("r")
    )
    body = F.concat(
        F.lit(head), F.array_join(F.transform("r", lambda x: x["text"]), glue), F.lit(tail)
    )
    return listed.select(F.lit("landed").alias("source"), "page_no", body.alias("body"))


def _place_of(column: str = "record_ord"):
    """Back from (page, position) to the record number the page was built from."""
    page = F.shiftright(F.col(column), PAGE_RECORD_BITS)
    return page * _PAGE_ROWS + F.col(column).bitwiseAND(F.lit((1 << PAGE_RECORD_BITS) - 1))


def feature_pages(spark: SparkSession, folder: str) -> DataFrame:
    feature = F.struct(
        F.struct(
            F.col("address").alias("SITE_LINE"),
            F.col("municipality").alias("PLACE_NM"),
            F.col("zip_code").alias("ZIP"),
            F.col("amount").alias("CONSIDERATION"),
            (F.unix_date("sold").cast("bigint") * 86_400_000).alias("RECORDED"),
            F.col("price_text").alias("PRICE_TEXT"),
        ).alias("attributes"),
        F.struct(
            F.col("record_ord").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y")
        ).alias("geometry"),
    )
    return _pages(_numbered(spark, folder), F.to_json(feature), '{"features":[', "]}")


def vendor_pages(spark: SparkSession, folder: str) -> DataFrame:
    record = F.struct(
        F.struct(
            F.col("address").alias("line1"),
            F.col("municipality").alias("town"),
            F.col("zip_code").alias("code"),
        ).alias("address"),
        F.struct(
            F.struct(F.col("amount").alias("total")).alias("amount"),
            F.col("sale_date_text").alias("day"),
        ).alias("sale"),
        F.array(F.struct((F.col("record_ord") % 5000).alias("size"))).alias("building"),
    )
    return _pages(_numbered(spark, folder), F.to_json(record), '{"property":[', "]}")


def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    def escaped(name: str):
        text = F.replace(F.col(name), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    rows = headlines(spark, folder).withColumn("page_no", F.floor(F.col("record_ord") / _PAGE_ROWS))
    item = F.concat(
        F.lit("<item><title>"), escaped("title"),
        F.lit("</title><description>"), escaped("summary"),
        F.lit("</description><link>"), F.col("link"),
        F.lit("</link><pubDate>"), F.col("published"), F.lit("</pubDate></item>"),
    )
    return _pages(
        rows, item, '<?xml version="1.0"?><rss version="2.0"><channel><title>Local</title>',
        "</channel></rss>", "",
    )


def transfer_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.raw_reports(spark, folder).withColumn(
        "page_no", F.floor(F.col("record_ord") / _PAGE_ROWS)
    )
    cells = F.concat(
        F.lit("<tr><td>"), F.replace(F.col("address"), F.lit("&"), F.lit("&amp;")),
        F.lit("</td><td>"), F.col("sale_date_text"),
        F.lit("</td>\n<td class='money'> <b>"), F.col("price_text"),
        F.lit("</b></td><td>"), F.col("municipality"), F.lit("</td></tr>"),
    )
    return _pages(
        rows, cells, "<html><body><table class='transfers wide'><tbody>", "</tbody></table></body></html>", ""
    )


_FEATURE_MAP = {
    "address": "SITE_LINE", "municipality": "PLACE_NM", "zip_code": "ZIP", "county": "COUNTY_NAME",
}
_VENDOR_MAP = {
    "address": "address", "price": "sale.amount.total", "sale_date": "sale.day",
    "municipality": "address.town", "zip_code": "address.code", "sqft": "building.0.size",
}
_CELL_MAP = {
    "address": "td:nth-child(1)", "sale_date": "td:nth-child(2)",
    "price": "td:nth-child(3)", "municipality": "td:nth-child(4)",
}


# --- queries -------------------------------------------------------------------------------


def _display(spark, folder):
    shown = addresses.display_address(F.col("address"), F.col("unit"))
    rows = reports(spark, folder)
    return rows.select(F.col("seq").bitwiseAND(F.lit((1 << RECORD_BITS) - 1)).alias("record_ord"), shown.alias("display"))


def _build(spark, folder):
    return reports(spark, folder).select(
        "seq", "property_key", "address", "unit", "municipality", "county", "zip_code", "price",
        "sale_date", "beds", "sqft", "buyer", "source", "state",
    )


def _quarantine(spark, folder):
    return quarantine(raw(spark, folder)).select(
        F.col("seq").bitwiseAND(F.lit((1 << RECORD_BITS) - 1)).alias("record_ord"), "unusable"
    )


def _union(spark, folder):
    return raw(spark, folder).select(
        "seq", "source", "address", "price_text", "sale_date_text", "county", "municipality",
        F.coalesce("zip_code", F.lit("")).alias("zip_code"),
    )


def _qualified(lookback):
    return lambda spark, folder: qualify(labelled(spark, folder, lookback=lookback)).select(
        "seq", "area", "price", "sale_date"
    )


def _dry_run(spark, folder):
    shown = addresses.display_address(F.col("address"), F.col("unit"))
    return runs.dry_run_preview(kept(spark, folder)).select(
        "seq", "source", "sale_date", "price", shown.alias("display"), "area"
    )


def _pushdown(spark, folder):
    orders = X.table(spark, folder, "orders")
    floored = price_and_date_floor(
        orders, "o_totalprice", "o_orderdate", 100_000, date(2000, 1, 1), "timestamp",
        F.col("o_orderstatus") == "F",
    )
    return floored.select(
        "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").cast("string").alias("ordered")
    )


def _resolve(specs=X.SPECS, window=14):
    return lambda spark, folder: shown_sales(
        resolve_events(kept(spark, folder, specs), specs, window)
    )


def _sessions(spark, folder):
    return sessionize_events(kept(spark, folder), X.SPECS).select(
        "property_key", "event_seq", "first_date", "last_date", "reports", "sale_date", "source", "price",
        "beds", "sqft", "buyer", "unit", "area",
    )


def _area_months(spark, folder):
    stored = stage(bucket_sketches(sales(spark, folder), _BUCKETS), "sketches")
    return area_month_stats(stored)


def _second_run(spark, folder):
    """All sources but the first in one run, the first, of highest rank, in a second."""
    base = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = X.raw_reports(spark, folder)
    best = X.SPECS[0].name
    for run, part in (("run1", F.col("source") != best), ("run2", F.col("source") == best)):
        collect_and_store(
            base, [rows.filter(part)], X.SPECS, X.AREAS, X.TODAY, X.RUN_TS, run, lookback_days=X.LONG_LOOKBACK_DAYS
        )
    stored = read_sales(spark, f"{base}/sales")
    return stored.select("property_key", "sale_date", "price", "source", "beds", "sqft", "buyer")


def _merge_records(spark, folder):
    ranked = rank_lookup(kept(spark, folder, X.REVERSED_SPECS), X.REVERSED_SPECS)
    assigned = assign_events(ranked, 45)
    merged = shown_sales(merge_events(assigned))
    several = assigned.reports.groupBy("property_key", "event_seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return merged.join(several, ["property_key", "event_seq"], "left_semi").select(
        "property_key", "event_seq", "price", "source", "beds", "sqft", "buyer", "raw_seq",
        "raw_parcel", "raw_note",
    )


def _run_totals(spark, folder):
    return run_totals(assign_events(rank_lookup(kept(spark, folder), X.SPECS)))


def _runs(spark, folder):
    result = collect_run(
        [X.raw_reports(spark, folder)], X.SPECS, X.AREAS, X.TODAY, X.RUN_TS, "run1",
        lookback_days=X.LONG_LOOKBACK_DAYS,
    )
    return result.run.select("run_id", "new_sales", "updated_sales")


def _bad_pages(spark: SparkSession) -> DataFrame:
    return local_frame(
        spark,
        [("vendor_b", 7, "error", "later page"), ("vendor_b", 3, "misconfigured", "bad page 3")],
        "source STRING, page_no BIGINT, status STRING, message STRING",
    )


def _source_runs(spark, folder):
    log = runs.source_runs(
        labelled(spark, folder, lookback=LOOKBACK_DAYS), _bad_pages(spark), X.SPECS, "run1",
        X.RUN_TS, datetime(2001, 8, 1, 7, 0, 0),
    )
    return log.select("source", "status", "fetched", "kept", "message")


def _source_health(spark, folder):
    healthy = runs.drop_failed_sources(raw(spark, folder), _bad_pages(spark))
    return healthy.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _incremental(spark, folder):
    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    rows = stage(kept(spark, folder), "kept")
    later = F.shiftright("seq", 40) >= 2  # the last three sources arrive in a second run
    for part in (~later, later):
        rows.filter(part).write.mode("append").parquet(f"{base}/landed")
        incremental_resolve(
            spark, f"{base}/landed", f"{base}/sales", X.SPECS, f"{base}/checkpoint",
            buckets=_BUCKETS,
        ).awaitTermination()
    return shown_sales(read_sales(spark, f"{base}/sales"))


def _write_read(spark, folder):
    path = f"{shared_folder(spark)}/sales-{uuid.uuid4().hex}"
    write_sales(resolve_events(kept(spark, folder), X.SPECS), path, buckets=_BUCKETS)
    return shown_sales(read_sales(spark, path))


def _nearest(spark, folder):
    found = nearest_event(reports(spark, folder), sales(spark, folder))
    return found.select("seq", "event_seq", "event_date", "distance")


def _query_sales(spark, folder):
    return query.query_sales(
        sales(spark, folder), min_price=1_500_000, since=date(1998, 1, 1), area="Birch County",
        county="Birch County", search="WAYNE",
    ).select("event_id", "sale_date", "price", "address", "area", "county")


def _distinct(spark, folder):
    table = sales(spark, folder)
    result = None
    for name in sorted(LISTABLE_COLUMNS):
        part = query.distinct_values(table, name).select(F.lit(name).alias("listed"), "value")
        result = part if result is None else result.unionByName(part)
    return result


def _market(spark, folder):
    table = sales(spark, folder)
    page = query.query_sales(
        table, min_price=1_500_000, since=date(1999, 1, 1), area="Birch County"
    )
    return query.market_stats(page, table)


def _presentation(spark, folder):
    return query.presentation(sales(spark, folder)).drop("seller", "source_url")


def _export(spark, folder, columns=COMMAND_EXPORT_COLUMNS, limit=COMMAND_EXPORT_LIMIT):
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    table = sales(spark, folder)
    page = query.query_sales(table, min_price=1_200_000, limit=limit)
    exported = query.export_rows(page, columns)
    write_csv(exported, path, columns)
    fields = ", ".join(
        f"{f.name} {'STRING' if f.name == 'sale_date' else f.dataType.simpleString()}"
        for f in exported.schema.fields
    )
    return spark.read.schema(fields).csv(path, header=True, escape='"')


def _export_dashboard(spark, folder):
    return _export(spark, folder, DASHBOARD_EXPORT_COLUMNS, DASHBOARD_EXPORT_LIMIT)


def _log(spark, folder):
    return X.run_log(spark, folder)


def _last_run(spark, folder):
    return runs.last_run(run_table(_log(spark, folder))).select("run_id", "new_sales", "updated_sales")


def _latest_status(spark, folder):
    return runs.latest_source_status(_log(spark, folder)).select(
        "id", "run_id", "source", "status", "fetched", "kept", "message"
    )


def _listing(spark, folder):
    configured = (
        SourceSpec("s3", 90), SourceSpec("s1", 60), SourceSpec("s0", 40, enabled=False),
        SourceSpec("never_ran", 10),
    )
    return runs.source_listing(configured, _log(spark, folder))


def _health(spark, folder):
    log = _log(spark, folder)
    summary = runs.health_summary(sales(spark, folder), run_table(log), log)
    listed = F.transform("sources", lambda s: F.concat(s["source"], F.lit("="), s["status"]))
    return summary.select(
        "tracked_sales", F.col("last_run.run_id").alias("last_run_id"),
        F.array_join(listed, ",").alias("sources"), "ok",
    )


def _json_path(spark, folder):
    rows = X.table(spark, folder, "events").select(
        "event_id",
        F.try_parse_json(
            F.concat(
                F.lit('{"p":'), F.col("props"), F.lit(',"list":[{"u":'),
                F.col("user_id").cast("string"), F.lit("}]}"),
            )
        ).alias("payload"),
    )
    return rows.select(
        "event_id",
        paths.json_path(F.col("payload"), "p.k", "bigint").alias("k"),
        paths.json_path(F.col("payload"), "p.k.deeper", "string").alias("missing"),
        paths.json_path(F.col("payload"), "list.0.u", "bigint").alias("nested"),
    )


def _raw_payload(spark, folder):
    rows = X.table(spark, folder, "events").select(
        "event_id", F.to_json(F.try_parse_json("props")).alias("raw")
    )
    return rows.select("event_id", F.try_variant_get(F.try_parse_json("raw"), "$.k", "bigint").alias("k"))


def _column_name(spark, folder):
    name = F.concat("p_name", F.lit("--"), "p_type")
    return X.table(spark, folder, "part").select(
        "p_partkey", paths.normalize_column_name(name).alias("normalized")
    )


def _scan_features(spark, folder):
    features, _ = scan_feature_json(feature_pages(spark, folder))
    placed = features.withColumn("record_ord", page_record_ord(F.col("page_no"), F.col("pos")))
    return placed.select(
        _place_of().alias("record_ord"),
        as_text(F.try_variant_get("record", "$.SITE_LINE", "variant")).alias("address"),
        as_text(F.try_variant_get("record", "$.PRICE_TEXT", "variant")).alias("price_text"),
        "latitude",
    )


def _map_fields(spark, folder):
    features, _ = scan_feature_json(feature_pages(spark, folder))
    mapped = feature_reports(features, "CONSIDERATION", "RECORDED", _FEATURE_MAP, "https://gis.example.org/0")
    ordered = reports_union([mapped], [SourceSpec("landed", 90, county="Delaware")])
    parsed = parse_reports(ordered)
    return parsed.withColumn("record_ord", F.col("seq")).select(
        _place_of().alias("record_ord"), "address", "price", "sale_date", "municipality", "county", "zip_code"
    )


def _scan_records(spark, folder):
    records, _ = scan_json_records(vendor_pages(spark, folder), "property")
    return record_reports(records, _VENDOR_MAP, "https://api.example.com").select(
        _place_of().alias("record_ord"), "address", "price_num", "sale_date_text", "municipality",
        "zip_code", "sqft",
    )


# Records of a landed document, so that a larger table gives more documents, and those a task can sort.
_DOCUMENT_ROWS = 500_000


def _documents(rows: DataFrame, head: str, glue: str, tail: str) -> DataFrame:
    """(record_ord, text) to lines of documents, one for each range of the order, four at least."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head
        for batch in batches:
            lines = []
            for text in batch.column(1).to_pylist():
                lines.append(before + text)
                before = glue
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        end = tail if before != head else head + tail
        yield pa.RecordBatch.from_arrays([pa.array([end])], names=["value"])

    number = max(4, -(-rows.count() // _DOCUMENT_ROWS))
    parts = rows.repartitionByRange(number, "record_ord").sortWithinPartitions("record_ord")
    return parts.select("record_ord", "text").mapInArrow(wrap, "value string")


def _landed(spark: SparkSession, name: str, documents: DataFrame) -> tuple[str, Column]:
    """Write documents as files; their folder, and the page number out of a file's name."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    documents.write.text(path)
    return f"{path}/part-*", F.regexp_extract("file", r"part-(\d+)", 1)


def _placed(rows: DataFrame, share: int = 1 << 16) -> DataFrame:
    """`place`: the number of each record in its source, from 1.

    Records are numbered within shares of the order, at most `share` to a share; the counts of the
    shares before are added. So no task holds a source.
    """
    shared = stage(rows, "placed").withColumn("share", F.floor(F.col("record_ord") / share))
    counts = shared.groupBy("source", "share").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("source").orderBy("share").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("source", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("source", "share").orderBy("record_ord"))
    return (
        shared.withColumn("own", own)
        .join(before, ["source", "share"])
        .withColumn("place", (F.col("before") + F.col("own")).cast("int"))
        .drop("share", "own", "before")
    )


def _scan_json_files(spark, folder):
    records = _numbered(spark, folder).select("record_ord", F.to_json(F.struct(
        F.struct(F.col("address").alias("line1"), F.col("municipality").alias("town"), F.col("zip_code").alias("code")).alias("address"),
        F.struct(F.struct(F.col("amount").alias("total")).alias("amount"), F.col("sale_date_text").alias("day")).alias("sale"),
        F.array(F.struct((F.col("record_ord") % 5000).alias("size"))).alias("building"),
    )).alias("text"))
    head = '{"page":{"property":[]},"result":{"property":['
    path, page_no = _landed(spark, "json", _documents(records, head, ",", '],"n":1}}'))
    rows, _ = scan_json_files(spark, path, "result.property", "vendor", page_no)
    return _placed(record_reports(rows, _VENDOR_MAP, "https://api.example.com")).select(
        "place", "address", "price_num", "sale_date_text", "municipality", "zip_code", "sqft"
    )


def _scan_feed_files(spark, folder):
    """The same headlines as RSS and as Atom."""

    def escaped(name: str):
        text = F.replace(F.col(name), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    rows = headlines(spark, folder)
    item = F.concat(
        F.lit("<item><title>"), escaped("title"), F.lit("</title><description>"), escaped("summary"),
        F.lit("</description><link>"), F.col("link"), F.lit("</link><pubDate>"), F.col("published"),
        F.lit("</pubDate></item>"),
    )
    entry = F.concat(
        F.lit("<entry><title>"), escaped("title"), F.lit("</title><content>"), escaped("summary"),
        F.lit('</content><link href="'), F.col("link"), F.lit('"/><link href="other"/><published>'),
        F.col("published"), F.lit("</published></entry>"),
    )
    found = None
    for kind, text, head, tail in (
        ("rss", item, '<?xml version="1.0"?><rss version="2.0"><channel><title>Local</title>', "</channel></rss>"),
        ("atom", entry, '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"),
    ):
        path, page_no = _landed(spark, kind, _documents(rows.select("record_ord", text.alias("text")), head, "", tail))
        entries, _ = scan_feed_files(spark, path, kind, page_no)
        found = entries if found is None else found.unionByName(entries)
    return _placed(found).select(
        F.col("source").alias("kind"), "place", "title", "summary", "link",
        prose.parse_feed_date(F.col("published")).alias("published_on"),
    )


def _scan_html(spark, folder):
    pages = spread(X.table(spark, folder, "pages"), "page_id").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("page_no"), F.col("html").alias("body"), "url"
    )
    rows, _ = scan_html_rows(pages, "nav li", {"address": "a", "source_url": "a"})
    return rows.select(F.col("page_no").alias("page_id"), F.col("cells")["source_url"].alias("link"))


def _html_reports(spark, folder):
    rows, _ = scan_html_rows(transfer_pages(spark, folder), "table.transfers tbody > tr", _CELL_MAP)
    ordered = reports_union([html_reports(rows)], [SourceSpec("landed", 40)])
    usable = parse_reports(ordered).filter("unusable IS NULL").withColumn("record_ord", F.col("seq"))
    return usable.select(
        _place_of().alias("record_ord"), "address", "price", "sale_date", "municipality"
    )


def _strip_html(spark, folder):
    return headlines(spark, folder).select("record_ord", prose.strip_html(F.col("summary")).alias("plain"))


def _gazetteer(spark, folder):
    places_ = known_places(spark, (), X.PLACES)
    return gazetteer_match(_texts(spark, folder), places_).select("record_ord", "place")


def _gazetteer_many(spark, folder):
    """Fifty thousand names, and texts that end with one of seventy thousand."""
    named = _texts(spark, folder).withColumn(
        "text", F.concat("text", F.lit(" Quarter "), (F.col("record_ord") % 70_000).cast("string"))
    )
    places_ = known_places(spark, (), [*X.PLACES, *(f"Quarter {k}" for k in range(50_000))])
    return gazetteer_match(named, places_).select("record_ord", "place")


def _scan_feed(spark, folder):
    entries, _ = scan_feed_xml(feed_pages(spark, folder))
    return entries.select(
        _place_of().alias("record_ord"), "title", "summary", "link",
        prose.parse_feed_date(F.col("published")).alias("published_on"),
    )


def _text_reports(spark, folder):
    entries = headlines(spark, folder).withColumn("summary", prose.strip_html(F.col("summary")))
    found = extract_reports_from_text(entries, "news", known_places(spark, (), X.PLACES), "Delaware")
    return found.select(
        "record_ord", "address", F.col("price_num").cast("bigint").alias("price"),
        F.col("sale_date_text").cast("date").alias("sale_date"), "municipality", "county", "source_url",
    )


def _layer(spark, folder):
    return X.view(spark, folder, X.LAYER_COLUMNS)


def _encoding(spark, folder):
    table = _layer(spark, folder)
    return layer_columns.date_encoding(table, layer_columns.match_columns(table))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reports to merged events to the newest qualified sales, labelled."""
    merged = resolve_events(kept(spark, folder), X.SPECS)
    return query.query_sales(merged).select(
        "event_id", "sale_date", "price", "address", "unit", "municipality", "county", "area", "source"
    )


def queries() -> dict[str, Query]:
    plain: dict[str, Query] = {
        "split_unit": _split_unit,
        "normalize_address": scalar("normalized", addresses.normalize_address, "address"),
        "normalize_municipality": scalar("normalized", places.normalize_municipality, "municipality"),
        "normalize_county": scalar("normalized", places.normalize_county, "county"),
        "normalize_zip": scalar("zip5", places.normalize_zip, "zip_code"),
        "parse_price": scalar("price", amounts.parse_price, "price_text"),
        "parse_date": scalar("sale_date", amounts.parse_date, "sale_date_text"),
        "title_case_address": scalar("titled", addresses.title_case_address, "address"),
        "property_key": scalar(
            "property_key", addresses.property_key, "address", "zip_code", "municipality"
        ),
        "display_address": _display,
        "build_report": _build,
        "quarantine": _quarantine,
        "reports_union": _union,
        "rank_lookup": lambda s, d: rank_lookup(reports(s, d), X.SPECS).select("seq", "source", "rank"),
        "match_area": lambda s, d: match_area(reports(s, d), X.AREAS).select("seq", "area"),
        "qualify": _qualified(X.LONG_LOOKBACK_DAYS),
        "qualify_recent": _qualified(LOOKBACK_DAYS),
        "reject_counts": lambda s, d: reject_counts(labelled(s, d, lookback=LOOKBACK_DAYS)),
        "source_counts": lambda s, d: source_counts(labelled(s, d, lookback=LOOKBACK_DAYS)),
        "dry_run_preview": _dry_run,
        "source_pushdown": _pushdown,
        "resolve_events": _resolve(),
        "sessionize_events": _sessions,
        "area_month_stats": _area_months,
        "second_run_outranks": _second_run,
        "scan_json_files": _scan_json_files,
        "scan_feed_files": _scan_feed_files,
        "resolve_events_reversed": _resolve(X.REVERSED_SPECS, 45),
        "merge_records": _merge_records,
        "run_totals": _run_totals,
        "incremental_resolve": _incremental,
        "write_read_sales": _write_read,
        "nearest_event": _nearest,
        "query_sales": _query_sales,
        "newest_first": lambda s, d: query.newest_first(sales(s, d), 500, 250).select(
            "event_id", "sale_date", "price"
        ),
        "newest_first_long_page": lambda s, d: query.newest_first(sales(s, d), 1_000_000, 100).select(
            "event_id", "sale_date", "price"
        ),
        "search_sales": lambda s, d: query.search_sales(sales(s, d), "buyer1").select(
            "event_id", "address", "municipality", "buyer"
        ),
        "count_sales": lambda s, d: query.count_sales(sales(s, d), 2_000_000, date(1999, 6, 1)),
        "distinct_values": _distinct,
        "market_stats": _market,
        "presentation": _presentation,
        "export_csv": _export,
        "export_csv_dashboard": _export_dashboard,
        "latest_source_status": _latest_status,
        "last_run": _last_run,
        "run_ok": lambda s, d: runs.run_ok(_log(s, d)),
        "source_listing": _listing,
        "health_summary": _health,
        "source_runs": _source_runs,
        "source_health_input": _source_health,
        "runs": _runs,
        "json_path": _json_path,
        "raw_payload": _raw_payload,
        "normalize_column_name": _column_name,
        "scan_feature_json": _scan_features,
        "map_fields": _map_fields,
        "scan_json_records": _scan_records,
        "scan_html_rows": _scan_html,
        "extract_reports_from_html": _html_reports,
        "strip_html": _strip_html,
        "extract_price": lambda s, d: _texts(s, d).select(
            "record_ord", prose.extract_price(F.col("text")).alias("price")
        ),
        "extract_address": lambda s, d: _texts(s, d).select(
            "record_ord", prose.extract_address(F.col("text")).alias("address")
        ),
        "parse_feed_date": lambda s, d: headlines(s, d).select(
            "record_ord", prose.parse_feed_date(F.col("published")).alias("published_on")
        ),
        "gazetteer_match": _gazetteer,
        "gazetteer_many_names": _gazetteer_many,
        "scan_feed_xml": _scan_feed,
        "extract_reports_from_text": _text_reports,
        "match_columns": lambda s, d: layer_columns.match_columns(_layer(s, d)),
        "date_encoding": _encoding,
    }
    return {name: _configured(run) for name, run in plain.items()}


def _configured(run: Query) -> Query:
    return lambda spark, folder: run(configure(spark), folder)
