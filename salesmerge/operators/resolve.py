"""Resolving reports into events: near-duplicate matching and rank-based merging.

The rule is sequential. Reports arrive in `seq` order. Each joins the nearest event
of its property at most `window_days` away, or opens a new event. When the report's
source ranks above the event's, the event takes over the report's date and source,
so events move and the outcome depends on the order.

Three facts let that rule run as ordinary grouped work, whatever the size of a group:

* Only a report that opens an event or outranks one changes the (date, rank) state
  that later matches depend on. Two events of a property never share a date, and an
  event's rank only rises, so a property has at most `dates x ranks` such changes,
  however many reports it has. That state is replayed per property over one candidate
  per (date, rank): the first report of each, found by a map-side combined aggregate.
* A later report of the same date and rank matters only if the event that covered it
  moved away in between. The replay shows where that could be; just those reports are
  looked up and replayed as well, until none is left. Every round settles at least the
  earliest open change, and most data needs no second round.
* With the matches known, the merged record needs no order beyond one sort key:
  per field the latest outranking report with a value decides, else the earliest
  report with one. That is a maximum, so it combines map-side too.

Dates more than a window apart never interact, so the replay works on date islands. Its result
is an interval index: every property's event versions filed under the date bins that they can
reach, so that a report finds them by an equal (property, bin), however long a history is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import DEDUPE_WINDOW_DAYS
from ..functions.text import let
from ..schema import (
    REPORT_SCHEMA,
    SALE_SCHEMA,
    SourceSpec,
    local_frame,
    small_side,
    sources_frame,
)
from ..session import stage

_OPEN_END = 2**63 - 1
_STATES = "array<struct<event_seq:bigint,day:int,rank:int,from_seq:bigint>>"
_VERSIONS = "array<struct<event_seq:bigint,day:int,rank:int,from_seq:bigint,to_seq:bigint>>"
# An island with more cells than this is replayed with a look-up by date instead of a scan.
LONG_ISLAND = 64
# One (date, rank) of a property may hold most reports; its repeats are searched in splits.
_REPEAT_SPLITS = 32
_CELL = ("late", "seq", "day", "rank", "last_seq", "n")
# A property below this many reports is never worth splitting over several tasks.
HOT_KEY_ROWS = 1_000_000

_NOT_MERGED = ("seq", "property_key", "source", "raw", "first_seen", "last_seen")
_FIELDS = [f for f in REPORT_SCHEMA.fields if f.name not in _NOT_MERGED]


def rank_lookup(reports: DataFrame, specs: Sequence[SourceSpec]) -> DataFrame:
    """Add the rank of each report's source; an unknown source ranks 0."""
    ranks = sources_frame(reports.sparkSession, specs).select("source", F.col("rank").alias("_rank"))
    joined = reports.join(small_side(ranks, len(specs)), "source", "left")
    return joined.withColumn("rank", F.coalesce(F.col("_rank"), F.lit(0))).drop("_rank")


# --- replay of the (date, rank) state ----------------------------------------------


def _near(versions: Column, day: Column, window: int, alive, more: Sequence[str] = ()) -> Column:
    """The nearest live event version: struct(dist, day, event_seq, rank, from_seq, `more`)."""
    hits = F.filter(versions, lambda v: alive(v) & (F.abs(v["day"] - day) <= window))
    return F.array_min(
        F.transform(
            hits,
            lambda v: F.struct(
                F.abs(v["day"] - day).alias("dist"),
                v["day"].alias("day"),
                v["event_seq"].alias("event_seq"),
                v["rank"].alias("rank"),
                v["from_seq"].alias("from_seq"),
                *[v[name].alias(name) for name in more],
            ),
        )
    )


def _at(seq: Column):
    return lambda v: (v["from_seq"] <= seq) & (seq < v["to_seq"])


def _replay(candidates: Column, window: int) -> Column:
    """Run the rule over an island's candidates; every state an event went through."""

    def state(event_seq: Column, c: Column) -> Column:
        return F.struct(
            event_seq.alias("event_seq"), c["day"].alias("day"), c["rank"].alias("rank"),
            c["seq"].alias("from_seq"),
        )

    def version(v: Column, to_seq: Column) -> Column:
        return F.struct(
            v["event_seq"].alias("event_seq"), v["day"].alias("day"), v["rank"].alias("rank"),
            v["from_seq"].alias("from_seq"), to_seq.alias("to_seq"),
        )

    def step(done: Column, c: Column) -> Column:
        nearest = _near(done["live"], c["day"], window, lambda v: F.lit(True))

        def apply(best: Column) -> Column:
            is_best = lambda v: v["event_seq"] == best["event_seq"]
            opened = F.struct(
                F.concat(done["live"], F.array(state(c["seq"], c))).alias("live"),
                done["past"].alias("past"),
            )
            moved = F.struct(
                F.transform(
                    done["live"], lambda v: F.when(is_best(v), state(v["event_seq"], c)).otherwise(v)
                ).alias("live"),
                F.concat(
                    done["past"],
                    F.transform(F.filter(done["live"], is_best), lambda v: version(v, c["seq"])),
                ).alias("past"),
            )
            return (
                F.when((c["late"] == 0) | best.isNull(), opened)
                .when(best["rank"] < c["rank"], moved)
                .otherwise(done)
            )

        return let(nearest, apply)

    def finish(done: Column) -> Column:
        open_end = F.lit(_OPEN_END)
        return F.concat(done["past"], F.transform(done["live"], lambda v: version(v, open_end)))

    first = candidates[0]
    start = F.struct(F.array().cast(_STATES).alias("live"), F.array().cast(_VERSIONS).alias("past"))
    single = F.array(version(state(first["seq"], first), F.lit(_OPEN_END)))
    return F.when(F.size(candidates) == 1, single).otherwise(
        F.aggregate(candidates, start, step, finish)
    )


def _open_windows(cells: Column, versions: Column, window: int) -> Column:
    """Per repeated (date, rank): the spans in which a repeat could change the state."""

    def spans(c: Column) -> Column:
        # A change farther away than two windows cannot alter what covers this date.
        changes = F.filter(
            versions,
            lambda v: (v["from_seq"] > c["seq"]) & (F.abs(v["day"] - c["day"]) <= 2 * window),
        )

        def uncovered(v: Column) -> Column:
            best = _near(versions, c["day"], window, _at(v["from_seq"]))
            lower = F.coalesce(best["rank"] < c["rank"], F.lit(True))
            return (v["from_seq"] < c["last_seq"]) & lower

        def span(v: Column) -> Column:
            later = F.filter(changes, lambda u: u["from_seq"] > v["from_seq"])
            ends = F.array_min(F.transform(later, lambda u: u["from_seq"]))
            return F.struct(
                c["day"].alias("day"),
                c["rank"].alias("rank"),
                v["from_seq"].alias("after_seq"),
                F.coalesce(ends, F.lit(_OPEN_END)).alias("before_seq"),
            )

        return F.transform(F.filter(changes, uncovered), span)

    repeated = F.filter(cells, lambda c: (c["late"] == 1) & (c["last_seq"] > c["seq"]))
    return F.when(F.size(versions) > 1, F.flatten(F.transform(repeated, spans)))


def _islands(narrow: DataFrame, window: int) -> DataFrame:
    """One row per property and date island: bounds, report count, ordered candidates."""
    cells = narrow.groupBy("property_key", "day", "rank", "late", "stored_seq").agg(
        F.min("seq").alias("seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n")
    )
    by_day = W.partitionBy("property_key").orderBy("day")
    starts = F.coalesce((F.col("day") - F.lag("day").over(by_day) > window).cast("int"), F.lit(1))
    numbered = cells.withColumn("starts", starts).withColumn(
        "island", F.sum("starts").over(by_day.rowsBetween(W.unboundedPreceding, 0))
    )
    return numbered.groupBy("property_key", "island").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.sum("n").alias("island_n"),
        # Bounded by distinct dates x ranks, not by reports.
        F.sort_array(F.collect_list(F.struct(*_CELL))).alias("cells"),
    )


def bin_days(window: int) -> int:
    """Days of a date bin: a version reaches two bins, rarely three."""
    return 4 * window + 2


def _slices(window: int) -> Column:
    """An island cut by date bin: the bin's cells, and the versions in reach of it."""
    width, reach = bin_days(window), 2 * window

    def cut(number: Column) -> Column:
        start = number * width
        end = start + (width - 1)
        return F.struct(
            number.alias("bin"),
            F.filter("cells", lambda c: c["day"].between(start, end)).alias("cells"),
            F.filter("versions", lambda v: v["day"].between(start - reach, end + reach)).alias("versions"),
        )

    first, last = (F.floor(F.col(c) / width) for c in ("first_day", "last_day"))
    one = F.array(F.struct(first.alias("bin"), F.col("cells"), F.col("versions")))
    several = F.filter(F.transform(F.sequence(first, last), cut), lambda s: F.size(s["cells"]) > 0)
    return F.when(first == last, one).otherwise(several)


_CELLS = "array<struct<late:int,seq:bigint,day:int,rank:int,last_seq:bigint,n:bigint>>"
_SLICE_SCHEMA = (
    f"property_key string, island bigint, island_n bigint, bin bigint, cells {_CELLS}, versions {_VERSIONS}"
)


def _long_replay(cells: list[dict], window: int) -> list[dict]:
    """The rule over one island's cells in order, with the live events found by date."""
    live: dict[int, list[dict]] = defaultdict(list)
    past = []
    # Nearest first; of equally near dates the earlier, of one date the older event.
    steps = [0] + [sign * k for k in range(1, window + 1) for sign in (-1, 1)]
    for c in cells:
        there = next((c["day"] + k for k in steps if live.get(c["day"] + k)), None) if c["late"] else None
        if there is None:
            opened = {"event_seq": c["seq"], "day": c["day"], "rank": c["rank"], "from_seq": c["seq"]}
            live[c["day"]].append(opened)
            continue
        best = min(live[there], key=lambda v: v["event_seq"])
        if best["rank"] < c["rank"]:
            live[there].remove(best)
            past.append({**best, "to_seq": c["seq"]})
            live[c["day"]].append({**best, "day": c["day"], "rank": c["rank"], "from_seq": c["seq"]})
    return past + [{**v, "to_seq": _OPEN_END} for held in live.values() for v in held]


def _long_slices(islands: DataFrame, window: int) -> DataFrame:
    """Replay and cut long islands; each takes time in proportion to its cells."""
    width, reach = bin_days(window), 2 * window

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("property_key", "island", "island_n")}
                cells = batch.column("cells")[k].as_py()
                own, near = defaultdict(list), defaultdict(list)
                for c in cells:
                    own[c["day"] // width].append(c)
                for v in _long_replay(cells, window):
                    for number in range((v["day"] - reach) // width, (v["day"] + reach) // width + 1):
                        near[number].append(v)
                out = [{**row, "bin": b, "cells": held, "versions": near[b]} for b, held in own.items()]
                yield from pa.Table.from_pylist(out, schema=batch.schema).to_batches()

    return islands.select(*_names(_SLICE_SCHEMA)).mapInArrow(replay, _SLICE_SCHEMA)


def _names(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema)]


def _with_windows(slices: DataFrame, window: int) -> DataFrame:
    return slices.withColumns(
        {
            "n": F.aggregate("cells", F.lit(0).cast("bigint"), lambda total, c: total + c["n"]),
            "open_windows": _open_windows(F.col("cells"), F.col("versions"), window),
        }
    )


def _replayed(islands: DataFrame, window: int) -> DataFrame:
    """(property_key, island, island_n, bin, cells, versions, n, open_windows) of all islands."""
    long = F.size("cells") > LONG_ISLAND
    # A long island is staged as it is, as one slice without a bin.
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("bin"), "cells", "versions"))
    versions = islands.withColumn(
        "versions", F.when(~long, _replay(F.col("cells"), window)).otherwise(F.array().cast(_VERSIONS))
    )
    sliced = versions.select(
        "property_key", "island", "island_n", F.inline(F.when(long, whole).otherwise(_slices(window)))
    )
    held = stage(_with_windows(sliced, window), "events")
    waiting = held.filter("bin IS NULL")
    if waiting.isEmpty():
        return held
    done = stage(_with_windows(_long_slices(waiting, window), window), "events")
    return held.filter("bin IS NOT NULL").unionByName(done)


def event_versions(narrow: DataFrame, window_days: int) -> DataFrame:
    """The full (date, rank) history of every event, by property, island and date bin."""
    slices = _replayed(_islands(narrow, window_days), window_days)
    settled = None
    island = ["property_key", "island"]
    while True:
        open_ = slices.filter(F.size("open_windows") > 0)
        if open_.isEmpty():
            break
        spans = open_.select(*island, F.inline("open_windows")).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(_REPEAT_SPLITS - 1)))
        )
        extra = stage(
            narrow.filter("late = 1")
            .withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(_REPEAT_SPLITS)).cast("int"))
            .join(spans, ["property_key", "day", "rank", "salt"])
            .filter("seq > after_seq AND seq < before_seq")
            .groupBy(*island, "day", "rank", "after_seq")
            .agg(F.min("seq").alias("seq")),
            "repeats",
        )
        if extra.isEmpty():
            break
        # Replay again just the islands that gained candidates; the others are final.
        gained = extra.withColumns(
            {"late": F.lit(1), "last_seq": F.col("seq"), "n": F.lit(0).cast("bigint")}
        ).groupBy(*island).agg(F.collect_list(F.struct(*_CELL)).alias("gained"))
        done = slices.join(gained, island, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        whole = slices.groupBy(*island).agg(
            F.first("island_n").alias("island_n"),
            F.flatten(F.collect_list("cells")).alias("cells"),
        )
        more = whole.join(gained, island).withColumn("cells", F.sort_array(F.concat("cells", "gained")))
        days = F.transform("cells", lambda c: c["day"])
        slices = _replayed(
            more.withColumns({"first_day": F.array_min(days), "last_day": F.array_max(days)}).drop("gained"),
            window_days,
        )
    return slices if settled is None else settled.unionByName(slices)


# --- matching reports to events -------------------------------------------------------


def _hot_keys(versions: DataFrame, floor: int) -> list[tuple[str, int]]:
    """Properties holding more than a partition's fair share, with their number of splits.

    At most `shuffle partitions` properties can exceed total / partitions, so the
    list is small whatever the data; their splits add up to twice that at most.
    """
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = versions.agg(F.sum("n")).first()[0] or 0
    share = max(floor, -(-total // parts))
    if total <= share:
        return []
    keys = versions.groupBy("property_key").agg(F.sum("n").alias("n")).filter(F.col("n") > share)
    return [(row["property_key"], -(-row["n"] // share)) for row in keys.collect()]


def interval_index(versions: DataFrame, on: list[str]) -> DataFrame:
    """One row per (`on`, bin): all versions that a report in that bin can meet.

    Islands of one bin are more than a window apart, so their versions can stand together.
    """
    held = F.transform("versions", lambda v: v.withField("island_n", F.col("island_n")))
    return (
        versions.select(*on, "bin", held.alias("versions"))
        .repartition(*on)
        .groupBy(*on, "bin")
        .agg(F.flatten(F.collect_list("versions")).alias("versions"))
    )


def _matched(reports: DataFrame, versions: DataFrame, on: list[str], window: int) -> DataFrame:
    """Reports with their events. Both sides are dealt by `on` alone, as merging needs them."""
    filed = reports.repartition(*on).withColumn("bin", F.floor(F.col("day") / bin_days(window)))
    joined = filed.join(interval_index(versions, on), [*on, "bin"])
    only = F.col("versions")[0]
    best = F.when(
        F.size("versions") == 1,
        F.struct(
            F.lit(0).alias("dist"), only["day"].alias("day"), only["event_seq"].alias("event_seq"),
            only["rank"].alias("rank"), only["from_seq"].alias("from_seq"),
            only["island_n"].alias("island_n"),
        ),
    ).otherwise(_near(F.col("versions"), F.col("day"), window, _at(F.col("seq")), ("island_n",)))
    is_stored = F.col("late") == 0
    return (
        joined.withColumn("best", best)
        .withColumns(
            {
                "event_seq": F.when(is_stored, F.col("seq")).otherwise(F.col("best.event_seq")),
                "leads": is_stored | (F.col("best.from_seq") == F.col("seq")),
                "island_n": F.col("best.island_n"),
            }
        )
        .withColumn("is_new", ~is_stored & (F.col("event_seq") == F.col("seq")))
        .drop("best", "versions", "bin", "stored_seq", "day")
    )


@dataclass(frozen=True)
class Matches:
    """Reports with their events, in lanes that are each partitioned for merging.

    The first lane is partitioned by property; the second, if any, holds the largest
    properties, partitioned by property and `salt`.
    """

    lanes: list[DataFrame]

    @property
    def reports(self) -> DataFrame:
        plain = [lane.drop("salt") for lane in self.lanes]
        return reduce(lambda a, b: a.unionByName(b), plain)


def assign_events(
    reports: DataFrame,
    window_days: int = DEDUPE_WINDOW_DAYS,
    stored: DataFrame | None = None,
    staged: bool = False,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> Matches:
    """Ranked reports with the event each one belongs to.

    Adds `event_seq` (the `seq` of the report that opened the event), `leads` (the
    report opened or outranked it) and `is_new` (it opened it). `stored` events, from
    earlier runs, stand before all reports and never merge with each other; they come
    back as rows with `late` = 0. Pass `staged=True` when `reports` already reads a
    written table, which is scanned more than once here.
    """
    rows = reports.withColumns({"late": F.lit(1), "stored_seq": F.lit(None).cast("bigint")})
    if stored is not None:
        before = stored.withColumns(
            {"seq": F.col("event_seq"), "stored_seq": F.col("event_seq"), "late": F.lit(0)}
        )
        rows = rows.unionByName(before.select(*rows.columns))
    rows = rows.withColumn("day", F.unix_date("sale_date"))
    if not staged:
        rows = stage(rows, "reports")

    narrow = rows.select("property_key", "day", "rank", "seq", "late", "stored_seq")
    versions = event_versions(narrow, window_days)

    hot = _hot_keys(versions, hot_key_rows)
    if not hot:
        return Matches([_matched(rows, versions, ["property_key"], window_days)])
    keys = F.broadcast(local_frame(rows.sparkSession, hot, "property_key STRING, splits BIGINT"))
    cold = rows.join(keys, "property_key", "left_anti")
    # Rows of a large property spread over its splits, each with a copy of the events.
    salted_rows = rows.join(keys, "property_key").withColumn(
        "salt", F.pmod(F.xxhash64("seq"), F.col("splits")).cast("int")
    )
    salted_versions = versions.join(keys, "property_key").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), (F.col("splits") - 1).cast("int")))
    )
    return Matches(
        [
            _matched(cold, versions, ["property_key"], window_days),
            _matched(
                salted_rows.drop("splits"),
                salted_versions.drop("splits"),
                ["property_key", "salt"],
                window_days,
            ),
        ]
    )


# --- merging --------------------------------------------------------------------------


def _has_value(value: Column, kind: str) -> Column:
    return value.isNotNull() if kind == "date" else value.isNotNull() & (value != ("" if kind == "string" else 0))


def merge_events(matches: Matches) -> DataFrame:
    """One merged row per event.

    Sort key of a report within its event: a leading report by its `seq`, any other
    behind all leading ones and the earlier the better. Per field the best report that
    has a value (not null, "" or 0) decides; per raw key the best report that has it.
    """
    return reduce(lambda a, b: a.unionByName(b), [_merged(lane) for lane in matches.lanes])


def _merged(assigned: DataFrame) -> DataFrame:
    """Merge one lane by maxima that combine before the shuffle.

    Every report of an event that may have several gives one row for its fields and one for each
    key of its raw object. Per (event, key) the best report decides; then the keys of an event meet.
    """
    kinds = {f.name: f.dataType.typeName() for f in _FIELDS}
    several = F.col("island_n") > 1
    order = F.when(F.col("leads"), F.col("seq") + 1).otherwise(-(F.col("seq") + 1))
    raw = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>")
    entries = F.transform(
        F.map_entries(F.when(several, raw)),
        lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
    )
    # The row of the fields has no key; an order below all others keeps the fields of key rows out.
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = assigned.withColumn("order", order).select(
        "property_key", "event_seq", "order", *kinds, "source", "raw", "first_seen", "last_seen",
        F.inline(F.concat(own, F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))),
    )
    is_own = F.col("key").isNull()
    best = {
        # A report with a value goes before one without; then the order decides.
        name: F.max_by(F.when(is_own, F.col(name)), F.when(is_own, F.struct(_has_value(F.col(name), kind), "order")))
        for name, kind in kinds.items()
    }
    per_key = rows.groupBy("property_key", "event_seq", "key").agg(
        *[c.alias(name) for name, c in best.items()],
        F.max_by(F.when(is_own, F.col("source")), F.when(is_own, F.col("order"))).alias("source"),
        F.max_by(F.when(is_own, F.col("raw")), F.when(is_own, F.col("order"))).alias("raw"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("reports"),
        F.max_by("value", "order").alias("value"),
    )
    held = [*kinds, "source", "raw", "first_seen", "last_seen", "reports"]
    per_event = per_key.groupBy("property_key", "event_seq").agg(
        F.first(F.when(is_own, F.struct(*held)), ignorenulls=True).alias("row"),
        # As many as the merged object has keys.
        F.sort_array(F.collect_list(F.when(~is_own, F.struct("key", "value")))).alias("entries"),
    )
    whole = F.to_json(
        F.map_from_entries(
            F.transform("entries", lambda e: F.struct(e["key"], F.parse_json(F.coalesce(e["value"], F.lit("null")))))
        ),
        {"ignoreNullFields": "false"},
    )
    event_id = F.sha1(F.concat_ws("|", "property_key", "event_seq").cast("binary"))
    return per_event.select(
        F.substring(event_id, 1, 20).alias("event_id"),
        "event_seq",
        "property_key",
        *[F.col("row")[name].alias(name) for name in [*kinds, "source"]],
        F.when(F.col("row.reports") > 1, whole).otherwise(F.col("row.raw")).alias("raw"),
        F.col("row.first_seen").alias("first_seen"),
        F.col("row.last_seen").alias("last_seen"),
    ).select(*SALE_SCHEMA.fieldNames())


def resolve_events(
    reports: DataFrame,
    specs: Sequence[SourceSpec],
    window_days: int = DEDUPE_WINDOW_DAYS,
    stored: DataFrame | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Qualified reports (and stored events) to merged events."""
    ranked = rank_lookup(reports, specs)
    before = rank_lookup(stored, specs) if stored is not None else None
    return merge_events(assign_events(ranked, window_days, before, hot_key_rows=hot_key_rows))


def run_totals(matches: Matches) -> DataFrame:
    """Reports that opened an event and reports that joined one, as one row."""
    return matches.reports.filter("late = 1").agg(
        F.count_if("is_new").alias("new_sales"), F.count_if(~F.col("is_new")).alias("updated_sales")
    )
