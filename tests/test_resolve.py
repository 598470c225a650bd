"""Resolution against a record-by-record simulation of the rule."""

import json
import random
from datetime import date, timedelta

import pytest
from conftest import SPECS
from pyspark.sql import functions as F

from salesmerge.operators import resolve
from salesmerge.operators.nearest import nearest_event
from salesmerge.operators.resolve import (
    assign_events,
    event_versions,
    merge_events,
    rank_lookup,
    resolve_events,
    run_totals,
)
from salesmerge.schema import REPORT_SCHEMA, SourceSpec

RANKED = [SourceSpec(f"s{r}", r) for r in range(5)]
START = date(2000, 1, 1)
BLANK = (None, "", 0)


def simulate(history, window):
    """Apply the rule one report at a time; returns (events, event of each report)."""
    events, outcome = [], {}
    for seq, day, rank, record in history:
        near = [e for e in events if abs(e["day"] - day) <= window]
        if not near:
            events.append({"seq": seq, "day": day, "rank": rank, "record": dict(record)})
            outcome[seq] = seq
            continue
        event = min(near, key=lambda e: (abs(e["day"] - day), e["day"], e["seq"]))
        outcome[seq] = event["seq"]
        first, second = event["record"], record
        if rank > event["rank"]:
            event["day"], event["rank"] = day, rank
            first, second = second, first
        merged = dict(first)
        for name in ("beds", "buyer"):
            if merged[name] in BLANK and second[name] not in BLANK:
                merged[name] = second[name]
        merged["raw"] = {**second["raw"], **first["raw"]}
        event["record"] = merged
    return events, outcome


def random_history(rng, n, span, start_seq):
    history, seq = [], start_seq
    for _ in range(n):
        seq += rng.randint(1, 3)
        rank = rng.randrange(5)
        raw = {k: rng.choice([None, 1, "a", seq]) for k in rng.sample("ABCD", rng.randint(0, 3))}
        record = {
            "beds": rng.choice([None, 0.0, 1.0, 2.0]), "buyer": rng.choice([None, "", f"x{seq}"]),
            "raw": raw, "source": f"s{rank}", "price": seq,
        }
        history.append((seq, rng.randint(0, span), rank, record))
    return history


def to_frame(spark, histories):
    rows = [
        (seq, key, START + timedelta(days=day), r["source"], r["price"], r["beds"], r["buyer"],
         json.dumps(r["raw"]))
        for key, history in histories.items()
        for seq, day, _, r in history
    ]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(
        rows, "seq BIGINT, property_key STRING, sale_date DATE, source STRING, price BIGINT, "
        "beds DOUBLE, buyer STRING, raw STRING",
    )
    return frame.select(
        *[
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in REPORT_SCHEMA.fields
        ]
    )


def expected(histories, window):
    found = {}
    for key, history in histories.items():
        for e in simulate(history, window)[0]:
            r = e["record"]
            found[key, e["seq"]] = (
                START + timedelta(days=e["day"]), r["source"], r["price"], r["beds"], r["buyer"],
                json.dumps(r["raw"], sort_keys=True))
    return found


def resolved(rows):
    return {
        (r.property_key, r.event_seq): (
            r.sale_date, r.source, r.price, r.beds, r.buyer,
            json.dumps(json.loads(r.raw), sort_keys=True))
        for r in rows.collect()
    }


def histories(seed, keys):
    rng = random.Random(seed)
    made, seq = {}, 0
    for k in range(keys):
        made[f"k{k}"] = random_history(
            rng, rng.choice([1, 2, 3, 5, 8, 14, 40]), rng.choice([10, 40, 90]), seq)
        seq = made[f"k{k}"][-1][0]
    return made


@pytest.mark.parametrize("window", [0, 3, 14])
def test_matches_record_by_record_rule(spark, window):
    made = histories(window, 120)
    assert resolved(resolve_events(to_frame(spark, made), RANKED, window)) == expected(made, window)


@pytest.mark.parametrize("window", [0, 14])
def test_long_islands_follow_the_same_rule(spark, monkeypatch, window):
    monkeypatch.setattr(resolve, "LONG_ISLAND", 1)  # all but single candidates
    made = histories(30 + window, 80)
    assert resolved(resolve_events(to_frame(spark, made), RANKED, window)) == expected(made, window)


def test_reports_meet_events_by_equal_keys_only(spark):
    """No range condition is left in a join, and the wide rows are dealt once."""
    rows = to_frame(spark, histories(3, 10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_events(assign_events(rank_lookup(rows, RANKED)))
        plan = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line.split("SortMergeJoin", 1)[1] for line in plan if "SortMergeJoin" in line]
    assert len(joins) == 1 and "bin" in joins[0]
    assert "<=" not in joins[0] and ">=" not in joins[0]
    dealt = [line for line in plan if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and all("hashpartitioning(property_key" in line and "bin" not in line.split("REPARTITION")[0] for line in dealt)


def test_a_century_of_dates_takes_bounded_index_rows(spark):
    """One property, one island of a hundred years: a report reads its bin, not the history."""
    rows = spark.range(40_000).select(
        F.col("id").alias("seq"), F.lit("k").alias("property_key"), F.lit(1).alias("late"),
        F.pmod(F.xxhash64("id"), F.lit(36_500)).cast("int").alias("day"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int").alias("rank"),
        F.lit(None).cast("bigint").alias("stored_seq"),
    )
    index = resolve.interval_index(event_versions(rows, 14), ["property_key"])
    sizes = index.agg(F.count("*").alias("bins"), F.max(F.size("versions")).alias("most")).first()
    assert sizes.bins == -(-36_500 // resolve.bin_days(14)) and sizes.most <= 3 * resolve.bin_days(14) * 3


def test_many_raw_key_sets_of_one_event(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("k").alias("property_key"), F.lit(START).alias("sale_date"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.col("id").alias("price"),
        F.format_string('{"k%d": %d, "same": %d, "q\\"%d": null}', F.col("id"), F.col("id"), F.col("id"), F.col("id") % 2).alias("raw"),
    )
    rows = rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA.fields]
    )
    (sale,) = resolve_events(rows, RANKED).collect()
    raw = json.loads(sale.raw)
    # The last report that outranked the event leads it.
    assert (sale.price, sale.source, raw["same"]) == (4, "s4", 4)
    assert len(raw) == n + 3 and raw["k17"] == 17 and raw['q"0'] is None


def test_large_property_is_split_and_exact(spark):
    """One property holds most rows; its rows go over several tasks."""
    made = histories(7, 20)
    made["hot"] = random_history(random.Random(8), 3000, 200, 10_000)
    rows = to_frame(spark, made)
    ranked = rank_lookup(rows, RANKED)
    assigned = assign_events(ranked, 14, hot_key_rows=200)
    cold, hot = assigned.lanes
    assert hot.select("salt").distinct().count() > 1 and cold.filter("property_key = 'hot'").isEmpty()
    assert resolved(merge_events(assigned)) == expected(made, 14)


def test_replay_state_is_bounded_by_dates_and_ranks(spark):
    """Twenty thousand reports of one property reach the replay as a few candidates."""
    rows = spark.range(20_000).select(
        F.lit("k").alias("property_key"), (F.col("id") % 30).cast("int").alias("day"),
        (F.col("id") % 5).cast("int").alias("rank"), F.col("id").alias("seq"),
        F.lit(1).alias("late"), F.lit(None).cast("bigint").alias("stored_seq"))
    versions = event_versions(rows, 14)
    sizes = versions.agg(F.sum(F.size("cells")).alias("cells"), F.sum("n").alias("n")).first()
    assert sizes.cells <= 30 * 5 * 2 and sizes.n == 20_000


def test_repeat_after_the_event_moved_away(spark):
    """The second report of a (date, rank) matters once its event has drifted off."""
    record = {"beds": None, "buyer": None, "raw": {}, "price": 1}
    made = {"k": [
        (seq, day, rank, {**record, "source": f"s{rank}"})
        for seq, day, rank in [(1, 0, 0), (2, 14, 1), (3, 28, 2), (4, 0, 0), (5, 0, 0), (6, 14, 1), (7, 0, 0)]
    ]}
    assert resolved(resolve_events(to_frame(spark, made), RANKED, 14)) == expected(made, 14)


def test_incremental_equals_replay(spark):
    made = histories(21, 80)
    cut = 900
    first = {k: [h for h in v if h[0] <= cut] for k, v in made.items()}
    later = {k: [h for h in v if h[0] > cut] for k, v in made.items()}
    stored = resolve_events(to_frame(spark, first), RANKED, 14)
    both = resolve_events(to_frame(spark, later), RANKED, 14, stored=stored)
    assert resolved(both) == expected(made, 14)


def test_authoritative_source_wins_and_gaps_fill(make_reports):
    rows = make_reports(
        {"source": "news", "price": "1499000", "beds": "5", "sqft": "4,200", "sale_date": "2026-03-09",
         "address": "123 North Wayne Avenue", "buyer": "Somebody Else"},
        {"source": "county", "buyer": "Smith"},
    )
    (sale,) = resolve_events(rows, SPECS).collect()
    assert (sale.price, sale.buyer, sale.beds, sale.sqft, sale.source) == (1_500_000, "Smith", 5, 4200, "county")
    assert sale.sale_date == date(2026, 3, 1)


def test_separate_events(make_reports):
    rows = make_reports(
        {}, {"sale_date": "2026-03-15"}, {"sale_date": "2026-03-16"}, {"sale_date": "2026-09-01"},
        {"address": "500 Lancaster Ave Apt 1"}, {"address": "500 Lancaster Ave Apt 2"},
    )
    assert resolve_events(rows, SPECS).count() == 5
    totals = run_totals(assign_events(rank_lookup(rows, SPECS))).first()
    assert (totals.new_sales, totals.updated_sales) == (5, 1)


def test_nearest_event(spark):
    events = spark.createDataFrame(
        [("k", date(2026, 3, 1), 5), ("k", date(2026, 3, 1), 3), ("k", date(2026, 3, 21), 4)],
        "property_key STRING, sale_date DATE, event_seq BIGINT")
    reports = spark.createDataFrame(
        [(0, "k", date(2026, 3, 11)), (1, "k", date(2026, 3, 12)), (2, "k", date(2026, 4, 9)),
         (3, "x", date(2026, 3, 1)), (4, "k", date(2026, 2, 15))],
        "seq BIGINT, property_key STRING, sale_date DATE")
    got = {r.seq: (r.event_seq, r.distance) for r in nearest_event(reports, events).collect()}
    assert got == {0: (3, 10), 1: (4, 9), 2: (None, None), 3: (None, None), 4: (3, 14)}


def test_sessions_differ_where_a_chain_spans_more_than_the_window(spark, make_reports):
    from salesmerge.operators.sessions import sessionize_events

    days = ("2026-03-01", "2026-03-15", "2026-03-29")
    rows = make_reports(
        *({"sale_date": d, "source": "news", "beds": b} for d, b in zip(days, (None, "4", "5"), strict=True)),
        {"sale_date": "2026-04-13", "source": "county"}, {"sale_date": "2026-04-27", "buyer": "Late"},
    )
    sessions = sessionize_events(rows, SPECS).orderBy("first_date").collect()
    assert [(r.first_date.isoformat(), r.last_date.isoformat(), r.reports) for r in sessions] == [
        ("2026-03-01", "2026-03-29", 3), ("2026-04-13", "2026-04-27", 2)]
    assert [(r.sale_date.isoformat(), r.source, r.beds, r.buyer) for r in sessions] == [
        ("2026-03-01", "news", 4.0, None), ("2026-04-13", "county", None, "Late")]
    assert resolve_events(rows, SPECS).count() == 3  # one after the other, the third report opens an event
