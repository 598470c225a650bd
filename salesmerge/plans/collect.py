"""One collection run, from raw reports to stored sales and run log."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DEDUPE_WINDOW_DAYS, LOOKBACK_DAYS, MIN_PRICE
from ..operators.qualify import label_reports, qualify
from ..operators.reports import finish_reports, reports_union, usable_reports
from ..operators.resolve import assign_events, merge_events, rank_lookup, run_totals
from ..operators.runs import drop_failed_sources, run_row, source_runs
from ..schema import RUN_SCHEMA, SOURCE_RUN_SCHEMA, START_SCHEMA, Area, SourceSpec
from ..session import stage
from ..sources.by_name import TypedSource, read_sources
from ..sources.landed import read_landed
from ..sources.tables import (
    append_log,
    committed_version,
    read_log,
    read_sales,
    table_buckets,
    write_sales,
)
from ..streaming.incremental import check_order, stored_beside


@dataclass
class CollectionRun:
    """The run's results; `sales` is the whole table after the run."""

    kept: DataFrame
    sales: DataFrame
    source_runs: DataFrame
    run: DataFrame


def _labelled(
    frames: Sequence[DataFrame],
    specs: Sequence[SourceSpec],
    areas: Sequence[Area],
    today: date,
    run_no: int,
    failures: DataFrame | None,
    only: Sequence[str] | None,
    min_price: int,
    lookback_days: int,
) -> DataFrame:
    """Usable reports of the sources that didn't fail, each with its reason to stay or go; staged."""
    raw = reports_union(frames, specs, run_no, only)
    if failures is not None:
        raw = drop_failed_sources(raw, failures)
    # Parsing is the costly part and has several readers: the accounting and the matching.
    return stage(
        label_reports(usable_reports(raw), areas, today, min_price, lookback_days), "labelled"
    )


def _kept(labelled: DataFrame, run_ts: datetime) -> DataFrame:
    """The finished reports to keep; staged, since several steps read them."""
    return stage(finish_reports(qualify(labelled), run_ts), "kept")


def collect_run(
    frames: Sequence[DataFrame],
    specs: Sequence[SourceSpec],
    areas: Sequence[Area],
    today: date,
    run_ts: datetime,
    run_id: str,
    *,
    run_no: int = 0,
    first_id: int = 0,
    started_at: datetime | None = None,
    failures: DataFrame | None = None,
    stored: DataFrame | None = None,
    only: Sequence[str] | None = None,
    min_price: int = MIN_PRICE,
    lookback_days: int = LOOKBACK_DAYS,
    window_days: int = DEDUPE_WINDOW_DAYS,
) -> CollectionRun:
    """Union, normalize, qualify, resolve and account, without writing any result.

    `run_no` must put the reports after the `stored` events of their properties. With `started_at`
    the log rows hold that time and the time when the matching ended; otherwise both are `run_ts`.
    """
    labelled = _labelled(
        frames, specs, areas, today, run_no, failures, only, min_price, lookback_days
    )
    kept = _kept(labelled, run_ts)
    before = None
    if stored is not None:
        check_order(kept, stored)
        before = rank_lookup(stored, specs)
    # Ranking is cheap, so the staged rows are read again as they are.
    assigned = assign_events(rank_lookup(kept, specs), window_days, before, staged=stored is None)
    begun = started_at or run_ts
    ended = datetime.now(timezone.utc) if started_at else run_ts
    return CollectionRun(
        kept=kept,
        sales=merge_events(assigned),
        source_runs=source_runs(labelled, failures, specs, run_id, begun, ended, only, first_id),
        run=run_row(run_totals(assigned), run_id, begun, ended),
    )


def start_run(spark: SparkSession, folder: str, run_id: str) -> tuple[int, datetime]:
    """The run's number and start, recorded before anything else, so that a crashed run can go on.

    A run that is begun again keeps its number, unless another run has begun in between and
    this one hadn't stored its sales: its reports then come after the other's.
    """
    starts = read_log(spark, f"{folder}/starts", START_SCHEMA)
    last = starts.agg(F.max("run_no")).first()[0] or 0
    own = starts.filter(F.col("run_id") == run_id).orderBy(F.desc("run_no")).first()
    if own is not None:
        stored = committed_version(spark, f"{folder}/sales", f"run {run_id}", own["run_no"])
        if own["run_no"] == last or stored is not None:
            return own["run_no"], own["started_at"].replace(tzinfo=timezone.utc)
    number = max(last, read_log(spark, f"{folder}/runs", RUN_SCHEMA).count()) + 1
    started = datetime.now(timezone.utc)
    row = spark.createDataFrame([(number, run_id, started)], START_SCHEMA)
    append_log(row, f"{folder}/starts")
    return number, started


def _append_once(rows: DataFrame, path: str, schema: str, run_id: str) -> None:
    if read_log(rows.sparkSession, path, schema).filter(F.col("run_id") == run_id).isEmpty():
        append_log(rows, path)


def collect_and_store(
    folder: str,
    frames: Sequence[DataFrame],
    specs: Sequence[SourceSpec],
    areas: Sequence[Area],
    today: date,
    run_ts: datetime,
    run_id: str,
    *,
    failures: DataFrame | None = None,
    only: Sequence[str] | None = None,
    min_price: int = MIN_PRICE,
    lookback_days: int = LOOKBACK_DAYS,
    window_days: int = DEDUPE_WINDOW_DAYS,
) -> CollectionRun:
    """A run whose results land in `folder`: sales, source_runs and runs.

    The run's number, which orders its reports after all earlier ones, is recorded first. A run that
    ended at any point can be called again with the same id and input: what it has written is
    found by the id and stays, what is missing is computed from the sales as they were before it.
    Only the buckets of properties that the run reports are read and written.
    """
    spark = frames[0].sparkSession
    run_no, started = start_run(spark, folder, run_id)
    path, name = f"{folder}/sales", f"run {run_id}"
    labelled = _labelled(
        frames, specs, areas, today, run_no, failures, only, min_price, lookback_days
    )
    kept = _kept(labelled, run_ts)
    version = committed_version(spark, path, name, run_no)
    buckets = table_buckets(spark, path)
    touched, concerned, others = stored_beside(kept, path, buckets, version)
    assigned = assign_events(rank_lookup(kept, specs), window_days, rank_lookup(concerned, specs))
    totals = stage(run_totals(assigned), "totals")
    if version is None and touched:
        write_sales(merge_events(assigned).unionByName(others), path, touched, buckets, run_no, name)
    ended = datetime.now(timezone.utc)
    log = read_log(spark, f"{folder}/source_runs", SOURCE_RUN_SCHEMA)
    first_id = (log.agg(F.max("id")).first()[0] or 0) + 1
    rows = source_runs(labelled, failures, specs, run_id, started, ended, only, first_id)
    _append_once(rows, f"{folder}/source_runs", SOURCE_RUN_SCHEMA, run_id)
    run = run_row(totals, run_id, started, ended)
    _append_once(run, f"{folder}/runs", RUN_SCHEMA, run_id)
    own = F.col("run_id") == run_id
    return CollectionRun(
        kept=kept,
        sales=read_sales(spark, path),
        source_runs=read_log(spark, f"{folder}/source_runs", SOURCE_RUN_SCHEMA).filter(own),
        run=read_log(spark, f"{folder}/runs", RUN_SCHEMA).filter(own),
    )


#: Payload rows of one source to its raw reports and the failures of its pages.
Scan = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def collect_landed(
    spark: SparkSession,
    landed: str,
    folder: str,
    scans: Mapping[str, Scan],
    specs: Sequence[SourceSpec],
    *args,
    **kwargs,
) -> CollectionRun:
    """A run from landed files to stored sales and logs.

    `scans` has one entry per source. A source with a page that can't be read contributes nothing and
    is logged with that page's message; a landed source without a scan is left out.
    """
    payloads, failures = read_landed(spark, landed)
    payloads = stage(payloads, "payloads")  # each source reads its own rows
    frames = []
    for source, scan in scans.items():
        rows, failed = scan(payloads.filter(F.col("source") == source))
        frames.append(rows)
        failures = failures.unionByName(failed)
    failures = stage(failures, "failures")
    return collect_and_store(folder, frames, specs, *args, failures=failures, **kwargs)


def collect_named(
    spark: SparkSession, folder: str, sources: Sequence[TypedSource], *args, only: Sequence[str] | None = None, **kwargs
) -> CollectionRun:
    """A run over sources that are read by the type names of their registered readers."""
    frames, failures = read_sources(spark, sources, only)
    specs = [source.spec for source in sources]
    return collect_and_store(
        folder, frames, specs, *args, failures=stage(failures, "failures"), only=only, **kwargs
    )
