"""Sources by type name: data source readers registered in the session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..schema import RAW_REPORT_SCHEMA, SourceSpec, local_frame
from ..session import stage

#: Columns that a reader may give: the order of its records and the text of a raw report.
READER_SCHEMA = T.StructType(
    [T.StructField("record_ord", T.LongType())]
    + [f for f in RAW_REPORT_SCHEMA.fields if f.name not in ("seq", "source")]
)
_NEEDED = ("record_ord", "address")


class SourceMisconfigured(Exception):
    """Raised by a reader whose options can't be right."""


@dataclass(frozen=True)
class TypedSource:
    """A configured source, the type name of its reader, and the reader's options."""

    spec: SourceSpec
    type: str
    options: Mapping[str, str] = field(default_factory=dict)


def register_source(spark: SparkSession, reader: type[DataSource]) -> type[DataSource]:
    """Make a reader class known to the session by the name it gives itself."""
    spark.dataSource.register(reader)
    return reader


def read_source(spark: SparkSession, source: TypedSource) -> DataFrame:
    """The records of one source; its columns are checked before anything is read."""
    name = source.spec.name
    try:
        frame = spark.read.format(source.type).options(**source.options).load()
    except (AnalysisException, Py4JJavaError) as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise SourceMisconfigured(f"{name}: unknown source type {source.type!r}") from None
        raise
    kinds = {f.name: f.dataType for f in READER_SCHEMA.fields}
    missing = [c for c in _NEEDED if c not in frame.columns]
    if missing:
        raise SourceMisconfigured(f"{name}: {source.type} gives no {', '.join(missing)}")
    for column in frame.schema.fields:
        if column.name not in kinds:
            raise SourceMisconfigured(f"{name}: {source.type} gives an unknown column {column.name}")
        if column.dataType != kinds[column.name]:
            wanted = kinds[column.name].simpleString()
            raise SourceMisconfigured(
                f"{name}: {column.name} is {column.dataType.simpleString()}, not {wanted}"
            )
    return frame.withColumn("source", F.lit(name))


def read_sources(
    spark: SparkSession, sources: Sequence[TypedSource], only: Sequence[str] | None = None
) -> tuple[list[DataFrame], DataFrame]:
    """Each enabled source's records, staged, and a failure for each that can't be read.

    A reader runs once, on the executors. One that fails contributes nothing; the others proceed.
    """
    frames, failed = [], []
    for source in sources:
        name = source.spec.name
        if not source.spec.enabled or (only and name not in only):
            continue
        try:
            frames.append(stage(read_source(spark, source), f"source-{name}"))
        except (SourceMisconfigured, PySparkException, Py4JJavaError) as error:
            text = str(error)
            status = "misconfigured" if "SourceMisconfigured" in text or isinstance(error, SourceMisconfigured) else "error"
            failed.append((name, 0, status, _last_line(text)))
    if not frames:
        empty = T.StructType([*READER_SCHEMA.fields, T.StructField("source", T.StringType())])
        frames.append(spark.createDataFrame([], empty))
    return frames, local_frame(spark, failed, "source STRING, page_no BIGINT, status STRING, message STRING")


def _last_line(text: str) -> str:
    """What was raised, out of a reader's trace."""
    raised = [line.strip() for line in text.splitlines() if line.strip() and not line.startswith((" ", "\t"))]
    named = [line for line in raised if "Error: " in line or "SourceMisconfigured: " in line]
    return (named or raised or [text])[-1].split(": ", 1)[-1] if named else (raised or [text])[0]
