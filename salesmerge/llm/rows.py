"""Row keys, staging and linked components, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmerge.session import stage

#: Deletes a query's shuffle files when it ends, instead of when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch that goes to a Python worker.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files of the write are dropped.

    With `batch_rows`, Python workers get batches of so many rows at most: an Arrow batch is held whole, by
    the executor and by the worker, and its rows may be large.
    """
    conf = df.sparkSession.conf
    own = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {name: conf.get(name, None) for name in own}
    for key, value in own.items():
        conf.set(key, value)
    try:
        return stage(df, name)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def keys(id_column: str, text_column: str) -> list[Column]:
    """Two numbers that tell rows apart by id and text; nulls count as values.

    Rows that repeat in both have the same key, and the same result.
    """
    return [
        F.xxhash64(F.col(id_column).isNull(), id_column).alias("__a"),
        F.xxhash64(F.col(text_column).isNull(), text_column, id_column).alias("__b"),
    ]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the links (x, y).

    Alternates large and small stars, so the number of rounds grows with the logarithm of the
    longest chain. Each node keeps one link to the smallest neighbour, so no node's links meet
    in one task: minima combine before the shuffle. Every round is staged.
    """
    links = staged(
        edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .where("x < y")
        .distinct(),
        "links",
    )
    for _ in range(rounds):
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # Large star: every larger neighbour of x links to the least neighbour of x.
        large = (
            both.join(least, "x")
            .where("y > x")
            .select(F.col("m").alias("x"), F.col("y").alias("y"))
            .where("x < y")
            .distinct()
        )
        large = staged(large, "large")
        # Small star: the smaller neighbours of y, and y, link to the least of them.
        low = large.groupBy("y").agg(F.min("x").alias("m"))
        small = (
            large.join(low, "y")
            .select(
                F.col("m"), F.explode(F.array("x", "y")).alias("y")
            )
            .select(F.col("m").alias("x"), "y")
            .where("x < y")
            .distinct()
        )
        small = staged(small, "small")
        # Stars only: no y has two links and no x is itself a y.
        open_links = small.groupBy("y").agg(F.count("x").alias("n")).where("n > 1")
        chained = small.select(F.col("x").alias("y")).join(small.select("y"), "y", "left_semi")
        links = small
        if open_links.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError("links didn't settle")
    return links.select(F.col("y").alias("node"), F.col("x").alias("component")).unionByName(
        links.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct()
    )
