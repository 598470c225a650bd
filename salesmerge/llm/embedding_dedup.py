"""Near-duplicate vectors: a navigable small-world graph in each shard, every shard queried.

Equal vectors are one class from the start. Classes are dealt into shards by hash; a task builds
each shard's graph. Of two shards, the classes of one query the other, and every class queries its own
shard; queries come in blocks, so a task holds one shard and one block. The first beam is narrow, as
most queries have few links. A query whose whole beam lies above the threshold is asked again
with a beam twice as wide, until its links end inside the beam. The audit queries of a part of the block
are compared with the whole shard, each weighing the same; if their recall is too low, wider beams rarely
help (a group that no walk enters), and the part is compared with the whole shard, which costs less than
walking twice. Where a beam would read as many nodes as the shard has, the shard is compared whole, too.

Found pairs are verified by cosine in double precision. A task keeps the number of links of each
query, and of each node that a query from elsewhere has found, and a spanning set of links that connects
the same components, so the rows that leave a task grow with its queries and nodes and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.hnsw import LINKS, Graph
from salesmerge.llm.rows import components, staged

#: Vectors of a shard and queries of a block; shards are `MIN_SHARDS` at least.
SHARD_ROWS, BLOCK_ROWS, MIN_SHARDS = 100_000, 16_000, 6
#: Queries of a part, which is audited by itself, and the beam that the first one begins with.
PART_ROWS, FIRST_BEAM = 4_000, 16
#: Audited queries of each stratum, their mean recall, and the recall each must reach.
_AUDIT, _RECALL, _LEAST = 128, 0.999, 0.99


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard's graph: their layer and links, the vector kept."""
    shard = shard.sort_values("id", ignore_index=True)
    graph = Graph.build(_unit(shard["vector"]).astype(np.float32))
    height = np.zeros(len(shard), np.int32)
    for level, nodes in enumerate(graph.layers):
        height[nodes] = level
    links = np.stack(graph.links, 1).reshape(len(shard), -1)
    island = np.zeros(len(shard), bool)
    island[graph.islands] = True
    return shard.assign(
        place=np.arange(len(shard), dtype=np.int32), height=height, island=island, links=list(links)
    )


def _restore(nodes: pd.DataFrame) -> tuple[Graph, np.ndarray]:
    vectors = _unit(nodes["vector"])
    links = np.array(nodes["links"].tolist(), np.int32).reshape(len(nodes), -1, LINKS)
    height = nodes["height"].to_numpy()
    layers = [np.flatnonzero(height >= level) for level in range(links.shape[1])]
    own = [np.ascontiguousarray(links[:, level]) for level in range(links.shape[1])]
    islands = np.flatnonzero(nodes["island"].to_numpy(bool))
    return Graph(vectors.astype(np.float32), layers, own, islands), vectors


def _hits(graph: Graph, queries: np.ndarray, threshold: float, beam: int):
    """Query and node of each pair that single precision puts at the threshold or nearly so."""
    n, floor = len(graph.vectors), threshold - 1e-4
    todo, out = np.arange(len(queries)), []
    single = queries.astype(np.float32)
    while len(todo):
        if beam * LINKS >= n:  # a walk is no cheaper than the whole shard, and not exact
            for lo in range(0, len(todo), 256):
                part = todo[lo : lo + 256]
                for to in range(0, n, 50_000):
                    row, col = np.nonzero(single[part] @ graph.vectors[to : to + 50_000].T >= floor)
                    out.append((part[row], col + to))
            break
        again = []
        for lo in range(0, len(todo), 2048):
            part = todo[lo : lo + 2048]
            ids, sims = graph.search(single[part], beam, floor=floor)
            good = sims >= floor
            full = good.sum(1) >= max(1, beam - beam // 8)
            row, col = np.nonzero(good & ~full[:, None])
            out.append((part[row], ids[row, col]))
            again.append(part[full])
        todo, beam = np.concatenate(again), beam * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (todo, todo)


def _audit(graph: Graph, queries, row, node, threshold: float, selves: np.ndarray | None = None) -> float:
    """Least mean recall of audited queries with no, few and many found links; 0 if one query's is too low.

    Every query weighs the same; its own node (`selves`, -1 if elsewhere) is no link.
    """
    selves = np.full(len(queries), -1) if selves is None else selves
    links = np.bincount(row[node != selves[row]], minlength=len(queries))
    rng = np.random.default_rng(len(queries))
    worst = 1.0
    for stratum in (links == 0, (links > 0) & (links <= LINKS), links > LINKS):
        chosen = np.flatnonzero(stratum)
        if len(chosen) > _AUDIT:
            chosen = np.sort(rng.choice(chosen, _AUDIT, replace=False))
        if not len(chosen):
            continue
        place = np.full(len(queries), -1)
        place[chosen] = np.arange(len(chosen))
        known = np.flatnonzero(place[row] >= 0)
        true, missed = np.zeros(len(chosen)), np.zeros(len(chosen))
        for lo in range(0, len(graph.vectors), 50_000):
            part = graph.vectors[lo : lo + 50_000]
            near = queries[chosen].astype(np.float32) @ part.T >= threshold + 1e-6
            own = np.flatnonzero((selves[chosen] >= lo) & (selves[chosen] < lo + len(part)))
            near[own, selves[chosen][own] - lo] = False
            true += near.sum(1)
            here = known[(node[known] >= lo) & (node[known] < lo + len(part))]
            near[place[row[here]], node[here] - lo] = False
            missed += near.sum(1)
        recall = 1 - missed / np.maximum(true, 1)
        worst = min(worst, float(recall.mean()) if recall.min() >= _LEAST else 0.0)
    return worst


def _spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same ids as the links (x, y), one for each id at most."""
    ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[label[moved]], ids[moved]


def _pairs(graph: Graph, exact: np.ndarray, asked: np.ndarray, selves: np.ndarray, threshold: float):
    """Query and node of each pair at the threshold or above; all there are if the audit of the walks fails."""
    for beam in (FIRST_BEAM, len(exact)):
        row, node = _hits(graph, asked, threshold, beam)
        cosine = np.concatenate(
            [np.einsum("kd,kd->k", asked[row[lo : lo + 200_000]], exact[node[lo : lo + 200_000]])
             for lo in range(0, len(row), 200_000)] or [np.zeros(0)]
        )
        good = cosine >= threshold
        row, node = row[good], node[good]
        if beam * LINKS >= len(exact) or _audit(graph, asked, row, node, threshold, selves) >= _RECALL:
            break
    return row, node


def _query(threshold: float):
    def run(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"x": [], "y": [], "n": []}, dtype=np.int64)
        if not len(queries) or not len(nodes):
            return empty
        graph, exact = _restore(nodes.sort_values("place", ignore_index=True))
        asked, own = _unit(queries["vector"]), queries["id"].to_numpy()
        nodes = nodes.sort_values("place")
        other, size = nodes["id"].to_numpy(), nodes["n"].to_numpy()
        weight = queries["n"].to_numpy() if "n" in queries else np.ones(len(queries), np.int64)
        at = np.minimum(np.searchsorted(other, own), len(other) - 1)  # places are in the order of ids
        inside = other[at] == own
        selves = np.where(inside, at, -1)
        links, back = np.zeros(len(own), np.int64), np.zeros(len(other), np.int64)
        x, y = [], []
        for lo in range(0, len(own), PART_ROWS):
            part = slice(lo, lo + PART_ROWS)
            row, node = _pairs(graph, exact, asked[part], selves[part], threshold)
            row += lo
            apart = own[row] != other[node]
            row, node = row[apart], node[apart]
            np.add.at(links, row, size[node])
            # A query from another shard isn't asked for from here.
            cross = ~inside[row]
            np.add.at(back, node[cross], weight[row[cross]])
            a, b = _spanning(own[row], other[node])
            x.append(a)
            y.append(b)
        x, y = _spanning(np.concatenate(x), np.concatenate(y))
        return pd.concat(
            [
                pd.DataFrame({"x": ids[n > 0], "y": ids[n > 0], "n": n[n > 0]})
                for ids, n in ((own, links), (other, back))
            ]
            + [pd.DataFrame({"x": x, "y": y, "n": np.zeros(len(x), np.int64)})]
        )

    return run


def near_duplicate_vectors(
    embeddings: DataFrame,
    threshold: float = 0.95,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """`id_column`, n_links, component_id (least id reachable by links), kept (id is component_id).

    A vector that is null or empty, has length 0 or holds a null or non-finite component links with
    nothing, and so does a row with a null id (it is kept, its component null). Vectors of
    different dimensions don't link. A row that repeats as a whole links with its copy. Extra columns
    aren't read. Every pair of which a graph search misses no more than the audits allow is
    found; none below the threshold is.
    """
    vector = F.col(vector_column).cast("array<double>")
    sound = (
        F.col(id_column).isNotNull()
        & F.coalesce(F.size(vector) > 0, F.lit(False))
        & F.coalesce(
            F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))),
            F.lit(False),
        )
        & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))
    )
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))
    usable = F.coalesce(sound & (length > 0) & (length < float("inf")), F.lit(False))
    rows = staged(
        embeddings.select(
            F.col(id_column).alias("id"),
            usable.alias("usable"),
            F.when(usable, vector).alias("vector"),
            F.xxhash64(vector).alias("h1"),
            F.xxhash64(F.lit("second"), vector).alias("h2"),
        ),
        "vectors",
    )
    classes = staged(
        rows.where("usable")
        .groupBy("h1", "h2")
        .agg(F.min("id").cast("bigint").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector")),
        "vector-classes",
    )
    count = classes.count()
    shards = max(MIN_SHARDS, -(-count // SHARD_ROWS))
    blocks = max(1, -(-count // BLOCK_ROWS))
    own = classes.select(
        "dim", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), "id", "n", "vector"
    )
    graph = staged(
        # The tasks are few and long: a number given here keeps them from being put together.
        own.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(
            _build,
            "dim int, shard int, id bigint, n bigint, vector array<double>, place int, height int, island boolean, links array<int>",
        ),
        "graphs",
    )
    nodes = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = own.select(
        "dim",
        "id",
        "n",
        "vector",
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"),
        F.col("shard").alias("home"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    # Each two shards meet once; every shard asks half of the others.
    asks = (F.col("shard") > F.col("home")) == ((F.col("shard") + F.col("home")) % 2 == 0)
    queries = queries.where((F.col("shard") == F.col("home")) | asks).drop("home")
    task = ["dim", "shard", "block"]
    tasks = 3 * shards * blocks
    found = staged(
        queries.repartition(tasks, *task)
        .groupBy(*task)
        .cogroup(nodes.repartition(tasks, *task).groupBy(*task))
        .applyInPandas(_query(threshold), "x bigint, y bigint, n bigint"),
        "vector-links",
    )
    links = found.where("x = y").groupBy("x").agg(F.sum("n").alias("linked"))
    groups = components(found.where("x != y").select("x", "y"))
    told = (
        classes.select("h1", "h2", "id", "n")
        .join(links, F.col("id") == F.col("x"), "left")
        .join(groups, F.col("id") == F.col("node"), "left")
        .select(
            "h1",
            "h2",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    kind = rows.schema["id"].dataType
    named = rows.select("id", *[F.when(F.col("usable"), F.col(c)).alias(c) for c in ("h1", "h2")])
    return named.join(told, ["h1", "h2"], "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(F.col("component_id").cast(kind), F.col("id")).alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce(F.col("component_id").cast(kind), F.col("id"))).alias("kept"),
    )
