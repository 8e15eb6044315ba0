"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, hot_limit, join_groups

MAX_ROUNDS = 60
#: Edges that one task joins up by itself, 16 bytes each and some working space.
EDGES = 1_000_000


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): the edges of u with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")).withColumn("m", F.least("u", "m"))
    return join_groups(edges, least, "u", "__n", hot_limit(rows)).drop("__n")


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task as stars: each id under the least that these edges link it to, by halving paths."""
    got = list(batches)
    a, b = (np.concatenate([np.asarray(x.column(i)) for x in got] or [np.zeros(0, np.int64)]) for i in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ids))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    while (up != up[up]).any():
        up = up[up]
    under = np.flatnonzero(up != np.arange(len(ids)))
    yield pa.RecordBatch.from_pydict({"u": pa.array(ids[under], pa.int64()), "v": pa.array(ids[up[under]], pa.int64())})


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
    return False


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the least id that it is linked to, over any path.

    Each round every task first joins up about EDGES edges by itself. Then large-star and small-star: every node hangs its
    larger neighbours, then its smaller ones, under the least of them, until all are stars. Each round's edges are
    stored in the shared folder.
    """
    edges = _joined_up(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    for _ in range(MAX_ROUNDS):
        if _stars(edges):
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
        rows, old = edges.count(), edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, rows)
        edges = _joined_up(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v"))
        forget(old)
    raise RuntimeError("components did not settle")


def _joined_up(edges: DataFrame) -> DataFrame:
    """Distinct edges, joined up task by task; stored."""
    stored = cut(edges.distinct())
    tasks = max(1, -(-stored.count() // EDGES))
    out = cut(stored.repartition(tasks).mapInArrow(_join_up, "u long, v long"))
    forget(stored)
    return out
