"""Distances between vectors (row_id, v), as expressions and as joins of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .utils import stored

#: Rows to a block; a task holds the distances of two blocks.
BLOCK = 1_024
Metric = str | Callable[[np.ndarray, np.ndarray], float]
#: Metrics of which the triangle inequality holds, so that blocks far from each other needn't meet.
TRIANGLE = ("euclidean", "cityblock", "chebyshev")
PAIRS = "i long, j long, d double"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _off(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _centred(a: Column) -> Column:
    mean = _sum(a) / F.size(a)
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(mean, F.size(a)).alias("m")), lambda s: s["x"] - s["m"])


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2, v: list[float] | None = None, vi: list[list[float]] | None = None, w: list[float] | None = None) -> Column:
    """The distance of two array columns. pcosine is 1 - |cosine|."""
    if w is not None:
        if metric not in ("minkowski", "euclidean"):
            raise ValueError("weights go with minkowski and euclidean")
        p = 2 if metric == "euclidean" else p
        weights = F.array(*[F.lit(float(x)) for x in w])
        return F.pow(_sum(F.zip_with(_off(a, b), weights, lambda x, y: y * F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))
    off, cosine = _off(a, b), lambda x, y: F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y)))
    if metric == "euclidean":
        return F.sqrt(_sum(F.transform(off, lambda x: x * x)))
    if metric == "sqeuclidean":
        return _sum(F.transform(off, lambda x: x * x))
    if metric == "cityblock":
        return _sum(off)
    if metric == "chebyshev":
        return F.array_max(off)
    if metric == "minkowski":
        return F.pow(_sum(F.transform(off, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    if metric == "pcosine":
        return F.lit(1.0) - F.abs(cosine(a, b))
    if metric == "correlation":
        return F.lit(1.0) - cosine(_centred(a), _centred(b))
    if metric == "hamming":
        return _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)
    if metric == "braycurtis":
        return F.try_divide(_sum(off), _sum(F.zip_with(a, b, lambda x, y: F.abs(x + y))))
    if metric == "canberra":
        return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))
    if metric == "seuclidean":
        if v is None:
            raise TypeError("seuclidean needs the variances v")
        return F.sqrt(_sum(F.zip_with(off, F.array(*[F.lit(float(x)) for x in v]), lambda x, s: x * x / s)))
    if metric == "mahalanobis":
        if vi is None:
            raise TypeError("mahalanobis needs the inverse covariance vi")
        d = F.zip_with(a, b, lambda x, y: x - y)
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in vi])
        return F.sqrt(_sum(F.zip_with(d, F.transform(rows, lambda r: _dot(r, d)), lambda x, y: x * y)))
    raise ValueError(f"unknown metric {metric!r}")


def _between(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, same: bool, one_block: bool, within: float | None, metric: Metric, options: dict) -> list[np.ndarray]:
    """(i, j, d) between two blocks, or all pairs i < j within one and the same set of rows."""
    d = k.distances(x, y, metric, **options)
    if same and callable(metric):
        d = np.where(a[:, None] < b[None, :], d, k.distances(y, x, metric, **options).T)
    wanted = np.ones(d.shape, bool) if within is None else d <= within
    if same:
        wanted &= a[:, None] < b[None, :] if one_block else a[:, None] != b[None, :]
    r, c = np.nonzero(wanted)
    i, j = a[r], b[c]
    return [np.minimum(i, j) if same else i, np.maximum(i, j) if same else j, d[r, c]]


def _check(metric: Metric, options: dict) -> None:
    """Raises for unknown metrics and missing options before any task runs."""
    options = {n: x for n, x in options.items() if n in ("w",)} | {n: np.ones((1, 1)) if n == "vi" else [1.0] for n in options if n in ("v", "vi") and options[n] is not None}
    k.distances(np.ones((1, 1)), np.ones((1, 1)), metric, **{n: [1.0] if n == "w" and x is not None else x for n, x in options.items()})


def _blocks(rows: DataFrame, *more: str) -> tuple[DataFrame, int]:
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("v").cast("array<double>").alias("v"), *more)
    n = max(1, -(-rows.count() // BLOCK))
    return rows.withColumn("own", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")), n


#: Blocks to a partition; a task holds the pairs of those of two partitions.
HELD = 8


def packed(rows: DataFrame, own: str, n: int, *more: str) -> DataFrame:
    """(own, row_id, v, more...): one row a block, with its rows' ids, values and components as arrays. Stored once, in n / HELD partitions."""
    dealt = rows.repartition(-(-n // HELD), own).groupBy(own).agg(F.collect_list(F.struct("row_id", "v", *more)).alias("rows"))
    return stored(dealt.select(own, F.col("rows.row_id").alias("row_id"), F.flatten("rows.v").alias("v"), *[F.col(f"rows.{c}").alias(c) for c in more]))


def blocks_met(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every block of left beside every one of right, whose columns end in _2. Tasks read both where they are stored: nothing is shuffled."""
    both = left.crossJoin(right.select(*[F.col(c).alias(f"{c}_2") for c in right.columns]))
    return both if condition is None else both.where(condition)


def block_columns(batch: pa.RecordBatch, row: int, suffix: str = "", *more: str) -> list[np.ndarray]:
    """The ids, the vectors as a matrix, and the values of one block in a batch of blocks met."""
    ids, v, *rest = (batch.column(f"{c}{suffix}")[row].values for c in ("row_id", "v", *more))
    return [np.asarray(ids), np.asarray(v).reshape(len(ids), -1), *[x.to_numpy(zero_copy_only=False) for x in rest]]


def _met(left: DataFrame, right: DataFrame, same: bool, within: float | None, metric: Metric, options: dict, condition: Column | None = None) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one_block = batch.column("own")[r].as_py() == batch.column("own_2")[r].as_py()
                i, j, d = _between(*block_columns(batch, r), *block_columns(batch, r, "_2"), same, one_block, within, metric, options)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64(), from_pandas=True)], ["i", "j", "d"])

    return blocks_met(left, right, condition).mapInArrow(run, PAIRS)


def pdist(rows: DataFrame, metric: Metric = "euclidean", **options) -> DataFrame:
    """(i, j, d) of all pairs i < j of distinct row ids, by a metric's name or a function of two vectors.

    All pairs are the result, so its size is the square of the input's. Blocks of rows are stored once and meet pairwise; nothing else is shuffled.
    """
    _check(metric, options)
    rows, n = _blocks(rows)
    blocks = packed(rows, "own", n)
    return _met(blocks, blocks, True, None, metric, options, F.col("own") <= F.col("own_2"))


def close_pairs(rows: DataFrame, within: float, metric: Metric = "euclidean", **options) -> DataFrame:
    """(i, j, d) of the pairs i < j of distance `within` or less.

    With a metric that obeys the triangle inequality rows are dealt to blocks by their distance from the origin, and
    only blocks meet whose distances differ by no more than `within`; with others all blocks do.
    """
    _check(metric, options)
    if options or metric not in TRIANGLE:
        return pdist(rows, metric, **options).where(F.col("d") <= within)
    blocks, last = _shells(rows, within, metric)
    return _met(blocks, blocks, True, within, metric, options, last)


def _shells(rows: DataFrame, within: float, metric: str, *more: str) -> tuple[DataFrame, Column]:
    """Rows packed in blocks by their distance from the origin, in order, and which blocks may hold rows within reach of each other."""
    rows, n = _blocks(rows, *more)
    far = rows.withColumn("far", distance(F.col("v"), F.transform("v", lambda x: F.lit(0.0)), metric))
    edges = far.approxQuantile("far", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("far"))) if edges else F.lit(0)
    lows, highs = [0.0, *edges], [*edges, float("inf")]
    last = [max(j for j in range(i, n) if j == i or lows[j] - highs[i] <= within * (1 + 1e-9)) for i in range(n)]
    reach = F.element_at(F.array(*map(F.lit, last)), F.col("own") + 1)
    return packed(far.withColumn("own", place.cast("int")), "own", n, *more), F.col("own_2").between(F.col("own"), reach)


def near_blocks(rows: DataFrame, within: float, metric: Metric = "euclidean", *more: str, **options) -> tuple[DataFrame, Column]:
    """Packed blocks of (row_id, v, more...), and the condition for two of them to hold rows within reach of each other."""
    _check(metric, options)
    if not options and metric in TRIANGLE:
        return _shells(rows, within, metric, *more)
    rows, n = _blocks(rows, *more)
    return packed(rows, "own", n, *more), F.col("own") <= F.col("own_2")


def cdist(left: DataFrame, right: DataFrame, metric: Metric = "euclidean", **options) -> DataFrame:
    """(i, j, d) of every row of left with every row of right."""
    _check(metric, options)
    (left, n), (right, m) = _blocks(left), _blocks(right)
    left, right = packed(left, "own", n), packed(right, "own", m)
    return _met(left, right, False, None, metric, options)


def squareform(pairs: DataFrame, force: str | None = None, checks: bool = False) -> DataFrame:
    """(i, j, d) of both orders and of each row with itself, from pairs i < j; the pairs i < j again from such a square.

    force: "tosquare" or "tovector" where the input is known; otherwise it is a square if it holds a pair i = j. checks
    raises unless a square is symmetric with zeros on its diagonal.
    """
    if force not in (None, "tosquare", "tovector"):
        raise ValueError("force is 'tosquare' or 'tovector'")
    if force == "tovector" or (force is None and not pairs.where("i = j").isEmpty()):
        if checks:
            other = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("e"))
            bad = pairs.join(other, ["i", "j"], "full").where("d is null or e is null or d <> e or (i = j and d <> 0)")
            if not bad.isEmpty():
                raise ValueError("the square isn't symmetric with zeros on its diagonal")
        return condensed(pairs)
    ids = pairs.select("i").union(pairs.select("j")).distinct()
    return pairs.union(pairs.select("j", "i", "d")).union(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def condensed(square: DataFrame) -> DataFrame:
    return square.where("i < j")
