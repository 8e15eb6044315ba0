"""Seat allocation, random parts, file names, result schemas."""

from __future__ import annotations

import keyword
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIVISORS = ("dHondt", "Huntington-Hill", "Sainte-Lague", "Imperiali", "Danish")


def _divisor(name: str, j: Column) -> Column:
    """The divisor of the seat after j seats."""
    forms = {"dHondt": j + 1, "Huntington-Hill": F.sqrt((j + 1) * (j + 2)), "Sainte-Lague": 2 * j + 1, "Imperiali": j / 2 + 1, "Danish": 3 * j + 1}
    if name not in forms:
        raise ValueError(f"unknown divisor {name!r}")
    return forms[name].cast("double")


def highest_averages(parties: DataFrame, party: str, votes: str, seats: int, divisor: str = "dHondt") -> DataFrame:
    """(party, seats): a seat for each of the highest quotients, ties to the smaller party."""
    quotients = parties.select(party, F.col(votes).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("j"))
    ranked = quotients.withColumn("q", F.col("v") / _divisor(divisor, F.col("j")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("q"), party, "j"))
    return ranked.withColumn("won", (place <= seats).cast("int")).groupBy(party).agg(F.sum("won").alias("seats"))


def largest_remainder(parties: DataFrame, party: str, votes: str, seats: int, reverse: bool = True) -> DataFrame:
    """(party, seats): whole quotas, then a seat each for the largest remainders (the smallest, unless reverse)."""
    every = Window.partitionBy(F.lit(0))
    quota = F.col("v") / (F.sum("v").over(every) / F.lit(float(seats)))
    rows = parties.select(party, F.col(votes).cast("double").alias("v")).withColumn("quota", quota).withColumn("sure", F.floor("quota"))
    left = F.lit(seats) - F.sum("sure").over(every)
    order = F.round(F.col("quota") - F.col("sure"), 12)
    place = F.row_number().over(every.orderBy(F.desc(order) if reverse else F.asc(order), party))
    return rows.withColumn("left", left).withColumn("place", place).select(party, (F.col("sure") + (F.col("place") <= F.col("left")).cast("int")).cast("long").alias("seats"))


def _draw(key: str, *turn: Column) -> Column:
    """A seeded hash of a key, in hexadecimal, whose order is random and the same on every run."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), *[t.cast("string") for t in turn]))


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names, or just the frame where it names none."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def numbered(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """rows with each one's place in a total order, from 0, and how many there are.

    No task gets all rows: ranges of the order are sorted apart, each starting where those before it end.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("__part") + 1) if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + start
    return parts.withColumn(name, place.cast("long")).drop("__part"), total


def random_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds `use`: true for the given fraction of the rows, the first in order of a seeded hash."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is between 0 and 1")
    placed, n = numbered(rows.withColumn("__draw", _draw(key, F.lit(seed))), "__place", "__draw", key)
    return placed.withColumn("use", F.col("__place") < int(n * fraction + 1e-9)).drop("__draw", "__place")


def cross_validation(rows: DataFrame, label: str, key: str, n_iter: int = 10, test_size: float = 0.1, seed: int = 0) -> DataFrame:
    """(split, key, label, test): stratified shuffle splits, each label giving its share of the test rows, at least one."""
    splits = rows.select(F.col(key), F.col(label)).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    own = Window.partitionBy("split", label)
    place = F.row_number().over(own.orderBy(_draw(key, F.col("split"), F.lit(seed)), key))
    return splits.withColumn("test", place <= F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(own) * test_size)))


def normpath(path: str) -> str:
    return os.path.abspath(os.path.expanduser(path))


def fileparts(path: str | Column) -> tuple[str, str, str] | Column:
    """(folder, name, extension without its dot) of a path, or a struct of them for a column of paths."""
    if isinstance(path, Column):
        file = F.substring_index(path, "/", -1)
        ext = F.regexp_extract(file, r"\.([^.]*)$", 1)
        return F.struct(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), ext.alias("ext"))
    folder, file = os.path.split(path)
    name, ext = os.path.splitext(file)
    return folder, name, ext.replace(".", "")


def fullfile(*parts: str) -> str:
    """Joins parts; of three or more the last is the extension."""
    return os.path.join(*parts[:-1]) + "." + parts[-1] if len(parts) > 2 else os.path.join(*parts)


def walktree(spark: SparkSession, top: str, spec: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a folder whose names match a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", spec).load(top).select("path", "length", "modificationTime")


def check_names(names: list[str]) -> list[str]:
    """Column names of a result: unique, alphanumeric with underscores, no keywords, no leading digit."""
    for name in names:
        if not isinstance(name, str) or not name.replace("_", "").isalnum() or keyword.iskeyword(name) or name[0].isdigit():
            raise ValueError(f"{name!r} can't be a field name")
    if len(set(names)) != len(names):
        raise ValueError("field names must differ")
    return names


class Result:
    """Named outputs of a pipeline, each a DataFrame, by position or name."""

    def __init__(self, **fields):
        check_names(list(fields))
        self._fields = fields
        self.__dict__.update(fields)

    def __getnewargs__(self) -> tuple:
        """The values alone, as a tuple has them when it is copied or pickled."""
        return (tuple(self),)

    def __reduce__(self) -> tuple:
        return _result, (self._fields,)

    def __getitem__(self, key):
        return list(self._fields.values())[key] if isinstance(key, int | slice) else self._fields[key]

    def __iter__(self):
        return iter(self._fields.values())

    def __len__(self) -> int:
        return len(self._fields)

    def __repr__(self) -> str:
        return f"Result({', '.join(self._fields)})"

    def keys(self) -> list[str]:
        return list(self._fields)

    def as_dict(self) -> dict:
        return dict(self._fields)


def _result(fields: dict) -> Result:
    return Result(**fields)


_clocks: dict[str | None, float] = {}


def tic(name: str | None = None) -> None:
    _clocks[name] = time.perf_counter()


def tac(name: str | None = None) -> float:
    """Seconds since tic(name); a KeyError for an unknown clock."""
    return time.perf_counter() - _clocks[name]


def clear(name: str | None = None) -> None:
    _clocks.pop(name, None)


def clear_all() -> None:
    _clocks.clear()
