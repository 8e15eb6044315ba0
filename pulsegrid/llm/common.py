"""What the corpus operators share: shared-folder tables, row ids, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The complement is what separates words.
WORD = "[^\\x09-\\x0D\\x20]+"
#: A key counts as hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.005


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a temporary folder serves in local mode only.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: With this Spark deletes a job's shuffle files when it is done, which what is stored makes needless.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and its shuffle files are deleted."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(*stored: DataFrame | None) -> None:
    """Deletes what cut wrote, once nothing that is still to be computed reads it."""
    for df in stored:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """Numbers the rows. Another scan, or another number of cores, gives other numbers: store them, and scan by `place`."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: The columns that name a stored row alike in every scan: a hash of its file's path, and its number in the file.
PLACE = ["__file", "__at"]


def _is_scan(df: DataFrame) -> bool:
    """Whether df is files, columns and filters only, so that each row is one stored row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(df: DataFrame) -> DataFrame:
    """df with PLACE, and its other columns under the names c0, c1 and so on, which can't clash with an operator's own.

    What isn't a scan of files is stored first.
    """
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    plain = plain if _is_scan(df) and "_metadata" not in df.columns else cut(plain)
    return plain.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))


def place_name(df: DataFrame, column: str) -> str:
    """What placed(df) calls a column."""
    return f"c{df.columns.index(column)}"


def unplaced(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a placed table by their own names again."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hot_limit(rows: int) -> int:
    return max(1000, int(rows * HOT_SHARE))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Left join of many rows to one row per group, without a task that gets all of a hot group.

    groups has the key once, and in `size` how many rows bear it. Groups above the limit, of
    which there are at most rows / limit, are broadcast; the others meet their rows in a shuffle.
    """
    marks = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).withColumnRenamed(key, "__hot")
    cold = groups.where(F.col(size) <= limit)
    first = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["__hot"]), "left")
    is_hot = F.col("__hot").isNotNull()
    done = first.where(is_hot).drop("__hot")
    rest = first.where(~is_hot).drop("__hot", *marks)
    return done.unionByName(rest.join(cold, key, "left").select(*done.columns))
