"""Signals as text: header lines with #, then tab-separated samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The header's keys, as other tools write them.
KEYS = {"Sampling Rate (Hz)": "sampling_rate", "Resolution": "resolution", "Date": "date", "Data Type": "data_type", "Labels": "labels"}
DATE = "%Y-%m-%dT%H:%M:%S.%f"


def load_txt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples (signal_id, i, x ARRAY), metadata (signal_id, sampling_rate, resolution, date, labels)) of every file at a path.

    A file is a signal, named by its path. Any line with # is a header line; keys may be missing, and a
    date of another form is null. Samples are numbered by their line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("signal_id"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    is_header = F.contains("value", F.lit("#"))
    header = lines.where(is_header & F.contains("value", F.lit(":="))).select("signal_id", F.trim(F.regexp_replace(F.split("value", ":=")[0], "#", "")).alias("key"), F.trim(F.split("value", ":=")[1]).alias("text"))
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("text")))
    meta = header.groupBy("signal_id").agg(
        F.try_to_number(value("Sampling Rate (Hz)"), F.lit("999999999999.999999")).cast("double").alias("sampling_rate"),
        value("Resolution").try_cast("long").alias("resolution"),
        F.try_to_timestamp(value("Date"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("date"),
        F.split(value("Labels"), "\t").alias("labels"),
    )
    body = lines.where(~is_header & (F.trim("value") != ""))
    i = F.row_number().over(Window.partitionBy("signal_id").orderBy("line")).cast("long") - 1
    return body.select("signal_id", i.alias("i"), F.transform(F.split("value", "\t"), lambda s: s.try_cast("double")).alias("x")), meta


def store_txt(samples: DataFrame, path: str, sampling_rate: float = 1000.0, resolution: int | None = None, date: dt.datetime | None = None, labels: list[str] | None = None, precision: int = 6) -> None:
    """Writes one signal (i, x or x ARRAY) as one file in a folder: one task, as the format has one file a signal."""
    kind = samples.schema["x"].dataType.simpleString()
    inner = kind[6:-1] if kind.startswith("array") else kind
    head = [("Sampling Rate (Hz)", f"{sampling_rate:.2f}"), ("Resolution", resolution), ("Date", date.strftime(DATE) if date else None), ("Data Type", {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "boolean": "bool"}.get(inner, inner)), ("Labels", "\t".join(labels) if labels else None)]
    text = "\n".join(f"# {key}:= {value}" for key, value in head if value is not None)
    show = (lambda c: F.format_string(f"%.{precision}f", c.cast("double"))) if inner in ("double", "float") else (lambda c: c.cast("int").cast("string") if inner == "boolean" else c.cast("string"))
    row = F.array_join(F.transform("x", show), "\t") if kind.startswith("array") else show(F.col("x"))
    header = samples.sparkSession.createDataFrame([(-1, text)], "i long, value string")
    rows = samples.select(F.col("i").cast("long").alias("i"), row.alias("value"))
    header.unionByName(rows).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
