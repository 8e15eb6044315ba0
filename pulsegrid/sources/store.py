"""A store of signals and events in groups: Parquet tables below one path, with JSON metadata."""

from __future__ import annotations

import json
import os
import pickle
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def join_group(*parts: str) -> str:
    """'a//b/', 'c' as '/a/b/c'."""
    return "/" + "/".join(p for part in parts for p in part.strip().split("/") if p)


class Store:
    """signals (grp, name, mdata, i, x) and events (grp, name, mdata, ts, value), partitioned by group and name.

    A partition is an entry, so that adding, replacing and deleting one leave the others alone, and
    reading one prunes the rest.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "a"):
        if mode not in ("r", "w", "a"):
            raise ValueError("mode must be 'r', 'w' or 'a'")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode == "r" and not self._exists(self.path):
            raise OSError(f"{path} doesn't exist")
        if mode == "w":
            self._delete(self.path)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Every write is complete when its call returns; closed stores refuse more."""
        self.mode = "r"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _delete(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.delete(at, True)

    def _entry(self, kind: str, group: str, name: str) -> str:
        return f"{self.path}/{kind}/grp={join_group(group).replace('/', '%2F')}/name={name}"

    def _put(self, kind: str, rows: DataFrame, mdata: dict | None, group: str, name: str | None, compress: bool) -> tuple[str, str]:
        if self.mode == "r":
            raise OSError("the store is read-only")
        name = name or uuid.uuid4().hex
        codec = "gzip" if compress else "snappy"
        rows.withColumn("mdata", F.lit(json.dumps(mdata or {}))).write.mode("overwrite").option("compression", codec).parquet(self._entry(kind, group, name))
        return join_group(group), name

    def _get(self, kind: str, group: str, name: str) -> tuple[DataFrame, dict]:
        path = self._entry(kind, group, name)
        if not self._exists(path):
            raise KeyError(f"no entry {name!r} in group {join_group(group)!r}")
        rows = self.spark.read.parquet(path)
        first = rows.select("mdata").first()
        return rows.drop("mdata"), json.loads(first[0]) if first else {}

    def _list(self, kind: str, group: str, recursive: bool) -> list[tuple[str, str]]:
        if not self._exists(f"{self.path}/{kind}"):
            return []
        fs, at = self._fs(f"{self.path}/{kind}")
        found, top = [], join_group(group)
        for g in fs.listStatus(at):
            own = g.getPath().getName().removeprefix("grp=").replace("%2F", "/")
            if own == top or recursive and (own + "/").startswith(top.rstrip("/") + "/"):
                found += [(own, n.getPath().getName().removeprefix("name=")) for n in fs.listStatus(g.getPath()) if n.isDirectory()]
        return sorted(found)

    def _drop(self, kind: str, group: str, name: str | None) -> None:
        if self.mode == "r":
            raise OSError("the store is read-only")
        entries = [(join_group(group), name)] if name else self._list(kind, group, recursive=True)
        for g, n in entries:
            if not self._delete(self._entry(kind, g, n)) and name:
                raise KeyError(f"no entry {n!r} in group {g!r}")

    def add_header(self, header: dict) -> None:
        if self.mode == "r":
            raise OSError("the store is read-only")
        self.spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/header")

    def get_header(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/header").first()[0]) if self._exists(f"{self.path}/header") else {}

    def add_signal(self, rows: DataFrame, mdata: dict | None = None, group: str = "", name: str | None = None, compress: bool = False) -> tuple[str, str]:
        return self._put("signals", rows.select("i", "x"), mdata, group, name, compress)

    def get_signal(self, group: str = "", name: str = "") -> tuple[DataFrame, dict]:
        return self._get("signals", group, name)

    def del_signal(self, group: str = "", name: str = "") -> None:
        self._drop("signals", group, name)

    def del_signal_group(self, group: str = "") -> None:
        self._drop("signals", group, None)

    def list_signals(self, group: str = "", recursive: bool = False) -> list[tuple[str, str]]:
        return self._list("signals", group, recursive)

    def add_event(self, rows: DataFrame, mdata: dict | None = None, group: str = "", name: str | None = None, compress: bool = False) -> tuple[str, str]:
        return self._put("events", rows.select("ts", "value"), mdata, group, name, compress)

    def get_event(self, group: str = "", name: str = "") -> tuple[DataFrame, dict]:
        return self._get("events", group, name)

    def del_event(self, group: str = "", name: str = "") -> None:
        self._drop("events", group, name)

    def del_event_group(self, group: str = "") -> None:
        self._drop("events", group, None)

    def list_events(self, group: str = "", recursive: bool = False) -> list[tuple[str, str]]:
        return self._list("events", group, recursive)


def serialize(data, path: str, compress: int = 3) -> None:
    """Pickles data into a file on the driver, at a zlib level of 0 to 9."""
    if compress not in range(10):
        raise ValueError("compress is 0 to 9")
    with open(os.path.abspath(os.path.expanduser(path)), "wb") as f:
        f.write(zlib.compress(pickle.dumps(data), compress))


def deserialize(path: str):
    """What serialize wrote. Unpickling runs code: read only files that you trust."""
    with open(os.path.abspath(os.path.expanduser(path)), "rb") as f:
        return pickle.loads(zlib.decompress(f.read()))


def dump_json(data, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f)


def load_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def pack_zip(files: list[str], path: str, recursive: bool = True, force_ext: bool = True) -> str:
    """A zip of files and folders on the driver; missing ones are skipped."""
    path = path if path.endswith(".zip") or not force_ext else path + ".zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for f in files:
            if os.path.isdir(f):
                for folder, _, names in os.walk(f):
                    for n in names if recursive or folder == f else []:
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(os.path.abspath(f))))
            elif os.path.exists(f):
                z.write(f, os.path.basename(f))
    return path


def unpack_zip(zip_path: str, path: str) -> None:
    with zipfile.ZipFile(zip_path) as z:
        z.extractall(path)
