"""Filters over streams of segments (signal_id, seq, x ARRAY), with state carried from segment to segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as k


class OnlineFilter:
    """A causal filter for one signal: the first segment starts it as if its first sample had always been."""

    def __init__(self, b, a):
        if b is None or a is None:
            raise TypeError("both coefficient arrays are needed")
        self.b, self.a = np.asarray(b, float), np.asarray(a, float)
        self.reset()

    def reset(self) -> None:
        self.state: np.ndarray | None = None

    def filter(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        if not len(x):
            return x
        if self.state is None:
            self.state = k.lfilter_zi(self.b, self.a) * x[0]
        out, self.state = k.lfilter(self.b, self.a, x, self.state)
        return out


def filter_stream(segments: DataFrame, b, a) -> DataFrame:
    """(signal_id, i, x) of a streaming DataFrame of segments, each signal's in order of seq.

    Segments of one micro-batch are sorted; one that comes after a later one was filtered is dropped,
    as its samples can no longer be put in their place, and so is a repeated one.
    """
    b, a = [float(v) for v in b], [float(v) for v in a]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, at, last = held.get if held.exists else ([], 0, -1)
        online = OnlineFilter(b, a)
        online.state = np.array(state) if last >= 0 else None
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, x in zip(rows["seq"], rows["x"], strict=True):
            if seq <= last:
                continue
            y, last = online.filter(x), int(seq)
            yield pd.DataFrame({"signal_id": key[0], "i": np.arange(at, at + len(y)), "x": y})
            at += len(y)
        if last >= 0:
            held.update(([float(v) for v in (online.state if online.state is not None else [])], at, last))

    kind = segments.schema["signal_id"].dataType.simpleString()
    return segments.select("signal_id", "seq", "x").groupBy("signal_id").applyInPandasWithState(
        run, f"signal_id {kind}, i long, x double", "state array<double>, at long, last long", "append", GroupStateTimeout.NoTimeout
    )


def windowed_stream(samples: DataFrame, ts: str = "ts", size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(signal_id, window, n, mean, min, max) of a stream of samples (signal_id, ts, x); samples later than `late` are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return samples.withWatermark(ts, late).groupBy("signal_id", window).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


def sessions(samples: DataFrame, ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(signal_id, session_window, n): recordings split where nothing comes for `gap`."""
    return samples.withWatermark(ts, late).groupBy("signal_id", F.session_window(ts, gap)).agg(F.count("x").alias("n"))
