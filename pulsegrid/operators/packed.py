"""Numeric kernels over whole signals: one grouped Arrow call per signal, so a signal must fit one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as d
from ..functions import kernels as k
from .signal import KEY


class Signals:
    """Signals that a task makes whole, each from a row (id, ...) of a small table, and hands to the kernels itself: their samples
    are neither shuffled nor stored, nor do they leave the task's Python.

    Filters add a step, all else gives a table of its rows.
    """

    def __init__(self, rows: DataFrame, make: Callable[..., np.ndarray], steps: tuple[Callable[[np.ndarray], np.ndarray], ...] = ()):
        self.rows, self.make, self.steps = rows, make, steps

    def then(self, step: Callable[[np.ndarray], np.ndarray]) -> Signals:
        return Signals(self.rows, self.make, (*self.steps, step))

    def ids(self) -> DataFrame:
        return self.rows.select(F.col("id").alias(KEY))

    def table(self, fcn: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
        """(signal_id, columns...): what fcn gives for each signal."""
        make, steps, names = self.make, self.steps, [c.split()[0] for c in columns.split(", ")]
        kind = self.rows.schema["id"].dataType.simpleString()
        schema = f"{KEY} {kind}, {columns}"

        def run(batches):
            for b in batches:
                for values in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    try:
                        x = make(*values)
                        for step in steps:
                            x = step(x)
                        out = {c: np.atleast_1d(v) for c, v in fcn(x).items()}
                    except k.NoResult:
                        continue
                    if n := len(out[names[0]]):
                        yield pa.RecordBatch.from_arrays([pa.array([values[0]] * n, b.schema.field(0).type), *[_column(out[c]) for c in names]], [KEY, *names])

        return self.rows.mapInArrow(run, schema)

    def samples(self) -> DataFrame:
        """(signal_id, i, x)."""
        return self.table(_samples, "i long, x double")


def _column(values: np.ndarray) -> pa.Array:
    if values.ndim == 2:
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel(), pa.float64()))
    if values.dtype == object:
        return pa.array(values.tolist())
    return pa.array(values, pa.int64() if values.dtype.kind in "iu" else None)


def samples(df: DataFrame | Signals) -> DataFrame:
    return df.samples() if isinstance(df, Signals) else df


def _filtered(df: DataFrame | Signals, fcn: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = (KEY,)) -> DataFrame | Signals:
    return df.then(fcn) if isinstance(df, Signals) else per_signal(df, lambda x: _samples(fcn(x)), "i long, x double", keys)


def per_signal(df: DataFrame | Signals, fcn: Callable[[np.ndarray], dict], columns: str, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(signal_id, columns...): the arrays of equal length, or the values, that fcn gives for each signal's samples in order.

    A signal that is too short for the kernel, or has nothing that it looks for, gives no rows; other errors are raised.
    """
    if isinstance(df, Signals):
        return df.table(fcn, columns)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("i", kind="stable")["x"].to_numpy(float)
        try:
            out = {c: np.atleast_1d(v) for c, v in fcn(x).items()}
        except k.NoResult:
            out = {c: np.zeros(0) for c in names}
        n = len(out[names[0]])
        return pd.DataFrame({c: np.repeat(rows[c].to_numpy()[:1], n) for c in keys} | out)

    return df.select(*keys, "i", "x").groupBy(*keys).applyInPandas(run, f"{kinds}, {columns}")


def _samples(y: np.ndarray) -> dict[str, np.ndarray]:
    return {"i": np.arange(len(y)), "x": y}


def filter_signal(df: DataFrame | Signals, ftype: str = "FIR", band: str = "lowpass", order: int | None = None, frequency=None, sampling_rate: float = 1000.0, keys: tuple[str, ...] = (KEY,), **options: float) -> DataFrame | Signals:
    """Zero-phase filtered samples."""
    k.get_filter(ftype, band, order, frequency, sampling_rate, **options)
    return _filtered(df, lambda x: k.filter_signal(x, ftype, band, order, frequency, sampling_rate, **options), keys)


def lfilter(df: DataFrame | Signals, b: list[float], a: list[float]) -> DataFrame | Signals:
    """Causal filter that starts as if the first sample had always been."""
    b, a = np.asarray(b, float), np.asarray(a, float)
    return _filtered(df, lambda x: k.lfilter(b, a, x, k.lfilter_zi(b, a) * x[0])[0])


def smooth(df: DataFrame | Signals, kernel: str = "boxzen", size: int = 10, mirror: bool = True, **options: float) -> DataFrame | Signals:
    return _filtered(df, lambda x: k.smooth(x, kernel, size, mirror, **options))


def analytic_signal(df: DataFrame, n: int | None = None) -> DataFrame:
    """(signal_id, i, amplitude, phase) of the analytic signal."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        z = k.analytic(x, n)
        return {"i": np.arange(len(z)), "amplitude": np.abs(z), "phase": np.angle(z)}

    return per_signal(df, run, "i long, amplitude double, phase double")


DETECTORS: dict[str, Callable] = {
    "ssf": d.ssf, "christov": d.christov, "engzee": d.engzee, "gamboa": d.gamboa, "hamilton": d.hamilton, "asi": d.asi,
    "zong": d.zong, "elgendi": d.elgendi, "kavsaoglu": lambda x, fs=1000.0, **o: d.kavsaoglu(x, fs, **o)[0],
    "heart_sounds": lambda x, fs=1000.0: d.heart_sounds(x, fs)[0],
}


def detect(df: DataFrame | Signals, detector: str, sampling_rate: float = 1000.0, **options: float) -> DataFrame:
    """(signal_id, i) of the beats or onsets that a named detector finds."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}")
    fcn = DETECTORS[detector]
    return per_signal(df, lambda x: {"i": np.asarray(fcn(x, sampling_rate, **options), dtype=np.int64)}, "i long")


def _beats(x: np.ndarray, detector: str, fs: float, tol: float, before: float, after: float) -> np.ndarray:
    """Beats moved to the highest sample, the first on a tie, within tol s, where all samples from `before` to `after` are there."""
    w, b, a = (int(t * fs) for t in (tol, before, after))
    found = {int(i) - w + int(np.argmax(x[i - w : i + w])) for i in DETECTORS[detector](x, fs) if w <= i <= len(x) - w}
    return np.array(sorted(i for i in found if b <= i <= len(x) - a), np.int64)


def corrected_beats(df: DataFrame | Signals, detector: str = "hamilton", sampling_rate: float = 1000.0, tol: float = 0.05, before: float = 0.2, after: float = 0.4) -> DataFrame:
    """(signal_id, i): a detector's beats, corrected, and left out where a heartbeat's samples would reach beyond an end."""
    return per_signal(df, lambda x: {"i": _beats(x, detector, sampling_rate, tol, before, after)}, "i long")


def heartbeats(df: DataFrame | Signals, detector: str = "hamilton", sampling_rate: float = 1000.0, tol: float = 0.05, before: float = 0.2, after: float = 0.4) -> DataFrame:
    """(signal_id, r, beat): the samples around those beats, as arrays."""
    b, a = int(before * sampling_rate), int(after * sampling_rate)

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        r = _beats(x, detector, sampling_rate, tol, before, after)
        return {"r": r, "beat": x[r[:, None] + np.arange(-b, a)]}

    if isinstance(df, Signals):
        return per_signal(df, run, "r long, beat array<double>")
    as_list = lambda x: {c: v if v.ndim == 1 else np.fromiter(v, object, len(v)) for c, v in run(x).items()}
    return per_signal(df, as_list, "r long, beat array<double>")


def kavsaoglu(df: DataFrame, sampling_rate: float = 1000.0, **options: float) -> DataFrame:
    """(signal_id, kind, i): the onsets, and as kind 'window' the ends of the windows that were searched."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        onsets, marks = d.kavsaoglu(x, sampling_rate, **options)
        return {"kind": np.array(["onset"] * len(onsets) + ["window"] * len(marks), object), "i": np.r_[onsets, marks].astype(np.int64)}

    return per_signal(df, run, "kind string, i long")


def ppg_segments(df: DataFrame, sampling_rate: float = 1000.0, select: bool = False, threshold: float | None = None) -> DataFrame:
    """(signal_id, start, stop, selected): pulses from minimum to minimum, and whether the selection keeps them."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        found = d.ppg_segments(x, sampling_rate, select, threshold)
        kept = {tuple(s) for s in found["selected"].tolist()}
        return {"start": found["segments"][:, 0], "stop": found["segments"][:, 1], "selected": np.array([not select or tuple(s) in kept for s in found["segments"].tolist()], bool)}

    return per_signal(df, run, "start long, stop long, selected boolean")


ACTIVITY: dict[str, Callable] = {"bonato": d.bonato, "lidierth": d.lidierth, "solnik": d.solnik, "londral": d.londral, "abbink": d.abbink, "silva": d.silva}


def activity(df: DataFrame, detector: str, **options) -> DataFrame:
    """(signal_id, i, kind) of the onsets and offsets that a named muscle-activity detector finds."""
    if detector not in ACTIVITY:
        raise ValueError(f"unknown detector {detector!r}")
    fcn = ACTIVITY[detector]

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        found = fcn(x, **options)
        return {"i": np.array([a for a, _ in found], np.int64), "kind": np.array([b for _, b in found], object)}

    return per_signal(df, run, "i long, kind string")


def emg_onsets(df: DataFrame | Signals, sampling_rate: float = 1000.0, size: float = 0.05, threshold: float | None = None) -> DataFrame:
    return per_signal(df, lambda x: {"i": d.emg_onsets(x, sampling_rate, size, threshold)[0].astype(np.int64)}, "i long")


def kbk_scr(df: DataFrame, sampling_rate: float = 1000.0, min_amplitude: float = 0.1) -> DataFrame:
    """(signal_id, onset, peak, amplitude) of skin-conductance responses."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        a, b, c = d.kbk(x, sampling_rate, min_amplitude)
        return {"onset": a, "peak": b, "amplitude": c}

    return per_signal(df, run, "onset long, peak long, amplitude double")


def homomorphic_filter(df: DataFrame | Signals, sampling_rate: float = 1000.0) -> DataFrame | Signals:
    return _filtered(df, lambda x: d.homomorphic(x, sampling_rate))


def average_rate(df: DataFrame | Signals, sampling_rate: float = 1000.0) -> DataFrame:
    """(signal_id, heart_rate, systolic) from an envelope."""

    def run(x: np.ndarray) -> dict[str, float]:
        a, b = d.average_rate(x, sampling_rate)
        return {"heart_rate": a, "systolic": b}

    return per_signal(df, run, "heart_rate double, systolic double")


def ppg_mean_pulse(df: DataFrame | Signals, sampling_rate: float = 1000.0, select: bool = False) -> DataFrame:
    """(signal_id, i, x): the mean pulse around the peaks."""
    return per_signal(df, lambda x: _samples(d.ppg_segments(x, sampling_rate, select)["mean_pulse"]), "i long, x double")


def filter_response(ftype: str, band: str, order: int, frequency, sampling_rate: float = 1000.0, points: int = 4096, **options: float) -> pd.DataFrame:
    """freq, magnitude (dB) and phase of a designed filter."""
    f, h = k.freqz(*k.get_filter(ftype, band, order, frequency, sampling_rate, **options), sampling_rate, points)
    return pd.DataFrame({"freq": f, "magnitude": 20 * np.log10(np.maximum(np.abs(h), 1e-300)), "phase": np.unwrap(np.angle(h))})


def pvalues(tests: DataFrame, statistic: str = "statistic", df: str = "df") -> DataFrame:
    """Adds the two-sided p-value of Student's t."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([k.t_pvalue(float(a), float(b)) if pd.notna(a) and b > 0 else None for a, b in zip(t, n, strict=True)], dtype=float)

    return tests.withColumn("pvalue", p(F.col(statistic).cast("double"), F.col(df).cast("double")))


def pearson_test(xy: DataFrame) -> DataFrame:
    """(signal_id, r, pvalue) of the correlation of x and y, by Student's t with n - 2 degrees of freedom."""
    r, n = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr("x", "y"))), F.count(F.lit(1))
    rows = xy.groupBy(KEY).agg(r.alias("r"), (n - 2).alias("df"))
    t = F.try_divide(F.col("r") * F.sqrt("df"), F.sqrt(F.lit(1.0) - F.col("r") * F.col("r")))
    return pvalues(rows.withColumn("statistic", t)).select(KEY, "r", "pvalue")
