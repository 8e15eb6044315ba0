"""Whole recordings to results: each pipeline gives a Result with one DataFrame for each kind of row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import beats as b
from ..operators import packed as p
from ..operators import signal as s
from ..operators.utils import Result

KEY = s.KEY


def _rates(found: DataFrame, fs: float) -> DataFrame:
    return s.heart_rate(found, fs, smooth=True, size=3).withColumn("ts", F.col("i") / F.lit(float(fs)))


def ecg(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    """FIR 3-45 Hz, Hamilton's detector, corrected peaks, beats of 0.2 s before to 0.4 s after, smoothed rate."""
    order = int(0.3 * fs)
    filtered = p.filter_signal(df, "FIR", "bandpass", order, [3, 45], fs)
    peaks = p.corrected_beats(filtered, "hamilton", fs)
    return Result(samples=s.add_time(p.samples(filtered), fs), rpeaks=peaks, templates=p.heartbeats(filtered, "hamilton", fs), heart_rate=_rates(peaks, fs))


def _pulse(df: DataFrame | p.Signals, fs: float, detector: str) -> Result:
    filtered = p.filter_signal(df, "butter", "bandpass", 4, [1, 8], fs)
    onsets = p.detect(filtered, detector, fs)
    return Result(samples=s.add_time(p.samples(filtered), fs, endpoint=False), onsets=onsets, heart_rate=_rates(onsets, fs))


def abp(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    """Band 1-8 Hz, onsets by the slope sum, smoothed rate."""
    return _pulse(df, fs, "zong")


def bvp(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    return _pulse(df, fs, "elgendi")


def ppg(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    return _pulse(df, fs, "elgendi")


def eda(df: DataFrame, fs: float = 1000.0, min_amplitude: float = 0.1) -> Result:
    """Low-pass 5 Hz, smoothed over 0.75 s, responses."""
    filtered = p.smooth(p.filter_signal(df, "butter", "lowpass", 4, 5, fs), "boxzen", int(0.75 * fs))
    return Result(samples=s.add_time(filtered, fs), responses=p.kbk_scr(filtered, fs, min_amplitude))


def emg(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    """High-pass 100 Hz, onsets."""
    filtered = p.filter_signal(df, "butter", "highpass", 4, 100, fs)
    return Result(samples=s.add_time(p.samples(filtered), fs), onsets=p.emg_onsets(filtered, fs))


def pcg(df: DataFrame | p.Signals, fs: float = 1000.0) -> Result:
    """Band 25-400 Hz, peaks of the envelope, first and second sounds, mean rate and the rate of first sounds."""
    filtered = p.filter_signal(df, "butter", "bandpass", 2, [25, 400], fs)
    sounds = b.identify_heart_sounds(p.detect(filtered, "heart_sounds", fs))
    average = p.average_rate(p.homomorphic_filter(filtered, fs), fs)
    return Result(samples=s.add_time(p.samples(filtered), fs), sounds=sounds, average=average, heart_rate=s.heart_rate(sounds.where("sound = 1").select(KEY, "i"), fs))


def resp(df: DataFrame, fs: float = 1000.0) -> Result:
    """Band 0.1-0.35 Hz, zero crossings, rate in Hz, smoothed."""
    filtered = p.filter_signal(df, "butter", "bandpass", 2, [0.1, 0.35], fs)
    rates = b.resp_rate(filtered, fs)
    place = rates.select(KEY, (F.row_number().over(s.by_signal()).cast("long") - 1).alias("k"), "i", "rate")
    flat = s.smoother_boxcar(place.select(KEY, F.col("k").alias("i"), F.col("rate").alias("x")), 3).select(KEY, F.col("i").alias("k"), F.col("x").alias("rate"))
    return Result(samples=s.add_time(filtered, fs), zeros=s.zero_cross(filtered, detrend=True), resp_rate=place.drop("rate").join(flat, [KEY, "k"]).select(KEY, "i", "rate"))


def acc(df: DataFrame, fs: float = 100.0) -> Result:
    """(signal_id, i, x, y, z): magnitudes, and the amplitude spectrum of each axis."""
    long = df.select(KEY, "i", F.expr("stack(3, 'x', x, 'y', y, 'z', z) as (axis, v)")).withColumnRenamed("v", "x")
    spectrum = s.dft(long, key=[KEY, "axis"])
    amplitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    return Result(samples=s.add_time(s.acc_time_features(df), fs), spectrum=spectrum.select(KEY, "axis", "k", (F.col("k") * F.lit(float(fs)) / F.col("n")).alias("freq"), amplitude.alias("abs_amp")))


# The bands of the EEG, in Hz.
BANDS = {"theta": (4, 8), "alpha_low": (8, 10), "alpha_high": (10, 13), "beta": (13, 25), "gamma": (25, 40)}


def _channel_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """(signal_id, channel, start, i, x): samples of (signal_id, channel, i, x) in each window."""
    one = df.withColumn("__key", F.struct(KEY, "channel")).select(F.col("__key").alias(KEY), "i", "x")
    return s.windows(one, size, step).select(F.col(f"{KEY}.{KEY}").alias(KEY), F.col(f"{KEY}.channel").alias("channel"), "start", F.col("k").alias("i"), "x")


def _median_over(df: DataFrame, value: str, size: int, keys: list[str]) -> DataFrame:
    """Running median of an odd size over windows in order; those beyond the ends count as 0."""
    half = size // 2
    frame = F.collect_list(value).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(-half, half))
    return df.withColumn(value, F.element_at(F.array_sort(F.concat(frame, F.array_repeat(F.lit(0.0), 2 * half + 1 - F.size(frame)))), half + 1))


def _feature_grid(fs: float, size: float, overlap: float) -> tuple[int, int, int]:
    n = int(size * fs)
    step = max(1, int(n * (1 - overlap)))
    odd = int(0.625 * fs / step)
    return n, step, max(1, odd + 1 - odd % 2)


def eeg_power_features(df: DataFrame, fs: float = 1000.0, size: float = 0.25, overlap: float = 0.5, points: int = 1024) -> DataFrame:
    """(signal_id, channel, start, band, power): mean power of each band in Hann windows padded to 1024 points, by a running median."""
    n, step, odd = _feature_grid(fs, size, overlap)
    rows = _channel_windows(df, n, step).withColumnRenamed("i", "k")
    rows = rows.withColumn("x", F.col("x") * s.hann(n)).withColumnRenamed("k", "i")
    key = [KEY, "channel", "start"]
    spectrum = s.power_spectrum(rows, fs, pad=max(0, points - n), decibel=False, key=key)
    out = None
    for name, (low, high) in BANDS.items():
        part = s.band_power(spectrum, low, high, decibel=False, key=key).select(*key, F.lit(name).alias("band"), F.col("band_power").alias("power"))
        out = part if out is None else out.unionByName(part)
    return _median_over(out, "power", odd, [KEY, "channel", "band"])


def eeg_plf_features(df: DataFrame, fs: float = 1000.0, size: float = 0.25, overlap: float = 0.5) -> DataFrame:
    """(signal_id, one, two, start, plf): phase locking of each two channels in each window, by a running median."""
    n, step, odd = _feature_grid(fs, size, overlap)
    rows = _channel_windows(df, n, step)
    flat = p.per_signal(rows, _phases, "i long, phase double", (KEY, "channel", "start"))
    other = flat.select(KEY, F.col("channel").alias("two"), "start", "i", F.col("phase").alias("p2"))
    d = F.col("phase") - F.col("p2")
    pairs = flat.join(other, [KEY, "start", "i"]).where("channel < two").groupBy(KEY, F.col("channel").alias("one"), "two", "start")
    plf = pairs.agg(F.sqrt(F.pow(F.avg(F.cos(d)), F.lit(2)) + F.pow(F.avg(F.sin(d)), F.lit(2))).alias("plf"))
    return _median_over(plf, "plf", odd, [KEY, "one", "two"])


def _phases(x):
    import numpy as np

    from ..functions.kernels import analytic

    return {"i": np.arange(len(x)), "phase": np.angle(analytic(x))}


def eeg(df: DataFrame, fs: float = 1000.0) -> Result:
    """(signal_id, channel, i, x): high-pass 4 Hz, low-pass 40 Hz, band power and phase locking."""
    keys = (KEY, "channel")
    flat = p.filter_signal(p.filter_signal(df, "butter", "highpass", 8, 4, fs, keys), "butter", "lowpass", 16, 40, fs, keys)
    return Result(samples=flat, power=eeg_power_features(flat, fs), plf=eeg_plf_features(flat, fs))
