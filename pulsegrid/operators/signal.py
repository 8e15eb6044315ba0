"""Primitives over signals: tables (signal_id, i, x) with i from 0, one row a sample.

Everything here is windows, joins and aggregates partitioned by signal_id, but for the Fourier transform and the matrix
profile, which are numpy over whole signals. Null samples should be
dropped before they are numbered. Ties go to the smallest index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .utils import numbered

KEY = "signal_id"
#: Query windows that one task of a matrix profile searches for.
PROFILE_BLOCK = 4_096


def by_signal(order: str = "i", key: str = KEY):
    return Window.partitionBy(key).orderBy(order)


def whole(key: str = KEY):
    return Window.partitionBy(key)


def number_samples(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(signal_id, i, x) of rows in a total order; rows without a value are dropped first."""
    rows = df.where(F.col(value).isNotNull())
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1
    return rows.select(F.col(key).alias(KEY), i.alias("i"), F.col(value).cast("double").alias("x"))


def norm_freq(frequency: Column | float, sampling_rate: float = 1000.0) -> Column:
    """A frequency as a fraction of half the sampling rate."""
    return F.lit(2.0) * (frequency if isinstance(frequency, Column) else F.lit(float(frequency))) / F.lit(float(sampling_rate))


def add_time(df: DataFrame, sampling_rate: float, endpoint: bool = True) -> DataFrame:
    """Adds ts in seconds; without the endpoint the steps are (n-1)/n as long."""
    ts = F.col("i") / F.lit(float(sampling_rate))
    return df.withColumn("ts", ts if endpoint else ts * (F.count(F.lit(1)).over(whole()) - 1) / F.count(F.lit(1)).over(whole()))


def normalize(df: DataFrame, ddof: int = 1) -> DataFrame:
    """Zero mean, unit deviation. A constant signal has no deviation: null."""
    dev = F.stddev_samp("x") if ddof else F.stddev_pop("x")
    return df.select(KEY, "i", F.try_divide(F.col("x") - F.avg("x").over(whole()), dev.over(whole())).alias("x"))


def signal_stats(df: DataFrame) -> DataFrame:
    """Mean, median, extremes, deviations, and bias-corrected kurtosis and skewness of each signal."""
    mid = F.median("x").over(whole())
    rows = df.select(KEY, "x", F.avg("x").over(whole()).alias("m"), mid.alias("mid"))
    n, g2, g1 = F.count(F.lit(1)).cast("double"), F.kurtosis("x"), F.skewness("x")
    return rows.groupBy(KEY).agg(
        F.avg("x").alias("mean"),
        F.median("x").alias("median"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.max(F.abs(F.col("x") - F.col("m"))).alias("max_amp"),
        F.var_samp("x").alias("var"),
        F.stddev_samp("x").alias("std_dev"),
        F.avg(F.abs(F.col("x") - F.col("mid"))).alias("abs_dev"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1).alias("skewness"),
    )


def convolve_same(df: DataFrame, kernel: list[float], mirror: bool = False) -> DataFrame:
    """Output i is the kernel, reversed, over samples i - m//2 .. i + (m-1)//2; beyond the ends the edge value or nothing."""
    m = len(kernel)
    w, first, last = by_signal(), F.first("x").over(by_signal().rowsBetween(Window.unboundedPreceding, 0)), F.last("x").over(by_signal().rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(0.0)
    for k, weight in enumerate(kernel):
        step = (m - 1) // 2 - k
        x = F.lead("x", step).over(w) if step > 0 else F.lag("x", -step).over(w) if step < 0 else F.col("x")
        total = total + F.lit(float(weight)) * F.coalesce(x, (last if step > 0 else first) if mirror else F.lit(0.0))
    return df.select(KEY, "i", total.alias("x"))


def smoother_boxcar(df: DataFrame, size: int = 10, mirror: bool = True) -> DataFrame:
    """Moving average of `size` samples (at most one less than the signal has, at least 1), edges repeated."""
    n = F.count(F.lit(1)).over(whole())
    first, last = F.min_by("x", "i").over(whole()), F.max_by("x", "i").over(whole())
    m = F.greatest(F.lit(1), F.least(F.lit(size), n - 1))
    rows = df.select(KEY, "i", "x", n.alias("n"), first.alias("first"), last.alias("last"), m.alias("m"))
    frame = by_signal().rowsBetween(-(size // 2), (size - 1) // 2)
    back, ahead = F.floor(F.col("m") / 2), F.floor((F.col("m") - 1) / 2)
    # Only signals not longer than the window have a smaller one; theirs is summed over an array.
    fits = F.sum("x").over(frame)
    small = F.aggregate(F.filter(F.collect_list(F.struct("i", "x")).over(frame), lambda s: s["i"].between(F.col("i") - back, F.col("i") + ahead)), F.lit(0.0), lambda a, s: a + s["x"])
    inner = F.when(F.col("m") == size, fits).otherwise(small) if size > 1 else F.col("x")
    edges = F.greatest(F.lit(0), back - F.col("i")) * F.col("first") + F.greatest(F.lit(0), ahead - (F.col("n") - 1 - F.col("i"))) * F.col("last")
    return rows.select(KEY, "i", ((inner + (edges if mirror else F.lit(0.0))) / F.col("m")).alias("x"))


def smoother_median(df: DataFrame, size: int = 5) -> DataFrame:
    """Running median of an odd number of samples; samples beyond the ends count as 0."""
    half = size // 2
    frame = F.collect_list("x").over(by_signal().rowsBetween(-half, half))
    padded = F.concat(frame, F.array_repeat(F.lit(0.0), 2 * half + 1 - F.size(frame)))
    return df.select(KEY, "i", F.element_at(F.array_sort(padded), half + 1).alias("x"))


def zero_cross(df: DataFrame, detrend: bool = False) -> DataFrame:
    """Indices before which and after which the sign differs; 0 has a sign of its own."""
    x = F.col("x") - F.avg("x").over(whole()) if detrend else F.col("x")
    rows = df.select(KEY, "i", F.signum(x).alias("s"))
    return rows.withColumn("next", F.lead("s").over(by_signal())).where("s <> next").select(KEY, "i")


def find_extrema(df: DataFrame, mode: str = "both") -> DataFrame:
    """Indices where the sign of the slope falls (max), rises (min) or changes; either edge of a plateau counts."""
    if mode not in ("max", "min", "both"):
        raise ValueError("mode must be 'max', 'min' or 'both'")
    w = by_signal()
    turn = F.signum(F.lead("x").over(w) - F.col("x")) - F.signum(F.col("x") - F.lag("x").over(w))
    found = {"max": "turn < 0", "min": "turn > 0", "both": "turn <> 0"}[mode]
    return df.withColumn("turn", turn).where(found).select(KEY, "i", "x")


def finite_difference(df: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum over an odd number of neighbours; indices without all of them are left out."""
    if len(weights) % 2 == 0:
        raise ValueError("the number of weights must be odd")
    half, w = len(weights) // 2, by_signal()
    total, count = F.lit(0.0), F.count(F.lit(1)).over(whole())
    for k, weight in enumerate(weights):
        step = k - half
        total = total + F.lit(float(weight)) * (F.lead("x", step).over(w) if step > 0 else F.lag("x", -step).over(w) if step < 0 else F.col("x"))
    rows = df.select(KEY, "i", total.alias("x"), count.alias("n"))
    return rows.where((F.col("i") >= half) & (F.col("i") < F.col("n") - half)).select(KEY, "i", "x")


def windows(df: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """(signal_id, start, k, x): each sample in each whole window that has it, at place k."""
    step = step or size
    if step < 1 or size < 1:
        raise ValueError("size and step must be positive")
    n = F.count(F.lit(1)).over(whole())
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step))
    high = F.least(F.floor(F.col("i") / step), F.floor((n - size) / step))
    rows = df.withColumn("low", low).withColumn("high", high).where("high >= low")
    placed = rows.withColumn("turn", F.explode(F.sequence("low", "high"))).withColumn("start", (F.col("turn") * step).cast("long"))
    return placed.select(KEY, "start", (F.col("i") - F.col("start")).alias("k"), "x")


def windower(df: DataFrame, size: int, step: int | None, fcn: Callable[[Column], Column], kernel: list[float] | None = None) -> DataFrame:
    """(signal_id, start, value): an aggregate of each window, its samples weighted by a kernel if given."""
    rows = windows(df, size, step)
    if kernel is not None:
        rows = rows.withColumn("x", F.col("x") * F.element_at(F.array(*[F.lit(float(v)) for v in kernel]), F.col("k").cast("int") + 1))
    return rows.groupBy(KEY, "start").agg(fcn(F.col("x")).alias("value"))


def windower_array(df: DataFrame, size: int, step: int | None, fcn: Callable[[np.ndarray], object], kernel: list[float] | None = None) -> DataFrame:
    """(signal_id, start, p, value): any function of a window's samples, which gives a number or an array; p is the place in it.

    A Python function for what no aggregate expresses: one Arrow call per signal, which must fit a task.
    """
    step = step or size
    if step < 1 or size < 1:
        raise ValueError("size and step must be positive")
    if kernel is not None and len(kernel) != size:
        raise ValueError("the kernel must be as long as a window")

    def run(rows: pa.Table) -> pa.Table:
        x = np.asarray(rows.sort_by("i").column("x"), float)
        starts = range(0, len(x) - size + 1, step)
        values = [np.atleast_1d(fcn(x[a : a + size] if kernel is None else x[a : a + size] * np.asarray(kernel, float))).astype(float) for a in starts]
        n = [len(v) for v in values]
        start = np.repeat(np.array(starts, np.int64), n)
        return pa.table({KEY: pa.repeat(rows.column(KEY)[0], len(start)), "start": start, "p": np.concatenate([np.arange(k) for k in n] or [np.zeros(0)]).astype(np.int32), "value": np.concatenate(values or [np.zeros(0)])})

    kind = df.schema[KEY].dataType.simpleString()
    return df.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, start long, p int, value double")


def waves(df: DataFrame, size: int, step: int | None = None, how: str = "mean", order: str = "row_id", vector: str = "v") -> DataFrame:
    """(start, wave): positionwise mean or median of each block of `size` rows in order."""
    step = step or size
    placed_rows, n = numbered(df.select(F.col(order).alias("o"), vector), "i", "o")
    rows = placed_rows.select("i", F.posexplode(vector).alias("p", "x"))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)), F.least(F.floor(F.col("i") / step), F.floor(F.lit((n - size) / step)))
    placed = rows.withColumn("low", low).withColumn("high", high).where("high >= low").withColumn("turn", F.explode(F.sequence("low", "high"))).withColumn("start", F.col("turn") * step)
    value = F.avg("x") if how == "mean" else F.median("x")
    return placed.groupBy("start", "p").agg(value.alias("x")).select(F.col("start").cast("long").alias("start"), "p", "x")


def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(signal_id, i, x, y) where both signals have a sample."""
    return x.join(y.withColumnRenamed("x", "y"), [KEY, "i"])


def rms_error(xy: DataFrame) -> DataFrame:
    return xy.groupBy(KEY).agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2)))).alias("rmse"))


def pearson_correlation(xy: DataFrame) -> DataFrame:
    """Correlation from raw sums, within -1 and 1."""
    return xy.groupBy(KEY).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr("x", "y"))).alias("r"))


def linear_regression(xy: DataFrame) -> DataFrame:
    return xy.groupBy(KEY).agg(F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("b"))


def paired_test(xy: DataFrame) -> DataFrame:
    """Student's t of the differences, with its degrees of freedom."""
    d = F.col("x") - F.col("y")
    n = F.count(F.lit(1))
    return xy.groupBy(KEY).agg(F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(n)).alias("statistic"), (n - 1).alias("df"))


def unpaired_test(xy: DataFrame) -> DataFrame:
    """Student's t of two samples of equal size and variance."""
    n = F.count(F.lit(1))
    pooled = (F.var_samp("x") + F.var_samp("y")) / 2
    return xy.groupBy(KEY).agg(F.try_divide(F.avg("x") - F.avg("y"), F.sqrt(pooled * 2 / n)).alias("statistic"), (2 * n - 2).alias("df"))


def cross_correlation(xy_x: DataFrame, xy_y: DataFrame, detrend: bool = True) -> DataFrame:
    """(signal_id, lag, c): sum of x[i + lag] * y[i], over all lags at which the signals overlap, by FFT of whole signals."""
    kind = xy_x.schema[KEY].dataType.simpleString()
    slim = lambda d: d.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    x, y = slim(xy_x), slim(xy_y)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        lag, c = np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            lag, c = kernels.correlation(*(np.asarray(t.column(n)) for t in (a, b) for n in ("i", "x")), detrend)
        return pa.table({KEY: (a if a.num_rows else b).column(KEY).take(pa.array(np.zeros(len(lag), np.int64))), "lag": lag, "c": c})

    return x.groupBy(KEY).cogroup(y.toDF(*y.columns).groupBy(KEY)).applyInArrow(run, f"{KEY} {kind}, lag long, c double")


def synchronize(x: DataFrame, y: DataFrame, detrend: bool = True, digits: int = 9) -> DataFrame:
    """(signal_id, delay, corr): the lag of the largest cross-correlation, the smallest on a tie to `digits` places."""
    c = cross_correlation(x, y, detrend).withColumn("c", F.round("c", digits))
    return c.groupBy(KEY).agg(F.max_by("lag", F.struct("c", -F.col("lag"))).alias("delay"), F.max("c").alias("corr"))


def aligned(x: DataFrame, y: DataFrame, delays: DataFrame) -> DataFrame:
    """(signal_id, i, x, y): the overlap of x and y once y is shifted by its delay, from 0."""
    shifted = y.join(delays.select(KEY, "delay"), KEY).select(KEY, (F.col("i") + F.col("delay")).alias("i"), F.col("x").alias("y"))
    rows = x.join(shifted, [KEY, "i"])
    return rows.select(KEY, (F.row_number().over(by_signal()).cast("long") - 1).alias("i"), "x", "y")


def heart_rate(beats: DataFrame, sampling_rate: float = 1000.0, smooth: bool = False, size: int = 3) -> DataFrame:
    """(signal_id, i, hr): beats a minute at the later of each two beats, those from 40 to 200 only."""
    gap = F.col("i") - F.lag("i").over(by_signal())
    rows = beats.withColumn("hr", F.try_divide(F.lit(60.0 * sampling_rate), gap.cast("double"))).where("hr between 40 and 200").select(KEY, "i", "hr")
    if not smooth:
        return rows
    placed = rows.select(KEY, (F.row_number().over(by_signal()).cast("long") - 1).alias("k"), "i", "hr")
    flat = smoother_boxcar(placed.select(KEY, F.col("k").alias("i"), F.col("hr").alias("x")), size)
    return placed.join(flat.select(KEY, F.col("i").alias("k"), "x"), [KEY, "k"]).select(KEY, "i", F.col("x").alias("hr"))


def dft(df: DataFrame, points: int | None = None, key: list[str] | None = None, pad: int = 0) -> DataFrame:
    """(key, k, re, im, n, samples): the discrete Fourier transform at bins below half of n, an FFT for each signal.

    n is `points`, or by default the number of samples and `pad`. Signals of fewer than 2 points have no bins.
    """
    key = key or [KEY]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def run(rows: pa.Table) -> pa.Table:
        m = rows.num_rows
        n = points or m + pad
        z = kernels.spectrum(np.asarray(rows.column("x"), float), np.asarray(rows.column("i")), n) if n >= 2 else np.zeros(0, complex)
        same = {c: pa.repeat(rows.column(c)[0], len(z)) for c in key}
        return pa.table(same | {"k": pa.array(np.arange(len(z)), pa.int64()), "re": z.real.copy(), "im": z.imag.copy(), "n": pa.repeat(pa.scalar(n, pa.int64()), len(z)), "samples": pa.repeat(pa.scalar(m, pa.int64()), len(z))})

    return df.select(*key, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).groupBy(*key).applyInArrow(run, f"{kinds}, k long, re double, im double, n long, samples long")


def power_spectrum(df: DataFrame, sampling_rate: float = 1000.0, pad: int = 0, decibel: bool = True, true_bins: bool = False, key: list[str] | None = None) -> DataFrame:
    """(key, k, freq, power) of the one-sided spectrum; `pad` zeros are appended.

    Frequencies run evenly from 0 to half the rate, the last bin's included, unless true_bins. Bins
    above the first are doubled in amplitude.
    """
    key = key or [KEY]
    scaled = dft(df, key=key, pad=pad)
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("samples")
    power = F.pow(amp * F.when(F.col("k") > 0, 2.0).otherwise(1.0), F.lit(2))
    half = F.expr("n div 2")
    freq = F.col("k") * F.lit(float(sampling_rate)) / F.col("n") if true_bins else F.when(half > 1, F.col("k") * (F.lit(sampling_rate / 2.0) / (half - 1))).otherwise(0.0)
    return scaled.select(*key, "k", freq.alias("freq"), (F.lit(10.0) * F.log10(power) if decibel else power).alias("power"))


def hann(size: int, symmetric: bool = True) -> Column:
    """Weight of place k in a Hann window."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0) * F.pi() * F.col("k") / F.lit(float(max(1, size - 1 if symmetric else size))))


def welch_spectrum(df: DataFrame, sampling_rate: float = 1000.0, size: int | None = None, overlap: int | None = None, decibel: bool = True, scaling: str = "spectrum", double: bool = True) -> DataFrame:
    """(signal_id, k, freq, power): mean spectrum of overlapping Hann windows less their means, one-sided.

    `double` doubles the power once more, as the toolbox does that this replaces; scaling may be "density".
    """
    if scaling not in ("spectrum", "density"):
        raise ValueError("scaling must be 'spectrum' or 'density'")
    size = int(size or sampling_rate)
    step = size - (size // 2 if overlap is None else overlap)
    if step < 1:
        raise ValueError("windows must overlap by less than their size")
    # The Hann window's sum, and that of its squares.
    scale = 4.0 / (size * size) if scaling == "spectrum" else 8.0 / (3.0 * size * sampling_rate)
    kind = df.schema[KEY].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        x = np.asarray(rows.sort_by("i").column("x"), float)
        power = kernels.mean_periodogram(x, size, step) * (scale * (2.0 if double else 1.0))
        return pa.table({KEY: pa.repeat(rows.column(KEY)[0], len(power)), "k": np.arange(len(power), dtype=np.int64), "power": power})

    out = df.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, k long, power double")
    return out.select(KEY, "k", (F.col("k") * F.lit(float(sampling_rate)) / size).alias("freq"), (F.lit(10.0) * F.log10("power") if decibel else F.col("power")).alias("power"))


def band_power(spectrum: DataFrame, low: float, high: float, decibel: bool = True, key: list[str] | None = None) -> DataFrame:
    """Mean power of the bins from low to high, both included; the band is ordered and clamped to the spectrum."""
    low, high = min(low, high), max(low, high)
    over = Window.partitionBy(*(key or [KEY]))
    rows = spectrum.withColumn("__lo", F.greatest(F.lit(float(low)), F.min("freq").over(over))).withColumn("__hi", F.least(F.lit(float(high)), F.max("freq").over(over)))
    power = F.pow(F.lit(10.0), F.col("power") / 10) if decibel else F.col("power")
    mean = F.avg(power)
    return rows.where("freq between __lo and __hi").groupBy(*(key or [KEY])).agg((F.lit(10.0) * F.log10(mean) if decibel else mean).alias("band_power"))


def find_intersection(one: DataFrame, two: DataFrame) -> DataFrame:
    """(signal_id, x, y): where two piecewise-linear curves (signal_id, t, y) over the same t cross or touch."""
    both = one.join(two.withColumnRenamed("y", "z"), [KEY, "t"])
    w = by_signal("t")
    rows = both.withColumn("d", F.col("y") - F.col("z")).withColumn("d1", F.lead("d").over(w)).withColumn("t1", F.lead("t").over(w)).withColumn("y1", F.lead("y").over(w))
    share = F.when(F.col("d") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("d"), F.col("d") - F.col("d1")))
    hit = rows.where("d = 0 or (d1 is not null and d1 <> 0 and signum(d) <> signum(d1))").withColumn("s", share)
    at = F.col("t") + F.coalesce(F.col("s") * (F.col("t1") - F.col("t")), F.lit(0.0))
    return hit.select(KEY, at.alias("x"), (F.col("y") + F.coalesce(F.col("s") * (F.col("y1") - F.col("y")), F.lit(0.0))).alias("y"))


def _normal_windows(df: DataFrame, size: int) -> DataFrame:
    """(signal_id, start, v, m, s): every window of `size` samples as an array, its mean and population deviation."""
    w = by_signal().rowsBetween(0, size - 1)
    rows = df.select(KEY, F.col("i").alias("start"), F.collect_list("x").over(w).alias("v"), F.avg("x").over(w).alias("m"), F.stddev_pop("x").over(w).alias("s"))
    return rows.where(F.size("v") == size)


def _normal_distance(size: int) -> Column:
    dot = F.aggregate(F.zip_with("v", "v2", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    corr = F.try_divide(dot - F.lit(float(size)) * F.col("m") * F.col("m2"), F.lit(float(size)) * F.col("s") * F.col("s2"))
    return F.sqrt(F.abs(F.lit(2.0 * size) * (F.lit(1.0) - corr)))


def distance_profile(query: DataFrame, df: DataFrame, size: int, metric: str = "euclidean") -> DataFrame:
    """(signal_id, start, d): z-normalised distance of one query window (signal_id, v, m, s) to every window."""
    other = _normal_windows(df, size)
    q = query.select(KEY, F.col("v").alias("v2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    d = _normal_distance(size)
    if metric == "pearson":
        d = F.lit(1.0) - F.abs(d * d) / F.lit(2.0 * size)
    elif metric != "euclidean":
        raise ValueError("metric must be 'euclidean' or 'pearson'")
    return other.join(q, KEY).select(KEY, "start", d.alias("d"))


def first_window(df: DataFrame, size: int) -> DataFrame:
    return _normal_windows(df, size).where("start = 0")


def matrix_profile(df: DataFrame, other: DataFrame | None, size: int, limit: Column | None = None, digits: int = 6) -> DataFrame:
    """(signal_id, start, d, neighbour): each window's nearest one, in the same signal or in another with its id.

    In the same signal, windows within round(size / 4) don't count. Distances tie at `digits` places; the
    same signal then gives the first neighbour, another the last. `limit` keeps a part of the query windows. Windows are
    searched for in blocks of PROFILE_BLOCK, each a task that holds the signal; no pair of windows is a row.
    """
    one = df.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    count = Window.partitionBy(KEY)
    blocks = F.expr(f"cast(greatest(0, (n - {size}) div {PROFILE_BLOCK}) as int)")
    dealt = one.withColumn("n", F.count(F.lit(1)).over(count)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks))).select(KEY, "block", "i", "x")
    skip = round(size / 4) if other is None else None
    schema = f"{KEY} {df.schema[KEY].dataType.simpleString()}, start long, d double, neighbour long"

    def run(mine: pa.Table, theirs: pa.Table | None = None) -> pa.Table:
        mine = mine.sort_by("i")
        theirs = mine if theirs is None else theirs.sort_by("i")
        x, y = np.asarray(mine.column("x")), np.asarray(theirs.column("x"))
        first = mine.column("block")[0].as_py() * PROFILE_BLOCK if mine.num_rows else 0
        at, d, near = kernels.nearest_windows(x, y, size, first, first + PROFILE_BLOCK, skip, digits)
        key = mine.column(KEY) if mine.num_rows else theirs.column(KEY)
        return pa.table({KEY: key.take(pa.array(np.zeros(len(at), np.int64))), "start": mine.column("i").take(pa.array(at)), "d": pa.array(d), "neighbour": theirs.column("i").take(pa.array(near))})

    if other is None:
        found = dealt.groupBy(KEY, "block").applyInArrow(lambda t: run(t), schema)
    else:
        every = dealt.select(KEY, "block").distinct()
        two = other.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).join(every, KEY).select(KEY, "block", "i", "x")
        two = two.toDF(*two.columns)  # columns of their own, as both may come from one table
        found = dealt.groupBy(KEY, "block").cogroup(two.groupBy(KEY, "block")).applyInArrow(lambda a, b: run(a, b), schema)
    return found if limit is None else found.join(_normal_windows(df, size).where(limit).select(KEY, "start"), [KEY, "start"], "left_semi")


def car_reference(df: DataFrame) -> DataFrame:
    """Each channel less the mean of all channels of the sample: (signal_id, channel, i, x)."""
    return df.select(KEY, "channel", "i", (F.col("x") - F.avg("x").over(Window.partitionBy(KEY, "i"))).alias("x"))


def phase_locking(phases: DataFrame) -> DataFrame:
    """(signal_id, plf) of the phases p1, p2 of two signals."""
    d = F.col("p1") - F.col("p2")
    return phases.groupBy(KEY).agg(F.sqrt(F.pow(F.avg(F.cos(d)), F.lit(2)) + F.pow(F.avg(F.sin(d)), F.lit(2))).alias("plf"))


def acc_time_features(df: DataFrame) -> DataFrame:
    """Adds vm, the length of (x, y, z), and sm, the mean of their magnitudes."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return df.withColumn("vm", F.sqrt(x * x + y * y + z * z)).withColumn("sm", (F.abs(x) + F.abs(y) + F.abs(z)) / 3)
