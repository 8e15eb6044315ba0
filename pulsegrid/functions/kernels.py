"""Numeric kernels in plain numpy, without Spark: filter design, filtering, windows, spectra, peaks, tests, linkage."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# --- windows -----------------------------------------------------------------------------------------------

# Cosine-sum coefficients of the named windows.
COSINE_SUMS = {
    "blackman": (0.42, 0.5, 0.08),
    "hamming": (0.54, 0.46),
    "hann": (0.5, 0.5),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}
ALIASES = {"rectangular": "boxcar", "hanning": "hann", "parzan": "parzen", "triangle": "triang", "slepian": "slepian", "chebyshev": "chebwin"}


def window(kernel: str, size: int, **options: float) -> np.ndarray:
    """Symmetric window of a name; unknown names are ValueErrors, missing parameters TypeErrors."""
    if not isinstance(kernel, str):
        raise TypeError("a kernel is named by a string")
    name = ALIASES.get(kernel, kernel)
    if size <= 1:
        return np.ones(max(size, 0))
    n, m = np.arange(size), size - 1
    u = 2 * n / m - 1
    need = {"kaiser": ("beta",), "gaussian": ("std",), "general_gaussian": ("power", "width"), "slepian": ("width",), "chebwin": ("attenuation",)}.get(name, ())
    if missing := [x for x in need if x not in options]:
        raise TypeError(f"{name} needs {', '.join(missing)}")
    if name in COSINE_SUMS:
        return sum((-1) ** k * c * np.cos(2 * np.pi * k * n / m) for k, c in enumerate(COSINE_SUMS[name]))
    if name == "boxcar":
        return np.ones(size)
    if name == "bartlett":
        return 1 - np.abs(u)
    if name == "triang":
        half = (size + 1) / 2 if size % 2 else size / 2
        return 1 - np.abs(n - m / 2) / half
    if name == "parzen":
        d = np.abs(n - m / 2) / (size / 2)
        return np.where(d <= 0.5, 1 - 6 * d**2 * (1 - d), 2 * (1 - d) ** 3)
    if name == "bohman":
        w = (1 - np.abs(u)) * np.cos(np.pi * np.abs(u)) + np.sin(np.pi * np.abs(u)) / np.pi
        w[[0, -1]] = 0
        return w
    if name == "barthann":
        f = np.abs(n / m - 0.5)
        return 0.62 - 0.48 * f + 0.38 * np.cos(2 * np.pi * f)
    if name == "cosine":
        return np.sin(np.pi * (n + 0.5) / size)
    if name == "kaiser":
        return np.i0(options["beta"] * np.sqrt(np.maximum(0, 1 - u**2))) / np.i0(options["beta"])
    if name == "gaussian":
        return np.exp(-0.5 * ((n - m / 2) / options["std"]) ** 2)
    if name == "general_gaussian":
        return np.exp(-0.5 * np.abs((n - m / 2) / options["width"]) ** (2 * options["power"]))
    if name == "slepian":
        # The sequence that has most energy in the band is the first eigenvector of a tridiagonal matrix.
        w = options["width"] / 2
        diagonal = ((m - 2 * n) / 2) ** 2 * np.cos(2 * np.pi * w)
        beside = n[1:] * (size - n[1:]) / 2
        vector = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))[1][:, -1]
        return np.abs(vector) / np.abs(vector).max()
    if name == "chebwin":
        order = size - 1
        beta = np.cosh(np.arccosh(10 ** (abs(options["attenuation"]) / 20)) / order)
        x = beta * np.cos(np.pi * n / size)
        inside = np.abs(x) <= 1
        p = np.empty(size)
        p[inside] = np.cos(order * np.arccos(x[inside]))
        p[x > 1] = np.cosh(order * np.arccosh(x[x > 1]))
        p[x < -1] = (2 * (size % 2) - 1) * np.cosh(order * np.arccosh(-x[x < -1]))
        if size % 2:
            w = np.real(np.fft.fft(p))
            half = (size + 1) // 2
            w = np.concatenate((w[half - 1 : 0 : -1], w[:half]))
        else:
            w = np.real(np.fft.fft(p * np.exp(1j * np.pi / size * n)))
            half = size // 2 + 1
            w = np.concatenate((w[half - 1 : 0 : -1], w[1:half]))
        return w / w.max()
    raise ValueError(f"unknown kernel {kernel!r}")


# --- filter design -------------------------------------------------------------------------------------------


def firwin(taps: int, cutoff, band: str) -> np.ndarray:
    """Windowed-sinc taps (Hamming) with unit gain in the middle of the pass band; cutoffs as fractions of Nyquist."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if edges.min() <= 0 or edges.max() >= 1:
        raise ValueError("cutoff frequencies must lie between 0 and half the sampling rate")
    bands = {"lowpass": [(0.0, edges[0])], "highpass": [(edges[0], 1.0)], "bandpass": [tuple(edges)], "bandstop": [(0.0, edges[0]), (edges[-1], 1.0)]}[band]
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in bands) * window("hamming", taps)
    lo, hi = bands[0]
    at = 0.0 if lo == 0 else 1.0 if hi == 1 else (lo + hi) / 2
    return h / np.sum(h * np.cos(np.pi * m * at))


def _prototype(kind: str, order: int, rp: float, rs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analog low-pass filter with its edge at 1."""
    k = np.arange(-order + 1, order, 2)
    if kind == "butter":
        return np.array([]), -np.exp(1j * np.pi * k / (2 * order)), 1.0
    if kind == "cheby1":
        eps = math.sqrt(10 ** (0.1 * rp) - 1)
        mu, theta = math.asinh(1 / eps) / order, np.pi * k / (2 * order)
        p = -np.sinh(mu + 1j * theta)
        gain = np.prod(-p).real
        return np.array([]), p, gain / math.sqrt(1 + eps * eps) if order % 2 == 0 else gain
    if kind == "cheby2":
        de = 1 / math.sqrt(10 ** (0.1 * rs) - 1)
        mu = math.asinh(1 / de) / order
        zk = k if order % 2 == 0 else k[k != 0]
        z = -np.conjugate(1j / np.sin(zk * np.pi / (2 * order)))
        p = -np.exp(1j * np.pi * k / (2 * order))
        p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
        return z, p, (np.prod(-p) / np.prod(-z)).real
    if kind == "bessel":
        # Reverse Bessel polynomial, scaled so that the phase at 1 is midway, as is usual.
        c = [math.factorial(2 * order - i) / (2 ** (order - i) * math.factorial(i) * math.factorial(order - i)) for i in range(order + 1)]
        p = np.roots(c[::-1]) / c[0] ** (1 / order)
        return np.array([]), p, 1.0
    if kind == "ellip":
        return _elliptic(order, rp, rs)
    raise ValueError(kind)


def _agm_k(m: float) -> float:
    a, b = 1.0, math.sqrt(max(1 - m, 1e-300))
    for _ in range(40):
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + math.sqrt(max(0.0, 1 - k * k)))) ** 2
        out.append(k)
    return out


def _cd(u, k: float):
    """Jacobi cd of u quarter periods, by descending Landen steps."""
    w = np.cos(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _sn(u, k: float):
    w = np.sin(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _asn(w: complex, k: float) -> complex:
    """Inverse of _sn in quarter periods."""
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (before * w) ** 2 + 0j)))
        before = v
    return 2 / np.pi * np.arcsin(w + 0j)


def _elliptic(order: int, rp: float, rs: float) -> tuple[np.ndarray, np.ndarray, float]:
    ep, es = math.sqrt(10 ** (rp / 10) - 1), math.sqrt(10 ** (rs / 10) - 1)
    if order == 1:
        return np.array([]), np.array([-1 / ep + 0j]), 1 / ep
    k1 = ep / es
    half, odd = order // 2, order % 2
    u = (2 * np.arange(1, half + 1) - 1) / order
    # The degree equation for the selectivity, through the complementary modulus.
    kc1 = math.sqrt(1 - k1 * k1)
    k = math.sqrt(1 - (kc1**order * np.prod(_sn(u, kc1).real) ** 4) ** 2)
    zeta = _cd(u, k)
    zeros = 1j / (k * zeta)
    v0 = (-1j * _asn(1j / ep, k1) / order)
    poles = 1j * _cd(u - 1j * v0, k)
    p = np.concatenate([poles, np.conj(poles)])
    if odd:
        p = np.append(p, (1j * _sn(1j * v0, k)))
    z = np.concatenate([zeros, np.conj(zeros)])
    gain = (np.prod(-p) / np.prod(-z)).real
    return z, p, gain * (1 if odd else 10 ** (-rp / 20))


def iir_zpk(kind: str, band: str, order: int, wn, rp: float = 1.0, rs: float = 40.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital filter; wn as fractions of Nyquist."""
    z, p, gain = _prototype(kind, order, rp, rs)
    warped = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(wn, float)) / 2)
    degree = len(p) - len(z)
    if band == "lowpass":
        w = warped[0]
        z, p, gain = z * w, p * w, gain * w**degree
    elif band == "highpass":
        w = warped[0]
        gain *= (np.prod(-z) / np.prod(-p)).real
        z, p = np.append(w / z, np.zeros(degree)), w / p
    else:
        bw, w0 = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        if band == "bandpass":
            z, p = z * bw / 2, p * bw / 2
            split = lambda r: np.concatenate([r + np.sqrt(r**2 - w0**2 + 0j), r - np.sqrt(r**2 - w0**2 + 0j)])
            z, p, gain = np.append(split(z), np.zeros(degree)), split(p), gain * bw**degree
        elif band == "bandstop":
            gain *= (np.prod(-z) / np.prod(-p)).real
            split = lambda r: np.concatenate([bw / 2 / r + np.sqrt((bw / 2 / r) ** 2 - w0**2 + 0j), bw / 2 / r - np.sqrt((bw / 2 / r) ** 2 - w0**2 + 0j)])
            z, p = np.concatenate([split(z), np.full(degree, 1j * w0), np.full(degree, -1j * w0)]), split(p)
        else:
            raise ValueError(f"unknown band {band!r}")
    degree = len(p) - len(z)
    gain *= (np.prod(4 - z) / np.prod(4 - p)).real
    return np.append((4 + z) / (4 - z), -np.ones(degree)), (4 + p) / (4 - p), gain


FIR, IIR = "FIR", ("butter", "cheby1", "cheby2", "ellip", "bessel")


def get_filter(ftype: str = FIR, band: str = "lowpass", order: int | None = None, frequency=None, sampling_rate: float = 1000.0, **options: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a). An even FIR order gets one tap more; an unknown type gives none, as callers expect."""
    if order is None or frequency is None:
        raise TypeError("order and frequency are needed")
    if band not in ("lowpass", "highpass", "bandpass", "bandstop"):
        raise ValueError(f"unknown band {band!r}")
    wn = 2 * np.asarray(frequency, float) / sampling_rate
    if ftype == FIR:
        return firwin(order + 1 - order % 2, wn, band), np.array([1.0])
    if ftype not in IIR:
        return np.array([]), np.array([])
    z, p, gain = iir_zpk(ftype, band, order, wn, options.get("rp", 1.0), options.get("rs", 40.0))
    return gain * np.real(np.poly(z)), np.real(np.poly(p))


# --- filtering -------------------------------------------------------------------------------------------------


class NoResult(ValueError):
    """A signal is too short for a kernel, or holds nothing that it looks for. Other errors are errors."""


#: Samples to a block of a recursive filter.
_BLOCK = 128


@lru_cache(maxsize=64)
def _responses(sections: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...], size: int) -> tuple[np.ndarray, ...]:
    """Of filters (b, a), one after the other: what `size` outputs owe to as many inputs, as a lower triangle, and to the
    state before them; what the state after them owes to the inputs; and, by the number of samples, to the state before."""
    orders = [len(a) - 1 for _, a in sections]
    n = sum(orders)
    states = [np.zeros((m, 1 + n)) for m in orders]
    at = 0
    for s in states:
        s[:, 1 + at : 1 + at + len(s)] = np.eye(len(s))
        at += len(s)
    y, held = np.zeros((size, 1 + n)), [np.concatenate(states)]
    for t in range(size):
        v = np.zeros(1 + n)
        v[0] = t == 0
        for i, (b, a) in enumerate(sections):
            s = states[i]
            w = b[0] * v + (s[0] if len(s) else 0.0)
            if len(s):
                states[i] = np.concatenate([s[1:], np.zeros((1, 1 + n))]) + np.multiply.outer(b[1:], v) - np.multiply.outer(a[1:], w)
            v = w
        y[t] = v
        held.append(np.concatenate(states))
    shift = np.subtract.outer(np.arange(size), np.arange(size))
    held = np.array(held)
    return np.where(shift >= 0, y[np.abs(shift), 0], 0.0), y[:, 1:], held[:0:-1, :, 0].T.copy(), held[:, :, 1:]


def _in_blocks(sections: tuple, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of filters, one after the other, for samples x, and the state they end in: all blocks' inputs at once, then
    state by state what each block owes to those before."""
    size = min(_BLOCK, len(x))
    triangle, owed, kept, passed = _responses(sections, size)
    whole = len(x) // size
    v = np.ascontiguousarray(x[: whole * size]).reshape(whole, size)
    left, before = v @ kept.T, np.empty((whole, len(state)))
    for i in range(whole):
        before[i] = state
        state = passed[size] @ state + left[i]
    out = np.empty(len(x))
    out[: whole * size] = (v @ triangle.T + before @ owed.T).ravel()
    if m := len(x) - whole * size:
        v = x[whole * size :]
        out[whole * size :] = triangle[:m, :m] @ v + owed[:m] @ state
        state = passed[m] @ state + kept[:, size - m :] @ v
    return out, state


def lfilter_zi(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State for which a step of height 1 passes without transient."""
    n = max(len(a), len(b))
    b, a = np.r_[b, np.zeros(n - len(b))] / a[0], np.r_[a, np.zeros(n - len(a))] / a[0]
    if n == 1:
        return np.zeros(0)
    companion = np.zeros((n - 1, n - 1))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion.T, b[1:] - a[1:] * b[0])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filter along the first axis, and the state it ends in (direct form II, transposed)."""
    n = max(len(a), len(b))
    b, a = np.r_[b, np.zeros(n - len(b))] / a[0], np.r_[a, np.zeros(n - len(a))] / a[0]
    x = np.asarray(x, float)
    state = np.zeros((n - 1, *x.shape[1:])) if zi is None else np.array(zi, float)
    if not a[1:].any():
        # Without feedback a convolution does it; the state is what later samples still owe to earlier ones.
        full = np.apply_along_axis(lambda v: np.convolve(v, b), 0, x) if len(x) else np.zeros((n - 1, *x.shape[1:]))
        full[: n - 1] += state
        return full[: len(x)], full[len(x) :]
    out = np.empty_like(x)
    if n == 1 or len(x) <= n:
        for t, v in enumerate(x):
            out[t] = b[0] * v + (state[0] if n > 1 else 0.0)
            if n > 1:
                state = np.concatenate([state[1:], np.zeros_like(state[:1])]) + np.multiply.outer(b[1:], v) - np.multiply.outer(a[1:], out[t])
        return out, state
    sections, flat = ((tuple(b.tolist()), tuple(a.tolist())),), state.reshape(n - 1, -1).copy()
    for c, (column, to) in enumerate(zip(x.reshape(len(x), -1).T, out.reshape(len(x), -1).T, strict=True)):
        to[:], flat[:, c] = _in_blocks(sections, column, flat[:, c])
    return out, flat.reshape(state.shape)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards, over an odd extension at both ends."""
    pad = 3 * max(len(a), len(b))
    x = np.asarray(x, float)
    if len(x) <= pad:
        raise NoResult(f"the signal must be longer than {pad} samples")
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi = lfilter_zi(b, a)
    shape = (len(zi),) + (1,) * (x.ndim - 1)
    for _ in range(2):
        long = lfilter(b, a, long, zi.reshape(shape) * long[0])[0][::-1]
    return long[pad:-pad]


@lru_cache(maxsize=64)
def _cascade(ftype: str, band: str, order: int, frequency: tuple[float, ...], sampling_rate: float, rp: float, rs: float) -> tuple[tuple, np.ndarray, int]:
    """A recursive filter's second-order sections, the states in which a step of height 1 passes them, and its number of poles."""
    wn = 2 * np.asarray(frequency if len(frequency) > 1 else frequency[0], float) / sampling_rate
    z, p, gain = iir_zpk(ftype, band, order, wn, rp, rs)
    sections, states, level = [], [], 1.0
    for i, (b, a) in enumerate(_pairs(z, p)):
        b = b * (gain if i == 0 else 1.0)
        n = max(len(a), len(b))
        b, a = np.r_[b, np.zeros(n - len(b))] / a[0], np.r_[a, np.zeros(n - len(a))] / a[0]
        sections.append((tuple(b.tolist()), tuple(a.tolist())))
        states.append(lfilter_zi(b, a) * level)
        level *= b.sum() / a.sum()
    return tuple(sections), np.concatenate(states), len(p)


def filter_signal(x: np.ndarray, ftype: str = FIR, band: str = "lowpass", order: int | None = None, frequency=None, sampling_rate: float = 1000.0, **options: float) -> np.ndarray:
    """Zero-phase filter. Recursive ones of more than 6 poles run as pairs of poles, as one polynomial loses too many digits."""
    if ftype in IIR and (order or 0) * (2 if band in ("bandpass", "bandstop") else 1) > 6:
        cutoff = tuple(float(f) for f in np.atleast_1d(np.asarray(frequency, float)))
        sections, start, poles = _cascade(ftype, band, order, cutoff, float(sampling_rate), options.get("rp", 1.0), options.get("rs", 40.0))
        x = np.asarray(x, float)
        pad = 3 * (poles + 1)
        if len(x) <= pad:
            raise NoResult(f"the signal must be longer than {pad} samples")
        long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        for _ in range(2):
            columns = [_in_blocks(sections, c, start * c[0])[0] for c in long.reshape(len(long), -1).T]
            long = np.stack(columns, 1).reshape(long.shape)[::-1]
        return long[pad:-pad]
    b, a = get_filter(ftype, band, order, frequency, sampling_rate, **options)
    return filtfilt(b, a, x)


def _pairs(z: np.ndarray, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order factors: conjugate poles together, each with the nearest zeros."""

    def quadratics(r: np.ndarray) -> list[np.ndarray]:
        up = sorted((x for x in r if x.imag > 1e-10), key=lambda x: -abs(x))
        real = sorted(x.real for x in r if abs(x.imag) <= 1e-10)
        out = [np.array([x, np.conj(x)]) for x in up] + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]
        return out

    zeros, out = quadratics(z), []
    for poles in quadratics(p):
        best = min(range(len(zeros)), key=lambda i: abs(zeros[i][0] - poles[0]) + 10 * (len(zeros[i]) != len(poles)), default=None)
        zs = zeros.pop(best) if best is not None else np.array([])
        out.append((np.real(np.poly(zs)) if len(zs) else np.array([1.0]), np.real(np.poly(poles))))
    return out[::-1]


def freqz(b: np.ndarray, a: np.ndarray, sampling_rate: float = 1000.0, points: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    w = np.pi * np.arange(points) / points
    e = np.exp(-1j * w)
    return w * sampling_rate / (2 * np.pi), np.polyval(b[::-1], e) / np.polyval(a[::-1], e)


@lru_cache(maxsize=256)
def _weights(kernel: str, size: int, options: tuple) -> np.ndarray:
    w = window(kernel, size, **dict(options))
    return w / w.sum()


def smooth(x: np.ndarray, kernel="boxzen", size: int = 10, mirror: bool = True, **options: float) -> np.ndarray:
    """Moving average by a kernel; boxzen is a boxcar, then Parzen; median has odd size and sees zeros beyond the ends."""
    x = np.asarray(x, float)
    if isinstance(kernel, np.ndarray):
        w, size = kernel.astype(float), len(kernel)
    else:
        size = max(1, min(int(size), len(x) - 1))
        if kernel == "boxzen":
            return smooth(smooth(x, "boxcar", size, mirror), "parzen", size, mirror)
        if kernel == "median":
            if size % 2 == 0:
                raise ValueError("a median needs an odd size")
            return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2), size), axis=1)
        w = _weights(kernel, size, tuple(sorted(options.items())))
    if isinstance(kernel, np.ndarray):
        w = w / w.sum()
    if not mirror:
        return np.convolve(x, w, "same")
    return np.convolve(np.concatenate([np.full(size, x[0]), x, np.full(size, x[-1])]), w, "same")[size:-size]


def analytic(x: np.ndarray, n: int | None = None) -> np.ndarray:
    """The analytic signal over n Fourier points."""
    n = n or len(x)
    f = np.fft.fft(x, n)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(f * gain)


def extrema(x: np.ndarray, mode: str) -> np.ndarray:
    turn = np.diff(np.sign(np.diff(x)))
    return np.flatnonzero(turn < 0 if mode == "max" else turn > 0 if mode == "min" else turn != 0) + 1


def peaks(x: np.ndarray) -> np.ndarray:
    """Strict local maxima, the middle of each plateau."""
    steps = np.flatnonzero(np.diff(x))
    if len(steps) < 2:
        return np.zeros(0, int)
    rises = np.diff(x)[steps] > 0
    top = np.flatnonzero(rises[:-1] & ~rises[1:])
    return (steps[top] + 1 + steps[top + 1]) // 2


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height above the higher of the lowest points on either side, up to the next higher sample."""
    if not len(at):
        return np.zeros(0)
    # Between neighbouring turning points, ends and places asked for the signal is monotonous, so those tell all.
    turns = np.flatnonzero(np.sign(np.diff(x[:-1])) != np.sign(np.diff(x[1:]))) + 1 if len(x) > 2 else np.zeros(0, int)
    keep = np.unique(np.concatenate([[0, len(x) - 1], turns, at]).astype(int))
    v = x[keep].tolist()

    def lowest(values: list[float]) -> list[float]:
        """Of each value and those before it, down to the next higher one, the least."""
        out, stack = [], []
        for y in values:
            low = y
            while stack and stack[-1][0] <= y:
                low = min(low, stack.pop()[1])
            stack.append((y, low))
            out.append(low)
        return out

    sides = np.maximum(lowest(v), lowest(v[::-1])[::-1])
    where = np.searchsorted(keep, at)
    return x[at] - sides[where]


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Peaks of some height; of those closer than `distance` the higher stay; then of some prominence."""
    at = peaks(x)
    if height is not None:
        at = at[x[at] >= height]
    if distance is not None and len(at):
        keep, reach, places = [True] * len(at), math.ceil(distance), at.tolist()
        for i in np.argsort(x[at], kind="stable")[::-1].tolist():
            if keep[i]:
                for step in (-1, 1):
                    j = i + step
                    while 0 <= j < len(places) and abs(places[j] - places[i]) < reach:
                        keep[j] = False
                        j += step
        at = at[np.array(keep)]
    if prominence is not None:
        at = at[prominences(x, at) >= prominence]
    return at


# --- tests -----------------------------------------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # Evaluated from its far end, where it has converged for all arguments that tests give.
    f = 1.0
    for i in range(400, 0, -1):
        m = i // 2
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + num / f
    return front / f


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


# --- linkage -----------------------------------------------------------------------------------------------------


def linkage(d: np.ndarray, method: str = "average", sizes: list[int] | None = None, scratch: bool = False) -> np.ndarray:
    """Merges (a, b, height, size) of a square distance matrix, by the Lance-Williams recurrences; ties to the first pair.

    Each row keeps its nearest later one, so a merge looks at a few rows and not at all pairs. sizes: how many members the
    leaves have; scratch: the matrix may be overwritten, which saves a copy.
    """
    n = len(d)
    squared = method in ("centroid", "median", "ward")
    d = d if scratch and d.dtype == float else np.array(d, float)
    if squared:
        d **= 2
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), np.ones(n) if sizes is None else np.array(sizes, float), []
    live = np.ones(n, bool)
    near, least = np.zeros(n, int), np.full(n, np.inf)

    def look(row: int) -> None:
        if row + 1 < n:
            near[row] = row + 1 + int(d[row, row + 1 :].argmin())
            least[row] = d[row, near[row]]

    for row in range(n):
        look(row)
    for step in range(n - 1):
        i = int(least.argmin())
        j = int(near[i])
        h, ni, nj = d[i, j], sizes[i], sizes[j]
        out.append([min(ids[i], ids[j]), max(ids[i], ids[j]), math.sqrt(max(h, 0)) if squared else h, ni + nj])
        k = np.flatnonzero(live)
        k = k[(k != i) & (k != j)]
        a, b, nk = d[i, k], d[j, k], sizes[k]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (ni * a + nj * b) / (ni + nj)
        elif method == "weighted":
            new = (a + b) / 2
        elif method == "centroid":
            new = (ni * a + nj * b) / (ni + nj) - ni * nj * h / (ni + nj) ** 2
        elif method == "median":
            new = (a + b) / 2 - h / 4
        elif method == "ward":
            new = ((ni + nk) * a + (nj + nk) * b - nk * h) / (ni + nj + nk)
        else:
            raise ValueError(f"unknown linkage {method!r}")
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        live[j], ids[i], sizes[i], least[j] = False, n + step, ni + nj, np.inf
        stale = k[(k < j) & ((near[k] == j) | (near[k] == i))]
        before = k[k < i]
        closer = (d[before, i] < least[before]) | ((d[before, i] == least[before]) & (i < near[before]))
        near[before[closer]], least[before[closer]] = i, d[before[closer], i]
        for row in (i, *stale.tolist()):
            look(row)
    return np.array(out).reshape(-1, 4)


def cut_tree(z: np.ndarray, n: int, k: int | None = None, height: float | None = None) -> np.ndarray:
    """Cluster of each leaf, numbered from 0 by first member: k clusters, or those merged at or below a height."""
    parent = list(range(n + len(z)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, h, _) in enumerate(z):
        if (k is not None and step < n - k) or (height is not None and h <= height):
            parent[root(int(a))] = parent[root(int(b))] = n + step
    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def life_time(z: np.ndarray, n: int) -> np.ndarray:
    """Clusters by the widest gap between merges. Fewer than 3 leaves, or no gap that stands out, leave singletons."""
    if n < 3:
        return np.arange(n)
    gaps = np.diff(z[:, 2])
    wide, narrow = gaps.max(initial=0), gaps.min(initial=0)
    if wide < 2 * narrow:
        return np.arange(n)
    k = n - 1 - int(np.flatnonzero(gaps == wide)[-1])
    return cut_tree(z, n, k=k) if k > 1 else np.arange(n)


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, kernel, tol: float = 1e-3, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Dual weights and offset of a soft-margin SVM with bounds c per sample, by pairs that violate most."""
    k = kernel(x, x)
    a, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        up = ((y > 0) & (a < c - 1e-12)) | ((y < 0) & (a > 1e-12))
        down = ((y < 0) & (a < c - 1e-12)) | ((y > 0) & (a > 1e-12))
        score = -y * grad
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(down, score, np.inf).argmin())
        if score[i] - score[j] < tol:
            break
        eta = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (score[i] - score[j]) / eta
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += step * y * (k[:, i] - k[:, j])
    score = -y * grad
    inside = (a > 1e-9) & (a < c - 1e-9)
    bias = float(score[inside].mean()) if inside.any() else float((score[up].max() + score[down].min()) / 2)
    return a, bias


def one_class_svm(x: np.ndarray, kernel, nu: float = 0.1, tol: float = 1e-4, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights and threshold of the smallest half space that leaves out a share nu: outside is below the threshold."""
    n = len(x)
    k, cap = kernel(x, x), 1 / (nu * n)
    a = np.minimum(cap, np.maximum(0, 1 - cap * np.arange(n)))
    a = a / a.sum()
    grad = k @ a
    for _ in range(rounds):
        i, j = int(np.where(a < cap - 1e-12, grad, np.inf).argmin()), int(np.where(a > 1e-12, grad, -np.inf).argmax())
        if grad[j] - grad[i] < tol:
            break
        step = min((grad[j] - grad[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), cap - a[i], a[j])
        a[i] += step
        a[j] -= step
        grad += step * (k[:, i] - k[:, j])
    inside = (a > 1e-9) & (a < cap - 1e-9)
    return a, float(grad[inside].mean() if inside.any() else (grad[a > 1e-12].max() + grad[a < cap - 1e-12].min()) / 2)


# --- distances -------------------------------------------------------------------------------------------------

#: Doubles that a block of differences may hold.
_ROOM = 1 << 22


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two boolean matrices, for every pair of rows: places where both, one only and none are set."""
    a, b = (a != 0).astype(float), (b != 0).astype(float)
    both, n = a @ b.T, a.shape[1]
    one = a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * both
    return both, one, n - both - one


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, where y is 0 nothing differs."""
    return np.divide(x, y, out=np.zeros(np.broadcast(x, y).shape), where=y != 0)


#: Distances of boolean vectors from the places where both (t), one only (u) or none (f) are set.
BOOLEAN = {
    "dice": lambda t, u, f: _ratio(u, 2 * t + u),
    "jaccard": lambda t, u, f: _ratio(u, t + u),
    "kulsinski": lambda t, u, f: (2 * u + f) / (t + 2 * u + f),
    "matching": lambda t, u, f: u / (t + u + f),
    "rogerstanimoto": lambda t, u, f: 2 * u / (t + 2 * u + f),
    "russellrao": lambda t, u, f: (u + f) / (t + u + f),
    "sokalmichener": lambda t, u, f: 2 * u / (t + 2 * u + f),
    "sokalsneath": lambda t, u, f: _ratio(2 * u, t + 2 * u),
}


def _yule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the product of the places set in one only, either way, over its sum with that of both and none."""
    a, b = (a != 0).astype(float), (b != 0).astype(float)
    first, second = a @ (1 - b).T, (1 - a) @ b.T
    return _ratio(2 * first * second, first * second + (a @ b.T) * ((1 - a) @ (1 - b).T))


def distances(a: np.ndarray, b: np.ndarray, metric="euclidean", p: float = 2, v=None, vi=None, w=None) -> np.ndarray:
    """The distance of every row of a from every row of b, by a metric's name or a function of two rows."""
    if callable(metric):
        return np.array([[float(metric(x, y)) for y in b] for x in a]).reshape(len(a), len(b))
    if metric in BOOLEAN:
        return BOOLEAN[metric](*_counts(a, b))
    if metric == "yule":
        return _yule(a, b)
    if metric in ("cosine", "pcosine", "correlation"):
        a, b = (x - x.mean(1, keepdims=True) if metric == "correlation" else x for x in (a, b))
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = (a @ b.T) / np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
        return 1 - (np.abs(cosine) if metric == "pcosine" else cosine)
    power = 2.0 if metric == "euclidean" else float(p)
    weight = 1.0 if w is None else np.asarray(w, float)
    if w is not None and metric not in ("minkowski", "euclidean"):
        raise ValueError("weights go with minkowski and euclidean")
    if metric == "seuclidean":
        if v is None:
            raise TypeError("seuclidean needs the variances v")
        weight = 1 / np.asarray(v, float)
    if metric == "mahalanobis" and vi is None:
        raise TypeError("mahalanobis needs the inverse covariance vi")
    of = {
        "sqeuclidean": lambda d, x, y: (d * d).sum(2),
        "seuclidean": lambda d, x, y: np.sqrt((d * d * weight).sum(2)),
        "cityblock": lambda d, x, y: np.abs(d).sum(2),
        "chebyshev": lambda d, x, y: np.abs(d).max(2),
        "euclidean": lambda d, x, y: np.sqrt((d * d * weight).sum(2)),
        "minkowski": lambda d, x, y: ((np.abs(d) ** power * weight).sum(2)) ** (1 / power),
        "hamming": lambda d, x, y: (d != 0).mean(2),
        "braycurtis": lambda d, x, y: np.where(np.abs(x + y).sum(2) > 0, np.abs(d).sum(2), np.nan) / np.maximum(np.abs(x + y).sum(2), 1e-300),
        "canberra": lambda d, x, y: _ratio(np.abs(d), np.abs(x) + np.abs(y)).sum(2),
        "mahalanobis": lambda d, x, y: np.sqrt(np.einsum("ijk,kl,ijl->ij", d, np.asarray(vi, float), d)),
    }
    if metric not in of:
        raise ValueError(f"unknown metric {metric!r}")
    step = max(1, _ROOM // max(1, b.size))
    parts = [of[metric](a[i : i + step, None, :] - b[None, :, :], a[i : i + step, None, :], b[None, :, :]) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)))


def near(a: np.ndarray, b: np.ndarray, within: float, metric="euclidean", **options) -> np.ndarray:
    """Which distances of rows of a from rows of b are `within` or less, as `distances` says: by a product of matrices where
    that leaves no doubt, else by the distances themselves."""
    if metric != "euclidean" or options or not np.isfinite(within):
        return distances(a, b, metric, **options) <= within
    one, two = (a * a).sum(1), (b * b).sum(1)
    square = one[:, None] + two[None, :] - 2 * (a @ b.T) - within * within
    doubt = 1e-9 * (one.max(initial=0) + two.max(initial=0) + within * within)
    out = (square <= 0) if within >= 0 else np.zeros(square.shape, bool)
    r, c = np.nonzero(~(np.abs(square) > doubt))
    for i in range(0, len(r), 65_536):
        p, q = r[i : i + 65_536], c[i : i + 65_536]
        out[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1)) <= within
    return out


def components(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each is linked to, over any number of links i - j)."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    p, q = at[: len(i)], at[len(i) :]
    label = np.arange(len(ids))
    while True:
        before, low = label.copy(), np.minimum(label[p], label[q])
        np.minimum.at(label, label[p], low)
        np.minimum.at(label, label[q], low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        if (before == label).all():
            return ids, ids[label]


def nearest_windows(x: np.ndarray, y: np.ndarray, size: int, first: int, last: int, skip: int | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, distance, neighbour): for the windows first..last-1 of x their nearest ones of y, z-normalised.

    skip: windows of the same signal that near don't count, and ties at `digits` places go to the first neighbour; without
    it they go to the last. Windows that are constant have no distance.
    """
    from numpy.lib.stride_tricks import sliding_window_view

    if len(x) < size or len(y) < size:
        return np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    b = sliding_window_view(y, size)
    mean_b, dev_b = b.mean(1), b.std(1)
    at, best, where = [], [], []
    step = max(1, _ROOM // len(b))
    for i in range(first, min(last, len(x) - size + 1), step):
        a = sliding_window_view(x, size)[i : min(i + step, last)]
        spread = size * np.outer(a.std(1), dev_b)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.sqrt(np.abs(2 * size * (1 - (a @ b.T - size * np.outer(a.mean(1), mean_b)) / spread)))
        d = np.where(spread > 0, np.round(d, digits), np.inf)
        if skip is not None:
            d[np.abs(np.subtract.outer(np.arange(i, i + len(a)), np.arange(len(b)))) <= skip] = np.inf
        near = d.argmin(1) if skip is not None else d.shape[1] - 1 - d[:, ::-1].argmin(1)
        least = d[np.arange(len(a)), near]
        good = np.isfinite(least)
        at.append(np.flatnonzero(good) + i)
        best.append(least[good])
        where.append(near[good])
    return (np.concatenate(at), np.concatenate(best), np.concatenate(where)) if at else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))


def spectrum(x: np.ndarray, at: np.ndarray, points: int) -> np.ndarray:
    """The discrete Fourier transform at bins below half of the points, of samples x at places `at`, by FFT."""
    y = np.zeros(points)
    np.add.at(y, at % points, x)
    return np.fft.rfft(y)[: points // 2]


def mean_periodogram(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """The mean over windows, less their means and under a periodic Hann window, of squared one-sided spectra; empty without a window."""
    from numpy.lib.stride_tricks import sliding_window_view

    if len(x) < size:
        return np.zeros(0)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total, parts = np.zeros(size // 2 + 1), sliding_window_view(x, size)[::step]
    room = max(1, _ROOM // size)
    for i in range(0, len(parts), room):
        v = parts[i : i + room]
        total += (np.abs(np.fft.rfft((v - v.mean(1, keepdims=True)) * hann, axis=1)) ** 2).sum(0)
    sides = np.full(size // 2 + 1, 2.0)
    sides[0] = 1.0
    if size % 2 == 0:
        sides[-1] = 1.0
    return total / len(parts) * sides


def correlation(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, detrend: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(lag, sum of x[n + lag] * y[n]) of samples x at places i and y at places j, for all lags from end to end."""
    if detrend:
        x, y = x - x.mean(), y - y.mean()
    a, b = np.zeros(int(i.max() - i.min()) + 1), np.zeros(int(j.max() - j.min()) + 1)
    a[i - i.min()], b[j - j.min()] = x, y
    n = len(a) + len(b) - 1
    c = np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b[::-1], n), n)
    return np.arange(n) - (len(b) - 1) + int(i.min() - j.min()), c
