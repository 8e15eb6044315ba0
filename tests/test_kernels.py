"""Kernels and detectors against closed forms, loops and recordings whose beats are known."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.functions import detectors as d
from pulsegrid.functions import kernels as k
from pulsegrid.sources.synthetic import beat


def test_butterworth_golden():
    b, a = k.get_filter("butter", "lowpass", 2, 0.25, 1.0)
    assert np.allclose(b, [0.292893, 0.585786, 0.292893], atol=1e-6)
    assert np.allclose(a, [1, 0, 0.171573], atol=1e-6)


@pytest.mark.parametrize("kind", k.IIR)
@pytest.mark.parametrize("band", ["lowpass", "highpass", "bandpass", "bandstop"])
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_designs_pass_and_stop(kind, band, order):
    frequency = [30, 120] if band.startswith("band") else 80
    b, a = k.get_filter(kind, band, order, frequency, 1000.0, rp=1, rs=40)
    f, h = k.freqz(b, a, 1000.0, 4096)
    gain = np.abs(h)
    assert np.abs(np.roots(a)).max() < 1 and gain.max() < 1.001
    inside = {"lowpass": 1, "highpass": 490, "bandpass": 60, "bandstop": 1}[band]
    outside = {"lowpass": 490, "highpass": 1, "bandpass": 499, "bandstop": 60.5}[band]
    # The edge of cheby2 is that of the stop band, so low orders reach their pass band far from it.
    assert gain[np.argmin(abs(f - inside))] > (0.88 if kind != "cheby2" or order > 3 else 0.02)
    assert gain[np.argmin(abs(f - outside))] < (0.35 if order == 1 else 0.2)


@pytest.mark.parametrize("ftype,order", [("FIR", 101), ("butter", 4), ("butter", 16), ("cheby2", 5)])
def test_low_pass_keeps_a_constant(ftype, order):
    y = k.filter_signal(np.full(2000, 3.0), ftype, "lowpass", order, 40.0, 1000.0)
    assert np.allclose(y, 3, atol=1e-6)


def test_short_signals_and_unknown_types():
    with pytest.raises(ValueError):
        k.filter_signal(np.ones(5), "butter", "lowpass", 4, 40.0, 1000.0)
    assert [len(x) for x in k.get_filter("other", "lowpass", 2, 40.0)] == [0, 0]
    with pytest.raises(ValueError):
        k.window("other", 5)
    with pytest.raises(TypeError):
        k.window("kaiser", 5)


@pytest.mark.parametrize("name", ["blackman", "triang", "hamming", "bartlett", "hann", "blackmanharris", "parzen", "bohman", "nuttall", "barthann", "flattop", "boxcar", "cosine"])
@pytest.mark.parametrize("size", [1, 2, 7, 8])
def test_windows_are_symmetric(name, size):
    w = k.window(name, size)
    assert len(w) == size and np.allclose(w, w[::-1])


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=40), st.lists(st.floats(-0.4, 0.4), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_filtering_in_parts_is_filtering_at_once(x, a):
    b, a, x = np.array([0.5, 0.2]), np.r_[1.0, a], np.array(x)
    once, _ = k.lfilter(b, a, x)
    cut = len(x) // 2
    first, state = k.lfilter(b, a, x[:cut])
    second, _ = k.lfilter(b, a, x[cut:], state)
    assert np.allclose(once, np.r_[first, second])
    slow = np.zeros(len(x))
    for n in range(len(x)):
        slow[n] = sum(b[i] * x[n - i] for i in range(len(b)) if n >= i) - sum(a[i] * slow[n - i] for i in range(1, len(a)) if n >= i)
    assert np.allclose(once, slow)


def test_smoothing_a_constant():
    for kernel in ("boxzen", "hamming", "parzen", "boxcar"):
        assert np.allclose(k.smooth(np.full(30, 3.0), kernel, 7), 3)
    assert k.smooth(np.array([1.0, 9, 1, 2]), "median", 3).tolist() == [1, 1, 2, 1]


def test_extrema_on_a_plateau():
    assert k.extrema(np.array([0.0, 1, 0, 2, 2, 0]), "max").tolist() == [1, 3, 4]


def test_find_peaks():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0.0])
    assert k.peaks(x).tolist() == [1, 3, 6]
    assert k.find_peaks(x, distance=3).tolist() == [3, 6]
    assert k.prominences(x, np.array([1, 3, 6])).tolist() == [2, 3, 1]


def test_p_values():
    assert k.t_pvalue(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert k.t_pvalue(0.0, 4) == pytest.approx(1)


def test_linkage_and_cuts():
    x = np.array([0.0, 0.1, 5, 5.1, 9])
    d = np.abs(x[:, None] - x[None, :])
    for method in ("single", "complete", "average", "weighted", "centroid", "median", "ward"):
        z = k.linkage(d, method)
        assert len(z) == 4 and k.cut_tree(z, 5, k=3).tolist() == [0, 0, 1, 1, 2]


def test_machines():
    r = np.random.default_rng(0)
    x = np.r_[r.standard_normal((30, 2)) - 3, r.standard_normal((20, 2)) + 3]
    y = np.r_[-np.ones(30), np.ones(20)]
    a, bias = k.svm(x, y, np.ones(50), lambda p, q: p @ q.T)
    assert (np.sign((a * y) @ (x @ x.T) + bias) == y).all() and abs(a @ y) < 1e-9
    rbf = lambda p, q: np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(2))
    a, rho = k.one_class_svm(x[:30], rbf, 0.1)
    assert a.sum() == pytest.approx(1) and ((a @ rbf(x[:30], x[:30])) < rho - 1e-3).sum() <= 3
    assert (a @ rbf(x[:30], x[30:])).max() < rho


@pytest.fixture(scope="module")
def ecg():
    parts = [beat(1000.0, 0.01, j)[0] for j in range(20)]
    x = np.concatenate(parts)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    tops = np.array([s + int(np.argmax(p)) for s, p in zip(starts, parts, strict=True)])
    return x, tops


@pytest.mark.parametrize("name", ["hamilton", "christov", "asi"])
def test_r_peaks_are_found(ecg, name):
    x, tops = ecg
    found = getattr(d, name)(x, 1000.0)
    hit = [np.abs(found - t).min() <= 50 for t in tops[1:-1]]
    assert np.mean(hit) >= 0.9 and len(found) <= len(tops) + 2


@pytest.mark.parametrize("fcn", [d.hamilton, d.christov, d.asi, d.gamboa, d.ssf, d.engzee, d.zong, d.elgendi])
def test_detectors_survive_flat_signals(fcn):
    try:
        assert len(fcn(np.zeros(3000), 1000.0)) <= 15
    except (ValueError, IndexError):
        pass


def slow_switches(active, hold, fails, repay):
    """The two-state rule, restated state by state."""
    out, on, alarm, held, bad, good = [], False, -1, 0, 0, 0
    for i, a in enumerate(active):
        differs = a if not on else not a
        if alarm < 0:
            alarm = i if differs else -1
            continue
        if differs:
            held += 1
            if bad > 0:
                good += 1
                if good == repay:
                    good = bad = 0
            if held == hold:
                out.append((alarm, "offset" if on else "onset"))
                on, alarm, held, bad, good = not on, -1, 0, 0, 0
        elif fails is not None:
            bad += 1
            if bad > fails:
                alarm, held, bad, good = -1, 0, 0, 0
    return out


@given(st.lists(st.booleans(), max_size=60), st.integers(1, 4), st.sampled_from([None, 0, 1, 2]), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_switches(active, hold, fails, repay):
    assert d.switches(np.array(active, bool), hold, fails, repay) == slow_switches(active, hold, fails, repay)


def test_heart_sounds_alternate():
    assert d.sound_classes(np.array([0, 300, 1000, 1300, 2000])).tolist() == [1, 2, 1, 2, 1]


def test_average_rate_of_a_periodic_envelope():
    t = np.arange(10_000)
    rate, _ = d.average_rate(1 + np.cos(2 * np.pi * t / 800), 1000.0)
    assert rate == pytest.approx(75, abs=1.5)


def test_lfilter_in_blocks_is_the_recursion():
    r = np.random.default_rng(1)
    for n in (1, 3, 63, 64, 65, 200):
        for b, a in ((np.array([0.2]), np.array([1, -0.8])), k.get_filter("butter", "bandpass", 2, [5, 40], 1000.0)):
            x, m = r.standard_normal((n, 2)), max(len(a), len(b)) - 1
            full_b, full_a = np.r_[b, np.zeros(m + 1 - len(b))], np.r_[a, np.zeros(m + 1 - len(a))]
            state, want = r.standard_normal((m, 2)), []
            got, end = k.lfilter(b, a, x, state)
            for v in x:
                y = full_b[0] * v + state[0]
                state = np.vstack([state[1:], np.zeros(2)]) + np.outer(full_b[1:], v) - np.outer(full_a[1:], y)
                want.append(y)
            assert np.allclose(got, want) and np.allclose(end, state)


def test_distances_by_their_definitions():
    r = np.random.default_rng(2)
    a, b = r.standard_normal((5, 6)), r.standard_normal((4, 6))
    vi = np.diag(np.arange(1.0, 7))
    one = {
        "euclidean": lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5,
        "cityblock": lambda x, y: sum(abs(p - q) for p, q in zip(x, y)),
        "chebyshev": lambda x, y: max(abs(p - q) for p, q in zip(x, y)),
        "canberra": lambda x, y: sum(abs(p - q) / (abs(p) + abs(q)) for p, q in zip(x, y)),
        "braycurtis": lambda x, y: sum(abs(p - q) for p, q in zip(x, y)) / sum(abs(p + q) for p, q in zip(x, y)),
        "correlation": lambda x, y: 1 - np.corrcoef(x, y)[0, 1],
        "mahalanobis": lambda x, y: float((x - y) @ vi @ (x - y)) ** 0.5,
    }
    for name, f in one.items():
        got = k.distances(a, b, name, **({"vi": vi} if name == "mahalanobis" else {}))
        assert np.allclose(got, [[f(x, y) for y in b] for x in a]), name
    assert np.allclose(k.distances(a, b, lambda x, y: abs(x[0] - y[0])), np.abs(np.subtract.outer(a[:, 0], b[:, 0])))
    p, q = np.array([[1.0, 1, 0, 0, 1], [0, 0, 0, 0, 0]]), np.array([[1.0, 0, 1, 0, 1]])
    # Of the first pair two places are set in both, one in either alone, one in none.
    want = {"dice": 2 / 6, "jaccard": 2 / 4, "kulsinski": 5 / 7, "matching": 2 / 5, "rogerstanimoto": 4 / 7, "russellrao": 3 / 5, "sokalmichener": 4 / 7, "sokalsneath": 4 / 6, "yule": 2 / 3}
    for name, d in want.items():
        assert abs(k.distances(p, q, name)[0, 0] - d) < 1e-12, name
        assert k.distances(p[1:], p[1:], name)[0, 0] == (1 if name in ("russellrao", "kulsinski") else 0), name
    for bad in ({"metric": "none"}, {"metric": "cityblock", "w": [1.0] * 6}):
        with pytest.raises(ValueError):
            k.distances(a, b, **bad)


def test_detectors_find_the_beats_of_a_train():
    """Golden vectors: in a noisy train each detector of heart beats finds each beat once, near its R peak."""
    r = np.random.default_rng(3)
    names = {1000.0: ("christov", "hamilton"), 500.0: ("christov", "hamilton", "engzee", "asi"), 250.0: ("christov", "hamilton", "engzee")}
    for fs in names:
        parts = [beat(fs, 0.02, s)[0] for s in range(15)]
        ends = np.cumsum([len(x) for x in parts])
        x = np.concatenate(parts) + 0.005 * r.standard_normal(int(ends[-1]))
        tops = np.array([int(np.argmax(x[e - len(p) : e])) + e - len(p) for e, p in zip(ends, parts)])
        for name in names[fs]:
            found = np.asarray(getattr(d, name)(x, fs))
            near = [int((np.abs(found - t) <= 0.06 * fs).sum()) for t in tops]
            assert sum(n == 1 for n in near) >= 13 and len(found) <= 16, (name, fs, near, len(found))
