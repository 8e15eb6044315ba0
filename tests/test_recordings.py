"""Recordings that tasks keep whole, and kernels over them, against tables of samples and loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import detectors as d
from pulsegrid.functions import kernels as k
from pulsegrid.operators import beats as b
from pulsegrid.operators import packed as p
from pulsegrid.plans import pipelines as pipe
from pulsegrid.plans import views
from pulsegrid.plans.queries import QUERIES
from pulsegrid.sources import synthetic

from .conftest import SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def signals(spark):
    trains = spark.createDataFrame([(1, 9), (2, 12), (3, 1)], "id long, beats long")
    return p.Signals(trains, lambda i, beats: synthetic.train(i, beats))


def test_whole_recordings_are_the_recordings(spark):
    one, two = views.recordings(spark, SF, 250.0), views.whole_recordings(spark, SF, 250.0)
    total = lambda df: df.groupBy("signal_id").agg(F.count("i").alias("n"), F.round(F.sum(F.col("x") * F.col("i")), 6).alias("s"))
    assert rows(total(one)) == rows(total(two.samples()))
    assert views._trains(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["detect_christov", "detect_ssf", "pipeline_emg", "ppg_mean_pulse"])
def test_samples_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_kernels_agree_on_whole_signals_and_samples(signals):
    table = signals.samples()
    for name in ("christov", "hamilton", "elgendi", "heart_sounds"):
        assert rows(p.detect(signals, name)) == rows(p.detect(table, name))
    for name in ("ecg", "abp", "ppg"):
        one, two = (getattr(pipe, name)(x).heart_rate.select("signal_id", "i", F.round("hr", 6)) for x in (signals, table))
        assert rows(one) == rows(two) and one.count() > 10
    one, two = (b.signal_quality(x, p.detect(x, "hamilton"), p.detect(x, "christov")) for x in (signals, table))
    assert rows(one) == rows(two) and one.count() == 3


def test_corrected_beats_are_those_of_the_joins(signals):
    table = p.filter_signal(signals, "FIR", "bandpass", 300, [3, 45]).samples()
    found = b.extract_heartbeats(table, b.correct_rpeaks(table, p.detect(table, "hamilton"), 1000.0, 0.05), 1000.0, 0.2, 0.4)
    for x in (table, p.filter_signal(signals, "FIR", "bandpass", 300, [3, 45])):
        assert rows(p.corrected_beats(x)) == rows(found.select("signal_id", "r"))
        assert rows(p.heartbeats(x)) == rows(found.select("signal_id", "r", "beat"))


def test_pulse_pipelines_find_a_beat_each(spark):
    """The band of 1 to 8 Hz at 1000 Hz has 8 poles, which as one polynomial run over."""
    x = synthetic.train(5, 40)
    assert np.isfinite(k.filter_signal(x, "butter", "bandpass", 4, [1, 8], 1000.0)).all()
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert 0.8 * events < QUERIES["pipeline_bvp"](spark, SF).count() <= events


def test_peaks_and_running_largest_as_by_loops():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 40, 300):
        x = r.integers(0, 6, n).astype(float)
        at = k.peaks(x)
        want = []
        for q in at:
            left, right = np.flatnonzero(x[:q] > x[q]), np.flatnonzero(x[q + 1 :] > x[q])
            lo, hi = (left[-1] + 1 if len(left) else 0), (q + 1 + right[0] if len(right) else n)
            want.append(x[q] - max(x[lo : q + 1].min(), x[q:hi].min()))
        assert k.prominences(x, at).tolist() == want
        for size in (1, 2, 7, 50):
            top = d._running_max(x, size)
            assert top.tolist() == [0.0] + [x[max(0, t - size) : t].max() for t in range(1, n + 1)]


def test_prominences_take_linear_time():
    x = np.sin(np.arange(2_000_000) * 0.5) + np.linspace(0, 1e-3, 2_000_000)
    at = k.peaks(x)
    assert len(at) > 100_000 and (k.prominences(x, at) > 0.5).mean() > 0.9


def test_abbink_searches_once_for_each_kind(monkeypatch):
    searched, flat = [], np.flatnonzero
    monkeypatch.setattr(d.np, "flatnonzero", lambda x: searched.append(len(x)) or flat(x))
    x = np.tile(np.r_[np.zeros(150), np.tile([9.0, -9.0], 75)], 20) + np.random.default_rng(0).normal(0, 0.5, 6000)
    found = d.abbink(x, rest=[0, 100], size=10, alarm_size=10, threshold=1.0, transition=1.0)
    assert {kind for _, kind in found} == {"onset", "offset"} and len(searched) == 2
