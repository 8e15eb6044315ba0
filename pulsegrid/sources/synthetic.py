"""A synthetic electrocardiogram: one beat from segments, or a train of beats as a signal table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as k

# The usual lengths and heights of a beat's segments.
DEFAULTS = {"Kb": 130, "Ap": 0.2, "Kp": 100, "Kpq": 40, "Aq": 0.1, "Kq1": 25, "Kq2": 5, "Ar": 0.7, "Kr": 40, "As": 0.2, "Ks": 30, "Kcs": 5, "sm": 96, "Kst": 100, "At": 0.15, "Kt": 220, "si": 2, "Ki": 200}


# The least and the largest that each may be.
LIMITS = {
    "Kb": (0, 130), "Ap": (-0.2, 0.5), "Kp": (10, 100), "Kpq": (0, 60), "Aq": (0, 0.5), "Kq1": (0, 70), "Kq2": (0, 50), "Ar": (0.5, 2), "Kr": (10, 150),
    "As": (0, 1), "Ks": (10, 200), "Kcs": (-5, 150), "sm": (1, 150), "Kst": (0, 110), "At": (-0.5, 1), "Kt": (50, 300), "si": (0, 50),
}


def check_limits(p: dict[str, float]) -> None:
    """Raises for a parameter that no beat has."""
    for name, (low, high) in LIMITS.items():
        if not low <= p[name] <= high:
            raise ValueError(f"{name} is {p[name]}, not between {low} and {high}")


def segments(p: dict[str, float], step: float = 1.0) -> list[np.ndarray]:
    """The base line, P, PQ, Q down, Q up, R, S, ST, T and the return, each sampled every `step`."""
    at = lambda n: np.arange(0, n, step)
    flat = lambda n: np.zeros(int(n * int(1 / step)))

    # Each wave starts where the one before ends, at the ends of their formulas and not at their last samples.
    def s_wave(x):
        return -p["As"] * step * x * 19.78 * np.pi / p["Ks"] * np.exp(-2 * (6 * np.pi / p["Ks"] * step * x) ** 2)

    def st(x):
        return s_wave(p["Ks"] - p["Kcs"]) * (1 - x / p["sm"])

    def t_wave(x):
        return p["At"] * (1 - np.cos((1.48 * np.pi * x + 15) / p["Kt"])) + st(p["Kst"])

    return [
        flat(p["Kb"]),
        p["Ap"] / 2 * (1 - np.cos((2 * np.pi * at(p["Kp"]) + 15) / p["Kp"])),
        flat(p["Kpq"]),
        -p["Aq"] * at(p["Kq1"]) / p["Kq1"],
        p["Aq"] * (at(p["Kq2"]) / p["Kq2"] - 1),
        p["Ar"] * np.sin(np.pi * at(p["Kr"]) / p["Kr"]),
        s_wave(at(p["Ks"] - p["Kcs"])),
        st(at(p["Kst"])),
        t_wave(at(p["Kt"])),
        t_wave(p["Kt"]) * p["si"] / (at(p["Ki"]) + 10),
    ]


def beat(sampling_rate: float = 1000.0, var: float = 0.01, seed: int = 0, **parameters: float) -> tuple[np.ndarray, dict[str, float]]:
    """(samples, parameters used): one beat, its parameters varied by a normal share `var`, all but Ki.

    Parameters are checked before they vary.
    """
    if unknown := set(parameters) - set(DEFAULTS):
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    if not 0 <= var <= 1:
        raise TypeError("a variability is between 0 and 1")
    r = np.random.default_rng(seed)
    used = DEFAULTS | parameters
    check_limits(used)
    draws = iter(r.standard_normal(len(used)).tolist() if var else ())
    used = {n: v if n == "Ki" or not var else float(min(max(v * (1 + var * next(draws)), 0), 130) if n == "Kb" else max(v * (1 + var * next(draws)), 1e-9)) for n, v in used.items()}
    parts = segments(used, 1000.0 / sampling_rate)
    first, second = np.concatenate(parts[:6]), np.concatenate(parts[6:])
    widen = max(1, int(50 * sampling_rate / 10_000))
    return np.concatenate([k.smooth(first, "boxzen", widen), k.smooth(second, "boxzen", max(1, 10 * widen))]), used


def train(signal: int, beats: int, sampling_rate: float = 1000.0, var: float = 0.01, seed: int = 0) -> np.ndarray:
    """The samples of so many beats, made from a signal's own seed."""
    return np.concatenate([beat(sampling_rate, var, seed + 10_000 * int(signal) + j)[0] for j in range(beats)])


def ecg_table(spark: SparkSession, signals: int = 4, beats: int = 20, sampling_rate: float = 1000.0, var: float = 0.01, seed: int = 0) -> DataFrame:
    """(signal_id, i, x): trains of beats, each signal made by its own task from its own seed."""
    return ecg_trains(spark.range(signals).select("id", F.lit(beats).cast("long").alias("beats")), sampling_rate, var, seed)


def ecg_trains(trains: DataFrame, sampling_rate: float = 1000.0, var: float = 0.01, seed: int = 0) -> DataFrame:
    """(signal_id, i, x): for each (id, beats) a train of so many beats, made from a seed of its own."""

    def make(batches):
        import pandas as pd

        for b in batches:
            for s, beats in zip(b["id"], b["beats"], strict=True):
                x = train(s, beats, sampling_rate, var, seed)
                yield pd.DataFrame({"signal_id": s, "i": np.arange(len(x)), "x": x})

    return trains.select("id", "beats").mapInPandas(make, "signal_id long, i long, x double")
