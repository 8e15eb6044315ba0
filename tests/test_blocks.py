"""Blocks of rows that meet where they are stored, and what is computed over them, against brute force."""

import numpy as np
import pytest

from pulsegrid.functions import kernels as k
from pulsegrid.operators import beats
from pulsegrid.operators import biometrics as bio
from pulsegrid.operators import clusters as c
from pulsegrid.operators import metrics as m


def table(spark, x):
    return spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in enumerate(x)], "row_id long, v array<double>")


def brute_dbscan(x, min_samples, eps):
    near = k.distances(x, x) <= eps
    core = near.sum(1) >= min_samples
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += np.flatnonzero(near[j] & core).tolist()
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
    order = {v: n for n, v in enumerate(sorted({label[i] for i in np.flatnonzero(core)}))}
    return {i: order[label[i]] if i in label else -1 for i in range(len(x))}


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean"])
def test_dbscan_as_by_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(m, "BLOCK", 20)
    monkeypatch.setattr(m, "HELD", 2)
    x = np.random.default_rng(3).random((120, 2)) * 8
    eps = 0.7 if metric == "euclidean" else 0.49
    got = {r["row_id"]: r["cluster"] for r in c.dbscan(table(spark, x), 4, eps, metric).collect()}
    assert got == brute_dbscan(x, 4, 0.7) and len(set(got.values())) > 4


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 5)
    rows = table(spark, np.random.default_rng(0).random((40, 3)))
    for pairs, n in ((m.pdist(rows), 780), (m.cdist(rows, rows.where("row_id < 7")), 280)):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan and pairs.count() == n


def test_near_is_exact_at_the_limit():
    x = np.floor(np.random.default_rng(1).random((60, 4)) * 5) / 10 + 100
    for within in (0.0, 0.1, 0.5, float(k.distances(x, x)[3, 17])):
        assert (k.near(x, x, within) == (k.distances(x, x) <= within)).all()
    assert not k.near(x, x, -1.0).any()


def test_few_links_join_what_a_matrix_joins():
    r = np.random.default_rng(2)
    for density in (0.0, 0.01, 0.05, 0.5):
        close = r.random((30, 40)) < density
        i, j = c._joined(close)
        assert len(i) <= 3 * 70 and close[i, j].all()
        groups = lambda p, q: dict(zip(*map(np.ndarray.tolist, k.components(p, q + 30)), strict=True))
        assert groups(i, j) == groups(*np.nonzero(close))


def test_linkage_is_that_of_all_pairs():
    r = np.random.default_rng(4)
    for method in ("single", "complete", "average", "weighted", "centroid", "median", "ward"):
        x = np.floor(r.random((40, 2)) * 6)  # many ties
        d = k.distances(x, x)
        left, want = np.array(d) ** (2 if method in ("centroid", "median", "ward") else 1), []
        np.fill_diagonal(left, np.inf)
        z = k.linkage(d, method)
        place = {i: i for i in range(40)}
        for step, (a, b, _, _) in enumerate(z):
            i, j = divmod(int(left.argmin()), 40)
            want.append({place[a], place[b]} == {i, j})
            place[40 + step] = i
            if method in ("single", "complete"):
                new = (np.minimum if method == "single" else np.maximum)(left[i], left[j])
                left[i, :] = left[:, i] = new
                left[i, i] = np.inf
                left[j, :] = left[:, j] = np.inf
            else:
                break
        assert all(want)


def test_ensemble_partition_is_that_of_the_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(run, i, int(r.integers(0, 3))) for run in range(4) for i in range(60) if (run, i) != (2, 7)]
    ensemble = spark.createDataFrame(rows, "run_id int, row_id long, cluster int")
    for number, linkage in ((3, "average"), (5, "complete"), (59, "average"), (0, "average"), (3, "ward")):
        one, two = c.ensemble_partition(ensemble, number, linkage), c.coassoc_partition(c.create_coassoc(ensemble), number, linkage)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_hierarchical_takes_more_rows(spark):
    x = np.concatenate([np.random.default_rng(6).random((2_600, 2)), np.random.default_rng(7).random((2_600, 2)) + 9])
    got = {r["row_id"]: r["cluster"] for r in c.hierarchical(table(spark, x), 2).collect()}
    assert got == {i: int(i >= 2_600) for i in range(5_200)}


def test_nearest_templates_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(bio, "BLOCK", 7)
    monkeypatch.setattr(m, "HELD", 2)
    x = np.floor(np.random.default_rng(8).random((90, 2)) * 4)  # many ties
    every = spark.createDataFrame([(f"s{i % 3}", i, [float(z) for z in v]) for i, v in enumerate(x)], "subject string, sample_id long, v array<double>")
    probes, templates = every.where("sample_id % 4 = 0"), every.where("sample_id % 4 <> 0")
    near = bio.ranked(probes, templates, digits=6, kk=3)
    assert "CoGroup" not in near._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for r in near.collect():
        best.setdefault((r["sample_id"], r["claimed"]), []).append((r["d"], r["template_id"]))
    d = k.distances(x, x)
    for i in range(0, 90, 4):
        for s in range(3):
            want = sorted((round(float(d[i, j]), 6), j) for j in range(90) if j % 4 and j % 3 == s)[:3]
            assert sorted(best[i, f"s{s}"])[:3] == want
    assert bio.ranked(probes, templates).count() == probes.count() * templates.count()


def test_autocorrelation_shuffles_samples_once(spark):
    x = np.random.default_rng(9).random(25)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "signal_id long, i long, x double")
    got = beats.autocorrelation(df, 6)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["lag"]: pytest.approx(r["c"]) for r in got.collect()} == {j: float(x[: 25 - j] @ x[j:]) for j in range(7)}
