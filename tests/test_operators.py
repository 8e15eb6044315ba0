"""Golden vectors, stores, streams and classifiers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as k
from pulsegrid.operators import beats as b
from pulsegrid.operators import biometrics as bio
from pulsegrid.operators import clusters as c
from pulsegrid.operators import metrics as m
from pulsegrid.operators import packed as p
from pulsegrid.operators import signal as s
from pulsegrid.operators import utils as u
from pulsegrid.sources.store import Store, join_group, pack_zip, unpack_zip
from pulsegrid.sources.text import load_txt, store_txt
from pulsegrid.streaming.online import OnlineFilter, filter_stream


def signal(spark, x, name=0):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(x)], "signal_id long, i long, x double")


def beats(spark, at):
    return spark.createDataFrame([(0, int(i)) for i in at], "signal_id long, i long")


def ints(df, col="i"):
    return sorted(r[col] for r in df.collect())


def test_golden_signals(spark):
    assert ints(s.find_extrema(signal(spark, [0, 1, 0, 2, 2, 0]), "max")) == [1, 3, 4]
    assert ints(s.zero_cross(signal(spark, [1, 0, -1]))) == [0, 1]
    rates = s.heart_rate(beats(spark, [0, 1000, 1500, 1550]), 1000.0).orderBy("i").collect()
    assert [(r["i"], r["hr"]) for r in rates] == [(1000, 60.0), (1500, 120.0)]
    assert [r["sound"] for r in b.identify_heart_sounds(beats(spark, [0, 300, 1000, 1300, 2000])).orderBy("i").collect()] == [1, 2, 1, 2, 1]
    slope = s.finite_difference(signal(spark, range(6)), [-0.5, 0, 0.5]).orderBy("i").collect()
    assert [(r["i"], r["x"]) for r in slope] == [(i, 1.0) for i in range(1, 5)]


def test_spectrum_of_a_cosine(spark):
    x = 2 * np.cos(2 * np.pi * 5 * np.arange(64) / 64)
    power = {r["k"]: r["power"] for r in s.power_spectrum(signal(spark, x), 64.0, decibel=False).collect()}
    assert power[5] == pytest.approx(4) and sum(power.values()) == pytest.approx(4)


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9, 50])
def test_boxcar_equals_the_kernel(spark, size):
    x = np.random.default_rng(size).standard_normal(12)
    got = [r["x"] for r in s.smoother_boxcar(signal(spark, x), size).orderBy("i").collect()]
    assert np.allclose(got, k.smooth(x, "boxcar", size))


def test_empty_and_tiny_signals(spark):
    none = signal(spark, [1.0]).where("i < 0")
    for df in (s.normalize(none), s.smoother_boxcar(none), s.zero_cross(none), s.power_spectrum(none), s.matrix_profile(none, None, 4), p.smooth(none), p.detect(none, "hamilton")):
        assert df.count() == 0
    one = signal(spark, [1.0])
    assert s.normalize(one).first()["x"] is None
    assert s.smoother_boxcar(one, 3).first()["x"] == 1.0
    assert p.filter_signal(one, "butter", "lowpass", 2, 10, 1000.0).count() == 0


def test_matrix_profile_of_a_periodic_signal(spark):
    x = np.tile([0, 1, 3, 1, 0, -2, -1, 0.5, 0.25, 2], 6)
    rows = s.matrix_profile(signal(spark, x), None, 8).collect()
    assert len(rows) == 53 and all(r["d"] == pytest.approx(0, abs=1e-5) for r in rows)


def test_correct_rpeaks_takes_the_first_of_a_tie(spark):
    x = [0.0] * 40
    x[18] = x[21] = 5.0
    assert ints(b.correct_rpeaks(signal(spark, x), beats(spark, [20, 1]), 100.0, 0.05)) == [18]


def test_allocators(spark):
    votes = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0)], "party string, votes double")
    for df in (u.highest_averages(votes, "party", "votes", 7), u.largest_remainder(votes, "party", "votes", 7)):
        assert [r["seats"] for r in df.orderBy("party").collect()] == [4, 2, 1]
    with pytest.raises(ValueError):
        u.highest_averages(votes, "party", "votes", 7, "other")


def test_rates_with_empty_columns(spark):
    zero = spark.createDataFrame([(0.5, 0, 0, 0, 0)], "threshold double, tp long, fp long, tn long, fn long")
    row = bio.auth_rates(zero).first()
    assert all(row[n] == 0 for n in ("acc", "tar", "far", "frr", "trr", "err", "ppv", "mcc"))


def test_majority_and_combination(spark):
    votes = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("y", "b", 1.0)], "classifier string, label string, weight double")
    assert bio.combination(votes).first()["label"] == "b"
    one = votes.withColumn("key", F.lit(1))
    assert tuple(bio.majority_rule(one, "key").first()) == (1, "b", 2)
    with pytest.raises(bio.CombinationError):
        bio.combination(votes.where("false"))


def test_distances(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [-1.0, -2.0, -3.0]), (3, [0.0, 1.0, 5.0])], "row_id long, v array<double>")
    d = {(r["i"], r["j"]): r["d"] for r in m.pdist(rows, "pcosine").collect()}
    assert d[(1, 2)] == pytest.approx(0, abs=1e-12)
    for metric in ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski", "cosine", "correlation", "hamming", "braycurtis", "canberra"):
        assert m.pdist(rows, metric).count() == 3
    vi = [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert m.pdist(rows, "mahalanobis", vi=vi).where("i = 1 and j = 3").first()["d"] == pytest.approx(6**0.5)
    assert m.squareform(m.pdist(rows)).count() == 9
    with pytest.raises(ValueError):
        m.pdist(rows, "other")


def blobs(spark, n=12):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(v) for v in r.standard_normal(4) * 0.2 + 5 * (i % 3)], str(i % 3)) for i in range(3 * n)], "row_id long, v array<double>, subject string")


def test_clusterings(spark):
    rows = blobs(spark)
    for df in (c.hierarchical(rows, 3), c.kmeans(rows, 3), c.dbscan(rows, 3, 2.0), c.consensus_kmeans(rows, 3, nensemble=4, kmin=3, kmax=4)):
        groups = {}
        for r in df.collect():
            groups.setdefault(r["row_id"] % 3, set()).add(r["cluster"])
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3
    assert c.outliers_dbscan(rows.union(spark.createDataFrame([(99, [50.0] * 4, "x")], rows.schema)), 3, 2.0).where("cluster = -1").count() == 1
    assert c.centroid_templates(rows, rows.select("row_id", F.col("subject").cast("int").alias("cluster")), 6).count() == 6


@pytest.mark.parametrize("cls", [bio.KNN, bio.SVM])
def test_classifiers(spark, cls, tmp_path):
    rows = blobs(spark).withColumnRenamed("row_id", "sample_id")
    model = cls(spark)
    with pytest.raises(bio.UntrainedError):
        model.authenticate(rows, "0", 1.0)
    model.batch_train({n: rows.where(F.col("subject") == n) for n in "012"})
    assert model.list_subjects() == ["0", "1", "2"] and model.check_subject("1")
    threshold = 3.0 if cls is bio.KNN else 0.5
    found = {r["sample_id"]: r["identified"] for r in model.identify(rows, threshold).collect()}
    assert all(found[i] == str(i % 3) for i in found)
    accepted = model.authenticate(rows.where("subject = '1'"), "1", threshold).collect()
    assert len(accepted) == 12 and all(r["accepted"] for r in accepted)
    with pytest.raises(bio.SubjectError):
        model.authenticate(rows, "9", threshold)
    model.set_threshold("1", "auth", threshold)
    assert model.get_threshold("1", "auth") == threshold
    model.save(str(tmp_path / "model"))
    again = cls.load(spark, str(tmp_path / "model"))
    assert again.get_threshold("1", "auth") == threshold and again.list_subjects() == ["0", "1", "2"]
    model.dismiss("2")
    assert model.list_subjects() == ["0", "1"] and not model.check_subject("2")


def test_knn_updates_thresholds_and_cross_validates(spark):
    rows = blobs(spark, 8).withColumnRenamed("row_id", "sample_id")
    model = bio.KNN(spark, 3)
    model.batch_train({n: rows.where(F.col("subject") == n) for n in "012"})
    model.update_thresholds()
    assert set(model.thresholds) <= {"0", "1", "2"}
    splits = u.cross_validation(rows.select("sample_id", "subject"), "subject", "sample_id", 2, 0.25)
    out = bio.KNN.cross_validate(spark, rows, splits, bio.threshold_grid(spark, 10.0, 5)).where("subject is null").orderBy("threshold").collect()
    assert out[-1]["tar"] == 1.0 and out[2]["id_acc"] == 1.0


def test_online_filter_in_parts():
    x = np.random.default_rng(0).standard_normal(50)
    whole, parts = OnlineFilter([0.2], [1, -0.8]), OnlineFilter([0.2], [1, -0.8])
    assert np.allclose(whole.filter(x), np.concatenate([parts.filter(y) for y in np.split(x, [7, 7, 30])]))
    with pytest.raises(TypeError):
        OnlineFilter(None, [1])


def test_filter_stream_equals_one_pass(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((3, 28))
    for seq in range(4):
        rows = [(sid, seq, [float(v) for v in x[sid, 7 * seq : 7 * seq + 7]]) for sid in range(3)]
        spark.createDataFrame(rows, "signal_id long, seq long, x array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{seq}")
    stream = spark.readStream.schema("signal_id long, seq long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = filter_stream(stream, [0.2], [1.0, -0.8]).writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("filtered").orderBy("signal_id", "i").collect()
    want = [v for sid in range(3) for v in OnlineFilter([0.2], [1.0, -0.8]).filter(x[sid])]
    assert len(got) == 84
    assert np.allclose([r["x"] for r in got], want)


def test_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i / 4, -float(i)]) for i in range(5)], "i long, x array<double>")
    store_txt(rows, f"{tmp_path}/txt", 100.0, 12, dt.datetime(2020, 1, 2, 3, 4, 5, 6), ["A", "B"])
    samples, meta = load_txt(spark, f"{tmp_path}/txt")
    assert [r["x"] for r in samples.orderBy("i").collect()] == [[i / 4, -float(i)] for i in range(5)]
    row = meta.first()
    assert (row["sampling_rate"], row["resolution"], row["labels"], row["date"]) == (100.0, 12, ["A", "B"], dt.datetime(2020, 1, 2, 3, 4, 5, 6))


def test_text_without_header_and_bad_date(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Date:= yesterday\n1\n2\n")
    samples, meta = load_txt(spark, f"{tmp_path}/a.txt")
    assert [r["x"] for r in samples.orderBy("i").collect()] == [[1.0], [2.0]]
    assert meta.first()["date"] is None and meta.first()["sampling_rate"] is None


def test_store(spark, tmp_path):
    with Store(spark, f"{tmp_path}/store") as store:
        store.add_header({"who": "me"})
        store.add_signal(signal(spark, [1, 2]), {"fs": 10}, "a/b", "one")
        store.add_signal(signal(spark, [3]), None, "a", "two", compress=True)
        store.add_event(spark.createDataFrame([(0.5, 1.0)], "ts double, value double"), {}, "a", "ev")
        rows, mdata = store.get_signal("a/b", "one")
        assert mdata == {"fs": 10} and rows.count() == 2
        assert store.list_signals("a") == [("/a", "two")]
        assert store.list_signals("", recursive=True) == [("/a", "two"), ("/a/b", "one")]
        assert store.list_events("a") == [("/a", "ev")] and store.get_event("a", "ev")[0].count() == 1
        store.del_signal("a", "two")
        with pytest.raises(KeyError):
            store.get_signal("a", "two")
        store.del_signal_group("a")
        assert store.list_signals("", recursive=True) == [] and store.get_header() == {"who": "me"}
    with pytest.raises(OSError):
        store.add_header({})
    assert join_group("a//b/", "c") == "/a/b/c"


def test_zip(tmp_path):
    (tmp_path / "x.txt").write_text("x")
    path = pack_zip([str(tmp_path / "x.txt"), str(tmp_path / "none")], str(tmp_path / "z"))
    unpack_zip(path, str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.txt").read_text() == "x"


def test_results_and_names():
    r = u.Result(a=1, b=2)
    assert r[0] == r["a"] == r.a == 1 and list(r) == [1, 2] and r.keys() == ["a", "b"] and r.as_dict() == {"a": 1, "b": 2}
    for bad in (["1a"], ["for"], ["a", "a"], ["a b"]):
        with pytest.raises(ValueError):
            u.check_names(bad)
    assert u.fileparts("/a/b.tar") == ("/a", "b", "tar") and u.fullfile("a", "b", "txt") == "a/b.txt"
    u.tic("t")
    assert u.tac("t") >= 0
    u.clear("t")
    with pytest.raises(KeyError):
        u.tac("t")


def test_errors_of_a_kernel_are_raised(spark):
    from pulsegrid.functions.kernels import NoResult
    from pulsegrid.operators import packed

    df = spark.createDataFrame([(s, i, float(i % 3)) for s in (1, 2) for i in range(4 * s)], "signal_id long, i long, x double")

    def short(x):
        if len(x) < 5:
            raise NoResult("short")
        return {"i": np.arange(len(x))}

    assert packed.per_signal(df, short, "i long").count() == 8
    with pytest.raises(Exception, match="a bug"):
        packed.per_signal(df, lambda x: (_ for _ in ()).throw(ValueError("a bug")), "i long").count()
    assert packed.filter_signal(df, "butter", "lowpass", 4, 40, 1000.0).count() == 0  # too short


def test_close_pairs_in_blocks(spark, monkeypatch):
    from pulsegrid.operators import metrics

    monkeypatch.setattr(metrics, "BLOCK", 7)
    r = np.random.default_rng(0)
    x = r.standard_normal((60, 3)) * np.linspace(0.2, 3, 60)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    every = {(q["i"], q["j"]): q["d"] for q in metrics.pdist(rows).collect()}
    assert len(every) == 60 * 59 // 2 and all(abs(d[i, j] - v) < 1e-9 and i < j for (i, j), v in every.items())
    for eps in (0.3, 1.0, 100.0):
        assert {(q["i"], q["j"]) for q in metrics.close_pairs(rows, eps).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= eps}
    assert metrics.pdist(rows, lambda a, b: float(a[0] - b[0])).where("abs(d) > 0").count() == 60 * 59 // 2
    assert metrics.pdist(rows.limit(0)).count() == 0 and metrics.cdist(rows, rows.limit(3)).count() == 180
    square = metrics.squareform(metrics.pdist(rows))
    assert metrics.squareform(square, checks=True).count() == 60 * 59 // 2
    with pytest.raises(ValueError):
        metrics.squareform(square.where("i <= j"), checks=True)


def test_profile_in_blocks(spark, monkeypatch):
    from pulsegrid.operators import signal

    r = np.random.default_rng(1)
    x = r.integers(0, 5, 60).astype(float)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "signal_id long, i long, x double")
    whole = signal.matrix_profile(df, None, 6).orderBy("start").collect()
    monkeypatch.setattr(signal, "PROFILE_BLOCK", 11)
    assert signal.matrix_profile(df, None, 6).orderBy("start").collect() == whole and len(whole) == 55
    assert signal.matrix_profile(df, None, 6, limit=F.col("start") < 9).count() == 9


def test_stored_objects_and_results(tmp_path):
    import copy
    import pickle

    from pulsegrid.operators.utils import Result
    from pulsegrid.sources import store, synthetic

    store.serialize({"a": [1, 2]}, str(tmp_path / "x"), 9)
    assert store.deserialize(str(tmp_path / "x")) == {"a": [1, 2]}
    with pytest.raises(ValueError):
        store.serialize(1, str(tmp_path / "y"), 10)
    one = Result(a=1, b="x")
    for other in (copy.copy(one), pickle.loads(pickle.dumps(one))):
        assert other.as_dict() == {"a": 1, "b": "x"} and other.__getnewargs__() == ((1, "x"),)
    for bad in ({"Kb": 131}, {"Ap": 0.6}, {"Kr": 9}, {"sm": 0}):
        with pytest.raises(ValueError):
            synthetic.beat(**bad)
    with pytest.raises(TypeError):
        synthetic.beat(var=2)
