"""Every operator as a query over the test tables; doubles are rounded, so that engines that sum in another order agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beats as b
from ..operators import biometrics as bio
from ..operators import clusters as c
from ..operators import metrics as m
from ..operators import packed as p
from ..operators import signal as s
from ..operators import utils as u
from . import pipelines as pipe
from . import views as v

KEY = s.KEY
FS = 100.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def heart_rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed signals, their tops as beats, the beats' rates and their statistics, for every signal."""
    rates = s.heart_rate(v.peaks(spark, sf_dir), 5.0)
    return rounded(rates.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("hr").alias("mean_hr"), F.min("hr").alias("min_hr"), F.max("hr").alias("max_hr")))


THRESHOLDS = (8.0, 9.5, 11.0, 12.5)
EER_THRESHOLDS = (2.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0)


def _knn(spark: SparkSession, sf_dir: str, levels: tuple[float, ...] = THRESHOLDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = v.waves(spark, sf_dir).select(F.col("label").cast("string").alias("subject"), F.col("row_id").alias("sample_id"), "v")
    thresholds = spark.createDataFrame([(float(t),) for t in levels], "threshold double")
    return rows.where("sample_id % 5 = 0"), rows.where("sample_id % 5 <> 0"), thresholds


def _decisions(spark: SparkSession, sf_dir: str, levels: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    probes, templates, thresholds = _knn(spark, sf_dir, levels)
    pairs = u.stored(bio.ranked(probes, templates, digits=6, kk=3))
    return bio.knn_authenticate(pairs, thresholds).join(bio.knn_identify(pairs, thresholds), ["subject", "sample_id", "threshold"])


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("classifier"), (F.col("user_id") % 7).cast("string").alias("label"), F.length("event_type").cast("double").alias("weight"))


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("party")).agg(F.sum("value").alias("w")).select("party", F.round("w", 2).alias("votes"))


def _ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partitions of the customers of each nation by key and balance."""
    rows = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_nationkey", "s_acctbal")
    parts = [F.col("s_nationkey") % 3, F.col("s_nationkey") % 4, F.floor(F.col("s_acctbal") / 2500), F.col("row_id") % 3]
    out = None
    for r, part in enumerate(parts):
        one = rows.select(F.lit(r).alias("run_id"), "row_id", part.cast("int").alias("cluster"))
        out = one if out is None else out.unionByName(one)
    return out


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.sig_user(spark, sf_dir).groupBy(KEY).agg(F.avg("x").alias("a"), F.max("x").alias("h"), F.min("x").alias("l"), F.count(F.lit(1)).alias("n"))
    part = lambda k, n: ((F.col(KEY) * k) % n) / F.lit(float(n))
    return e.select(KEY, part(37, 101).alias("bsqi"), part(53, 97).alias("fsqi"), (part(11, 13) * 10).alias("ksqi"), (F.lit(0.85) + part(7, 19) * 0.15).alias("bas"), (F.col("n") * 1.7).alias("max_rate"))


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' signs as vectors of 0 and 1."""
    return v.waves(spark, sf_dir).select("row_id", F.transform("v", lambda x: (x > 0).cast("double")).alias("v"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all probes, and of those with even ids, as two runs."""
    every = _decisions(spark, sf_dir)
    return bio.subject_results(every).withColumn("run_id", F.lit(0)).unionByName(bio.subject_results(every.where("sample_id % 2 = 0")).withColumn("run_id", F.lit(1)))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.waves(spark, sf_dir).select(F.col("row_id").alias(KEY), F.col("v").alias("beat"))


def _curves(spark: SparkSession, sf_dir: str, k: float) -> DataFrame:
    return v.sig_user(spark, sf_dir).select(KEY, F.col("i").cast("double").alias("t"), (F.col("x") * k).alias("y"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "heart_rate_stats": heart_rate_stats,
    # Primitives.
    "signal_stats": lambda k, d: rounded(s.signal_stats(v.sig_user(k, d)), 8),
    "normalize": lambda k, d: rounded(s.normalize(v.sig_user(k, d))),
    "smoother_boxcar": lambda k, d: rounded(s.smoother_boxcar(v.sig_user(k, d), 5)),
    "smoother_hamming": lambda k, d: rounded(s.convolve_same(v.sig_user(k, d), [0.08, 0.54, 1.0, 0.54, 0.08], mirror=True)),
    "smoother_median": lambda k, d: rounded(s.smoother_median(v.sig_user(k, d), 5)),
    "zero_cross": lambda k, d: s.zero_cross(v.sig_user(k, d), detrend=True),
    "find_extrema": lambda k, d: rounded(s.find_extrema(v.sig_user(k, d), "both")),
    "finite_difference": lambda k, d: rounded(s.finite_difference(v.sig_user(k, d), [-0.5, 0.0, 0.5])),
    "windower_mean": lambda k, d: rounded(s.windower(v.sig_user(k, d), 10, 5, F.avg)),
    "windower_kernel": lambda k, d: rounded(s.windower(v.sig_user(k, d), 5, 5, F.sum, [0.0, 0.5, 1.0, 0.5, 0.0])),
    "windower_array": lambda k, d: rounded(s.windower_array(v.sig_user(k, d), 6, 3, lambda x: x - x[::-1])),
    "mean_waves": lambda k, d: rounded(s.waves(v.waves(k, d), 10, 5, "mean")),
    "median_waves": lambda k, d: rounded(s.waves(v.waves(k, d), 10, 10, "median")),
    "heart_rate": lambda k, d: rounded(s.heart_rate(v.raw_peaks(k, d), 5.0)),
    "heart_rate_smooth": lambda k, d: rounded(s.heart_rate(v.raw_peaks(k, d), 5.0, smooth=True)),
    "rms_error": lambda k, d: rounded(s.rms_error(v.xy(k, d))),
    "pearson": lambda k, d: rounded(s.pearson_correlation(v.xy(k, d))),
    "linear_regression": lambda k, d: rounded(s.linear_regression(v.xy(k, d))),
    "paired_test_stat": lambda k, d: rounded(s.paired_test(v.xy(k, d))),
    "unpaired_test_stat": lambda k, d: rounded(s.unpaired_test(v.xy(k, d))),
    "synchronize": lambda k, d: rounded(s.synchronize(v.sig_user(k, d), v.lagged(k, d), digits=6), 4),
    "power_spectrum": lambda k, d: rounded(s.power_spectrum(v.sig_user(k, d), FS, decibel=False)),
    "power_spectrum_padded": lambda k, d: rounded(s.power_spectrum(v.sig_user(k, d), FS, pad=20, decibel=False)),
    "welch_spectrum": lambda k, d: rounded(s.welch_spectrum(v.sig_user(k, d), FS, 16, 8, decibel=False), 5),
    "band_power": lambda k, d: rounded(s.band_power(s.power_spectrum(v.sig_user(k, d), FS, decibel=True), 5, 20)),
    "find_intersection": lambda k, d: rounded(s.find_intersection(_curves(k, d, 1.0), _curves(k, d, -0.5).withColumn("y", F.col("y") + 60.0))),
    "distance_profile": lambda k, d: rounded(s.distance_profile(s.first_window(v.sig_user(k, d), 8), v.sig_user(k, d), 8), 5),
    "matrix_profile_self": lambda k, d: s.matrix_profile(v.sig_user(k, d), None, 8, digits=5).select(KEY, "start", "d", F.col("neighbour")),
    "matrix_profile_cross": lambda k, d: s.matrix_profile(v.sig_user(k, d), v.lagged(k, d, 7).withColumn("x", F.col("x") * F.col("x") / 100), 8, digits=5),
    "car_reference": lambda k, d: rounded(s.car_reference(v.sig_channel(k, d))),
    "acc_time_features": lambda k, d: rounded(s.acc_time_features(v.acc3(k, d)).groupBy("l_orderkey").agg(F.sum("vm").alias("vm"), F.max("sm").alias("sm")), 4),
    "norm_freq": lambda k, d: rounded(v.sig_user(k, d).select(KEY, "i", s.norm_freq(F.col("x"), FS).alias("w"))),
    "time_axis": lambda k, d: rounded(s.add_time(v.sig_user(k, d), FS, endpoint=False).select(KEY, "i", "ts"), 9),
    # Beats and onsets.
    "correct_rpeaks": lambda k, d: b.correct_rpeaks(v.sig_user(k, d), v.peaks(k, d), FS, 0.03),
    "extract_heartbeats": lambda k, d: b.extract_heartbeats(v.sig_user(k, d), v.peaks(k, d), FS, 0.02, 0.04).select(KEY, "r", F.posexplode("beat").alias("p", "x")),
    "compare_segmentation": lambda k, d: rounded(b.compare_segmentation(v.raw_peaks(k, d), v.peaks(k, d), FS, 0, 0.03, 0.02)),
    "ssf_segmenter": lambda k, d: b.ssf_segmenter(v.sig_user(k, d), FS, 20, 0.03, 0.02),
    "bsqi": lambda k, d: rounded(b.bsqi(v.peaks(k, d), v.raw_peaks(k, d), "matching", 2)),
    "sample_sqi": lambda k, d: rounded(b.sample_sqi(v.sig_user(k, d), 20.0), 5),
    "fsqi": lambda k, d: rounded(b.fsqi(s.welch_spectrum(v.sig_user(k, d), FS, 32, 16, decibel=False, scaling="density", double=False), (5, 20), (0, 40)), 5),
    "zz2018_simple": lambda k, d: b.zz2018(_scores(k, d), "simple"),
    "zz2018_fuzzy": lambda k, d: b.zz2018(_scores(k, d), "fuzzy"),
    "template_positions": lambda k, d: b.template_positions(_templates(k, d), r=30, p_end=25, t_start=40).drop("beat").na.fill(-1),
    "threshold_edges": lambda k, d: b.threshold_edges(v.sig_user(k, d), F.lit(60.0)),
    "hodges_bui": lambda k, d: b.hodges_bui(v.sig_user(k, d), 10.0, 8.0, 6, 1.25),
    "silva": lambda k, d: b.silva(v.sig_user(k, d), 3, 9, 25.0),
    "basic_scr": lambda k, d: rounded(b.basic_scr(v.sig_user(k, d))),
    "identify_heart_sounds": lambda k, d: b.identify_heart_sounds(v.raw_peaks(k, d)),
    "avg_heart_rate": lambda k, d: rounded(b.avg_heart_rate(v.sig_user(k, d), 20.0, digits=4)),
    "resp_rate": lambda k, d: rounded(b.resp_rate(v.sig_user(k, d), 1.0)),
    # Distances, clusters, templates.
    "pdist_euclidean": lambda k, d: rounded(m.pdist(v.waves(k, d)), 5),
    "pdist_pcosine": lambda k, d: rounded(m.pdist(v.waves(k, d), "pcosine"), 5),
    "cdist_cityblock": lambda k, d: rounded(m.cdist(v.waves(k, d).where("label < 5"), v.waves(k, d).where("label >= 5"), "cityblock"), 5),
    "pdist_jaccard": lambda k, d: rounded(m.pdist(_signs(k, d), "jaccard"), 6),
    "pdist_yule": lambda k, d: rounded(m.pdist(_signs(k, d), "yule"), 6),
    "close_pairs": lambda k, d: rounded(m.close_pairs(v.waves(k, d), 9.5), 5),
    "squareform": lambda k, d: rounded(m.squareform(m.pdist(v.waves(k, d), "chebyshev")), 5),
    "dbscan": lambda k, d: c.dbscan(v.waves(k, d), 4, 9.5),
    "outliers_dbscan": lambda k, d: c.outliers_dbscan(v.waves(k, d), 4, 9.5),
    "outliers_dmean": lambda k, d: c.outliers_dmean(v.waves(k, d), digits=5),
    "mean_distance": lambda k, d: rounded(c.mean_distance(v.waves(k, d)), 5),
    "mdist_templates": lambda k, d: c.mdist_templates(v.waves(k, d), v.waves(k, d).select("row_id", F.col("label").alias("cluster")), 20, digits=5),
    "centroid_templates": lambda k, d: rounded(c.centroid_templates(v.waves(k, d), v.waves(k, d).select("row_id", F.col("label").alias("cluster"))).select("cluster", F.posexplode("template").alias("p", "x"))),
    "coassoc": lambda k, d: c.create_coassoc(_ensemble(k, d)),
    "extract_clusters": lambda k, d: c.extract_clusters(v.waves(k, d).select("row_id", (F.col("label") - 1).alias("cluster"))).select("cluster", F.explode("rows").alias("row_id")),
    "merge_clusters": lambda k, d: c.merge_clusters(v.waves(k, d).select("row_id", (F.col("label") - 1).alias("cluster"))),
    "hierarchical": lambda k, d: c.hierarchical(v.waves(k, d), 4, "average"),
    "coassoc_partition": lambda k, d: c.ensemble_partition(_ensemble(k, d), 3),
    "kmeans": lambda k, d: c.kmeans(v.waves(k, d), 10),
    "create_ensemble": lambda k, d: c.create_ensemble(v.waves(k, d), c.dbscan, {"min_samples": [3, 4], "eps": [9.0, 9.5]}),
    "consensus": lambda k, d: c.consensus(v.waves(k, d), c.dbscan, {"min_samples": [3, 4], "eps": [9.0, 9.5]}, 3),
    # Biometrics.
    "knn_authenticate": lambda k, d: bio.knn_authenticate(bio.ranked(*_knn(k, d)[:2], digits=6, kk=3), _knn(k, d)[2]),
    "knn_identify": lambda k, d: bio.knn_identify(bio.ranked(*_knn(k, d)[:2], digits=6, kk=3), _knn(k, d)[2]),
    "subject_results": lambda k, d: bio.subject_results(_decisions(k, d)),
    "assess_classification": lambda k, d: rounded(bio.assess_classification(bio.subject_results(_decisions(k, d)))),
    "assess_runs": lambda k, d: rounded(bio.assess_runs(_runs(k, d))),
    "misses": lambda k, d: bio.misses(_decisions(k, d)),
    "eer": lambda k, d: rounded(bio.crossings(bio.auth_rates(bio.subject_results(_decisions(k, d, EER_THRESHOLDS))), "far", "frr", ["subject"])),
    "majority_rule": lambda k, d: bio.majority_rule(v.table(k, d, "events"), "user_id", "event_type"),
    "combination": lambda k, d: rounded(bio.combination(_votes(k, d))),
    "svm_identify": lambda k, d: _svm(k, d),
    # Utilities.
    "dhondt": lambda k, d: u.highest_averages(_parties(k, d), "party", "votes", 17),
    "sainte_lague": lambda k, d: u.highest_averages(_parties(k, d), "party", "votes", 17, "Sainte-Lague"),
    "huntington_hill": lambda k, d: u.highest_averages(_parties(k, d), "party", "votes", 17, "Huntington-Hill"),
    "largest_remainder": lambda k, d: u.largest_remainder(_parties(k, d), "party", "votes", 17),
    "random_fraction": lambda k, d: u.random_fraction(v.waves(k, d).select("row_id", "label"), "row_id", 0.3),
    "cross_validation": lambda k, d: u.cross_validation(v.waves(k, d).select("row_id", "label"), "label", "row_id", 3, 0.2),
    # Whole signals.
    "iir_filter": lambda k, d: rounded(p.lfilter(v.sig_user(k, d), [0.2], [1.0, -0.8])),
    "fir_filter": lambda k, d: rounded(p.filter_signal(v.sig_type(k, d), "FIR", "bandpass", 31, [3, 45], 1000.0)),
    "butter_filter": lambda k, d: rounded(p.filter_signal(v.sig_type(k, d), "butter", "lowpass", 4, 40, 1000.0)),
    "analytic_signal": lambda k, d: rounded(p.analytic_signal(v.sig_user(k, d))),
    "phase_locking": lambda k, d: rounded(s.phase_locking(_phase_pairs(k, d))),
    "emg_find_onsets": lambda k, d: p.emg_onsets(v.sig_user(k, d), 100.0),
    "kbk_scr": lambda k, d: rounded(p.kbk_scr(v.sig_user(k, d), 5.0)),
    "average_rate": lambda k, d: rounded(p.average_rate(v.sig_user(k, d), 20.0)),
    "ppg_mean_pulse": lambda k, d: rounded(p.ppg_mean_pulse(v.whole_recordings(k, d))),
    "homomorphic_filter": lambda k, d: rounded(p.homomorphic_filter(v.sig_type(k, d), 100.0)),
    "pearson_test": lambda k, d: rounded(p.pearson_test(v.xy(k, d))),
    "filter_response": lambda k, d: rounded(k.createDataFrame(p.filter_response("cheby2", "lowpass", 4, 8, 100.0, 250)), 5),
    "unpaired_test": lambda k, d: rounded(p.pvalues(s.unpaired_test(v.xy(k, d)))),
    "paired_test": lambda k, d: rounded(p.pvalues(s.paired_test(v.xy(k, d)))),
}


def _detected(name: str, fs: float = 1000.0, **options: float) -> Callable[[SparkSession, str], DataFrame]:
    """A detector over a synthetic recording for each user."""
    return lambda k, d: p.detect(v.whole_recordings(k, d, fs), name, fs, **options)


QUERIES |= {f"detect_{n}": _detected(n) for n in ("christov", "gamboa", "hamilton", "asi", "zong", "elgendi", "kavsaoglu", "heart_sounds")}
QUERIES |= {"detect_ssf": _detected("ssf", threshold=1e-4), "detect_engzee": _detected("engzee", 250.0)}
QUERIES |= {
    "activity_bonato": lambda k, d: p.activity(v.sig_user(k, d), "bonato", rest=[0, 20], threshold=2.0, hold=2, repay=2, fails=1),
    "activity_lidierth": lambda k, d: p.activity(v.sig_user(k, d), "lidierth", rest=[0, 20], size=3, threshold=1.0, hold=2, fails=1),
    "activity_solnik": lambda k, d: p.activity(v.sig_user(k, d), "solnik", rest=[0, 20], threshold=10.0, hold=2),
    "activity_londral": lambda k, d: p.activity(v.sig_user(k, d), "londral", rest=[0, 20], size=4, threshold=8.0, hold=2),
    "activity_abbink": lambda k, d: p.activity(v.sig_type(k, d), "abbink", rest=[0, 200], size=10, alarm_size=10, threshold=1.0, transition=1.0),
    "pipeline_ecg": lambda k, d: rounded(pipe.ecg(v.whole_recordings(k, d)).heart_rate),
    "signal_quality": lambda k, d: b.signal_quality(v.whole_recordings(k, d), p.detect(v.whole_recordings(k, d), "hamilton"), p.detect(v.whole_recordings(k, d), "christov")),
    "pipeline_eda": lambda k, d: rounded(pipe.eda(v.sig_type(k, d), 100.0).responses),
    "pipeline_emg": lambda k, d: pipe.emg(v.whole_recordings(k, d), 1000.0).onsets,
    "pipeline_abp": lambda k, d: pipe.abp(v.whole_recordings(k, d)).onsets,
    "pipeline_bvp": lambda k, d: rounded(pipe.bvp(v.whole_recordings(k, d)).heart_rate),
    "pipeline_ppg": lambda k, d: rounded(pipe.ppg(v.whole_recordings(k, d)).heart_rate),
    "pipeline_pcg": lambda k, d: pipe.pcg(v.whole_recordings(k, d)).sounds,
    "pipeline_resp": lambda k, d: rounded(pipe.resp(v.sig_type(k, d), 10.0).resp_rate),
    "pipeline_acc": lambda k, d: rounded(pipe.acc(v.sig_user(k, d).select(KEY, "i", "x", (F.col("x") * 2).alias("y"), (-F.col("x")).alias("z")), FS).spectrum),
    "pipeline_eeg": lambda k, d: rounded(pipe.eeg(v.sig_channel(k, d), 256.0).power, 4),
    "eeg_plf": lambda k, d: rounded(pipe.eeg(v.sig_channel(k, d), 256.0).plf, 4),
}


def _svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, templates, _ = _knn(spark, sf_dir)
    model = bio.SVM(spark)
    model.save_templates(templates)
    model.train()
    return model.recognise(probes, spark.range(1).select(F.lit(0.5).alias("threshold")))


def _phase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = p.analytic_signal(v.sig_user(spark, sf_dir)).select(KEY, "i", F.col("phase").alias("p1"))
    other = v.sig_user(spark, sf_dir).select(KEY, "i", (F.col("x") * F.col("x")).alias("x"))
    return one.join(p.analytic_signal(other).select(KEY, "i", F.col("phase").alias("p2")), [KEY, "i"])
