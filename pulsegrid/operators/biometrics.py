"""Biometric verification and identification over templates (subject, sample_id, v), and their assessment."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from .metrics import block_columns, blocks_met, distance, packed
from .utils import random_fraction


class SubjectError(Exception):
    """A subject that isn't enrolled."""

    def __init__(self, subject=None):
        super().__init__(f"subject {subject} is not enrolled" if subject is not None else "the subject is not enrolled")
        self.subject = subject


class UntrainedError(Exception):
    def __init__(self):
        super().__init__("the classifier has no subjects")


class CombinationError(Exception):
    def __init__(self):
        super().__init__("there are no results to combine")


# --- rates -----------------------------------------------------------------------------------------------------


def _share(a: Column, b: Column) -> Column:
    """a / b, with 1 for a denominator of 0."""
    return a / F.when(b == 0, 1.0).otherwise(b.cast("double"))


def auth_rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of verification to (threshold, tp, fp, tn, fn)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*",
        _share(tp + tn, tp + tn + fp + fn).alias("acc"),
        _share(tp, tp + fn).alias("tar"),
        _share(fp, tn + fp).alias("far"),
        _share(fn, tp + fn).alias("frr"),
        _share(tn, tn + fp).alias("trr"),
        _share(fp + fn, tp + tn + fp + fn).alias("err"),
        _share(tp, tp + fp).alias("ppv"),
        _share(fp, tp + fp).alias("fdr"),
        _share(tn, tn + fn).alias("npv"),
        _share(fn, tn + fn).alias("for"),
        _share(tp * tn - fp * fn, root).alias("mcc"),
    )


def id_rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of identification to (threshold, h, m, r): hits, misses and rejections."""
    h, m, r = (F.col(c).cast("double") for c in ("h", "m", "r"))
    n = h + m + r
    return counts.select("*", _share(h, n).alias("acc"), _share(m + r, n).alias("err"), _share(m, n).alias("mr"), _share(r, n).alias("rr"))


def crossings(rates: DataFrame, one: str, two: str, key: list[str] | None = None) -> DataFrame:
    """(key, threshold, rate): where two rates, linear between thresholds, meet; every such point."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy("threshold")
    rows = rates.withColumn("d", F.col(one) - F.col(two)).withColumn("d1", F.lead("d").over(w)).withColumn("t1", F.lead("threshold").over(w)).withColumn("r1", F.lead(one).over(w))
    s = F.when(F.col("d") == 0, 0.0).otherwise(F.try_divide("d", F.col("d") - F.col("d1")))
    hit = rows.where("d = 0 or (d1 <> 0 and signum(d) <> signum(d1))").withColumn("s", s)
    at = F.col("threshold") + F.col("s") * F.coalesce(F.col("t1") - F.col("threshold"), F.lit(0.0))
    return hit.select(*(key or []), at.alias("threshold"), (F.col(one) + F.col("s") * F.coalesce(F.col("r1") - F.col(one), F.lit(0.0))).alias("rate"))


def subject_results(decisions: DataFrame) -> DataFrame:
    """(subject, threshold, tp, fp, tn, fn, h, m, r) of decisions (subject, sample_id, threshold, claimed, accepted, identified).

    The first four count each claim, the last three each sample: identified as its subject, as another, or not at all.
    """
    own, yes = F.col("claimed") == F.col("subject"), F.col("accepted")
    count = lambda c: F.count_if(c).cast("long")
    once = own
    return decisions.groupBy("subject", "threshold").agg(
        count(own & yes).alias("tp"), count(~own & yes).alias("fp"), count(~own & ~yes).alias("tn"), count(own & ~yes).alias("fn"),
        count(once & (F.col("identified") == F.col("subject"))).alias("h"),
        count(once & F.col("identified").isNotNull() & (F.col("identified") != F.col("subject"))).alias("m"),
        count(once & F.col("identified").isNull()).alias("r"),
    )


def assess_classification(results: DataFrame) -> DataFrame:
    """Counts per subject and threshold, and over all subjects (subject null), with all rates."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "h", "m", "r")]
    both = results.rollup("threshold", "subject").agg(*sums).where("threshold is not null")
    rated = auth_rates(both.drop("h", "m", "r"))
    ids = id_rates(both.select(F.col("threshold").alias("__t"), F.col("subject").alias("__s"), "h", "m", "r"))
    ids = ids.withColumnRenamed("acc", "id_acc").withColumnRenamed("err", "id_err")
    return rated.join(ids, (rated["threshold"] == ids["__t"]) & rated["subject"].eqNullSafe(ids["__s"])).drop("__t", "__s")


def misses(decisions: DataFrame) -> DataFrame:
    """(threshold, subject, identified, n): who is taken for whom."""
    own = decisions.where((F.col("claimed") == F.col("subject")) & F.col("identified").isNotNull() & (F.col("identified") != F.col("subject")))
    return own.groupBy("threshold", "subject", "identified").agg(F.count(F.lit(1)).alias("n"))


def assess_runs(results: DataFrame) -> DataFrame:
    """assess_classification of the mean counts over runs (run_id)."""
    runs = results.select("run_id").distinct().count()
    mean = [(F.sum(c) / runs).alias(c) for c in ("tp", "fp", "tn", "fn", "h", "m", "r")]
    return assess_classification(results.groupBy("subject", "threshold").agg(*mean))


def majority_rule(labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, label, n): the commonest label of each key, the smallest on a tie."""
    counts = labels.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return counts.withColumn("place", place).where("place = 1").select(key, label, "n")


def combination(votes: DataFrame) -> DataFrame:
    """(label, confidence) of the best label over votes (classifier, label, weight); each classifier's votes share its weight."""
    if votes.isEmpty():
        raise CombinationError
    own = Window.partitionBy("classifier")
    each = votes.withColumn("w", F.col("weight") / F.count(F.lit(1)).over(own))
    total = each.groupBy("label").agg(F.round(F.sum("w"), 12).alias("w"))
    share = total.withColumn("confidence", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))
    return share.orderBy(F.desc("confidence"), "label").limit(1).select("label", "confidence")


# --- k nearest neighbours ------------------------------------------------------------------------------------------


#: Probes, templates and machines to a block; a task holds two blocks.
BLOCK, MACHINES = 1_024, 64
RANKED = "subject string, sample_id long, claimed string, template_id long, d double"


def _dealt(rows: DataFrame, size: int, name: str, *by: str) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")), n


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, kk: int, metric: str, digits: int, options: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): for each row of x the kk nearest of y, ties at `digits` places going to the smaller id, and maybe more.

    Euclidean distances are taken only of rows that a product of matrices leaves in doubt.
    """
    if len(y) <= kk or metric != "euclidean" or options or not (np.isfinite(x).all() and np.isfinite(y).all()):
        d = k.distances(x, y, metric, **options)
        order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, digits)), axis=1)[:, :kk]
        row = np.repeat(np.arange(len(d)), order.shape[1])
        return row, order.ravel(), d[row, order.ravel()]
    one, two = (x * x).sum(1), (y * y).sum(1)
    square = one[:, None] + two[None, :] - 2 * (x @ y.T)
    slack = 1e-9 * (one.max() + two.max())
    edge = np.sqrt(np.maximum(np.partition(square, kk - 1, axis=1)[:, kk - 1], 0) + slack) + 2 * 10.0**-digits
    row, at = np.nonzero(square <= (edge * edge + slack)[:, None])
    return row, at, np.sqrt(((x[row] - y[at]) ** 2).sum(1))


def _all_pairs(batches, metric: str, options: dict):
    for batch in batches:
        for r in range(batch.num_rows):
            (s, x, who), (ids, y, claimed) = block_columns(batch, r, "", "subject"), block_columns(batch, r, "_2", "subject")
            d, n = k.distances(x, y, metric, **options), len(y)
            columns = [np.repeat(who, n), np.repeat(s, n), np.tile(claimed, len(x)), np.tile(ids, len(x)), d.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


_KINDS, _NAMES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()), [c.split()[0] for c in RANKED.split(", ")]


def _nearest_of_each(batches, metric: str, digits: int, kk: int, options: dict):
    """Of each claimed subject's templates in a task's blocks the kk nearest to each of its probes."""
    probes: dict[int, list] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            (s, x, who), (ids, y, claimed) = block_columns(batch, r, "", "subject"), block_columns(batch, r, "_2", "subject")
            found = probes.setdefault(batch.column("own")[r].as_py(), [who, s, []])[2]
            for name in sorted(set(claimed)):
                own = np.flatnonzero(claimed == name)
                row, at, d = _nearest(x, y[own], ids[own], kk, metric, digits, options)
                found.append((row, np.full(len(row), name, object), ids[own][at], d))
    for who, s, found in probes.values():
        row, name, ids, d = (np.concatenate(c) for c in zip(*found, strict=True))
        _, code = np.unique(name.astype(str), return_inverse=True)
        by = np.lexsort((ids, np.round(d, digits), code, row))
        group = row[by] * (code.max() + 1) + code[by]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
        by = by[place < kk]
        columns = [who[row[by]], s[row[by]], name[by], ids[by], d[by]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def ranked(probes: DataFrame, templates: DataFrame, metric: str = "euclidean", digits: int = 9, kk: int | None = None, **options) -> DataFrame:
    """(subject, sample_id, claimed, template_id, d): probes against all templates, computed once for all thresholds.

    With kk only each subject's kk nearest templates among a task's blocks are kept, which hold its kk nearest of all, ties at
    `digits` places going to the smaller template. Blocks meet where they are stored; only what is kept leaves a task.
    """
    slim = lambda t: t.select(F.col("subject").cast("string").alias("subject"), F.col("sample_id").cast("long").alias("sample_id"), F.col("v").cast("array<double>").alias("v"))
    sides = []
    for side in (probes, templates):
        dealt, n = _dealt(slim(side), BLOCK, "own", "subject", "sample_id")
        sides.append(packed(dealt.withColumnRenamed("sample_id", "row_id"), "own", n, "subject"))
    run = (lambda b: _all_pairs(b, metric, options)) if kk is None else (lambda b: _nearest_of_each(b, metric, digits, kk, options))
    return blocks_met(*sides).mapInArrow(run, RANKED).withColumn("d", F.round("d", digits))


def knn_authenticate(pairs: DataFrame, thresholds: DataFrame, kk: int = 3) -> DataFrame:
    """(subject, sample_id, claimed, threshold, accepted): more than kk // 2 of the claimed subject's kk nearest are within the threshold."""
    place = F.row_number().over(Window.partitionBy("subject", "sample_id", "claimed").orderBy("d", "template_id"))
    near = pairs.withColumn("place", place).where(F.col("place") <= kk)
    each = near.groupBy("subject", "sample_id", "claimed").agg(F.collect_list("d").alias("ds"))
    within = F.size(F.filter("ds", lambda d: d <= F.col("threshold")))
    return each.crossJoin(F.broadcast(thresholds)).select("subject", "sample_id", "claimed", "threshold", (within > kk // 2).alias("accepted"))


def knn_identify(pairs: DataFrame, thresholds: DataFrame, kk: int = 3) -> DataFrame:
    """(subject, sample_id, threshold, identified): the majority of the kk nearest, the smallest name on a tie, if more
    than kk // 2 of its templates among them are within the threshold; else null."""
    place = F.row_number().over(Window.partitionBy("subject", "sample_id").orderBy("d", "claimed", "template_id"))
    near = pairs.withColumn("place", place).where(F.col("place") <= kk)
    votes = near.groupBy("subject", "sample_id", "claimed").agg(F.collect_list("d").alias("ds"))
    best = F.row_number().over(Window.partitionBy("subject", "sample_id").orderBy(F.desc(F.size("ds")), "claimed"))
    winner = votes.withColumn("best", best).where("best = 1")
    within = F.size(F.filter("ds", lambda d: d <= F.col("threshold")))
    return winner.crossJoin(F.broadcast(thresholds)).select("subject", "sample_id", "threshold", F.when(within > kk // 2, F.col("claimed")).alias("identified"))


def threshold_grid(spark: SparkSession, high: float, points: int = 100, low: float = float(np.finfo(float).eps)) -> DataFrame:
    step = (high - low) / (points - 1)
    return spark.range(points).select((F.lit(low) + F.col("id") * F.lit(step)).alias("threshold"))


class Classifier:
    """A store of templates by subject, with thresholds per subject.

    Subclasses say how to prepare probes, verify and identify. Enrolling and dismissing may be
    deferred until flush(); a second deferred enrolment adds to the first.
    """

    #: Which crossing of the error rates sets a threshold.
    eer_index = 0

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.templates = spark.createDataFrame([], "subject string, sample_id long, v array<double>")
        self.thresholds: dict[str, dict[str, float]] = {}
        self._pending: dict[str, DataFrame | None] = {}

    # Stored templates.

    def load_templates(self, subject: str) -> DataFrame:
        return self.templates.where(F.col("subject") == subject)

    def save_templates(self, rows: DataFrame) -> None:
        self.templates = self.templates.unionByName(rows.select("subject", "sample_id", "v"))

    def delete_templates(self, subject: str) -> None:
        self.templates = self.templates.where(F.col("subject") != subject)

    def save(self, path: str) -> None:
        self.templates.write.mode("overwrite").parquet(f"{path}/templates")
        self.spark.createDataFrame([(json.dumps({"class": type(self).__name__, "thresholds": self.thresholds, "parameters": self.parameters()}),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        if state["class"] != cls.__name__:
            raise TypeError(f"{path} holds a {state['class']}")
        out = cls(spark, **state["parameters"])
        out.templates, out.thresholds = spark.read.parquet(f"{path}/templates"), state["thresholds"]
        out.train()
        return out

    def parameters(self) -> dict:
        return {}

    # Subjects.

    def list_subjects(self) -> list[str]:
        return [r[0] for r in self.templates.select("subject").distinct().orderBy("subject").collect()]

    def check_subject(self, subject: str) -> bool:
        return not self.load_templates(subject).isEmpty()

    def enroll(self, rows: DataFrame, subject: str, deferred: bool = False) -> None:
        """Adds a subject's rows (sample_id, v), and trains unless deferred."""
        named = rows.select(F.lit(subject).alias("subject"), "sample_id", "v")
        before = self._pending.get(subject)
        self._pending[subject] = named if before is None else before.unionByName(named)
        if not deferred:
            self.flush()

    def dismiss(self, subject: str, deferred: bool = False) -> None:
        if not self.check_subject(subject) and subject not in self._pending:
            raise SubjectError(subject)
        self._pending[subject] = None
        if not deferred:
            self.flush()

    def batch_train(self, rows: dict[str, DataFrame | None]) -> None:
        """Enrols each subject's rows, or dismisses it for None, and trains once."""
        for subject, own in rows.items():
            if own is None:
                self.dismiss(subject, deferred=True)
            else:
                self.enroll(own, subject, deferred=True)
        self.flush()

    def flush(self) -> None:
        for subject, rows in self._pending.items():
            if rows is None:
                self.delete_templates(subject)
                self.thresholds.pop(subject, None)
            else:
                self.save_templates(rows)
        self._pending = {}
        self.train()

    def train(self) -> None:
        """Whatever a subclass learns from the templates."""

    # Thresholds.

    def _known(self, subject: str) -> None:
        if self.templates.isEmpty():
            raise UntrainedError
        if not self.check_subject(subject):
            raise SubjectError(subject)

    def set_threshold(self, subject: str, kind: str, value: float) -> None:
        self._known(subject)
        self.thresholds.setdefault(subject, {})[kind] = float(value)

    def get_threshold(self, subject: str, kind: str) -> float | None:
        self._known(subject)
        return self.thresholds.get(subject, {}).get(kind)

    def update_thresholds(self, fraction: float = 1.0, seed: int = 0) -> None:
        """Sets each subject's thresholds where its error rates meet, tried on a part of its own templates."""
        part = random_fraction(self.templates, "sample_id", fraction, seed).where("use").drop("use") if fraction < 1 else self.templates
        table = self.evaluate(part).where("subject is not null").persist()
        for kind, a, b in (("auth", "far", "frr"), ("id", "mr", "rr")):
            found = crossings(table, a, b, ["subject"]).collect()
            for subject in {r["subject"] for r in found}:
                roots = sorted(r["threshold"] for r in found if r["subject"] == subject)
                self.thresholds.setdefault(subject, {})[kind] = roots[self.eer_index]
        table.unpersist()

    def threshold_table(self) -> DataFrame:
        raise NotImplementedError

    def verify(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        raise NotImplementedError

    def recognise(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _at(self, threshold: float) -> DataFrame:
        return self.spark.range(1).select(F.lit(float(threshold)).alias("threshold"))

    def authenticate(self, probes: DataFrame, subject: str, threshold: float | None = None) -> DataFrame:
        """(sample_id, accepted) for probes (sample_id, v) that claim to be a subject."""
        self._known(subject)
        value = threshold if threshold is not None else self.get_threshold(subject, "auth")
        if value is None:
            raise ValueError(f"{subject} has no threshold")
        rows = probes.select(F.lit("").alias("subject"), "sample_id", "v")
        return self.verify(rows, self._at(value)).where(F.col("claimed") == subject).select("sample_id", "accepted")

    def identify(self, probes: DataFrame, threshold: float | None = None) -> DataFrame:
        """(sample_id, identified): a subject or '' for probes (sample_id, v); without a threshold each subject's own holds."""
        if self.templates.isEmpty():
            raise UntrainedError
        rows = probes.select(F.lit("").alias("subject"), "sample_id", "v")
        values = [threshold] if threshold is not None else sorted({t["id"] for t in self.thresholds.values() if "id" in t})
        found = None
        for value in values:
            own = None if threshold is not None else [s for s, t in self.thresholds.items() if t.get("id") == value]
            part = self.recognise(rows, self._at(value)).select("sample_id", "identified")
            part = part if own is None else part.where(F.col("identified").isin(own))
            found = part if found is None else found.unionByName(part)
        named = rows.select("sample_id").distinct()
        if found is None:
            return named.withColumn("identified", F.lit(""))
        return named.join(found.where("identified is not null").groupBy("sample_id").agg(F.min("identified").alias("identified")), "sample_id", "left").na.fill("", ["identified"])

    def decisions(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        verified, recognised = self.verify(probes, thresholds), self.recognise(probes, thresholds)
        return verified.join(recognised, ["subject", "sample_id", "threshold"])

    def evaluate(self, probes: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
        """The assessment of probes (subject, sample_id, v) at all thresholds."""
        table = thresholds if thresholds is not None else self.threshold_table()
        return assess_classification(subject_results(self.decisions(probes, table)))

    @classmethod
    def cross_validate(cls, spark: SparkSession, rows: DataFrame, splits: DataFrame, thresholds: DataFrame | None = None, **parameters) -> DataFrame:
        """The assessment of mean counts over splits (split, sample_id, test): train on the others, evaluate on the test rows."""
        out = None
        for r in [x[0] for x in splits.select("split").distinct().orderBy("split").collect()]:
            own = rows.join(splits.where(F.col("split") == r).select("sample_id", "test"), "sample_id")
            model = cls(spark, **parameters)
            model.save_templates(own.where("not test"))
            model.train()
            table = thresholds if thresholds is not None else model.threshold_table()
            part = subject_results(model.decisions(own.where("test").select("subject", "sample_id", "v"), table)).withColumn("run_id", F.lit(r))
            out = part if out is None else out.unionByName(part)
        return assess_runs(out)


class KNN(Classifier):
    """k nearest neighbours on any metric."""

    def __init__(self, spark: SparkSession, k: int = 3, metric: str = "euclidean"):
        super().__init__(spark)
        distance(F.col("a"), F.col("b"), metric)
        self.k, self.metric = k, metric

    def parameters(self) -> dict:
        return {"k": self.k, "metric": self.metric}

    def threshold_table(self) -> DataFrame:
        """100 points up to 2 for cosine, 1 for pcosine, else 1.5 times the largest distance between templates."""
        fixed = {"cosine": 2.0, "pcosine": 1.0}.get(self.metric)
        high = fixed or 1.5 * (ranked(self.templates, self.templates, self.metric).agg(F.max("d")).first()[0] or 1.0)
        return threshold_grid(self.spark, high)

    def verify(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        return knn_authenticate(ranked(probes, self.templates, self.metric, kk=self.k), thresholds, self.k)

    def recognise(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        return knn_identify(ranked(probes, self.templates, self.metric, kk=self.k), thresholds, self.k)


# --- support vector machines -----------------------------------------------------------------------------------------


def pair_weights(n1: int, n2: int) -> tuple[float, float]:
    """Weights of two classes, inverse to their sizes, that add up to 2."""
    return 2.0 * n2 / (n1 + n2), 2.0 * n1 / (n1 + n2)


def _kernel(name: str, gamma: float, degree: int, coef0: float):
    dot = lambda a, b: a @ b.T
    forms = {
        "linear": dot,
        "poly": lambda a, b: (gamma * dot(a, b) + coef0) ** degree,
        "rbf": lambda a, b: np.exp(-gamma * ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * dot(a, b))),
        "sigmoid": lambda a, b: np.tanh(gamma * dot(a, b) + coef0),
    }
    if name not in forms:
        raise ValueError(f"unknown kernel {name!r}")
    return forms[name]


class SVM(Classifier):
    """A machine for every pair of subjects, each fitted in a task of its own; a one-class machine for a single subject."""

    eer_index = -1

    def __init__(self, spark: SparkSession, C: float = 1.0, kernel: str = "linear", degree: int = 3, gamma: float | None = None, coef0: float = 0.0, tol: float = 1e-3):  # noqa: N803
        super().__init__(spark)
        self.C, self.kernel, self.degree, self.gamma, self.coef0, self.tol = C, kernel, degree, gamma, coef0, tol
        self.models: DataFrame | None = None

    def parameters(self) -> dict:
        return {"C": self.C, "kernel": self.kernel, "degree": self.degree, "gamma": self.gamma, "coef0": self.coef0, "tol": self.tol}

    def threshold_table(self) -> DataFrame:
        return threshold_grid(self.spark, 1.0)

    def train(self) -> None:
        """models (one, two, vectors, weights, bias): the dual solution of each pair one < two, or of (subject, null)."""
        t = self.templates
        subjects = t.select("subject").distinct()
        pairs = subjects.alias("a").join(subjects.alias("b"), F.col("a.subject") < F.col("b.subject")).select(F.col("a.subject").alias("one"), F.col("b.subject").alias("two"))
        single = subjects.count() == 1
        if single:
            pairs = subjects.select(F.col("subject").alias("one"), F.lit(None).cast("string").alias("two"))
        member = pairs.join(t, (F.col("subject") == F.col("one")) | (F.col("subject") == F.col("two"))).select("one", "two", (F.col("subject") == F.col("one")).alias("first"), "sample_id", "v")
        p = self.parameters()

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["first", "sample_id"], kind="stable")
            x, first = np.array(rows["v"].tolist(), float), rows["first"].to_numpy(bool)
            gamma = p["gamma"] or 1 / x.shape[1]
            if rows["two"].iloc[0] is None:
                a, b = k.one_class_svm(x, _kernel("rbf", gamma, 3, 0.0), 0.1)
                weights, bias = a, -b
            else:
                w1, w2 = pair_weights(int(first.sum()), int((~first).sum()))
                y = np.where(first, 1.0, -1.0)
                a, bias = k.svm(x, y, p["C"] * np.where(first, w1, w2), _kernel(p["kernel"], gamma, p["degree"], p["coef0"]), p["tol"])
                weights = a * y
            keep = np.abs(weights) > 1e-12
            return pd.DataFrame({"one": [rows["one"].iloc[0]], "two": [rows["two"].iloc[0]], "vectors": [x[keep].tolist()], "weights": [weights[keep].tolist()], "bias": [float(bias)]})

        self.models = member.groupBy("one", "two").applyInPandas(fit, "one string, two string, vectors array<array<double>>, weights array<double>, bias double").persist()

    def votes(self, probes: DataFrame) -> DataFrame:
        """(subject, sample_id, one, two, winner): each pair's decision on each probe, null for a draw."""
        if self.models is None:
            raise UntrainedError
        p = self.parameters()

        kinds = "subject string, sample_id long, one string, two string, side double"

        def decide(rows: pa.Table, machines: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if rows.num_rows and machines.num_rows:
                x = np.array(rows.column("v").to_pylist(), float)
                for m in machines.to_pylist():
                    fcn = _kernel("rbf" if m["two"] is None else p["kernel"], p["gamma"] or 1 / x.shape[1], p["degree"], p["coef0"])
                    side = np.asarray(m["weights"], float) @ fcn(np.array(m["vectors"], float).reshape(-1, x.shape[1]), x) + m["bias"]
                    out += zip(rows.column("subject").to_pylist(), rows.column("sample_id").to_pylist(), [m["one"]] * len(x), [m["two"]] * len(x), side.tolist(), strict=True)
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64())
            return pa.table({c.split()[0]: pa.array(list(v), t) for c, v, t in zip(kinds.split(", "), columns, types, strict=True)})

        # Blocks of probes meet blocks of machines, each machine evaluating a block at once.
        rows = probes.select(F.col("subject").cast("string").alias("subject"), F.col("sample_id").cast("long").alias("sample_id"), "v")
        (rows, n), (machines, m) = _dealt(rows, BLOCK, "x", "subject", "sample_id"), _dealt(self.models, MACHINES, "y", "one", "two")
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        machines = machines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        each = rows.groupBy("x", "y").cogroup(machines.groupBy("x", "y")).applyInArrow(decide, kinds)
        winner = F.when(F.col("side") > 0, F.col("one")).when(F.col("side") < 0, F.col("two"))
        return each.select("subject", "sample_id", "one", "two", winner.alias("winner"))

    def _rates(self, probes: DataFrame) -> DataFrame:
        """(subject, sample_id, claimed, rate, best): the share of a subject's pairs that it wins, and the overall winner."""
        votes = self.votes(probes)
        subjects = self.templates.select(F.col("subject").alias("claimed")).distinct()
        n = max(subjects.count() - 1, 1)
        wins = votes.where("winner is not null").groupBy("subject", "sample_id", F.col("winner").alias("claimed")).agg(F.count(F.lit(1)).alias("won"))
        full = probes.select("subject", "sample_id").distinct().crossJoin(subjects).join(wins, ["subject", "sample_id", "claimed"], "left").na.fill(0, ["won"])
        place = F.row_number().over(Window.partitionBy("subject", "sample_id").orderBy(F.desc("won"), "claimed"))
        return full.select("subject", "sample_id", "claimed", (F.col("won") / n).alias("rate"), ((place == 1) & (F.col("won") > 0)).alias("best"))

    def verify(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        """Accepted: the claimed subject wins more than the threshold's share of its own pairs."""
        rates = self._rates(probes)
        return rates.crossJoin(F.broadcast(thresholds)).select("subject", "sample_id", "claimed", "threshold", (F.col("rate") > F.col("threshold")).alias("accepted"))

    def recognise(self, probes: DataFrame, thresholds: DataFrame) -> DataFrame:
        rates = self._rates(probes)
        top = rates.groupBy("subject", "sample_id").agg(F.max(F.when(F.col("best"), F.struct("rate", "claimed"))).alias("top"))
        return top.crossJoin(F.broadcast(thresholds)).select("subject", "sample_id", "threshold", F.when(F.col("top.rate") > F.col("threshold"), F.col("top.claimed")).alias("identified"))
