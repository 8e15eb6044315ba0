"""Toxicity: maximum-scoring segments over word log-odds with Dirichlet priors, calibrated as extreme values."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_documents
from .words import as_bytes

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Labelled documents that the model is fitted on, at most; their words bound the model's size.
MAX_TRAINING = 20_000
PREFIXES = (3, 4, 5, 6, 8)
PRIOR, DRIFT, LEAST_DF = 4.0, 0.5, 3
#: Segments with at most so many like them expected in a clean text of the same length are reported.
SIGNIFICANT = 0.05
BINS = np.linspace(-10, 10, 81)
MIDDLES = (BINS[:-1] + BINS[1:]) / 2
_EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def core(word: bytes) -> bytes:
    """A word without the ASCII punctuation around it."""
    return word.strip(_EDGES)


def units(word: bytes) -> list[str]:
    """A word's prefixes of some lengths, marked *, and itself: each the prior of the next."""
    text = core(word).decode("utf-8", "replace")
    return [text[:k] + "*" for k in PREFIXES if k < len(text)] + [text]


class WordScores(dict):
    """Word (bytes) to score: that of the longest known unit, the drift of other words otherwise."""

    def __init__(self, table: dict[str, float], most: int = 1 << 18):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, word: bytes) -> float:
        score = next((self.table[u] for u in reversed(units(word)) if u in self.table), -DRIFT)
        if len(self) < self.most:
            self[word] = score
        return score


def word_scores(words: list[bytes], known: WordScores) -> np.ndarray:
    """Scores of a text's words, each occurrence with its own."""
    return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def discounted(words: list[bytes], scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal segments (start, end, score) over all occurrences. A segment that repeats a positive word scores as
    its best part does with the repeats at 0: within a passage a repeated word adds no evidence of its own."""
    found = []
    for a, b, s in segments(scores):
        own, seen = scores[a:b].copy(), set()
        for i in np.flatnonzero(own > 0):
            if words[a + i] in seen:
                own[i] = 0.0
            seen.add(words[a + i])
        if len(seen) < np.count_nonzero(scores[a:b] > 0):
            s = max(x for _, _, x in segments(own))
        found.append((a, b, s))
    return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, end exclusive, in linear time.

    Each run of work is on positive scores only; a candidate is merged with those to its left as
    long as the joint segment scores above both. A candidate knows the nearest one to its left that has a smaller sum
    before it, as those between need not be looked at again; if there is none, all earlier candidates are final.
    """
    total = np.cumsum(scores)
    final: list[tuple[int, int, float]] = []
    open_: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at its end, the lower one to the left
    for i in np.flatnonzero(scores > 0):
        start, before, after = int(i), float(total[i] - scores[i]), float(total[i])
        end = start + 1
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= before:
                j = open_[j][4]
            if j < 0:
                final += [(a, b, y - x) for a, b, x, y, _ in open_]
                open_ = [(start, end, before, after, -1)]
                break
            if open_[j][3] >= after:
                open_.append((start, end, before, after, j))
                break
            start, before = open_[j][0], open_[j][2]
            del open_[j:]
    return final + [(a, b, y - x) for a, b, x, y, _ in open_]


@dataclass
class ToxicModel:
    """table: unit to score. lam, k: Karlin-Altschul parameters on clean text. weights: of the calibration."""

    table: dict[str, float]
    lam: float
    k: float
    weights: tuple[float, float, float]

    def evidence(self, words: list[bytes], scores: np.ndarray) -> tuple[list[tuple[int, int, float]], float, float]:
        """Significant segments (start, end, bits beyond chance), the best one's bits and all their bits together."""
        found = [(a, b, (self.lam * s - np.log(max(self.k * len(scores), 1e-300))) / np.log(2)) for a, b, s in discounted(words, scores)]
        kept = [x for x in found if x[2] >= -np.log2(SIGNIFICANT)]
        return kept, max([0.0, *(x[2] for x in found)]), sum(x[2] for x in kept)

    @staticmethod
    def features(best: float, total: float) -> tuple[float, float]:
        return min(best, 20.0), float(np.log1p(max(total, 0.0)))

    def probability(self, best: float, total: float) -> float:
        a, (b, c) = self.weights[0], self.features(best, total)
        return float(1 / (1 + np.exp(-np.clip(a + self.weights[1] * b + self.weights[2] * c, -30, 30))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic, clean): in how many documents of either kind it is."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            seen[label].update({u for w in set(text.lower().split()) for u in units(w)})
    rows = sorted(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_pydict({"unit": pa.array(rows, pa.string()), "toxic": pa.array([seen[1][u] for u in rows], pa.int64()), "clean": pa.array([seen[0][u] for u in rows], pa.int64())})


def log_odds(counts: pd.DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Unit to log-odds, less one standard error and the drift.

    A unit's share of toxic documents has a Dirichlet prior around its prefix's share.
    """
    base = (toxic + 1) / (toxic + clean + 2)
    t, c = dict(zip(counts["unit"], counts["toxic"], strict=True)), dict(zip(counts["unit"], counts["clean"], strict=True))
    share: dict[str, float] = {}

    def parent(u: str) -> float:
        stem = u[:-1] if u.endswith("*") else u
        return next((share[stem[:k] + "*"] for k in reversed(PREFIXES) if k < len(stem) and stem[:k] + "*" in share), base)

    for u in sorted(t, key=lambda u: (len(u), not u.endswith("*"))):
        share[u] = (t[u] + PRIOR * parent(u)) / (t[u] + c[u] + PRIOR)
    odds = lambda p: np.log(max(p, 1e-4) / max(1 - p, 1e-4))
    error = lambda u: (1 / (t[u] + 1) + 1 / (c[u] + 1)) ** 0.5
    return {u: float(odds(p) - odds(base) - error(u) - DRIFT) for u, p in share.items()}


def karlin(counts: np.ndarray) -> float:
    """The positive root of mean(exp(lam * score)) = 1 over a histogram of scores in BINS; 1 if there is none."""
    share = counts / max(counts.sum(), 1)
    if not share[MIDDLES > 0].sum() or share @ MIDDLES >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(high * MIDDLES) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(mid * MIDDLES) < 1 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING) -> ToxicModel:
    """Fits on up to `most` labelled documents outside the held-out fold; without any, nothing is toxic.

    Half of them give the log-odds, the other half the calibration, as scores of words that were
    learnt from the same documents would be too high.
    """
    rows = training_documents(docs, labels, "toxic", FOLDS, HELD_OUT, most, id_col, text_col).withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)))
    table = None
    parts = []
    for half in (0, 1):
        own = rows.where(F.col("half") == half)
        counts = own.select("text", "label").mapInArrow(_count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts.append((counts.where(F.col("toxic") + F.col("clean") >= LEAST_DF).toPandas(), sizes.get(1, 0), sizes.get(0, 0)))
    table = log_odds(*parts[0])
    sample = rows.where("half = 1").select("text", "label")
    fitted = sample.mapInArrow(partial(_raw, table=table), "label int, n long, best double, found array<double>, counts array<bigint>").toPandas()
    model = _calibrate(table, fitted)
    whole = pd.concat([p[0] for p in parts]).groupby("unit", as_index=False).sum() if len(parts[0][0]) + len(parts[1][0]) else parts[0][0]
    # The calibrated scale holds for the table of both halves, whose words are known no worse.
    kept = log_odds(whole, parts[0][1] + parts[1][1], parts[0][2] + parts[1][2])
    return ToxicModel(_needed(kept), model.lam, model.k, model.weights)


def _needed(table: dict[str, float]) -> dict[str, float]:
    """Units that score otherwise than their longest known prefix would, or the drift."""
    kept: dict[str, float] = {}
    for u in sorted(table, key=lambda u: (len(u), not u.endswith("*"))):
        stem = u[:-1] if u.endswith("*") else u
        before = next((kept[stem[:k] + "*"] for k in reversed(PREFIXES) if k < len(stem) and stem[:k] + "*" in kept), -DRIFT)
        if abs(table[u] - before) > 0.05:
            kept[u] = table[u]
    return kept


def _raw(batches: Iterator[pa.RecordBatch], table: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Per document: label, words, score of the best segment, all segments' scores, a histogram of the words' scores."""
    known = WordScores(table)
    for batch in batches:
        n, found, counts = [], [], []
        for text in as_bytes(batch.column(0)):
            words = text.lower().split()
            scores = word_scores(words, known)
            n.append(len(scores))
            found.append([x for _, _, x in discounted(words, scores)])
            counts.append(np.histogram(np.clip(scores, BINS[0], BINS[-1]), BINS)[0])
        yield pa.RecordBatch.from_pydict({"label": batch.column(1), "n": pa.array(n, pa.int64()), "best": pa.array([max([0.0, *f]) for f in found], pa.float64()), "found": pa.array(found, pa.list_(pa.float64())), "counts": pa.array(counts, pa.list_(pa.int64()))})


def _calibrate(table: dict[str, float], fitted: pd.DataFrame) -> ToxicModel:
    """Extreme-value parameters from the clean documents, then a logistic curve over both kinds."""
    clean = fitted[(fitted["label"] == 0) & (fitted["n"] > 0)]
    lam = karlin(np.sum(clean["counts"].tolist(), axis=0)) if len(clean) else 1.0
    # Half of the clean documents' best segments should have scores below the law's median.
    k = float(np.log(2) / max(np.median(clean["n"] * np.exp(-lam * clean["best"])), 1e-9)) if len(clean) else 1e-3
    model = ToxicModel(table, lam, k, (-4.0, 0.0, 0.0))
    if fitted["label"].nunique() < 2:
        return model
    bits = [[(lam * s - np.log(k * max(m, 1))) / np.log(2) for s in ss] for ss, m in zip(fitted["found"], fitted["n"], strict=True)]
    x = np.array([[1.0, *model.features(max([0.0, *b]), sum(v for v in b if v >= -np.log2(SIGNIFICANT)))] for b in bits])
    y, w = fitted["label"].to_numpy(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    model.weights = tuple(map(float, w))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: ToxicModel, passages: bool) -> Iterator[pa.RecordBatch]:
    known = WordScores(model.table)
    for batch in batches:
        ids, out, spans = batch.column(0), [], []
        for text in as_bytes(batch.column(1)):
            words = text.lower().split()
            kept, best, total = model.evidence(words, word_scores(words, known))
            out.append(model.probability(best, total))
            spans.append([{"start": a, "end": b, "bits": float(x)} for a, b, x in kept])
        columns = {"id": ids, "score": pa.array(out, pa.float64())}
        yield pa.RecordBatch.from_pydict(columns | ({"passages": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])))} if passages else {}))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING, model: ToxicModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and passages, the significant segments in words.

    Null and empty texts score like text without evidence, texts of any length are searched whole in linear time; null ids
    are scored and not held out; repeated rows and other columns are fine, an empty table gives no rows.
    """
    model = model or train(docs, labels, id_col, text_col, most)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(partial(_score, model=model, passages=True), f"id {kind}, score double, passages array<struct<start:int,end:int,bits:double>>")
    held_out = F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
