"""Quality: a multiple-instance network with gated attention over a document's passages, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_documents
from .words import as_bytes, portions

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Labelled documents that the network is fitted on, at most.
MAX_TRAINING = 8_000
#: Passages of one training text that the network is fitted on, at most, evenly spaced over the text; so fitting has a bound in
#: memory. All passages of every text are scored.
MAX_PASSAGES = 128
#: Words to a passage.
PASSAGE = 64
HIDDEN, GATE, HASHED, STEPS, BATCH, RATE, SEED = 24, 12, 32, 1_750, 64, 4e-3, 11
#: What is counted of each word: a 1, its length, squared, and how many bytes are of some class.
PER_WORD = 14
FEATURES = PER_WORD + 6 + HASHED


class WordFacts(dict):
    """Word (bytes) to its row in `facts`; rows are numbered as words come."""

    def __init__(self):
        super().__init__()
        self.facts = np.zeros((1 << 12, PER_WORD), np.float32)
        self.bucket = np.zeros(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i >= len(self.facts):
            self.facts, self.bucket = np.concatenate([self.facts, np.zeros_like(self.facts)]), np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        n = len(word)
        upper, lower, digit = sum(65 <= b <= 90 for b in word), sum(97 <= b <= 122 for b in word), sum(48 <= b <= 57 for b in word)
        wide = sum(b >= 128 for b in word)
        marks = [word.count(m) for m in (b"!", b"|", b".", b",")]
        other = n - upper - lower - digit - wide - sum(marks)
        self.facts[i] = (1, n, n * n / 16, upper, digit, wide, *marks, other, upper == n, 65 <= word[0] <= 90 and upper == 1, upper + lower + wide == 0)
        self.bucket[i] = xxhash.xxh3_64_intdigest(word.lower().strip(b".,!|#$%&*;:?")) % (2 * HASHED)
        return i


def passages(texts: list[bytes], facts: WordFacts) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage of every text, how many each text has); a text without words has one, of zeros."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter((facts[w] for ws in words for w in ws), np.int64, int(n.sum()))
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(first, n) + inside // PASSAGE
    x = np.zeros((total, FEATURES), np.float32)
    if len(at):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        x[of[starts], :PER_WORD] = np.add.reduceat(facts.facts[at], starts, axis=0)
        size = np.maximum(x[:, 0], 1)
        again = np.r_[False, (at[1:] == at[:-1]) & (of[1:] == of[:-1])]
        keys = np.sort(of * (1 << 24) + at)
        new = np.r_[True, keys[1:] != keys[:-1]]
        letters = np.maximum(x[:, 1], 1)
        distinct = np.bincount((keys >> 24)[new], minlength=total) / size
        bucket = facts.bucket[at]
        bag = np.bincount(of * HASHED + bucket % HASHED, np.where(bucket < HASHED, 1.0, -1.0), total * HASHED).reshape(total, HASHED)
        x[:, PER_WORD] = np.bincount(of, again, total) / size
        x[:, PER_WORD + 1] = distinct
        x[:, PER_WORD + 2] = np.bincount(of, inside == 0, total)
        x[:, PER_WORD + 3] = np.log1p(np.repeat(n, count)) / 8
        runs = np.bincount((keys >> 24), None, total)
        x[:, PER_WORD + 4] = runs / PASSAGE
        x[:, PER_WORD + 5] = (x[:, 1] / size > 9) | (x[:, 1] / size < 2.5)
        x[:, 11:14] /= size[:, None]
        x[:, 3:11] /= letters[:, None]
        x[:, 1:3] /= size[:, None] * 8
        x[:, 0] /= PASSAGE
        x[:, PER_WORD + 6 :] = bag / np.sqrt(size)[:, None]
    return x, count


class GatedAttention:
    """tanh encoder of passages; attention tanh(Vh) * sigmoid(Uh) . w, softmax over a document; logistic on the weighted sum."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {"E": init(len(mean), HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        p, first = self.p, np.cumsum(count) - count
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), count))
        a /= np.repeat(np.add.reduceat(a, first), count)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return x, h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(count) - count
        x, h, v, u, a, z, out = self.forward(x, count)
        d = (out - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], count, axis=0)
        pull = (dz * h).sum(1)
        da = a * (pull - np.repeat(np.add.reduceat(a * pull, first), count))
        dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
        dh = (dz * a[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        r, first = np.random.default_rng(seed), np.cumsum(count) - count
        batches = max(1, len(y) // BATCH)
        epochs = -(-STEPS // batches)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for some in np.array_split(r.permutation(len(y)), batches):
                rows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in some])
                t += 1
                for k, g in self.gradients(x[rows], count[some], y[some]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts = WordFacts()
    for batch in batches:
        x, count = passages(as_bytes(batch.column(1)), facts)
        cuts = np.cumsum(count)
        chosen = [x[b - n + np.unique(np.linspace(0, n - 1, min(n, MAX_PASSAGES)).astype(int))] for b, n in zip(cuts, count, strict=True)]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "x": pa.array([c.tobytes() for c in chosen], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING) -> GatedAttention | None:
    """The network, fitted on whole texts of up to `most` labelled documents outside the held-out fold; None without any."""
    rows = training_documents(docs, labels, "quality", FOLDS, HELD_OUT, most, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(_features, f"id {kind}, label int, x binary").toPandas().sort_values(["id", "label"], kind="stable")
    if not len(got):
        return None
    xs = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"]]
    x, count = np.concatenate(xs), np.array([len(v) for v in xs])
    net = GatedAttention(x.mean(0), x.std(0) + 1e-3)
    net.fit(x, count, got["label"].to_numpy(np.float32))
    return net


def _score(batches: Iterator[pa.RecordBatch], net: GatedAttention | None) -> Iterator[pa.RecordBatch]:
    facts = WordFacts()
    for batch in batches:
        texts = as_bytes(batch.column(1))
        out = np.ones(len(texts))
        for part in portions(np.array([len(t) for t in texts]), 1 << 20) if net else ():
            if len(facts) > 1 << 18:
                facts = WordFacts()
            x, count = passages([texts[i] for i in part], facts)
            out[part] = net.forward(x, count)[-1]
        yield pa.RecordBatch.from_pydict({"row": batch.column(0), "score": pa.array(out, pa.float64())} | {batch.schema.names[i]: batch.column(i) for i in range(2, batch.num_columns)})


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING, net: GatedAttention | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored as one passage without words; null ids are scored and not held out.
    Without labelled documents all score 1. Repeated rows and other columns are fine, an empty table gives no rows.
    """
    net = net or train(docs, labels, id_col, text_col, most)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(partial(_score, net=net), f"row {kind}, score double")
    held_out = F.coalesce(fold("row", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(F.col("row").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING) -> DataFrame:
    """The documents that the network predicts to be good, with all their columns; nothing is shuffled."""
    net = train(docs, labels, id_col, text_col, most)
    names = docs.columns
    rows = docs.select(F.lit(0).alias("__row"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(names)])
    kinds = ", ".join(f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    scored = rows.mapInArrow(partial(_score, net=net), f"row int, score double, {kinds}")
    return scored.where(F.col("score") >= THRESHOLD).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
