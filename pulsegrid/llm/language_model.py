"""Language-model scores of whole documents: a gated recurrent network above counts of the whole corpus."""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat
from math import ceil
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, with_row_id
from .gru import HIDDEN, WINDOW, Gru
from .labelled import fold
from .words import as_bytes, split_column, split_words

FOLDS, HELD_OUT = 7, 2
#: Words whose counts are sent to the workers; the counts of all others are joined.
HEAD = 262_144
#: The network has an id of its own for the commonest words and hashed ids for the rest. There are GROWTH times the root of the
#: number of distinct words of either, without a limit; words that share a hashed id are told apart by their counts.
WORDS, GROWTH, CLASSES = 4_096, 4, 64
#: The network learns once from each training document, in so many rounds.
ROUNDS = 2
STREAMS, BLOCK = 64, 65_536
#: So many texts are looked up, or scored, at a time.
TEXTS = 1_024
#: The end of a text: no word holds a space.
END = b" "


def _count(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        texts = as_bytes(batch.column(0))
        seen[END] += len(texts)
        for text in texts:
            seen.update(split_words(text))
            if len(seen) > most:
                yield flush()
    yield flush()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all whole texts (text), each ending in END; summed within tasks first."""
    return texts.mapInArrow(_count, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int = HEAD) -> pa.Table:
    """Up to `most` of the commonest words (word, c), by falling count, then word.

    Counts are dealt to some thousand classes, exact ones below 1,000; the words of the highest classes that together hold
    no more than `most` come to the driver, so that no task sends more than it must.
    """
    level = F.when(F.col("c") < 1000, F.col("c")).otherwise(1000 + F.floor(F.log("c") * 100)).cast("long")
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for x, n in sizes:
        total += n
        if total > most:
            break
        least = x
    found = counts.where(level >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    return found.sort_by([("c", "descending"), ("word", "ascending")])


def own_words(v: int) -> int:
    """How many of v distinct words have ids of their own in the network; at least WORDS - 1 if there are."""
    return max(WORDS - 1, ceil(GROWTH * v**0.5))


def hashed_ids(v: int) -> int:
    """How many hashed ids the rest of v distinct words have."""
    return max(1, ceil(GROWTH * v**0.5)) if v > own_words(v) else 1


@dataclass
class Vocabulary:
    """words: the head, by falling count; counts: theirs. n, v: all training tokens, and how many distinct.

    shared: for each hashed id the sum of the counts plus one of all words with that hash, own ids included.
    """

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    shared: np.ndarray | None = None

    def __post_init__(self):
        self.ids = {w: i for i, w in enumerate(self.words)}
        self.known, self.hashed = min(own_words(self.v), len(self.words)), hashed_ids(self.v)
        #: The id in the network of each word of the head.
        self.net = np.arange(len(self.words))
        self.net[self.known :] = [self.hashed_id(w) for w in self.words[self.known :]]
        own = np.array([self.hashed_id(w) - self.known for w in self.words[: self.known]], np.int64)
        total = np.array([self.n + self.v], np.float64) if self.shared is None else np.asarray(self.shared, np.float64)
        #: The counts plus one of the words that share each hashed id, and one for words never seen.
        self.rest = total - np.bincount(own, self.counts[: self.known] + 1, self.hashed) + 1
        #: Log10 of add-one unigram probabilities, and of those among the words that share an id.
        self.base = np.log10((self.counts + 1) / (self.n + self.v + 1))
        self.aside = np.log10(self.counts + 1)
        self.aside[: self.known] = 0
        self.aside[self.known :] -= np.log10(self.rest[self.net[self.known :] - self.known])
        self.first = int(self.look_up([END])[1][0])

    def bare(self) -> Vocabulary:
        """What the network needs of it: without the words."""
        out = copy.copy(self)
        out.counts, out.words, out.ids, out.net, out.base, out.aside = self.counts[: self.known], [], {}, None, None, None
        return out

    def hashed_id(self, word: bytes) -> int:
        return self.known + crc32(word) % self.hashed

    def network_counts(self) -> np.ndarray:
        """Counts of the network's ids, the hashed ones last."""
        return np.r_[self.counts[: self.known], self.rest - 1].astype(np.float64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the place in the head, -1 if it isn't there, and the id in the network."""
        at = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        ids = self.net[at] if len(self.net) else np.zeros(len(at), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            ids[i] = self.hashed_id(words[i])
        return at, ids

    def start(self) -> int:
        return self.first

    def id_type(self) -> type:
        return np.uint16 if self.known + self.hashed <= 1 << 16 else np.uint32

    def encoded(self, texts: pa.Array) -> list[np.ndarray]:
        """The network's ids of texts, an end after each; or of what `encode` stored of them."""
        if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
            return [np.frombuffer(x, self.id_type()) for x in texts.to_pylist()]
        return [self.look_up([*split_words(x), END])[1] for x in as_bytes(texts)]


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(n)], pa.int32())


def _encode(batches: Iterator[pa.RecordBatch], broadcast: Any) -> Iterator[pa.RecordBatch]:
    """A row per text (row, id, text), with its words' and its end's ids in the network, sums over the head's words, and its other words."""
    vocabulary: Vocabulary = broadcast.value
    known, end, rest, head = vocabulary.known, int(vocabulary.look_up([END])[0][0]), np.log10(vocabulary.rest), pa.array(vocabulary.words, pa.large_binary())
    base, aside, net = np.r_[vocabulary.base, 0.0], np.r_[vocabulary.aside, 0.0], np.r_[vocabulary.net, -1].astype(np.int64)
    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
        words, n = split_column(batch.column(2))
        starts, ends = np.cumsum(n + 1) - n - 1, np.cumsum(n + 1) - 1
        found = pc.index_in(words, value_set=head).fill_null(-1).to_numpy().astype(np.int64)
        at = np.full(int(n.sum()) + len(n), end)
        inner = np.ones(len(at), bool)
        inner[ends] = False
        at[inner] = found
        ids = net[at]
        ids[ends] = vocabulary.start()
        rare = np.flatnonzero(found < 0)
        texts = words.take(pa.array(rare)).to_pylist()
        of = np.repeat(np.arange(len(n)), n)[rare]
        places = np.flatnonzero(inner)[rare]
        ids[places] = np.fromiter(map(vocabulary.hashed_id, texts), np.int64, len(texts))
        apart = aside[at]
        unseen = np.flatnonzero(at < 0)
        apart[unseen] = -rest[ids[unseen] - known]
        tail = Counter(zip(of.tolist(), texts, strict=True))
        tails = _offsets(np.bincount(np.fromiter((i for i, _ in tail), np.int64, len(tail)), minlength=len(n)))
        blob = pa.Array.from_buffers(pa.binary(), len(n), [None, _offsets((n + 1) * np.dtype(vocabulary.id_type()).itemsize).buffers()[1], pa.py_buffer(ids.astype(vocabulary.id_type()))])
        yield pa.RecordBatch.from_pydict(
            {
                "row": batch.column(0).cast(pa.int64()),
                "id": batch.column(1),
                "ids": blob,
                "n": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(np.add.reduceat((at >= 0).astype(np.int64), starts)),
                "base": pa.array(np.add.reduceat(base[at], starts)),
                "apart": pa.array(np.add.reduceat(apart, starts)),
                "words": pa.ListArray.from_arrays(tails, pa.array([w for _, w in tail], pa.binary())),
                "times": pa.ListArray.from_arrays(tails, pa.array(list(tail.values()), pa.int64())),
            }
        )


def _learn(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Trains on the task's texts, or their ids, end to end in STREAMS streams; gives the weights in blocks, times the words seen.

    All streams advance together while they are long; at the end those that still hold words go on without the
    others, so that each word and each end is learnt once. A batch's longest texts choose the least filled streams first, which
    leaves few words to go on without the others, as these cost most. All words weigh alike, whatever the size of their window:
    else those of one long text, alone at the end, draw the network to it.
    """
    net = _network(vocabulary, weights)
    seen, start, words = {k: np.full_like(x, 1e-4 + 1e-8) for k, x in net.p.items()}, vocabulary.start(), 0
    streams: list[list[np.ndarray]] = [[np.array([start], vocabulary.id_type())] for _ in range(STREAMS)]
    sizes, h = np.ones(STREAMS, np.int64), np.zeros((STREAMS, HIDDEN), np.float32)

    def window(live: np.ndarray) -> None:
        nonlocal words
        steps = min(int(sizes[live].min()) - 1, WINDOW)
        block = np.empty((len(live), steps + 1), np.int64)
        for to, i in zip(block, live.tolist(), strict=True):
            flat = np.concatenate(streams[i]) if len(streams[i]) > 1 else streams[i][0]
            to[:], streams[i] = flat[: steps + 1], [flat[steps:]]
        block = np.ascontiguousarray(block.T)
        x, y = block[:-1], block[1:]
        h[live], _ = net.learn(x, y, x == start, h[live], seen, STREAMS * WINDOW)
        words += x.size
        sizes[live] -= steps

    for batch in batches:
        ids = vocabulary.encoded(batch.column(0))
        goes = np.empty(len(ids), np.int64)
        for i in np.argsort([-len(x) for x in ids], kind="stable").tolist():
            goes[i] = sizes.argmin()
            sizes[goes[i]] += len(ids[i])
        for x, i in zip(ids, goes.tolist(), strict=True):
            streams[i].append(x)
        while sizes.min() > WINDOW:
            window(np.arange(STREAMS))
    while len(live := np.flatnonzero(sizes > 1)):
        window(live)
    flat = net.flat() * words
    for k in range(0, len(flat), BLOCK):
        yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "words": pa.array([words], pa.int64()), "sums": pa.array([flat[k : k + BLOCK].astype(np.float32).tobytes()], pa.binary())})


def _add(rows: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in rows.column("sums").to_pylist())
    return pa.table({"block": rows.column("block").slice(0, 1).cast(pa.int32()), "words": pa.array([sum(rows.column("words").to_pylist())], pa.int64()), "sums": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})


def _network(vocabulary: Vocabulary, weights: np.ndarray | None) -> Gru:
    counts = vocabulary.network_counts()
    net = Gru(counts, max(CLASSES, ceil(len(counts) ** 0.5)))
    if weights is not None:
        net.load(weights)
    return net


def part(training: DataFrame, r: int, column: str = "text") -> DataFrame:
    """The texts of round r, or their ids; each training document is in one round."""
    return training.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ROUNDS)) == r).select(column)


def train(training: DataFrame, vocabulary: Vocabulary) -> np.ndarray | None:
    """The network's weights from documents (id, ids). In each round all tasks train on from the same weights, on their part of
    the round's documents, and the results are averaged, weighted by words, in two steps of a tree."""
    weights = None
    for r in range(ROUNDS):
        parts = part(training, r, "ids").mapInArrow(partial(_learn, vocabulary=vocabulary, weights=weights), "block int, words long, sums binary").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(16)))
        schema = "block int, words long, sums binary"
        half = parts.groupBy("block", "branch").applyInArrow(lambda t: _add(t), schema)
        rows = sorted(half.groupBy("block").applyInArrow(lambda t: _add(t), schema).collect(), key=lambda x: x["block"])
        if rows and rows[0]["words"]:
            weights = np.concatenate([np.frombuffer(x["sums"], np.float32) for x in rows]) / rows[0]["words"]
    return weights


def _score(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, n, n_known, base, apart, ids) of `encode` with the score over the head's words in place of the last two."""
    net, start = _network(vocabulary, weights), vocabulary.start()
    for batch in batches:
        ids = vocabulary.encoded(batch.column(6))
        order = np.argsort([-len(x) for x in ids], kind="stable")
        logs = np.empty(len(ids))
        for i in range(0, len(order), TEXTS):
            some = order[i : i + TEXTS]
            logs[some] = net.score([ids[k] for k in some.tolist()], start) / np.log(10)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(logs + batch.column(5).to_numpy())], ["row", "id", "n", "n_known", "base", "score"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z lower-cased, then one end. Counts are over all training documents, those
    whose crc32(id as text) mod 7 isn't 2. base_score is the add-one unigram log10 probability; score
    the model's: the network tells the commonest words apart, the others by hashed ids, whose words share
    their probability by their counts plus one. Null and empty texts are one end; a document with a null id is scored
    but not learnt from; repeated rows and other columns are fine; an empty table gives no rows.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("__row", "id", "text")
    in_training = fold("id", FOLDS) != HELD_OUT
    counts = cut(corpus_counts(rows.where(in_training).select("text")))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = commonest(counts)
    hashed = counts.groupBy(F.pmod(F.crc32("word"), F.lit(hashed_ids(totals["v"]))).alias("h")).agg(F.sum(F.col("c") + 1).alias("c")).collect()
    shared = np.zeros(hashed_ids(totals["v"]))
    shared[[r["h"] for r in hashed]] = [r["c"] for r in hashed]
    vocabulary = Vocabulary(head["word"].to_pylist(), head["c"].to_numpy().astype(np.float64), totals["n"], totals["v"], shared)
    kind = docs.schema[id_col].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(vocabulary)
    encoded = cut(rows.mapInArrow(partial(_encode, broadcast=broadcast), f"row long, id {kind}, ids binary, n long, n_known long, base double, apart double, words array<binary>, times array<long>"))
    broadcast.destroy()
    vocabulary = vocabulary.bare()
    weights = train(encoded.where(in_training), vocabulary)
    schema = f"row long, id {kind}, n long, n_known long, base double, score double"
    scored = encoded.select("row", "id", "n", "n_known", "base", "apart", "ids").mapInArrow(partial(_score, vocabulary=vocabulary, weights=weights), schema)
    tail = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n")).join(counts, "word", "left")
    plus = F.log10(F.coalesce("c", F.lit(0)) + 1)
    of_tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"),
        F.sum(F.col("n") * (plus - F.log10(F.lit(float(vocabulary.n + vocabulary.v + 1))))).alias("t_base"),
        F.sum(F.col("n") * plus).alias("t_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = scored.join(of_tail, "row", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + zero("t_known")).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base")).alias("base_score"),
        (F.col("score") + zero("t_score")).alias("score"),
    )
    result = cut(whole)
    forget(counts, encoded)
    return result
