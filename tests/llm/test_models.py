"""The language model, the quality network and toxicity scores: gradients, exact parts, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import language_model as lm
from pulsegrid.llm import quality as q
from pulsegrid.llm import queries
from pulsegrid.llm import toxicity as t
from pulsegrid.llm.gru import Gru

from ..conftest import SF

SCHEMA = "doc_id long, text string, score string, label long, id string, row long"


def rows_of(texts):
    return [(i, x, "s", 1, "z", i) for i, x in enumerate(texts)]


def test_gradients_of_the_gru():
    r = np.random.default_rng(0)
    net = Gru(np.array([50.0, 30, 20, 10, 5, 5, 3, 2, 1, 90]), 3)
    net.p = {k: (v + 0.3 * r.standard_normal(v.shape)).astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(0, 10, (5, 3)), r.integers(0, 10, (5, 3))
    fresh, h = r.random((5, 3)) < 0.2, r.standard_normal((3, 32)) * 0.3

    def loss():
        state, total = h, 0.0
        for a, b, f in zip(x, y, fresh, strict=True):
            state = net.step(a, state * ~f[:, None])[-1]
            total -= net.word_logs(state, b)[0].sum()
        return total / x.size

    before, want = {k: v.copy() for k, v in net.p.items()}, {}
    for k, v in net.p.items():
        for i in r.choice(v.size, min(6, v.size), replace=False):
            at = np.unravel_index(i, v.shape)
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            want[k, at] = (up - loss()) / 2e-5
            v[at] += 1e-5
    seen = {k: np.full_like(v, 1e12) for k, v in net.p.items()}  # so that a step is the gradient, scaled
    net.learn(x, y, fresh, h, seen)
    for (k, at), g in want.items():
        assert (before[k] - net.p[k])[at] / 0.06 * 1e6 == pytest.approx(g, abs=2e-4)


def test_gru_probabilities_add_up_and_state_is_carried():
    net = Gru(np.arange(40, 0, -1.0), 5)
    h = np.random.default_rng(0).standard_normal((1, 32)).astype(np.float32)
    assert sum(math.exp(net.word_logs(h, np.array([i]))[0][0]) for i in range(40)) == pytest.approx(1, abs=1e-5)
    text = np.random.default_rng(1).integers(0, 40, 150)
    state, last, total = np.zeros((1, 32), np.float32), 3, 0.0
    for word in text:
        state = net.step(np.array([last]), state)[-1]
        total += net.word_logs(state, np.array([word]))[0][0]
        last = word
    scores = net.score([text[:0], text, text[:33], text[:32]], 3)
    assert scores[1] == pytest.approx(total, rel=1e-5) and scores[0] == 0


def test_language_model_scores(stored):
    r = random.Random(0)
    texts = [None, "", "Solo", *[" ".join(r.choice(["the", "cat", "sat", "on", "mat", f"rare{r.randrange(300)}"]) for _ in range(r.randrange(1, 120))) for _ in range(120)], "the " * 3000]
    rows = [*rows_of(texts), (None, "the cat", "", 0, "", 0), (5, texts[5], "", 0, "", 0)]
    got = lm.score_documents(stored(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, x, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(x or "").lower().split(), " "])
    n, v = sum(counts.values()), len(counts)
    by = {x[0]: x[1] for x in rows}
    for g in got:
        ws = [*(by[g["doc_id"]] or "").lower().split(), " "]
        assert g["n_tokens"] == len(ws) and g["train_tokens"] == n and g["n_known"] == sum(counts[w] > 0 for w in ws)
        assert g["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert g["score"] < 0 and math.isfinite(g["score"])
        assert g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 7 == 2)
    assert lm.score_documents(stored([], SCHEMA, "none")).count() == 0


def test_tail_words_are_joined(stored, monkeypatch):
    """With a head of 3 words the counts of all others come by the join; the scores stay."""
    rows = rows_of([f"a b c d{i % 5} e{i}" for i in range(60)])
    whole = {r["doc_id"]: r for r in lm.score_documents(stored(rows, SCHEMA)).collect()}
    monkeypatch.setattr(lm, "HEAD", 3)
    part = lm.score_documents(stored(rows, SCHEMA, "again")).collect()
    for r in part:
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"]) and r["n_known"] == whole[r["doc_id"]]["n_known"]


def test_network_learns_from_every_training_document(stored):
    rows = stored(rows_of([f"text {i}" for i in range(200)]), SCHEMA).selectExpr("doc_id as id", "text")
    seen = Counter(x["text"] for r in range(lm.ROUNDS) for x in lm.part(rows, r).collect())
    assert seen == Counter(f"text {i}" for i in range(200))


@pytest.mark.parametrize("texts", [["the cat sat"], ["the cat sat"] * 20 + ["the cat sat on the mat " * 900] + ["on the mat"] * 90, [f"the cat {i} sat " * 30 for i in range(150)]])
def test_every_word_of_the_texts_is_learnt(texts):
    import pyarrow as pa

    counts = Counter(w for x in texts for w in [*x.encode().split(), lm.END])
    vocabulary = lm.Vocabulary([w for w, _ in counts.most_common()], np.array([c for _, c in counts.most_common()], float), sum(counts.values()), len(counts))
    got = list(lm._learn(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]), vocabulary, None))
    assert all(x.column("words").to_pylist() == [sum(counts.values())] for x in got)
    weights = np.concatenate([np.frombuffer(x.column("sums")[0].as_py(), np.float32) for x in got]) / sum(counts.values())
    assert np.isfinite(weights).all() and not np.allclose(weights, lm._network(vocabulary, None).flat(), atol=1e-3)


def test_texts_are_looked_up_once():
    """Training and scores go by the stored ids, without the words; sums and rare words are those of a plain count."""
    import pyarrow as pa

    r = random.Random(4)
    texts = [None, "", " \t", "Solo ", *[" ".join(r.choice(["the", "Cat", "\u00e9t\u00e9", "sat", f"rare{r.randrange(400)}"]) for _ in range(r.randrange(1, 90))) for _ in range(lm.TEXTS + 300)]]
    words = [[*(x or "").encode().lower().split(), lm.END] for x in texts]
    counts = Counter(w for ws in words for w in ws)
    head = counts.most_common(150)
    shared = np.zeros(lm.hashed_ids(len(counts)))
    for w, c in counts.items():
        shared[lm.crc32(w) % len(shared)] += c + 1
    vocabulary = lm.Vocabulary([w for w, _ in head], np.array([c for _, c in head], float), sum(counts.values()), len(counts), shared)
    sent = type("Sent", (), {"value": vocabulary})
    rows = pa.RecordBatch.from_pydict({"row": pa.array(range(len(texts))), "id": pa.array(range(len(texts))), "text": pa.array(texts)})
    stored = pa.Table.from_batches(list(lm._encode(iter([rows.slice(0, 7), rows.slice(7)]), sent))).combine_chunks()
    bare = vocabulary.bare()
    assert not bare.words and not bare.ids
    ids = bare.encoded(stored.column("ids").chunk(0))
    for i, (ws, row) in enumerate(zip(words, stored.to_pylist(), strict=True)):
        at, own = vocabulary.look_up(ws)
        assert row["row"] == i and row["n"] == len(ws) and row["n_known"] == (at >= 0).sum() and ids[i].tolist() == own.tolist()
        assert dict(zip(row["words"], row["times"], strict=True)) == Counter(w for w, k in zip(ws, at, strict=True) if k < 0)
        assert row["base"] == pytest.approx(vocabulary.base[at[at >= 0]].sum())
        assert row["apart"] == pytest.approx(vocabulary.aside[at[at >= 0]].sum() - np.log10(vocabulary.rest[own[at < 0] - vocabulary.known]).sum())
    learnt = [next(iter(lm._learn(iter([pa.RecordBatch.from_arrays([x], ["x"])]), v, None))) for x, v in ((rows.column(2), vocabulary), (stored.column("ids").chunk(0), bare))]
    assert learnt[0].equals(learnt[1])
    scored = list(lm._score(iter(stored.select(["row", "id", "n", "n_known", "base", "apart", "ids"]).to_batches()), bare, None))
    assert len(scored) == 1 and scored[0].column("row").to_pylist() == list(range(len(texts)))
    net = lm._network(vocabulary, None)
    for i in (0, 2, 9, len(texts) - 1):
        assert scored[0].column("score")[i].as_py() == pytest.approx(net.score([ids[i]], vocabulary.start())[0] / math.log(10) + stored.column("apart")[i].as_py(), rel=1e-4)


def test_long_texts_leave_few_words_alone(monkeypatch):
    """A long text that comes last doesn't go on without the others; words weigh alike in windows of all sizes."""
    import pyarrow as pa

    texts = ["the cat sat on " * 10] * 300 + ["on the mat " * 60]
    counts = Counter(w for x in texts for w in [*x.encode().split(), lm.END])
    vocabulary = lm.Vocabulary([w for w, _ in counts.most_common()], np.array([c for _, c in counts.most_common()], float), sum(counts.values()), len(counts))
    shapes = []

    class Seen(Gru):
        def learn(self, x, *rest):
            shapes.append(x.shape)
            return super().learn(x, *rest)

    monkeypatch.setattr(lm, "Gru", Seen)
    list(lm._learn(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]), vocabulary, None))
    assert sum(a * b for a, b in shapes) == sum(counts.values())
    assert sum(a * b for a, b in shapes if b < lm.STREAMS / 2) < 0.005 * sum(counts.values())
    r, moved = np.random.default_rng(1), []
    x, y = r.integers(0, 10, (5, 3)), r.integers(0, 10, (5, 3))
    for of in (None, 15, 60):
        net = Gru(np.arange(10, 0, -1.0), 3)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        before = net.flat()
        net.learn(x, y, x < 0, np.zeros((3, 32)), {k: np.full_like(v, 1e6) for k, v in net.p.items()}, of)
        moved.append(net.flat() - before)
    assert np.allclose(moved[0], moved[1], atol=0) and np.allclose(moved[0], 4 * moved[2], rtol=1e-4, atol=1e-12)


def test_large_logits_and_frequent_words_of_a_window():
    from pulsegrid.llm.gru import _sums

    r = np.random.default_rng(2)
    net = Gru(np.arange(40, 0, -1.0), 5)
    net.p = {k: v * np.float32(300) for k, v in net.p.items()}
    h = np.float32([[0.9] * 32, [-0.9] * 32])
    net.p["W"][:, 7], net.p["C"][3] = r.standard_normal(40) * 400, r.standard_normal(len(net.p["c"])) * 400
    logs = np.array([net.word_logs(h, np.full(2, i))[0] for i in range(40)])
    assert np.isfinite(logs).all() and np.exp(logs).sum(0) == pytest.approx([1, 1], abs=1e-4)
    d, words = r.standard_normal((300, 6)), r.choice(40, 300, p=np.arange(1, 41) ** 3 / (np.arange(1, 41) ** 3).sum())
    want = np.zeros((40, 6))
    np.add.at(want, words, d)
    rows, sums = _sums(d, words)
    assert sorted(rows.tolist()) == np.unique(words).tolist() and np.allclose(sums, want[rows])


def test_network_tells_rare_words_apart(monkeypatch):
    """Words without ids of their own differ as context and as target; the probabilities of all words add up."""
    monkeypatch.setattr(lm, "WORDS", 4)
    words = [lm.END, *(f"w{i}".encode() for i in range(400))]
    counts, v = np.arange(401, 0, -1.0), 401
    shared = np.zeros(lm.hashed_ids(v))
    for w, c in zip(words, counts, strict=True):
        shared[lm.crc32(w) % len(shared)] += c + 1
    vocabulary = lm.Vocabulary(words[:300], counts[:300], int(counts.sum()), v, shared)
    net = lm._network(vocabulary, None)
    at, ids = vocabulary.look_up(words)
    assert (at[:300] == np.arange(300)).all() and (at[300:] == -1).all() and len(set(ids[vocabulary.known :])) > 50
    assert lm.own_words(10**6) == 4000 and lm.own_words(10**8) == lm.hashed_ids(10**8) == 40_000
    h = np.random.default_rng(0).standard_normal((1, 32)).astype(np.float32)
    apart = np.where(at >= 0, vocabulary.aside[at.clip(0)], np.log10(counts + 1) - np.log10(vocabulary.rest[(ids - vocabulary.known).clip(0)]))
    unseen = sum(math.exp(net.word_logs(h, np.array([vocabulary.known + b]))[0][0]) / vocabulary.rest[b] for b in range(vocabulary.hashed))
    total = sum(math.exp(net.word_logs(h, np.array([i]))[0][0]) * 10**a for i, a in zip(ids, apart, strict=True))
    assert total + unseen == pytest.approx(1, abs=1e-4)
    states = {net.step(np.array([i]), h)[-1].tobytes() for i in ids}
    assert len(states) == len(set(ids))


def test_gradients_of_the_attention_network():
    r = np.random.default_rng(0)
    net = q.GatedAttention(np.zeros(6), np.ones(6))
    net.p = {k: v.astype(np.float64) + 0.1 * r.standard_normal(v.shape) for k, v in net.p.items()}
    net.mean, net.scale = np.zeros(6), np.ones(6)
    x, count, y = r.standard_normal((9, 6)), np.array([4, 1, 4]), np.array([1.0, 0, 1])

    def loss():
        p = net.forward(x, count)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(x, count, y)
    for k, v in net.p.items():
        for i in r.choice(v.size, min(4, v.size), replace=False):
            at = np.unravel_index(i, v.shape)
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            slope = (up - loss()) / 2e-5
            v[at] += 1e-5
            assert g[k][at] == pytest.approx(slope, abs=1e-6)


def slow_segments(scores):
    """Highest-scoring segment, then the same left and right of it: all maximal segments."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    _, _, a, b = best
    return slow_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in slow_segments(scores[b:])]


def test_segments_are_maximal():
    r = random.Random(0)
    for _ in range(60):
        scores = [r.choice([-4.03, -2.01, -1.07, 0.0, 1.13, 2.29, 5.41]) + r.random() / 1000 for _ in range(r.randrange(0, 25))]
        assert [(a, b) for a, b, _ in t.segments(np.array(scores, float))] == slow_segments(scores)


def test_karlin():
    share = np.zeros(len(t.MIDDLES))
    share[[30, 45]] = 0.8, 0.2
    lam = t.karlin(share * 1000)
    assert 0.8 * math.exp(lam * t.MIDDLES[30]) + 0.2 * math.exp(lam * t.MIDDLES[45]) == pytest.approx(1)


def labelled(spark, stored, fcn, name):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, fcn(r, words, bad), "s", 1, "z", i))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None, "", 0, "", 0), (1001, "", "", 0, "", 0), (None, "w1 w2", "", 0, "", 0), (7, rows[7][1], "", 0, "", 0)]
    return stored(rows, SCHEMA, name), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(got, name):
    held = [r for r in got if r["held_out"]]
    truth = {True: lambda i: int(i % 3 == 0), False: lambda i: int(i % 3 != 0)}[name == "toxic"]
    return np.mean([r["predicted"] == truth(r["doc_id"]) for r in held if r["doc_id"] < 400]), held


def test_quality(spark, stored):
    fcn = lambda r, ws, bad: " ".join([r.choice(ws).upper() + "!!" for _ in range(50)] if bad else [r.choice(ws) for _ in range(r.randrange(20, 200))])
    docs, labels = labelled(spark, stored, fcn, "quality")
    got = q.score_quality(docs, labels).collect()
    good, held = accuracy(got, "quality")
    assert len(got) == 404 and good > 0.9 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])
    assert all(r["score"] == 1 for r in q.score_quality(docs, labels.where("false")).collect())
    assert q.score_quality(stored([], SCHEMA, "none"), labels).count() == 0


def test_toxicity(spark, stored):
    fcn = lambda r, ws, bad: " ".join([r.choice(ws) for _ in range(60)] + ([r.choice(["scum", "Trash!", "moron"]) for _ in range(4)] if bad else []) + [r.choice(ws) for _ in range(40)])
    docs, labels = labelled(spark, stored, fcn, "toxic")
    got = t.score_toxicity(docs, labels).collect()
    good, held = accuracy(got, "toxic")
    assert len(got) == 404 and good > 0.95 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    bad = next(r for r in got if r["doc_id"] == 0)
    assert any(s["start"] >= 55 and s["end"] <= 65 for s in bad["passages"])
    empty = {r["doc_id"]: r for r in got if r["doc_id"] in (1000, 1001)}
    assert empty[1000]["score"] == empty[1001]["score"] < 0.5
    assert all(r["predicted"] == 0 for r in t.score_toxicity(docs, labels.where("false")).collect())
    assert t.score_toxicity(stored([], SCHEMA, "none"), labels).count() == 0


def test_same_toxic_passage_at_two_places():
    model = t.ToxicModel({"scum": 5.0, "trash": 5.0, "moron": 5.0}, 1.0, 0.1, (-4.0, 0.5, 1.0))
    clean, bad = [f"w{i}".encode() for i in range(400)], [b"scum", b"trash", b"moron"]
    known = t.WordScores(model.table)
    words = clean[:100] + bad + clean[100:300] + bad + clean[300:]
    kept, best, total = model.evidence(words, t.word_scores(words, known))
    assert [(a, b) for a, b, _ in kept] == [(100, 103), (303, 306)] and kept[0][2] == kept[1][2] == best
    # Words that occurred before, far apart, are a passage where they meet.
    words = [b"scum", *clean[:100], b"trash", *clean[100:200], b"moron", *clean[200:300], *bad]
    assert (303, 306) in [(a, b) for a, b, _ in model.evidence(words, t.word_scores(words, known))[0]]
    # One word over and over is no more evidence than once.
    once, often = ([b"scum"] * n + clean for n in (1, 50))
    assert t.discounted(often, t.word_scores(often, known))[0][2] == t.discounted(once, t.word_scores(once, known))[0][2] == 5
    # Close together they are one passage, and no less significant than one of them.
    words = bad + clean[:5] + bad
    assert [(a, b) for a, b, _ in model.evidence(words, t.word_scores(words, known))[0]] == [(0, 11)]


def test_pipeline_stages(spark):
    """Each stage's rows are those of the stage before that it keeps; the bins hold all words of the mix."""
    docs = corpus_pipeline.table(spark, SF, "documents")
    counts, frames = [docs.count()], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(corpus_pipeline.cut(stage(spark, frames[-1], SF)))
        assert frames[-1].columns == docs.columns
        counts.append(frames[-1].count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, frames[-1], SF).collect()
    length = defaultdict(int)
    for r in packed:
        length[r["doc_id"]] += r["length"]
    words = defaultdict(int)
    for r in frames[-1].collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
    assert length == words
    fill = Counter()
    for r in packed:
        fill[r["bin_id"]] += r["length"]
    assert max(n for b, n in fill.items() if b is not None) <= 2048


def test_queries_are_registered():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries.queries()
    assert set(queries.oracle_sql()) <= set(names)


def test_segments_of_a_long_falling_walk():
    """Clean text: no candidate starts below an earlier one. Quadratic work on it would take an hour."""
    scores = np.tile([0.5, -1.0], 200_000)
    assert t.segments(scores) == [(2 * i, 2 * i + 1, 0.5) for i in range(200_000)]


def test_commonest_words(spark):
    counts = spark.createDataFrame([(str(i).encode(), c) for i, c in enumerate([5, 3, 3, 3, 2000, 1001, 1, 1])], "word binary, c long")
    assert [int(w) for w in lm.commonest(counts, 3)["word"].to_pylist()] == [4, 5, 0]
    assert [int(w) for w in lm.commonest(counts, 6)["word"].to_pylist()] == [4, 5, 0, 1, 2, 3]
    assert lm.commonest(counts, 0).num_rows == 0 and lm.commonest(counts.limit(0)).num_rows == 0


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns; and empty tables."""
    r = random.Random(5)
    words = lambda n: " ".join(r.choice("the good words of a plain text that one reads and keeps".split()) + str(r.randrange(50)) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, label int, __file long, c0 string"
    rows = [(i, words(r.randrange(20, 90)), "en", f"s{i % 3}", 5, i, "x", 1, 7, "c") for i in range(60)]
    rows += [(None, words(40), None, None, None, None, None, None, None, None), (100, None, "en", "s0", None, 1, "x", 1, 7, "c"), (101, "", "en", None, 0, 1, "x", 1, 7, "c")]
    rows += [(102, words(30_000), "en", "s1", 1, 1, "x", 1, 7, "c"), rows[3], rows[3], (103, rows[4][1].upper(), "en", "s2", 1, 1, "x", 1, 7, "c")]
    labels = [(i, i % 2, 0) for i in range(0, 60, 2)] + [(None, 1, None), (7, None, None), (7, 1, 1)]
    for name, docs, marks in (("some", rows, labels), ("none", [], [])):
        spark.createDataFrame(docs, schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, f"file://{tmp_path}/{name}")
            assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{name}/stage{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}/stage{k}")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}/{name}").collect()
        assert {p["doc_id"] for p in packed} <= {x[0] for x in rows} and (name == "some") == (len(packed) > 0)


def test_softmax_of_many_words_takes_some_at_a_time():
    """The classes' probabilities of all words at once would be 33 MB; the logs are those of each word alone."""
    import tracemalloc

    net = Gru(np.arange(20_000, 0, -1.0), 256)
    r = np.random.default_rng(0)
    net.p = {k: (v + 0.1 * r.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    h, y = r.standard_normal((1 << 15, 32)).astype(np.float32), r.integers(0, 20_000, 1 << 15)
    tracemalloc.start()
    logs = net.word_logs(h, y)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    for i in (0, 2047, 2048, 32767):
        assert logs[i] == pytest.approx(net.word_logs(h[i : i + 1], y[i : i + 1])[0][0], rel=1e-4)
