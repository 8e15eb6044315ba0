"""Near duplicates, lines, top-k and packing against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import bagminhash as b
from pulsegrid.llm import components as c
from pulsegrid.llm import cover_tree as ct
from pulsegrid.llm import fuzzy_lines as fl
from pulsegrid.llm import packing as p
from pulsegrid.llm import words as w

SCHEMA = "doc_id long, text string, source string, row long, key long"


def document(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def corpus(seed=0):
    """Copies, near copies of all degrees, chains, a hot group, short and empty texts."""
    r, out = random.Random(seed), [None, "", "  ", "one", "One", "one two three", "one two three", "É x", "é x"]
    for _ in range(12):
        base = document(r, r.randrange(30, 200))
        out += [" ".join(base), " ".join(base).upper()]
        for _ in range(6):
            v = list(base)
            for _ in range(r.randrange(1, 8)):
                v[r.randrange(len(v))] = "zz"
            out.append("  ".join(v))
    base = document(r, 120)
    for _ in range(60):
        v = list(base)
        for _ in range(r.randrange(1, 6)):
            v[r.randrange(len(v))] = f"q{r.randrange(9)}"
        out.append(" ".join(v))
    out += ["a b c d e f g h"] * 30 + [" ".join(["again and again and"] * 40), " ".join(["again and again and"] * 41)]
    return [(i, t, "s", i, 0) for i, t in enumerate(out)]


def bag(t):
    ws = (t or "").encode().lower().split()
    return Counter([tuple(ws)]) if len(ws) < 5 and ws else Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def jaccard(x, y):
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def brute_classes(rows, least):
    bags, up = [bag(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= least:
                up[root(i)] = root(j)
    out = defaultdict(set)
    for i, r in enumerate(rows):
        out[root(i)].add(r[0])
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("most,rounds", [(b.MAX_BROADCAST, b.ROUNDS), (0, 0)])
def test_near_duplicates(stored, monkeypatch, most, rounds):
    """With most = 0 nothing is broadcast, with no rounds every pair is compared."""
    rows = corpus()
    monkeypatch.setattr(b, "MAX_BROADCAST", most)
    monkeypatch.setattr(b, "ROUNDS", rounds)
    monkeypatch.setattr(b.similar_links, "__defaults__", (b.SIMILAR, rounds))
    got = b.near_duplicates(stored(rows, SCHEMA)).collect()
    found = defaultdict(set)
    for r in got:
        found[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in found.values()} == brute_classes(rows, 0.8)
    for r in got:
        assert r["class_size"] == len(found[r["class_id"]]) and r["kept"] == (r["doc_id"] == max(found[r["class_id"]]))


def test_near_duplicates_with_odd_rows(stored):
    rows = [(None, "x y z", None, None, None), (None, "x y z", None, None, None), (1, None, None, None, None), (1, None, None, 1, 1)]
    got = b.near_duplicates(stored(rows, SCHEMA)).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2
    assert b.near_duplicates(stored([], SCHEMA, "none")).count() == 0
    kept = b.drop_near_duplicates(stored(rows, SCHEMA, "again"))
    assert kept.columns == ["doc_id", "text", "source", "row", "key"] and kept.count() == 2


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        x, y = r.integers(0, 6, 200), r.integers(0, 6, 200)
        y = np.where(r.random(200) < 0.6, x, y)
        value = w.mix(r.integers(1, 2**62, 200).astype(np.uint64))
        s = [b.bag_minhash(value[v > 0], v[v > 0], np.zeros((v > 0).sum(), int), 1, 1024) for v in (x, y)]
        errors.append((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.025


@pytest.mark.parametrize("edges", [10, 10**6])
def test_components(spark, monkeypatch, edges):
    """With few edges to a task rounds of stars are needed."""
    monkeypatch.setattr(c, "EDGES", edges)
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)]
    got = {x["id"]: x["root"] for x in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {i: i for e in links for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, y in links:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in up} == {i: root(i) for i in up}


def edit(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, bb in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != bb))
    return row[-1]


LINE = "the quick brown fox jumps over the lazy dog and runs into the wide green forest beyond the river"


def test_fuzzy_lines(stored):
    texts = [
        LINE + "\nunique line here of mine\n\n" + LINE.upper() + "!",
        None,
        "",
        LINE.replace("lazy", "lazi") + "\nkeep this other line please",
        "page 12 of 99\npage 13 of 42",
        "\n".join([LINE] * 3),
        "a\nb\na",
    ]
    rows = [(i, t, "s", 0, 0) for i, t in enumerate(texts)] + [(None, "page 77 of 11", "s", 0, 0)]
    docs = stored(rows, SCHEMA)
    got = fl.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n_lines"], sorted(r["dropped"])) for r in got}
    total = sum(r["n_dropped"] for r in got)
    assert by[1] == by[2] == (1, [])
    lines = [(r["doc_id"], r["n_dropped"]) for r in got]
    # LINE: 6 like it; page n of m: 3; 'a': 2: one of each stays.
    assert total == (6 - 1) + (3 - 1) + (2 - 1), lines
    out = fl.drop_repeated_lines(docs).collect()
    left = [x for r in out for x in (r["text"] or "").split("\n")]
    assert sum(edit(x.lower().strip("!"), LINE) <= 2 for x in left if abs(len(x) - len(LINE)) < 5) == 1
    assert "keep this other line please" in left and "unique line here of mine" in left
    assert fl.dedup_lines(stored([], SCHEMA, "none")).count() == 0


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim)) * 3
    return centres[r.integers(0, 5, n)] + r.standard_normal((n, dim))


@pytest.mark.parametrize("n,dim", [(1, 3), (40, 2), (900, 8)])
def test_search_is_exact(n, dim):
    x = np.floor(vectors(n, dim, n) * 4)
    x[n // 2 :] = x[: n - n // 2]  # ties
    q = np.arange(0, n, 7)
    ids = np.random.default_rng(1).permutation(n)
    score, at = ct.search(x[q], q, x, np.arange(n), ids, 10)
    for i, row in enumerate(q):
        order = sorted((j for j in range(n) if j != row), key=lambda j: (-float(x[row] @ x[j]), ids[j]))[:10]
        assert [j for j in at[i] if j >= 0] == order


def test_nearest_with_odd_vectors(stored, monkeypatch):
    monkeypatch.setattr(ct, "ROWS", 16)
    monkeypatch.setattr(ct, "QUERIES", 3)
    x = vectors(80, 4, 3)
    rows = [(i * 25, [float(v) for v in x[i]], 0) for i in range(80)] + [(100, [float("nan"), 1.0, 1.0, 1.0], 0), (200, None, 0), (300, [None, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (400, [float("inf")] * 4, 0), (500, [1.0, 2.0], 0), (0, [float(v) for v in x[0]], 0), (700, [], 0)]
    got = ct.nearest(stored(rows, "vec_id long, embedding array<double>, score int")).collect()
    ok = [(k, i, np.floor(np.array(v) * 1024)) for k, (i, v, _) in enumerate(rows) if i is not None and v and all(z is not None and np.isfinite(z) for z in v)]
    want = []
    for k, i, v in ok:
        if i % 100 == 0:
            near = sorted((-int(v @ u), j) for kk, j, u in ok if kk != k and len(u) == len(v))[:10]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(near)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    huge = [(0, [1e200, 1.0]), (1, [1e200, -1e200]), (2, [1.0, 2.0]), (3, [1e308, 1.0])]
    got = ct.nearest(stored([(*r, 0) for r in huge], "vec_id long, embedding array<double>, score int", "huge")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    assert ct.nearest(stored([], "vec_id long, embedding array<double>, score int", "none")).count() == 0


def test_nearest_takes_empty_vectors(stored):
    rows = [(700, [], 0), (3, [], 0), (100, [], 0), (5, [1.0], 0), (200, [None], 0)]
    got = ct.nearest(stored(rows, "vec_id long, embedding array<float>, score int")).collect()
    assert sorted(tuple(r) for r in got) == [(100, 1, 3, 0), (100, 2, 700, 0), (700, 1, 3, 0), (700, 2, 100, 0)]


def test_search_ties_scores_below_a_long():
    r = np.random.default_rng(0)
    x = np.floor(-1e12 * (1 + r.random((300, 2)) * 1e3))
    x[0] *= -1
    score, at = ct.search(x[:1], np.array([0]), x, np.arange(300), np.arange(300)[::-1].copy(), 10)
    assert at[0].tolist() == list(range(299, 289, -1)) and set(score[0]) == {-(2**63) + 1}


def test_search_bounds_allow_for_terms_that_cancel():
    q = ct.CoverTree(np.array([[1e9, 1.0], [1e9, 1.0]]))
    d = ct.CoverTree(np.array([[3.0, -3e9], [3.0, -3e9]]))
    assert ct._bounds(q, [0], d, 0)[0] >= 1e-9 * 1e9 * 3e9


def test_pack(stored, monkeypatch):
    monkeypatch.setattr(p, "PIECES_PER_SHARD", 100)
    r = random.Random(0)
    rows = [(i, " ".join(["w"] * r.randrange(0, 70)) + (" same" if i % 3 == 0 else f" {i}"), f"s{i % 5}" if i % 11 else None, i, 0) for i in range(300)]
    rows += [(1000, " ".join(map(str, range(450))), "s0", 0, 0), (1001, None, None, 0, 0), (1002, "", "s1", 0, 0), (1003, "same text", "s1", 0, 0), (1004, "SAME text", "s1", 0, 0), (None, "no id", "s1", 0, 0)]
    got = p.pack(stored(rows, SCHEMA), capacity=100, per_source=2).collect()
    text = {r[0]: r for r in rows}
    length, bins = Counter(), defaultdict(list)
    for x in got:
        length[x["doc_id"]] += x["length"]
        assert (x["bin_id"] is None) == (x["length"] == 0)
        if x["bin_id"] is not None:
            bins[x["bin_id"]].append(x)
    assert all(length[i] == len((t[1] or "").split()) for i, t in text.items())
    for content in bins.values():
        spans = sorted((x["offset"], x["offset"] + x["length"]) for x in content)
        assert spans[0][0] == 0 and all(a[1] == z[0] for a, z in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 100
        assert max(Counter(text[x["doc_id"]][2] for x in content).values()) <= 2
        assert max(Counter(text[x["doc_id"]][1].lower() for x in content).values()) == 1 or any(x["piece"] for x in content)
    assert p.pack(stored([], SCHEMA, "none")).count() == 0


def test_bins_are_the_tightest_compatible():
    r = random.Random(3)
    fast, slow = p.Bins(50, 2, (1, 4)), []
    for _ in range(400):
        n, source, cluster = r.randrange(1, 30), 1 << r.randrange(4), 1 << r.randrange(6) if r.random() < 0.5 else 0
        at, offset = fast.place(n, source, cluster)
        fits = [x for x in slow if x["room"] >= n and not x["clusters"] & cluster and x["sources"].count(source) < 2]
        best = min((x["room"] for x in fits), default=None)
        if best is None:
            assert at == len(slow) and offset == 0
            slow.append({"room": 50, "clusters": 0, "sources": []})
        else:
            assert slow[at]["room"] == best
        slow[at]["room"] -= n
        slow[at]["clusters"] |= cluster
        slow[at]["sources"].append(source)


def edited(r, line, share, kind):
    """The line with that share of its characters edited at random places, or with a word swapped or added."""
    words, chars = line.split(" "), list(line)
    if kind == "swap":
        i = r.randrange(len(words) - 1)
        words[i], words[i + 1] = words[i + 1], words[i]
        return " ".join(words)
    if kind == "add":
        words.insert(r.randrange(len(words) + 1), made_up(r, 1))
        return " ".join(words)
    for _ in range(max(1, int(len(chars) * share))):
        i, c = r.randrange(len(chars)), r.choice("abcdefghijklmnopqrstuvwxyz")
        chars[i : i + 1] = r.choice([[], [c], [chars[i], c]])
    return " ".join("".join(chars).split())


def made_up(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(n))


def test_lines_of_edit_similarity_are_candidates():
    """Recall against brute-force edit similarity, case by case, over random lines and edits."""
    r, got = random.Random(4), {}
    cases = [(n, s, "edit") for n in (2, 3, 5, 8, 12, 20, 60) for s in (0.0, 0.05, 0.08)] + [(n, 0, k) for n in (12, 20, 60) for k in ("swap", "add")]
    for case in cases:
        met = []
        for _ in range(100):
            x = made_up(r, case[0])
            y = edited(r, x, case[1], case[2])
            if x != y and edit(x, y) <= int(max(len(x), len(y)) * 0.1 + 1e-9):
                key, of = fl.bucket_keys(fl.Lines([f"{x}\n{y}".encode()]))
                met.append(bool(set(key[of == 0].tolist()) & set(key[of == 1].tolist())))
        got[case] = len(met), sum(met)
    print({k: (n, m / max(n, 1)) for k, (n, m) in got.items()})
    assert sum(n for n, _ in got.values()) > 1000
    assert all(m >= 0.9 * n for n, m in got.values() if n >= 20), got
    assert sum(m for _, m in got.values()) >= 0.97 * sum(n for n, _ in got.values()), got


def test_short_lines_are_always_candidates():
    """Below SHORT characters the pieces miss no pair."""
    r, n = random.Random(6), 0
    for _ in range(3000):
        x = "".join(r.choice("abcé ") for _ in range(r.randrange(10, fl.SHORT)))
        y = list(x)
        for _ in range(r.randrange(1, 4)):
            i, c = r.randrange(len(y)), r.choice("abcé ")
            y[i : i + 1] = r.choice([[], [c], [y[i], c]])
        x, y = " ".join(x.split()), " ".join("".join(y).split())
        if x != y and min(len(x), len(y)) < fl.SHORT and edit(x, y) <= int(max(len(x), len(y)) * 0.1 + 1e-9):
            key, of = fl.bucket_keys(fl.Lines([f"{x}\n{y}".encode()]))
            assert set(key[of == 0].tolist()) & set(key[of == 1].tolist()), (x, y)
            n += 1
    assert n > 300


def test_lines_of_texts():
    texts = [b"", b"\n\n One, TWO\t99 \n..!\n\x00end", "é  ß\x0b a-b".encode(), b"\n", b"last\nline"]
    got = fl.Lines(texts)
    assert [(int(r), int(p), got.text(i).decode()) for i, (r, p) in enumerate(zip(got.row, got.pos, strict=True))] == [(1, 2, "one two 00"), (1, 4, "end"), (2, 0, "é ß ab"), (4, 0, "last"), (4, 1, "line")]
    assert got.chars.tolist() == [10, 3, 6, 4, 4] and len(set(got.keys())) == 5
    again = fl.Lines([b"x\nEND"])
    assert again.keys()[1] == got.keys()[1] and fl.Lines([b"", b" . "]).keys() == []
    assert fl.Lines([b"two one"]).keys() != fl.Lines([b"one two"]).keys()


def test_edited_lines_are_dropped(stored):
    r = random.Random(5)
    base = [made_up(r, 20) for _ in range(40)]
    near = [edited(r, x, 0.05, "edit") for x in base]
    assert all(edit(x, y) <= 0.1 * max(len(x), len(y)) for x, y in zip(base, near, strict=True))
    got = fl.dedup_lines(stored([(0, "\n".join(base), "s", 0, 0), (1, "\n".join(near), "s", 0, 0)], SCHEMA)).collect()
    assert sum(x["n_dropped"] for x in got) >= 38


def test_lines_against_brute_force(stored):
    """Dropped lines are all but one of each group that edit similarity connects, over any path."""
    r = random.Random(7)
    base = [made_up(r, r.randrange(2, 25)) for _ in range(40)]
    lines = [y for x in base for y in (x, edited(r, x, 0.02, "edit"), edited(r, x, 0.04, "edit"), x.upper() + "!")] + ["", "a", "a", "b"] + [made_up(r, 2) for _ in range(20)]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 7 : i * 7 + 7]), "s", 0, 0) for i in range(-(-len(lines) // 7))] + [(99, None, "s", 0, 0), (98, "", "s", 0, 0)]
    plain = [" ".join(b"".join([x.encode()]).lower().translate(fl._PLAIN, fl._MARKS).decode().split()) for x in lines]
    up = list(range(len(lines)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(plain):
        for j in range(i):
            if x and plain[j] and abs(len(x) - len(plain[j])) <= 0.1 * max(len(x), len(plain[j])) and edit(x, plain[j]) <= int(max(len(x), len(plain[j])) * 0.1 + 1e-9):
                up[root(i)] = root(j)
    groups = len({root(i) for i, x in enumerate(plain) if x})
    got = fl.dedup_lines(stored(rows, SCHEMA)).collect()
    dropped = {(x["doc_id"], k) for x in got for k in x["dropped"]}
    left = [i for i in range(len(lines)) if plain[i] and (i // 7, i % 7) not in dropped]
    assert len(left) == len({root(i) for i in left}) == groups and all(x["n_dropped"] == len(x["dropped"]) for x in got)


def test_search_below_a_floor():
    x = np.floor(vectors(300, 4, 8) * 4)
    q, rows = np.arange(0, 300, 7), np.arange(300)
    score, at = ct.search(x[q], q, x, rows, rows, 10)
    floor = score[:, -1]
    assert (ct.search(x[q], q, x, rows, rows, 10, floor)[0] == score).all()
    above, _ = ct.search(x[q], q, x, rows, rows, 10, floor + 1)
    assert all({v for v in a if v > f} >= {v for v in s if v > f} for a, s, f in zip(above, score, floor, strict=True))


def test_within_is_the_edit_distance():
    r = random.Random(9)
    for _ in range(3000):
        x = "".join(r.choice("abé\U0001f600 ") for _ in range(r.randrange(0, 40)))
        y = list(x)
        for _ in range(r.randrange(0, 9)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randrange(2)] = r.choice(["", "a", "é", "b "])
        y = "".join(y) if r.random() < 0.9 else "".join(r.choice("abé ") for _ in range(r.randrange(0, 40)))
        d = edit(x, y)
        for most in (0, 1, 3, d - 1, d, d + 1):
            if most >= 0:
                assert fl.within(x, y, most) == (d <= most), (x, y, most)


def test_keys_of_lines_are_deleted_before_lines_are_compared(spark, stored, monkeypatch):
    """Keys are most of the stored tables; none is left once the cells are known."""
    kept, left, real, compare = [], [], fl.cut, fl.similar_lines

    def cut(df):
        kept.append(real(df))
        return kept[-1]

    def exists(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def similar(*args):
        left.extend(df for df in kept if "buckets" in df.columns and exists(df))
        return compare(*args)

    monkeypatch.setattr(fl, "cut", cut)
    monkeypatch.setattr(fl, "similar_lines", similar)
    r = random.Random(8)
    base = [made_up(r, 12) for _ in range(20)]
    got = fl.dedup_lines(stored([(i, "\n".join(base), "s", 0, 0) for i in range(3)], SCHEMA)).collect()
    assert sum(x["n_dropped"] for x in got) == 40 and any("buckets" in df.columns for df in kept)
    assert not left


def test_counts_of_runs_reject_no_pair_within():
    r = random.Random(9)
    pairs = [("", ""), ("a", ""), ("ab", "abc"), ("abc", "abd"), ("x" * 500, "x" * 450), ("né" * 40, "ne" * 40)]
    for _ in range(3000):
        x = "".join(r.choice("abcé \U0001f600") for _ in range(r.randrange(0, 40)))
        y = list(x)
        for _ in range(r.randrange(0, 5)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.choice([0, 1])] = r.choice([[], [r.choice("abcé")], [r.choice("abcé"), "b"]])
        pairs.append((x, "".join(y)))
    most = np.array([r.randrange(0, 6) for _ in pairs])
    kept = fl.may_be_within(pairs, most)
    near = np.array([fl.within(x, y, int(m)) for (x, y), m in zip(pairs, most, strict=True)])
    assert not (near & ~kept).any() and near.sum() > 500 and (~kept).sum() > 300
    assert len(fl.may_be_within([], most[:0])) == 0


def test_pairs_of_lines_go_part_by_part(stored, monkeypatch):
    """No join of pairs with texts is larger than it may be; the result is that of all pairs at once."""
    r = random.Random(10)
    base = [made_up(r, 12) for _ in range(30)]
    docs = stored([(i, "\n".join(edited(r, x, 0.02 * i, "edit") for x in base), "s", 0, 0) for i in range(3)], SCHEMA)
    steps, real = [], fl.cut

    def cut(df):
        steps.append(df.columns == ["a", "b"] and "MapInArrow" in df._jdf.queryExecution().toString())
        return real(df)

    monkeypatch.setattr(fl, "cut", cut)
    whole = sorted(tuple(x) for x in fl.dedup_lines(docs).collect())
    at_once = sum(steps)
    steps.clear()
    monkeypatch.setattr(fl, "PAIRS", 8, raising=False)
    assert sorted(tuple(x) for x in fl.dedup_lines(docs).collect()) == whole and sum(x[2] for x in whole) > 50
    assert sum(steps) > at_once
