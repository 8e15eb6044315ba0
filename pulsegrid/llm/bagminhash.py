"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, verified links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, cut, forget, hot_limit, join_groups, place_name, placed, unplaced, with_row_id
from .components import components
from .words import WordHashes, as_bytes, bags, hash_words, mix, portions, shingles, split_words

SHINGLE, SIMILAR = 5, 0.8
#: 24 bands of 4 miss a pair of similarity 0.8 with a chance of 3 in a million.
PLACES, BANDS, BAND = 128, 24, 4
#: Pairs whose signatures agree in fewer places than this, 4.5 deviations below 0.8, aren't compared.
LEAST_AGREE = int(PLACES * (SIMILAR - 4.5 * (SIMILAR * (1 - SIMILAR) / PLACES) ** 0.5))
#: Rounds of links to bucket centres; after them every open pair is compared.
ROUNDS = 2
BLOCK = 2_048
#: Rows that are named to all executors are so many bytes at most; more are joined by a shuffle.
MAX_BROADCAST = 32 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bag_minhash(value: np.ndarray, weight: np.ndarray, text: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """(texts, places) of 32-bit hashes that agree in a place with chance sum of min / sum of max of the weights.

    Integer weights are split into the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each element
    has a Poisson process per interval, at a rate of its length, which depends on nothing but the
    element. A point falls on a random place and on a random weight of its interval; it counts if the
    element's weight is above that, so larger weights see the points of smaller ones and more. The first point on
    each place is the signature. A process ends once it is past all first points of its text.
    """
    parts = [(np.arange(len(value)), 0, 1)]
    while len(more := np.flatnonzero(weight > (base := 1 << (len(parts) - 1)))):
        parts.append((more, base, base))
    which = np.concatenate([p[0] for p in parts])
    base = np.concatenate([np.full(len(p[0]), p[1], np.uint64) for p in parts])
    length = np.concatenate([np.full(len(p[0]), p[2], np.uint64) for p in parts])
    state = mix(value[which] + (base + np.uint64(1)) * _GOLD)
    of, most = text[which], weight[which].astype(np.uint64)
    rate = 1.0 / length
    first = np.full(texts * places, np.inf)
    limit = np.full(texts, np.inf)
    time, alive, k = np.zeros(len(which)), np.arange(len(which)), 0
    per_text = len(which) / max(texts, 1)
    while len(alive):
        step = 32 if per_text < 16 else 8 if per_text < 128 else 1 if k < 2 else 2
        u = mix(state[alive, None] + (np.arange(k + 1, k + 1 + step, dtype=np.uint64) * _GOLD)[None, :])
        at = time[alive, None] + np.cumsum(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate[alive, None], axis=1)
        r = mix(u ^ _GOLD)
        place = ((r >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        weight_at = base[alive, None] + (((r & np.uint64(0xFFFFFFFF)) * length[alive, None]) >> np.uint64(32))
        doc = of[alive]
        good = (weight_at < most[alive, None]) & (at < limit[doc, None])
        np.minimum.at(first, (doc[:, None] * places + place.astype(np.int64))[good], at[good])
        time[alive], k = at[:, -1], k + step
        limit = first.reshape(texts, places).max(axis=1)
        alive = alive[time[alive] < limit[doc]]
    return (mix(first.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(texts, places)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of 64-bit keys."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLD, len(signatures), 0)
    rows = signatures[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    for j in range(BAND):
        key = mix((key ^ rows[:, :, j]) + _GOLD)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (__file, __at, id, text): the same without the text, with a hash of its words, its signature and its bands."""
    hashes = WordHashes()
    for batch in batches:
        texts = as_bytes(batch.column(3))
        sizes = np.array([len(t) for t in texts])
        # Texts of like size go together: short ones need many rounds, which are cheap over many of them.
        order = np.argsort(sizes, kind="stable")
        for part in portions(sizes[order], 1 << 20):
            chosen = order[part]
            words = [split_words(texts[i]) for i in chosen]
            h, n = hash_words(words, hashes)
            s, text, weight = bags(*shingles(h, n, SHINGLE))[0:3]
            some = np.flatnonzero(n > 0)
            place = np.zeros(len(n), np.int64)
            place[some] = np.arange(len(some))
            signed = bag_minhash(s, weight, place[text], len(some))
            keys, at = band_keys(signed), {int(i): k for k, i in enumerate(some)}
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(k).take(pa.array(chosen)) for k, c in enumerate((*PLACE, "id"))}
                | {
                    "words": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                    "signature": pa.array([signed[at[i]].astype(np.uint16).tobytes() if i in at else b"" for i in range(len(n))], pa.binary()),
                    "bands": pa.array([keys[at[i]] if i in at else np.zeros(0, np.int64) for i in range(len(n))], pa.list_(pa.int64())),
                }
            )


def _bag_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bag): the sorted 32-bit shingle hashes of a text, a repeated one made distinct by its turn.

    Chance makes two texts of a thousand shingles share one more in a case of four thousand.
    """
    hashes = WordHashes()
    for batch in batches:
        rows, texts = batch.column(0), as_bytes(batch.column(1))
        for part in portions(np.array([len(t) for t in texts]), 1 << 20):
            h, n = hash_words([split_words(texts[i]) for i in part], hashes)
            s, text, weight = bags(*shingles(h, n, SHINGLE))
            turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            each = np.where(turn > 0, mix(np.repeat(s, weight) + turn.astype(np.uint64) * _GOLD), np.repeat(s, weight))
            cuts = np.searchsorted(np.repeat(text, weight), np.arange(len(n) + 1))
            yield pa.RecordBatch.from_pydict({"row": rows.take(pa.array(part)), "bag": pa.array([np.sort((each[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of _bag_of."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
        good = [i for i in range(len(a)) if similarity(np.frombuffer(x[i], np.uint32), np.frombuffer(y[i], np.uint32)) >= least]
        yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})


def _beside(few: DataFrame, many: DataFrame, key: str, size: int) -> DataFrame:
    """few, of that many bytes, joined with the rows of many that it names; a small one is broadcast, so that many isn't shuffled."""
    named = few.withColumnRenamed(key, "__named")
    return many.join(F.broadcast(named) if size <= MAX_BROADCAST else named, many["row"] == F.col("__named")).withColumnRenamed("__named", key)


def _verified(pairs: DataFrame, bag_rows: DataFrame, least: float, limit: int) -> DataFrame:
    """The pairs (a, b) that are similar; a centre that many pairs name is joined without a hot task."""
    pairs = cut(pairs)
    size = 32 * pairs.count()
    named = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("__n"))
    of_b = _beside(named, bag_rows, "b", size).select("b", "__n", F.col("bag").alias("y"))
    with_a = _beside(pairs, bag_rows, "a", size).select("a", "b", F.col("bag").alias("x"))
    found = cut(join_groups(with_a, of_b, "b", "__n", limit).select("a", "b", "x", "y").mapInArrow(partial(_verify, least=least), "a long, b long"))
    forget(pairs)
    return found


def _near(root: np.ndarray, side: np.ndarray, row: np.ndarray, band: int, signature: np.ndarray, bands: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): pairs of different roots whose signatures agree enough, in the first band that they share.

    Rows of side 0 meet those of side 1; rows of side 2 meet each other.
    """
    for i in np.flatnonzero(side != 1):
        other = np.flatnonzero((root != root[i]) & ((side == 1) if side[i] == 0 else (row > row[i])))
        other = other[(signature[other] == signature[i]).sum(axis=1) >= LEAST_AGREE]
        if len(other):
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
        if len(other):
            yield int(i), other


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows of one place, in batches sorted by place; a place has some 2 * BLOCK rows at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        place = rows.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield from (rows.slice(int(x), int(y - x)) for x, y in zip(cuts, cuts[1:], strict=False))
        held = rows.slice(int(cuts[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    row, root, side, band = (rows.column(i).to_numpy() for i in range(1, 5))
    signature = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint16).reshape(-1, PLACES)
    return root, side, row, int(band[0]), signature, np.array(rows.column(6).to_pylist(), np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (place, row, root, side, band, signature, bands) sorted by place: those with a near pair."""
    for rows in _places(batches):
        found = [x for i, others in _near(*_arrays(rows)) for x in (i, *others.tolist())]
        if found:
            yield from rows.take(pa.array(sorted(set(found)))).to_batches()


def _confirm(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Over the same rows with their bags: similar pairs (a, b), without those that others in the place already link."""
    for rows in _places(batches):
        arrays = _arrays(rows)
        bags_ = [np.frombuffer(b, np.uint32) for b in rows.column(7).to_pylist()]
        root, row, a, b = arrays[0].copy(), arrays[2], [], []
        for i, others in _near(*arrays):
            for j in others:
                if root[i] != root[j] and similarity(bags_[i], bags_[j]) >= least:
                    root[root == root[j]] = root[i]
                    a.append(int(row[i]))
                    b.append(int(row[j]))
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open_links(members: DataFrame, signed: DataFrame, bag_rows: DataFrame, least: float) -> DataFrame:
    """Similar pairs (a, b) of members (row, root, key, band, n, main_root, others) of unlike roots.

    A bucket's rows outside its main root meet each other, and those of the main root, block by
    block; rows of the main root don't meet. So the work is others x bucket, spread over blocks. First
    signatures are compared; only rows that have a near one come again, with their bags.
    """
    kb, km = F.ceil(F.col("others") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("others")) / BLOCK).cast("int")
    rows = members.withColumn("kb", kb).withColumn("km", km).withColumn("main", F.col("root") == F.col("main_root"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("main"), F.col("km")).otherwise(F.col("kb"))).cast("int"))
    places = F.expr("""
        case when main then transform(sequence(0, kb - 1), j -> struct('m' as kind, j as x, own as y, 1 as side))
        else concat(
            transform(sequence(0, kb - 1), j -> struct('o' as kind, least(j, own) as x, greatest(j, own) as y, case when j = own then 2 when own < j then 0 else 1 end as side)),
            transform(sequence(0, km - 1), j -> struct('m' as kind, own as x, j as y, 0 as side))) end""")
    dealt = cut(rows.withColumn("p", F.explode(places)).select(F.xxhash64("key", "p.kind", "p.x", "p.y").alias("place"), F.col("row").alias("id"), "root", "p.side", "band"))
    columns = ["place", F.col("id").alias("row"), "root", "side", "band", "signature", "bands"]
    first = _beside(dealt, signed.select("row", "signature", "bands"), "id", 56 * dealt.count()).select(*columns)
    kinds = "place long, row long, root long, side int, band int, signature binary, bands array<bigint>"
    near = cut(first.repartition("place").sortWithinPartitions("place").mapInArrow(_compare, kinds)).withColumnRenamed("row", "id")
    again = _beside(near, bag_rows, "id", (100 + 2 * PLACES + 8 * BANDS) * near.count()).select("place", F.col("id").alias("row"), "root", "side", "band", "signature", "bands", "bag")
    found = cut(again.repartition("place").sortWithinPartitions("place").mapInArrow(partial(_confirm, least=least), "a long, b long"))
    forget(dealt)
    return found


def similar_links(signed: DataFrame, bag_rows: DataFrame, members: DataFrame, least: float = SIMILAR, rounds: int = ROUNDS) -> DataFrame | None:
    """(id, root) over all verified links among members (row, band, key) of shared buckets; None without links.

    In each round every member of a bucket meets one centre, chosen anew, unless a path links them
    already. What stays unlinked in a bucket after that is compared pair by pair.
    """
    links = roots = None
    limit = hot_limit(members.count())
    for r in range(rounds + 1):
        rooted = members.withColumn("root", F.col("row")) if roots is None else cut(members.join(roots, members["row"] == roots["id"], "left").withColumn("root", F.coalesce("root", "row")).drop("id"))
        turn = F.col("row") if r == 0 else F.xxhash64("row", F.lit(r))
        buckets = rooted.groupBy("key").agg(
            F.min_by(F.struct("row", "root"), turn).alias("centre"), F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")
        ).where("lo <> hi")
        buckets = buckets.select("key", "n", F.col("centre.row").alias("centre"), F.col("centre.root").alias("main_root"))
        open_ = cut(join_groups(rooted, buckets, "key", "n", limit).where("n is not null"))
        if open_.isEmpty():
            break
        members = open_.select("row", "band", "key")
        if r < rounds:
            pairs = open_.where("root <> main_root").select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
            found = _verified(pairs, bag_rows, least, limit)
        else:
            others = open_.groupBy("key", F.col("n").alias("__n")).agg(F.count_if(F.col("root") != F.col("main_root")).alias("others"))
            found = _open_links(join_groups(open_, others, "key", "__n", limit), signed, bag_rows, least)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = cut(components(cut(links)))
            links = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b")
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, and its place (__file, __at).

    A class is linked by pairs whose bags of five-word shingles (words with A-Z lower-cased; a text of
    one to four words is one shingle) have a weighted Jaccard similarity of `least` or more, over
    any path. Its largest doc_id, null being the smallest, stays and names the class. Texts without words, null
    ones too, form a class. Repeated rows and other columns are fine; an empty table gives no rows.

    Texts of the same words are one text from the start. Texts of documents that share a bucket are read a second time.
    Texts of any length are taken whole. Of rows with the same largest id, the last by the numbers given here stays.
    """
    whole = placed(docs)
    text = F.coalesce(F.col(place_name(docs, text_col)), F.lit("")).alias("text")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = whole.select(*PLACE, F.col(place_name(docs, id_col)).alias("id"), text)
    signed = cut(with_row_id(texts.mapInArrow(_sign, f"__file long, __at long, id {kind}, words binary, signature binary, bands array<bigint>"), "row"))
    limit = hot_limit(signed.count())
    same = cut(signed.groupBy("words").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = cut(signed.select("row", "bands").join(same.select("rep"), F.col("row") == F.col("rep"), "left_semi"))
    banded = reps.select("row", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(join_groups(banded, shared, "key", "n", limit).where("n is not null").select("row", "band", "key"))
    needed = cut(signed.select("row", *PLACE).join(members.select("row").distinct(), "row", "left_semi"))
    few = 48 * needed.count() <= MAX_BROADCAST
    bag_rows = cut(texts.join(F.broadcast(needed) if few else needed, PLACE).select("row", "text").mapInArrow(_bag_of, "row long, bag binary"))
    roots = similar_links(signed, bag_rows, members, least)
    classes = same.withColumn("root", F.col("rep")) if roots is None else same.join(roots, same["rep"] == roots["id"], "left").withColumn("root", F.coalesce("root", "rep")).drop("id")
    rooted = cut(join_groups(signed.select("row", "id", "words", *PLACE), classes.select("words", "copies", "root"), "words", "copies", limit).select("row", "id", "root", *PLACE))
    forget(signed, same, reps, members, needed, bag_rows)
    groups = rooted.groupBy("root").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    joined = join_groups(rooted, groups, "root", "class_size", limit)
    return joined.select(F.col("id").alias("doc_id"), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), *PLACE)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns."""
    whole = placed(docs)
    lost = cut(near_duplicates(whole, place_name(docs, id_col), place_name(docs, text_col), least).where("not kept").select(*PLACE))
    few = 48 * lost.count() <= MAX_BROADCAST
    return unplaced(whole.join(F.broadcast(lost) if few else lost, PLACE, "left_anti"), docs.columns)
