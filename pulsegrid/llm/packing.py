"""Best-fit packing under conflicts: bins in order of room, with bitmaps of sources and of duplicate clusters."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, with_row_id

CAPACITY = 2_048
#: So many pieces of one source may share a bin; two of one duplicate cluster never do.
PER_SOURCE = 4
PIECES_PER_SHARD = 16_384


#: A source with more than this share of a shard's pieces has a list of its own of the bins that still take it.
HOT_SOURCE = 1 / 8


class _Rooms:
    """Bins by the room they have left; a bitmap of the rooms that have bins gives the successor of a length in one step."""

    def __init__(self, capacity: int):
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.some = 0

    def add(self, b: int, room: int) -> None:
        self.at[room][b] = None
        self.some |= 1 << room

    def drop(self, b: int, room: int) -> None:
        self.at[room].pop(b, None)
        if not self.at[room]:
            self.some &= ~(1 << room)

    def upwards(self, length: int):
        """Bins with room for a length, the tightest first."""
        room = length
        while rest := self.some >> room:
            room += (rest & -rest).bit_length() - 1
            yield from self.at[room]
            room += 1


class Bins:
    """Open bins. Each carries a bitmap of its clusters, and one of sources for each level: the n-th level has the sources
    of which it holds n pieces or more. hot: bits of sources that have lists of their own, so that bins which are full of
    such a source aren't tried again and again.
    """

    def __init__(self, capacity: int, per_source: int, hot: tuple[int, ...] = ()):
        self.capacity, self.per_source = capacity, per_source
        self.rooms = {bit: _Rooms(capacity) for bit in (0, *hot)}
        self.room, self.clusters, self.sources = [], [], []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece, in the tightest compatible bin. source and cluster are bits, 0 for none."""
        for b in self.rooms.get(source, self.rooms[0]).upwards(length):
            if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                return self._put(b, length, source, cluster)
        self.room.append(self.capacity)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        return self._put(len(self.room) - 1, length, source, cluster)

    def _put(self, b: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        room = self.room[b]
        self.room[b] = left = room - length
        self.clusters[b] |= cluster
        carry, levels = source, self.sources[b]
        for n in range(self.per_source):
            levels[n], carry = levels[n] | carry, levels[n] & carry
        for bit, rooms in self.rooms.items():
            rooms.drop(b, room)
            if left and not levels[-1] & bit:
                rooms.add(b, left)
        return b, self.capacity - room


def pack_shard(rows: pa.Table, capacity: int, per_source: int) -> pa.Table:
    """Adds bin and offset to pieces (row, piece, length, source, cluster, shard), the longest first, of equals the first row's."""
    length, cluster = np.asarray(rows.column("length")), rows.column("cluster").to_pylist()
    source = rows.column("source").to_pylist()
    copies = Counter(cluster)
    shared = {c: 1 << i for i, c in enumerate(x for x, n in copies.items() if n > 1 and x is not None)}
    bits = {s: 1 << i for i, s in enumerate(dict.fromkeys(source))}
    order = np.lexsort((np.asarray(rows.column("piece")), np.asarray(rows.column("row")), -length))
    often = [bits[x] for x, n in Counter(source).items() if n > HOT_SOURCE * len(source)]
    bins, at, offset = Bins(capacity, per_source, tuple(often)), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in order:
        at[i], offset[i] = bins.place(int(length[i]), bits[source[i]], shared.get(cluster[i], 0))
    keep = ["id", "piece", "start", "length", "shard"]
    return pa.table({c: rows.column(c) for c in keep} | {"bin": pa.array(at), "offset": pa.array(offset)})


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, offset; lengths and places are in words.

    A text longer than a bin is cut into pieces that fill one each, whose bin_id is negative, and a rest. A text without words, null
    too, is one piece of length 0 without a bin. Texts that are equal after lower-casing A-Z are a
    cluster unless a column says otherwise (null: in none); null is a source like any other. Rests are dealt by a hash of their
    row to shards of some PIECES_PER_SHARD, so no text, source or cluster makes a large one, and packed shard by shard, the
    longest first, of equals the first by number of row.
    Repeated rows and other columns are fine; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = cluster if cluster is not None else F.xxhash64(ascii_lower(text))
    kind = docs.schema[id_col].dataType.simpleString()
    sized = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), of.cast("string").alias("cluster"), F.regexp_count(text, F.lit(WORD)).alias("words")))
    last = F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity)).cast("int")
    pieces = cut(
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start", (F.col("piece") * capacity).cast("long"))
        .withColumn("length", F.least(F.lit(capacity), F.col("words") - F.col("start")).cast("long"))
        .select(F.col("__row").alias("row"), "id", "source", "cluster", "piece", "start", "length")
    )
    some = pieces.where((F.col("length") > 0) & (F.col("length") < capacity))
    shards = max(1, -(-some.count() // PIECES_PER_SHARD))
    dealt = some.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(lambda t: pack_shard(t, capacity, per_source), f"id {kind}, piece int, start long, length long, shard long, bin long, offset long")
    placed = packed.select("id", "piece", "start", "length", (F.col("shard") * (1 << 32) + F.col("bin")).alias("bin_id"), "offset")
    none = F.lit(None).cast("long")
    full = pieces.where(F.col("length") == capacity).select("id", "piece", "start", "length", (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    empty = pieces.where("length = 0").select("id", "piece", "start", "length", none.alias("bin_id"), none.alias("offset"))
    return placed.unionByName(full).unionByName(empty).withColumnRenamed("id", "doc_id")
