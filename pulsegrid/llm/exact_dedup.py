"""Exact dedup: two passes over Bloom filters find the hashes that may repeat; only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, ascii_lower, cut, hot_limit, join_groups, place_name, placed, unplaced, with_row_id

#: One filter block is a long of 15 counters of 4 bits; the low bit of each.
COUNTERS, LOW_BITS = 15, 0x111111111111111
#: More blocks than this aren't broadcast: 2 million rows of two longs, some 64 MB.
MAX_BROADCAST_BLOCKS = 2_000_000
#: Up to so many rows that go are named to all executors, 32 MB.
MAX_BROADCAST_LOST = 1_000_000


def _blocks(rows: int) -> int:
    n = 1024
    while n < 2 * rows:
        n *= 2
    return n


def _marked(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds the key's block and the low bits of the two counters that it adds to there."""
    bits = " | ".join(f"shiftleft(1L, cast(4 * pmod(shiftright(xxhash64({key}, 7), {by}), {COUNTERS}) as int))" for by in (0, 24))
    return rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("__mask", F.expr(bits))


def seen_twice(hashed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Pass 1, as a stored table of blocks: which of their counters at least two rows added to.

    It is a blocked counting Bloom filter, summed map-side first. Sums of up to 15 rows can't run
    over; a block with more rows has all bits set. So no repeated key is ever missed.
    """
    counted = _marked(hashed, key, blocks).groupBy("__block").agg(F.try_sum("__mask").alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1")
    reached = f"case when c > 15 or s is null then {LOW_BITS}L else (shiftright(s, 1) | shiftright(s, 2) | shiftright(s, 3)) & {LOW_BITS}L end"
    return cut(counted.select("__block", F.expr(reached).alias("__bits")).where("__bits != 0"))


def may_repeat(rows: DataFrame, key: str, twice: DataFrame, blocks: int, max_broadcast: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """Pass 2 adds `__again`: true for every row whose key another row has, and for a few others."""
    probed = _marked(rows, key, blocks).join(F.broadcast(twice) if twice.count() <= max_broadcast else twice, "__block", "left")
    again = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return probed.withColumn("__again", again).drop("__block", "__mask", "__bits")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Equal are texts that are identical after lower-casing A-Z; a null text counts as empty, so
    empty and null texts form one group. The largest id of a group stays; a null id counts as
    the smallest. Of rows repeated with the same id, one stays. Texts of any length are hashed whole; other columns
    are ignored, an empty table gives no rows.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    hashed = cut(with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))))
    rows = hashed.count()
    blocks = _blocks(rows)
    probed = may_repeat(hashed, "text_sha256", seen_twice(hashed, "text_sha256", blocks), blocks, max_broadcast)
    again = cut(probed.where("__again").drop("__again"))
    groups = (
        again.groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "__row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.__row").alias("__best"))
    )
    joined = join_groups(again, groups, "text_sha256", "group_size", hot_limit(rows))
    alone = F.col("group_size").isNull()
    of_groups = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__best"))).alias("kept"),
        "text_sha256",
    )
    straight = probed.where("not __again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return straight.unionByName(of_groups)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """The rows that stay, with all their columns, under the rules of find_copies.

    Hashes and places of rows are stored; which rows go is found among the possible repeats of those alone. So texts are
    only read, unless more rows go than can be named to all executors.
    """
    whole = placed(docs)
    text = ascii_lower(F.coalesce(F.col(place_name(docs, text_col)), F.lit("")))
    slim = cut(with_row_id(whole.select(*PLACE, F.col(place_name(docs, id_col)).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))))
    rows = slim.count()
    blocks = _blocks(rows)
    again = cut(may_repeat(slim, "sha", seen_twice(slim, "sha", blocks), blocks, max_broadcast).where("__again").drop("__again"))
    best = again.groupBy("sha").agg(F.max(F.struct("id", "__row")).getField("__row").alias("best"), F.count(F.lit(1)).alias("n"))
    lost = cut(join_groups(again, best.where("n > 1"), "sha", "n", hot_limit(rows)).where("__row <> best").select(*PLACE))
    few = lost.count() <= MAX_BROADCAST_LOST
    return unplaced(whole.join(F.broadcast(lost) if few else lost, PLACE, "left_anti"), docs.columns)
