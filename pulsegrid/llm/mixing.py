"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, WORD, cut, place_name, placed, unplaced

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEATS = 1.5, 2
BLOCK_TOKENS, DOCS_PER_SHARD, SEED = 128, 4_000, "mix-1"
#: Up to so many sources their table is broadcast.
MAX_BROADCAST_SOURCES = 65_536
#: A prime above the number of blocks in any shard: b -> STEP * b + c runs through all blocks of a shard.
STEP = 2_147_483_647


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, docs, rank, target): sources by code point, null last, weights repeating.

    The share of all words is dealt by weight; a target stops at `most` times its source's size
    and the excess is dealt anew. With sources in the order of the level at which they fill up,
    that ends at the first level not above the next source's own. The windows run over sources,
    not documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = by_source.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    full = (most * F.col("source_size")).cast("long")
    up = Window.orderBy("fills", "rank")
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("fills", full / F.col("weight")).withColumn("level", level)
    final = F.min_by(F.when(F.col("level") <= F.col("fills"), F.col("level")), F.when(F.col("level") <= F.col("fills"), F.struct("fills", "rank"))).over(everything)
    target = F.least(full.cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))
    return leveled.select("source", "source_size", "docs", "rank", target.alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, tie: str, within: list[str], name: str = "seats") -> DataFrame:
    """Sainte-Lague: adds how many of the group's `seats` each party gets by the highest quotients.

    A divisor that surely gives too few seats, and one that gives too many, leave at most about
    two open quotients a party; only those are ranked, ties going to the smaller `tie`.
    """
    group = Window.partitionBy(*(within or [F.lit(1)]))
    v, k = F.col(votes).cast("double"), F.col(seats)
    summed = parties.withColumn("__v", F.sum(v).over(group)).withColumn("__n", F.count(F.lit(1)).over(group) / 2)
    sure = F.when((F.col("__v") > 0) & (k > F.col("__n")), F.floor(v * (k - F.col("__n")) / F.col("__v") + 0.5)).otherwise(0).cast("long")
    most = F.when(F.col("__v") > 0, F.floor(v * (k + F.col("__n")) / F.col("__v") + 0.5) + 1).otherwise(0).cast("long")
    open_ = summed.withColumn("__sure", sure).withColumn("__most", most).withColumn("__open", k - F.sum("__sure").over(group))
    quotients = open_.withColumn("__j", F.explode_outer(F.when(F.col("__most") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__most")))))
    place = F.row_number().over(Window.partitionBy(*(within or [F.lit(1)])).orderBy(F.desc_nulls_last(v / (2 * F.col("__j") - 1)), tie))
    won = quotients.withColumn("__won", ((place <= F.col("__open")) & F.col("__j").isNotNull()).cast("long"))
    keys = [c for c in parties.columns]
    return won.groupBy(*keys, "__sure").agg(F.sum("__won").alias("__won")).withColumn(name, F.col("__sure") + F.col("__won")).drop("__sure", "__won")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and where its words lie.

    Words are runs of non-space; a null or empty text has none and is taken 0 times. Each source's
    documents are dealt to shards of about docs_per_shard by a seeded hash, so a hot source has many;
    within a shard they lie end to end in hash order (ties by id, then by place), cut into blocks of
    about block_tokens equal to within a word. Sainte-Lague deals the target's blocks to sources,
    and each source's to its shards; a seeded walk over a shard's blocks takes that many, each at
    most twice. Null ids, repeated rows and an empty table are fine; other columns are ignored.
    """
    name = lambda c: F.col(place_name(docs, c))
    size = F.regexp_count(F.coalesce(name(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = cut(placed(docs).select(*PLACE, name(id_col).alias("doc_id"), name(source_col).alias("source"), size.alias("size")))
    sources = source_targets(sizes).withColumn("__k", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_tokens).cast("long"))
    sources = cut(apportion(sources, "target", "__k", "rank", [], "blocks").drop("__k").withColumn("shards", F.ceil(F.col("docs") / docs_per_shard)))
    few = sources.count() <= MAX_BROADCAST_SOURCES
    dealt = (
        sizes.join((F.broadcast(sources) if few else sources).withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("shard", F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.col("shards")))
    )
    shard = Window.partitionBy("rank", "shard")
    laid = dealt.withColumn("end", F.sum("size").over(shard.orderBy("hash", "doc_id", *PLACE).rowsBetween(Window.unboundedPreceding, 0)))
    laid = cut(laid.select("doc_id", *PLACE, "size", "source_size", "target", "rank", "shard", "blocks", "end"))
    shards = laid.groupBy("rank", "shard", "blocks").agg(F.sum("size").alias("words"))
    won = apportion(shards, "words", "blocks", "shard", ["rank"], "seats").where("words > 0")
    quotas = won.withColumn("cuts", F.greatest(F.lit(1), F.round(F.col("words") / block_tokens)).cast("long")).withColumn("seats", F.least("seats", MAX_REPEATS * F.col("cuts")))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rank", "shard")), 1, 7), 16, 10).cast("long")
    quotas = quotas.select("rank", "shard", "words", "cuts", F.expr("seats div cuts").alias("whole"), F.expr("seats % cuts").alias("more"), start.alias("start"))
    dealt_out = laid.join(quotas, ["rank", "shard"], "left").withColumn("begin", F.col("end") - F.col("size"))
    pieces = F.expr("""
        case when size > 0 and words > 0 then transform(
            sequence(((begin + 1) * cuts - 1) div words, (end * cuts - 1) div words),
            b -> struct(
                greatest(b * words div cuts, begin) - begin as at,
                least((b + 1) * words div cuts, end) - greatest(b * words div cuts, begin) as n,
                whole + if(pmod(STEP * b + start, cuts) < more, 1L, 0L) as times))
        end""".replace("STEP", f"{STEP}L"))
    taken = F.expr("coalesce(aggregate(pieces, 0L, (sum, p) -> sum + p.n * p.times), 0L)")
    return dealt_out.withColumn("pieces", pieces).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "pieces", *PLACE)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of docs.

    A document comes once with the words that are taken at least once, and once more with those
    taken twice; its text, of any length, is kept to the letter between the words that stay together.
    """
    whole = placed(docs)
    text = place_name(docs, text_col)
    plan = plan_mix(whole, place_name(docs, id_col), text, place_name(docs, source_col), **options).where("taken > 0").select("pieces", *PLACE)
    whole = whole.join(plan, PLACE)
    rounds = whole.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(MAX_REPEATS)))).where("exists(pieces, p -> p.times >= __round)")
    words = f"split({text}, '(?<=[\\\\x09-\\\\x0D\\\\x20])(?=[^\\\\x09-\\\\x0D\\\\x20])')"
    cut_out = f"""
        case when forall(pieces, p -> p.times >= __round) then {text}
        else array_join(transform(filter(pieces, p -> p.times >= __round),
            p -> array_join(slice(__words, cast(p.at + 1 + __lead as int), cast(p.n as int)), '')), '') end"""
    lead = f"if({text} rlike '^[\\\\x09-\\\\x0D\\\\x20]', 1, 0)"
    out = rounds.withColumn("__words", F.expr(words)).withColumn("__lead", F.expr(lead)).withColumn(text, F.expr(cut_out))
    return unplaced(out, docs.columns)
