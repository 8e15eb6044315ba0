"""DuckDB SQL for the queries that SQL can express, on the same Parquet tables."""

from __future__ import annotations

from .mixing import BLOCK_TOKENS, DOCS_PER_SHARD, MAX_REPEATS, SEED, SHARE, STEP, WEIGHTS
from .secrets import BASE, RULES

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secrets() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        select doc_id, {rank} as rank, '{r.kind}' as kind, i, len(gaps[i]) as gap, len(held[i]) as held, len(judged[i]) >= {r.least} as counts
        from (select doc_id, held, judged, gaps, unnest(range(1, len(held) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{p}', 0) as held, regexp_extract_all(t, '{p}', {r.group}) as judged, regexp_split_to_array(t, '{p}') as gaps
            from (select doc_id, coalesce(text, '') as t from documents) where regexp_matches(t, '{p}')))""")
    counts = ", ".join(f"coalesce(count(*) filter (kind = '{r.kind}'), 0) as n_{r.kind}" for r in BASE)
    return f"""
    with found as ({' union all '.join(parts)}),
    placed as (
        select *, cast(sum(gap + held) over (partition by doc_id, kind order by i rows unbounded preceding) as bigint) as stop from found),
    kept as (select *, stop - held as start from placed where counts),
    listed as (
        select doc_id, {counts},
            string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(BASE)}) as base,
            string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
        from kept group by doc_id)
    select d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in BASE)},
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join listed l using (doc_id)"""


def _seats(frm: str, votes: str, seats: str, tie: str, within: str, keys: str) -> str:
    """Sainte-Lague over the rows of frm, quotient by quotient."""
    part = f"partition by {within}" if within else ""
    return f"""
        select {keys}, count(*) filter (place <= {seats}) as won from (
            select *, row_number() over ({part} order by {votes} / (2 * j - 1) desc, {tie}) as place from (
                select *, unnest(range(1, cast(round({votes} / unit) as bigint) + 3)) as j from (
                    select *, sum({votes}) over ({part}) / greatest({seats}, 1) as unit from {frm})))
        group by {keys}"""


def _mixing() -> str:
    weight = f"[{', '.join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1]"
    return f"""
    with sizes as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) as bigint) as size from documents),
    by_source as (select source, cast(sum(size) as bigint) as source_size, count(*) as docs from sizes group by source),
    ranked as (select *, {weight} as weight from (select *, row_number() over (order by source is null, source) as rank from by_source)),
    leveled as (
        select *, {MAX_REPEATS} * source_size / weight as fills,
            ({SHARE} * (select sum(source_size) from by_source)
                - coalesce(sum({MAX_REPEATS} * source_size) over (order by {MAX_REPEATS} * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by {MAX_REPEATS} * source_size / weight, rank rows between current row and unbounded following) as level
        from ranked),
    targets as (
        select *, least({MAX_REPEATS} * source_size, weight * (select arg_min(level, (fills, rank)) from leveled where level <= fills)) as target from leveled),
    asked as (select *, cast(round((select sum(target) from targets) / {BLOCK_TOKENS}) as bigint) as k, cast(ceil(docs / {DOCS_PER_SHARD}) as bigint) as shards from targets),
    blocks as ({_seats('asked', 'target', 'k', 'rank', '', 'rank')}),
    dealt as (
        select s.doc_id, s.size, a.source_size, a.target, a.rank, b.won as blocks, hash, cast('0x' || substr(hash, 1, 8) as bigint) % a.shards as shard
        from (select *, md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as hash from sizes) s
        join asked a on s.source is not distinct from a.source join blocks b on a.rank = b.rank),
    laid as (select *, cast(sum(size) over (partition by rank, shard order by hash, doc_id rows unbounded preceding) as bigint) as stop from dealt),
    shard_words as (select rank, shard, blocks, cast(sum(size) as bigint) as words from laid group by all),
    won as ({_seats('shard_words', 'words', 'blocks', 'shard', 'rank', 'rank, shard, words')}),
    quotas as (
        select *, least(won, {MAX_REPEATS} * cuts) as seats, cast('0x' || substr(md5('{SEED}:' || rank || ':' || shard), 1, 7) as bigint) as begin_at
        from (select *, cast(greatest(1, round(words / {BLOCK_TOKENS})) as bigint) as cuts from won) where words > 0),
    spread as (
        select doc_id, stop - size as start, stop, words, cuts, seats, begin_at,
            unnest(range(((stop - size + 1) * cuts - 1) // words, (stop * cuts - 1) // words + 1)) as b
        from laid join quotas using (rank, shard) where size > 0),
    taken as (
        select doc_id, cast(sum((least((b + 1) * words // cuts, stop) - greatest(b * words // cuts, start))
            * (seats // cuts + case when ({STEP} * b + begin_at) % cuts < seats % cuts then 1 else 0 end)) as bigint) as taken
        from spread group by doc_id)
    select d.doc_id, d.size, d.source_size, cast(d.target as double) as target, coalesce(t.taken, 0) as taken
    from dealt d left join taken t using (doc_id)"""


SQL = {
    "op1_secret_scans": _secrets(),
    "op3_exact_topk": """
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) as bigint) as score
        from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id and len(q.e) = len(d.e))
    select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
    where rank <= 10""",
    "op4_mixing": _mixing(),
    "op10_exact_dedup": f"""
    select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
        doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
    from (select doc_id, sha256({LOWERED}) as h from documents)""",
}
