"""Secret scans over a ledger of blobs: each version of a text is scanned once by each rule version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_limit, join_groups, shared_dir, with_row_id


@dataclass(frozen=True)
class Rule:
    """A match counts if its given group has at least `least` code points. hint: text that any match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str = ""


# Patterns and least lengths of the base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", hint="eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", hint="AIza"),
)
RULES = BASE + MORE


def _matches(text: Column, rule: Rule, at: int) -> Column:
    """All leftmost non-overlapping matches, short ones too: (kind, i, code points before and in it, whether it counts)."""
    pattern = F.lit(rule.pattern)
    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    judged = held if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    found = F.transform(
        F.arrays_zip(held.alias("held"), judged.alias("judged"), F.slice(gaps, 1, F.greatest(F.lit(0), F.size(gaps) - 1)).alias("gap")),
        lambda m, i: F.struct(F.lit(at).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["held"].alias("held"), (m["judged"] >= rule.least).alias("counts")),
    )
    may = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.hint)) & may if rule.hint else may, found).otherwise(F.array().cast(NO_MATCH))


NO_MATCH = "array<struct<kind:int,i:int,gap:int,held:int,counts:boolean>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, seen: str | None = None) -> DataFrame:
    """(sha, spans) of every blob (sha, text), by the rules that its array `seen` doesn't name.

    spans: (start, kind as the rule's place, end) in code points, end exclusive, by start, then kind.
    """
    none = F.array().cast(NO_MATCH)
    due = lambda r: F.lit(True) if seen is None else ~F.array_contains(F.coalesce(seen, F.array().cast("array<string>")), f"{r.kind}@{r.version}")
    found = F.concat(*[F.when(due(r), _matches(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)])
    each = blobs.select("sha", F.explode_outer(found).alias("m")).select("sha", "m.*")
    end = F.sum(F.col("gap").cast("long") + F.col("held")).over(Window.partitionBy("sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("held")).alias("start"), "kind", "end"))
    return each.withColumn("end", end).groupBy("sha").agg(F.sort_array(F.collect_list(span)).alias("spans"))


class BlobLedger:
    """A folder of scanned blobs: (sha, copies, rules scanned as kind@version, spans by kind name), a part per run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.parquet(self.path) if there else None

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scans the blobs of docs by the rules that haven't seen them, and appends what that gives.

        Equal texts become one blob, within each task before the shuffle already, so that a hot
        blob's copies never meet in one task. Blobs without findings are recorded as well.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text")).groupBy("sha").agg(F.any_value("text").alias("text"))
        before, names, seen = self.read(), [f"{r.kind}@{r.version}" for r in rules], None
        if before is not None:
            known = before.groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            blobs, seen = blobs.join(known, "sha", "left").where(F.expr(f"seen is null or not ({' and '.join(f'array_contains(seen, {n!r})' for n in names)})")), "seen"
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        found = scan_blobs(blobs, rules, seen).withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["kind"] + 1).alias("kind"), s["end"].alias("end"))))
        found.withColumn("rules", F.array(*map(F.lit, names))).write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, spans, __row) for every path of docs: the blob's spans by these rule versions, by start and rule order."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        paths = cut(with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"))))
        copies = paths.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
        order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
        names = [f"{r.kind}@{r.version}" for r in rules]
        spans = (
            self.read().where(F.size("spans") > 0).select("sha", F.explode("spans").alias("s"), "rules").select("sha", "s.*", "rules")
            .where(F.expr(f"exists(rules, r -> r in ({', '.join(map(repr, names))}) and substring_index(r, '@', 1) = kind)"))
            .select("sha", F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end").alias("s"))
            .groupBy("sha").agg(F.array_distinct(F.sort_array(F.collect_list("s"))).alias("spans"))
        )
        groups = spans.join(copies, "sha")
        return join_groups(paths, groups, "sha", "copies", hot_limit(paths.count())).select("doc_id", "spans", "__row")


def find_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a count for each base kind, base_sha256 and spans.

    Null and empty texts have no findings, null ids and repeated rows are kept, other columns
    ignored; an empty table gives no rows. Without a ledger a new one is begun in the shared folder.
    """
    ledger = ledger or BlobLedger(docs.sparkSession, shared_dir(docs.sparkSession))
    ledger.update(docs, rules, text_col)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    found = ledger.findings(docs, rules, id_col, text_col).withColumn("all", spans)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("all").alias("spans"))
