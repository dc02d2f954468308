"""Edit journals: every changed region of a text must be covered by a journal entry of the closed contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align

ENTRY = "struct<kind: string, original: string, corrected: string, rule: struct<source: string, id: string>, reason: string>"
MOST_TOKENS, MOST_REASON = 40, 200


def entry_faults(entries: DataFrame) -> DataFrame:
    """pair_id, ord, fault of (pair_id, ord, entry, input, output): one row per broken rule."""
    e = F.col("entry")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = [
        (~F.coalesce(e["kind"], F.lit("")).isin("changed", "kept"), "kind"),
        (empty(e["original"]), "original missing"),
        (~empty(e["original"]) & ~F.contains("input", e["original"]), "original not in input"),
        (F.size(F.split(F.trim(F.coalesce(e["original"], F.lit(""))), r"\s+")) > MOST_TOKENS, "span too long"),
        ((e["kind"] == "changed") & empty(e["corrected"]), "corrected missing"),
        ((e["kind"] == "changed") & ~empty(e["corrected"]) & ~F.contains("output", e["corrected"]), "corrected not in output"),
        (empty(e["rule"]["source"]) | empty(e["rule"]["id"]), "rule"),
        (empty(e["reason"]) | (F.length(e["reason"]) > MOST_REASON), "reason"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return entries.select("pair_id", "ord", F.explode(found).alias("fault"))


def rule_faults(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """pair_id, ord, fault: rule ids that their source file (source, content) doesn't hold."""
    named = entries.select("pair_id", "ord", F.col("entry.rule.source").alias("source"), F.col("entry.rule.id").alias("id"))
    held = named.join(rules, "source", "left").where(F.col("content").isNull() | ~F.contains("content", "id"))
    return held.select("pair_id", "ord", F.lit("unknown rule").alias("fault"))


def uncovered(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pair_id, i1, i2, removed, added: changed regions outside the union of the changed entries' spans. A region of no
    width is covered at a span's end but not at its start. Pairs without any entry are not checked."""
    needles = entries.groupBy("pair_id").agg(F.sort_array(F.collect_set(F.when(F.col("entry.kind") == "changed", F.col("entry.original")))).alias("needles"))
    located = pairs.join(needles, "pair_id").select("pair_id", align.changed_regions("original", "corrected").alias("regions"), align.occurrence_spans("original", "needles").alias("spans"))
    inside = lambda r, s: (s["s"] <= r["i1"]) & (r["i2"] <= s["e"]) & (r["i2"] > s["s"])
    open_ = F.filter("regions", lambda r: ~F.exists("spans", lambda s: inside(r, s)))
    return located.select("pair_id", F.explode(open_).alias("r")).select("pair_id", "r.*")


def check_journal(pairs: DataFrame, entries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """pair_id, faults, uncovered, verdict; a pair with an empty journal passes."""
    both = entries.join(pairs.select("pair_id", F.col("original").alias("input"), F.col("corrected").alias("output")), "pair_id")
    faults = entry_faults(both)
    if rules is not None:
        faults = faults.unionByName(rule_faults(entries, rules))
    n = faults.groupBy("pair_id").agg(F.count("*").alias("faults"))
    u = uncovered(pairs, entries).groupBy("pair_id").agg(F.count("*").alias("uncovered"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = pairs.select("pair_id").join(n, "pair_id", "left").join(u, "pair_id", "left").select("pair_id", zero("faults"), zero("uncovered"))
    return out.withColumn("verdict", F.when((F.col("faults") == 0) & (F.col("uncovered") == 0), "PASS").otherwise("FAIL"))


def merge_spans(spans: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, s, e: unions of overlapping or touching spans of (key, s, e). Spans without a beginning belong to the key's last union."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_i", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    numbered = marked.withColumn("_i", F.sum("_i").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def kind_counts(entries: DataFrame) -> DataFrame:
    """kind, n: entries of each kind, other kinds together as `other`."""
    kind = F.when(F.col("entry.kind").isin("changed", "kept"), F.col("entry.kind")).otherwise("other")
    return entries.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def by_offset(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with offset (of the original span in the input, -1 if it isn't there) and place among the pair's entries of its kind."""
    from pyspark.sql.window import Window

    both = entries.join(pairs.select("pair_id", F.col("original").alias("_input")), "pair_id")
    placed = both.withColumn("offset", F.coalesce(F.instr("_input", F.col("entry.original")) - 1, F.lit(-1))).drop("_input")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "entry.kind").orderBy("offset", "ord")))
