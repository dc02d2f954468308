"""Benchmark metrics, reports, regression gate and ablation statistics."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions import fixed as X
from ..functions import text as T
from .invariants import dice, multiset_diff, verify_pairs
from .lint import style_rates
from .places import running


def case_faults(cases: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """case_id, fault: rules of the case contract that a case breaks."""
    m = F.col("meta")
    in_ = lambda c, vs: F.coalesce(c.isin(*vs), F.lit(False))
    rules = [
        (F.coalesce(m["field"], F.lit("")) == "", "field"),
        (~in_(m["origin"], X.ORIGINS), "origin"),
        (~in_(m["review"], X.REVIEWS), "review"),
        (m["no_edit"].isNull(), "no_edit"),
        (F.coalesce(m["no_edit"], F.lit(False)) & (F.size("edits") > 0), "control with edits"),
        (F.coalesce(m["no_edit"], F.lit(False)) & (F.col("input") != F.col("gold")), "control with changes"),
        ((m["review"] == "approved") & ~in_(m["error_class"], X.EDIT_CLASSES), "class"),
        ((m["review"] == "approved") & ~in_(m["severity"], (*X.SEVERITY_WEIGHTS, "na")), "severity"),
        (F.exists("edits", lambda e: (e["start"] < 0) | (e["end"] < e["start"])), "span"),
        (F.exists("edits", lambda e: F.size(e["accept"]) == 0), "accept"),
    ]
    own = cases.select("case_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("fault"))
    if taxonomy is None:
        return own
    used = cases.select("case_id", F.explode("edits.class").alias("class")).where("class is not null")
    return own.unionByName(used.join(taxonomy.select("class"), "class", "left_anti").select("case_id", F.lit("unknown class").alias("fault")))


def unmatched(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, problem: candidates of no case (an error) and cases without a candidate (skipped)."""
    stray = candidates.join(cases, "case_id", "left_anti").select("case_id", F.lit("unknown candidate").alias("problem"))
    return stray.unionByName(cases.join(candidates, "case_id", "left_anti").select("case_id", F.lit("skipped").alias("problem")))


def scores(cases: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """case_id, field, error_class, severity, no_edit, source_doc_id, score, weight, eap, changed, source_tokens: each case
    aligned once with its candidate and its gold text. Without candidates the gold texts are scored.

    score: the share of the edits' severity weights that the candidate makes (its aligned tokens are accepted), 0 for all if it
    loses any invariant of the input, 1 without edits. eap: the share of the gold changes that it makes, by size; 1 without any.
    """
    pairs = cases.withColumn("text", F.col("gold")) if candidates is None else cases.join(candidates.select("case_id", "text"), "case_id")
    pairs = pairs.repartition("case_id")  # cases of one frequent text are together otherwise
    diff = multiset_diff(pairs.select("case_id", F.col("input").alias("original"), F.col("text").alias("corrected")), "case_id")
    lost = diff.where("missing > 0").select("case_id", F.lit(True).alias("_lost")).distinct()
    made = pairs.withColumn("_c", align.paired_with_gold("input", "text", "gold")).join(lost, "case_id", "left")
    weight = lambda e: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in X.SEVERITY_WEIGHTS.items() for x in kv]), e["severity"]), F.lit(0.0))
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda n, x: n + f(x))
    edits = F.coalesce("edits", F.array().cast(cases.schema["edits"].dataType))
    hit = lambda e: F.array_contains(e["accept"], align.aligned_tokens(F.col("_c"), e["start"], e["end"]))
    all_ = total(edits, weight)
    done = F.when(F.coalesce("_lost", F.lit(False)), F.lit(0.0)).otherwise(total(F.filter(edits, hit), weight))
    eap = F.when(F.col("_c.gold_all") > 0, F.col("_c.gold_made") / F.col("_c.gold_all")).otherwise(F.lit(1.0))
    score = F.when(all_ > 0, done / all_).otherwise(F.lit(1.0))
    return made.select("case_id", "meta.field", "meta.error_class", "meta.severity", "meta.no_edit", "meta.source_doc_id", score.alias("score"), all_.alias("weight"), eap.alias("eap"), align.changed_tokens(F.col("_c")).alias("changed"), F.size("_c.source").alias("source_tokens"))


def preservation(cases: DataFrame, candidates: DataFrame, names: list[str] = ()) -> DataFrame:
    """case_id, dice (mean over the kinds of invariants that either side has; 1 without any), strict (all multisets equal),
    protected_names (each name as often in the candidate as in the input)."""
    pairs = cases.select("case_id", F.col("input").alias("original")).join(candidates.select("case_id", F.col("text").alias("corrected")), "case_id")
    kinds = dice(multiset_diff(pairs, "case_id"), "case_id", "kind").groupBy("case_id").agg(F.avg("dice").alias("dice"), F.bool_and("strict").alias("strict"))
    kept = F.lit(True)
    for n in names:
        kept = kept & (T.occurrences(F.col("original"), F.lit(n)) == T.occurrences(F.col("corrected"), F.lit(n)))
    return pairs.select("case_id", kept.alias("protected_names")).join(kinds, "case_id", "left").select("case_id", F.coalesce("dice", F.lit(1.0)).alias("dice"), F.coalesce("strict", F.lit(True)).alias("strict"), "protected_names")


def report(scored: DataFrame) -> DataFrame:
    """One row: swcr (1.0 without weight), fpr0 and changed tokens per 1000 over controls (0.0 without), eap, cases."""
    control = F.coalesce("no_edit", F.lit(False))
    return scored.agg(
        F.coalesce(F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0)).alias("swcr"),
        F.coalesce(F.avg(F.when(control, (F.col("changed") > 0).cast("double"))), F.lit(0.0)).alias("fpr0"),
        F.coalesce(F.sum(F.when(control, F.col("changed"))) * 1000.0 / F.nullif(F.sum(F.when(control, F.col("source_tokens"))), F.lit(0)), F.lit(0.0)).alias("changed_per_1000"),
        F.avg("eap").alias("eap"), F.count("*").alias("cases"),
    )


def grouped(scored: DataFrame, value: str, sets: list[list[str]]) -> DataFrame:
    """Means of value over several groupings in one scan (grouping sets); columns outside a grouping are null."""
    cols = sorted({c for s in sets for c in s})
    return scored.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def regression(now: DataFrame, base: DataFrame, swcr: float = 0.005, fpr0: float = 0.01) -> DataFrame:
    """regressed of two one-row reports; different case sets (fingerprint) can't be compared and raise."""
    both = now.crossJoin(base.select(F.col("swcr").alias("b_swcr"), F.col("fpr0").alias("b_fpr0"), F.col("fingerprint").alias("b_fp")))
    worse = (F.col("swcr") < F.col("b_swcr") - swcr) | (F.col("fpr0") > F.col("b_fpr0") + fpr0)
    return both.select(F.when(F.col("fingerprint") != F.col("b_fp"), F.raise_error(F.lit("case sets differ")).cast("boolean")).otherwise(worse).alias("regressed"))


def fingerprint(cases: DataFrame, name: str = "case_id") -> DataFrame:
    return cases.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.col(name).cast("string")))), 256).alias("fingerprint"), F.count("*").alias("cases"))


def paired(on: DataFrame, off: DataFrame) -> DataFrame:
    """case_id, source_doc_id, on, off, difference; cases that only one arm has raise."""
    both = on.select("case_id", "source_doc_id", F.col("score").alias("on")).join(off.select("case_id", F.col("score").alias("off")), "case_id", "full_outer")
    checked = F.when(F.col("on").isNull() | F.col("off").isNull(), F.raise_error(F.lit("arms differ")).cast("double")).otherwise(F.col("on") - F.col("off"))
    return both.withColumn("difference", checked)


def summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("on").alias("mean_on"), F.avg("off").alias("mean_off"), F.avg("difference").alias("mean_difference"), F.coalesce(F.stddev_samp("difference"), F.lit(0.0)).alias("sd_difference"), F.count("*").alias("n"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, value: sorted[floor((n - 1) * share)] of each key, from counts of equal values and running sums of these over ranges of
    values: no key is one task's and no values are gathered. Null values don't count."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running(counts, keys, value, "_upto", weight="_n", keys_of=values)
    wanted = counts.groupBy(*keys).agg(F.floor((F.sum("_n") - 1) * F.lit(share)).alias("_at"))
    named = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_at")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], (F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
    return upto.join(named, same).select(*keys, F.col(value).alias("value"))


def bootstrap_interval(pairs: DataFrame, replicates: int = X.BOOTSTRAP_REPLICATES, seed: int = X.BOOTSTRAP_SEED) -> DataFrame:
    """low, high: 95 % interval of the mean difference over resampled clusters (source documents). The generator's sequence
    is part of the definition, so the replicates run in one task; it gets a row (sum, number) per cluster."""
    sums = pairs.groupBy("source_doc_id").agg(F.sum("difference").alias("s"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["source_doc_id", "s", "n"])]).sort_values("source_doc_id")
        groups, rng, values = list(zip(rows["s"], rows["n"], strict=True)), random.Random(seed), []
        for _ in range(replicates if groups else 0):
            drawn = [groups[rng.randrange(len(groups))] for _ in groups]
            values.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
        values.sort()
        at = lambda p: values[int((len(values) - 1) * p)]
        yield pd.DataFrame({"low": [at(0.025)], "high": [at(0.975)]} if values else {"low": [], "high": []})

    return sums.coalesce(1).mapInPandas(run, "low double, high double")


def mde_table(frame: DataFrame, sd: float) -> DataFrame:
    """n, mde = 2.802 * sd / sqrt(n) of (n)."""
    return frame.select("n", (F.lit(2.802) * sd / F.sqrt("n")).alias("mde"))


def taxonomy_ids(taxonomy: DataFrame) -> DataFrame:
    """id of a taxonomy; empty, blank and repeated ids raise. A taxonomy is a short list."""
    facts = taxonomy.agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim("id"), F.lit(""))).alias("ids")).first()
    if not facts.n or facts.n != facts.ids:
        raise ValueError("taxonomy must have ids, each once")
    return taxonomy.select("id")


def may_be_baseline(cases: DataFrame) -> DataFrame:
    """allowed: whether any case is approved; without one no baseline is written."""
    return cases.agg(F.coalesce(F.bool_or(F.col("meta.review") == "approved"), F.lit(False)).alias("allowed"))


def golden(triples: DataFrame, tells: list[str]) -> DataFrame:
    """case_id, passes, fails, regressed, status of (case_id, input, expected, failure): the expected text must pass the gate and not raise
    the style rates, the failure must not pass. A missing text fails its case."""
    pair = lambda c: triples.where(F.col("input").isNotNull() & F.col(c).isNotNull()).select(F.col("case_id").alias("pair_id"), F.col("input").alias("original"), F.col(c).alias("corrected"))
    gate = lambda c, name: verify_pairs(pair(c)).select(F.col("pair_id").alias("case_id"), (F.col("verdict") != "FAIL").alias(name))
    rates = style_rates(pair("expected"), tells).select(F.col("pair_id").alias("case_id"), "regressed")
    both = triples.select("case_id").join(gate("expected", "passes"), "case_id", "left").join(gate("failure", "_slips"), "case_id", "left").join(rates, "case_id", "left")
    out = both.select("case_id", F.coalesce("passes", F.lit(False)).alias("passes"), F.coalesce(~F.col("_slips"), F.lit(False)).alias("fails"), F.coalesce("regressed", F.lit(True)).alias("regressed"))
    return out.withColumn("status", F.when(F.col("passes") & F.col("fails") & ~F.col("regressed"), "OK").otherwise("FAIL"))
