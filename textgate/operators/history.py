"""Snapshots, histories and coverage scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X


def manifest_diff(current: DataFrame, saved: DataFrame, key: str = "rel_path", facts: tuple[str, ...] = ("mtime", "size", "sha1")) -> DataFrame:
    """key, change: arrived, removed or changed (any fact differs, null-safe)."""
    cols = lambda d, p: d.select(key, *[F.col(c).alias(p + c) for c in facts], F.lit(True).alias(p))
    both = cols(current, "n_").join(cols(saved, "o_"), key, "full_outer")
    same = F.lit(True)
    for c in facts:
        same = same & F.col("n_" + c).eqNullSafe(F.col("o_" + c))
    change = F.when(F.col("o_").isNull(), "arrived").when(F.col("n_").isNull(), "removed").when(~same, "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def latest(history: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return history.withColumn("_r", rank).where("_r = 1").drop("_r")


def keep_first(history: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return history.withColumn("_r", rank).where("_r = 1").drop("_r")


def term_overlap(now: Column, before: Column) -> Column:
    """Share of terms in common, of the longer list; null without an earlier list."""
    return F.when(before.isNotNull(), F.size(F.array_intersect(now, before)) / F.greatest(F.size(now), F.size(before), F.lit(1)))


def coverage_score(papers: Column, collocations: Column, sections: Column, words: Column, overlap: Column) -> Column:
    """0 to 100: capped linear shares of what full coverage has; an unknown overlap is neutral."""
    part = {"papers": papers, "collocations": collocations, "sections": sections, "words": words}
    score = F.coalesce(overlap, F.lit(X.NEUTRAL_OVERLAP)) * X.STABILITY_WEIGHT
    for name, (weight, full) in X.COVERAGE.items():
        score = score + F.least(part[name] / F.lit(full), F.lit(1.0)) * weight
    return score


def half_split(ranked: DataFrame, rank: str, name: str) -> DataFrame:
    """left, right: rank i beside rank i + half of a ranked list, half rounded up."""
    half = ranked.agg(F.ceil(F.max(rank) / 2).cast("bigint").alias("half"))
    left = ranked.crossJoin(F.broadcast(half)).where(F.col(rank) <= F.col("half"))  # one row
    return left.alias("l").join(ranked.alias("r"), F.col(f"r.{rank}") == F.col(f"l.{rank}") + F.col("l.half"), "left").select(F.col(f"l.{name}").alias("left"), F.col(f"r.{name}").alias("right"))
