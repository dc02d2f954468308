"""Coverage records of fields: one call from documents to the score, its parts and the field's leading terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from . import history, mining

#: Collocations that count: those used so often among the most frequent ones.
LEAST_USES, MOST_PHRASES = 5, 1000


def coverage(docs: DataFrame, previous: DataFrame | None = None, verbs: Iterable[str] = X.PHRASE_VERBS, stop: Iterable[str] = (), terms: int = 30, field: str = "source") -> DataFrame:
    """field, papers, words, collocations, sections, term_overlap, score, top_terms of each field that has any text.

    previous: (field, top_terms) of the run before; without it the overlap is null, which the score takes as neutral. Only lists of at most
    `terms` and a row per field and phrase or role meet after the shuffles.
    """
    stop = list(stop)
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    base = docs.groupBy(field).agg(F.count("*").alias("papers"), F.coalesce(F.sum(F.size(T.mining_words(F.col("text")))), F.lit(0)).alias("words"), F.bool_or(~blank).alias("_any")).where("_any").drop("_any")
    strong = mining.phrase_bank(docs, verbs, stop, MOST_PHRASES, field).where(F.col("cnt") >= LEAST_USES).groupBy(field).agg(F.count("*").alias("collocations"))
    roles = mining.section_metrics(docs, field).groupBy(field).agg(F.count("*").alias("sections"))
    top = mining.top_terms(docs, stop, terms, field).groupBy(field).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_top"))
    before = docs.sparkSession.createDataFrame([], f"{field} string, _before array<string>") if previous is None else previous.select(field, F.col("top_terms").alias("_before"))
    both = base.join(strong, field, "left").join(roles, field, "left").join(top, field, "left").join(before, field, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    own = F.coalesce("_top.term", F.array().cast("array<string>"))
    parts = both.select(field, "papers", "words", zero("collocations").alias("collocations"), zero("sections").alias("sections"), own.alias("top_terms"), "_before")
    parts = parts.withColumn("term_overlap", F.when(F.size("_before") > 0, F.round(history.term_overlap(F.col("top_terms"), F.col("_before")), 3)))
    score = history.coverage_score(F.col("papers"), F.col("collocations"), F.col("sections"), F.col("words"), F.col("term_overlap"))
    return parts.select(field, "papers", "words", "collocations", "sections", "term_overlap", F.round(score, 1).alias("score"), "top_terms")


def majors(records: DataFrame, named: list[str] | None = None, field: str = "source", least: int = 5) -> DataFrame:
    """records with major: the fields of the catalogue, or without one those of `least` papers or more."""
    chosen = F.col("papers") >= least if named is None else F.col(field).isin(named)
    return records.withColumn("major", F.coalesce(chosen, F.lit(False)))


def as_of(files: DataFrame, *keys: str, modified: str = "modified") -> DataFrame:
    """keys, as_of: the day of the newest file, in the session's time zone."""
    return files.groupBy(*keys).agg(F.to_date(F.max(modified)).alias("as_of"))


def nice_step(highest: Column, target: int = 5) -> Column:
    """The axis step of 1, 2 or 5 times a power of ten that gives at most `target` steps; 1 for nothing to show."""
    raw = highest / F.lit(float(target))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = F.array(*[unit * m for m in (1, 2, 5, 10)])
    return F.when(raw > 0, F.filter(steps, lambda s: raw <= s)[0]).otherwise(F.lit(1.0))
