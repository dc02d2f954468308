"""Lints of one text and style rates of edit pairs. References are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .mining import variant_counts
from .sections import bodies


def _bodies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return bodies(docs, key, text=text)


def notation_issues(docs: DataFrame, key: str = "doc_id", families=X.VARIANT_FAMILIES) -> DataFrame:
    """key, family, variants, majority: families of which a text has two spellings or more."""
    counts = variant_counts(_bodies(docs, key), key, families=families)
    return counts.groupBy(key, "family").agg(F.count("*").alias("variants"), F.max_by("variant", F.struct("cnt", -F.col("ord"))).alias("majority")).where("variants >= 2")


def undefined_acronyms(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, acronym, cnt: acronyms that the text neither defines nor may assume. known: (key, acronym) of a saved state."""
    t = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(t, X.CITATION_BRACKET, " "), X.CITATION_AUTHOR, " ")
    # Definitions are sought in the text as it is: a citation between expansion and acronym makes no definition.
    defined = F.array_distinct(F.transform(T.definitions(t), lambda d: d["acronym"]))
    used = F.filter(T.acronyms(plain), lambda a: ~a.isin(*X.ACRONYMS_KNOWN, *X.ACRONYMS_SKIPPED))
    open_ = T.let(defined, lambda known: F.filter(used, lambda a: ~F.array_contains(known, a)))
    counted = _bodies(docs, key).select(key, F.explode(open_).alias("acronym")).groupBy(key, "acronym").agg(F.count("*").alias("cnt"))
    return counted.join(known, [key, "acronym"], "left_anti") if known is not None else counted


def tell_pattern(phrase: str) -> str:
    """A phrase in any case at word edges; a slash stands between alternatives that a text may give one after the other."""
    parts = [r"\Q" + p + r"\E" for p in phrase.split("/")]
    return r"(?i)" + X.NOT_BEFORE + rf"{X.W}*\s*/?\s*".join(parts) + X.NOT_AFTER


def style_counts(text: Column, tells: list[str], families=X.VARIANT_FAMILIES) -> dict[str, Column]:
    """The seven detectors and the number of words of a text."""
    sents = T.sentences(text)
    n = lambda c: c.cast("bigint")
    low = F.lower(T.normalize(text))
    tell = [T.count(text, tell_pattern(t)) for t in tells]
    mixed = [F.when(sum((F.when(T.literal_count(low, v) > 0, 1).otherwise(0) for v in f), F.lit(0)) >= 2, 1).otherwise(0) for f in families]
    add = lambda cs: sum(cs, F.lit(0).cast("bigint"))
    hedged = lambda s: sum((s.rlike(h).cast("int") for h in X.HEDGES), F.lit(0)) >= 2
    clustered = lambda p: F.size(F.filter(F.split(p, X.SENTENCE_END), lambda s: s.rlike(X.TRANSITION))) > 1
    return {
        "ai_tell": add(tell),
        "hedge_stack": n(F.size(F.filter(sents, hedged))),
        "overclaim": T.count(text, X.OVERCLAIM),
        "figure_past": T.count(text, X.FIGURE_PAST),
        "long_sentence": n(F.size(F.filter(sents, lambda s: F.size(T.bench_words(s)) > 45))),
        "transition_cluster": n(F.size(F.filter(T.paragraphs(text), clustered))),
        "notation": add(mixed),
        "words": n(F.size(T.bench_words(text))),
    }


def style_rates(pairs: DataFrame, tells: list[str], key: str = "pair_id") -> DataFrame:
    """key, before and after counts of each detector, total rates per 100 words of the original, regressed."""
    b = bodies(pairs, key, o="original", c="corrected")
    one = {f"{k}_before": v for k, v in style_counts(F.col("o"), tells).items()} | {f"{k}_after": v for k, v in style_counts(F.col("c"), tells).items()}
    counted = b.select(key, *[v.alias(k) for k, v in one.items()])
    names = [k[:-7] for k in one if k.endswith("_before") and k != "words_before"]
    rate = lambda s: (sum((F.col(f"{k}_{s}") for k in names), F.lit(0)) * 100.0 / F.greatest("words_before", F.lit(1)))
    rated = counted.withColumn("total_before", rate("before")).withColumn("total_after", rate("after"))
    return rated.withColumn("regressed", F.col("total_after") > F.col("total_before"))
