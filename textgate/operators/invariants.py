"""Edit verification: what an edit must keep (numbers, quantities, citations, formulas, DOIs, equations, terms) is compared
as signed multisets, +1 from the original and -1 from the corrected text, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions import fixed as X
from ..functions import text as T
from .sections import bodies

#: What is extracted from texts without citations and DOIs: these are taken out once for all three.
FROM_BODY = {"number": T.numbers_in, "quantity": T.quantities_in, "formula": T.formulas_in}
EXTRACTORS = {"number": T.numbers, "quantity": T.quantities, "citation": T.citations, "formula": T.formulas, "doi": T.dois, "equation": T.equations}


def extracted(text: Column, kinds: tuple[str, ...], terms: Column | None = None) -> Column:
    tagged = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"))
    stripped = [k for k in kinds if k in FROM_BODY]
    parts = [F.transform(EXTRACTORS[k](text), tagged(k)) for k in kinds if k not in FROM_BODY]
    if stripped:
        parts.append(T.let(T.body_without(text), lambda body: F.concat(*[F.transform(FROM_BODY[k](body), tagged(k)) for k in stripped])))
    if terms is not None:
        parts.append(F.transform(F.filter(F.array_distinct(terms), lambda t: F.contains(text, t)), tagged("term")))
    return F.concat(*parts)


def invariants(docs: DataFrame, *keys: str, text: str = "text", kinds: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """keys, kind, token, cnt."""
    rows = docs.select(*keys, F.explode(extracted(F.col(text), kinds)).alias("x"))
    return rows.groupBy(*keys, "x.kind", "x.token").agg(F.count("*").alias("cnt"))


def multiset_diff(pairs: DataFrame, key: str = "pair_id", kinds: tuple[str, ...] = tuple(EXTRACTORS), terms: str | None = None) -> DataFrame:
    """key, kind, token, original, corrected, missing, invented (of tokens that either side has)."""
    original = F.when(F.col("type") == "A", T.hour_unit(F.col("original"))).otherwise(F.col("original")) if "type" in pairs.columns else F.col("original")
    side = lambda text, name: F.transform(extracted(F.coalesce(text, F.lit("")), kinds, F.col(terms) if terms else None), lambda x: F.struct(x["kind"].alias("kind"), x["token"].alias("token"), F.lit(name).alias("side")))
    rows = pairs.select(key, F.explode(F.concat(side(original, "o"), side(F.col("corrected"), "c"))).alias("x")).select(key, "x.*")
    return signed(rows, key, "kind", "token")


def signed(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with side 'o' or 'c': keys, original, corrected, missing, invented."""
    n = lambda s: F.count_if(F.col("side") == s)
    counted = rows.groupBy(*keys).agg(n("o").alias("original"), n("c").alias("corrected"))
    return counted.withColumn("missing", F.greatest(F.col("original") - F.col("corrected"), F.lit(0).cast("bigint"))).withColumn("invented", F.greatest(F.col("corrected") - F.col("original"), F.lit(0).cast("bigint")))


def word_multisets(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    side = lambda c, s: F.transform(T.whitespace_tokens(F.col(c)), lambda w: F.struct(F.lit(s).alias("side"), w.alias("token")))
    rows = pairs.select(key, F.explode(F.concat(side("original", "o"), side("corrected", "c"))).alias("x")).select(key, "x.side", "x.token")
    return signed(rows, key, "token")


def category_stats(diff: DataFrame, key: str = "pair_id") -> DataFrame:
    return diff.groupBy(key, "kind").agg(*[F.sum(c).alias(c) for c in ("original", "corrected", "missing", "invented")])


def dice(diff: DataFrame, *keys: str) -> DataFrame:
    """keys, dice = 2 * common / (original + corrected), strict (equal multisets)."""
    return diff.groupBy(*keys).agg((2 * F.sum(F.least("original", "corrected")) / F.sum(F.col("original") + F.col("corrected"))).alias("dice"), F.bool_and(F.col("original") == F.col("corrected")).alias("strict"))


def change_rate_bound(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, bound: 1 - 2 * common / all over white-space tokens; the aligned change rate is never below it."""
    w = word_multisets(pairs, key)
    return w.groupBy(key).agg((1 - 2 * F.sum(F.least("original", "corrected")) / F.sum(F.col("original") + F.col("corrected"))).alias("bound"))


def level_limits(level: Column) -> tuple[Column, Column]:
    """(warn, stop) of a level; levels never loosen the default."""
    warn, stop = F.lit(X.WARN_RATE), F.lit(X.STOP_RATE)
    for name, (w, s) in X.LEVELS.items():
        warn = F.when(level == name, F.lit(min(w, X.WARN_RATE))).otherwise(warn)
        stop = F.when(level == name, F.lit(min(s, X.STOP_RATE))).otherwise(stop)
    return warn, stop


def change_rates(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    body = bodies(pairs, key, o="original", c="corrected")
    return body.select(key, align.change_rate("o", "c").alias("change_rate"))


def verify_pairs(pairs: DataFrame, key: str = "pair_id", level: str | None = None, terms: str | None = None) -> DataFrame:
    """key, change_rate, missing, invented, violations, verdict (FAIL, WARN or PASS). Type A pairs are not gated by rate."""
    own = F.col("level") if "level" in pairs.columns and level is None else F.lit(level)
    kind = F.col("type") if "type" in pairs.columns else F.lit("B")
    diff = multiset_diff(pairs, key, terms=terms)
    text = F.concat(F.when(F.col("missing") > 0, F.lit("MISSING ")).otherwise(F.lit("INVENTED ")), F.col("kind"), F.lit(" "), F.col("token"))
    bad = diff.where("missing > 0 or invented > 0").groupBy(key).agg(F.sum("missing").alias("missing"), F.sum("invented").alias("invented"), F.array_sort(F.collect_list(text)).alias("violations"))
    warn, stop = level_limits(own)
    out = pairs.select(key, kind.alias("_kind"), warn.alias("_warn"), stop.alias("_stop")).join(change_rates(pairs, key), key).join(bad, key, "left")
    over = (F.col("_kind") != "A") & (F.col("change_rate") > F.col("_stop"))
    violations = F.concat(F.coalesce("violations", F.array().cast("array<string>")), F.when(over, F.array(F.lit("CHANGE RATE"))).otherwise(F.array().cast("array<string>")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    verdict = F.when(F.size("v") > 0, "FAIL").when((F.col("_kind") != "A") & (F.col("change_rate") > F.col("_warn")), "WARN").otherwise("PASS")
    return out.withColumn("v", violations).select(key, "change_rate", zero("missing"), zero("invented"), F.col("v").alias("violations"), verdict.alias("verdict"))
