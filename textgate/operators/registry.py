"""The abbreviation registry as a fold of definitions, and what manuscripts teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import text as T
from .lint import undefined_acronyms
from .mining import variant_counts
from .sections import bodies


def definitions(docs: DataFrame, field: str = "source", key: str = "doc_id") -> DataFrame:
    """field, key, kind, pos, acronym, expansion of plausible definitions."""
    rows = docs.select(field, key, F.posexplode(T.definitions(F.coalesce("text", F.lit("")))).alias("pos", "d")).select(field, key, "pos", "d.*")
    return rows.where(T.plausible_expansion(F.col("expansion")) & ~F.col("acronym").isin(*X.ACRONYM_STOPWORDS, *X.ELEMENTS))


def same_expansion(a: Column, b: Column) -> Column:
    """Whether one holds the other, in any case."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.contains(x, y) | F.contains(y, x)


def fold(defs: DataFrame, *keys: str, order: tuple[str, ...] = ("doc_id", "kind", "pos")) -> DataFrame:
    """keys, expansion, status, expansions_seen of (keys, order, expansion): the first expansion stands; the first later one
    that differs (neither holds the other, in any case) makes a conflict, which stays."""
    # One row for each wording first, so that what is listed grows with the wordings of an acronym and not with its uses.
    wordings = defs.groupBy(*keys, F.lower(F.trim("expansion")).alias("_low")).agg(F.min(F.struct(*order, "expansion")).alias("_first"))
    listed = wordings.groupBy(*keys).agg(F.array_sort(F.collect_list("_first")).alias("all"))
    first = F.col("all")[0]["expansion"]
    other = F.try_element_at(F.filter("all", lambda d: ~same_expansion(d["expansion"], first)), F.lit(1))["expansion"]
    return listed.select(*keys, first.alias("expansion"), F.when(other.isNull(), "verified").otherwise("conflict").alias("status"), F.array_compact(F.array(first, other)).alias("expansions_seen"))


def fold_registry(docs: DataFrame, existing: DataFrame | None = None, field: str = "source") -> DataFrame:
    """acronym, field, provenance, status, expansion, expansions_seen, sightings: corpus entries are rebuilt, manual ones of
    `existing` stay. Undefined acronyms are unverified entries with their number of occurrences."""
    made = fold(definitions(docs, field), field, "acronym")
    sightings = undefined_acronyms(docs, key="doc_id").join(docs.select("doc_id", field), "doc_id").where(~F.col("acronym").isin(*X.ACRONYM_STOPWORDS, *X.ELEMENTS)).groupBy(field, "acronym").agg(F.sum("cnt").alias("seen"))
    both = made.join(sightings, [field, "acronym"], "full_outer")
    n = F.when(F.col("status").isNotNull(), 1).otherwise(0) + F.coalesce("seen", F.lit(0))
    out = both.select("acronym", F.col(field).alias("field"), F.lit("corpus").alias("provenance"), F.coalesce("status", F.lit("unverified")).alias("status"), "expansion", F.coalesce("expansions_seen", F.array().cast("array<string>")).alias("expansions_seen"), n.cast("bigint").alias("sightings"))
    return out if existing is None else out.unionByName(existing.where("provenance = 'manual'").select(out.columns))


def status_histogram(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count("*").alias("entries"))


def learn_state(docs: DataFrame, manuscript: str = "source", families=X.VARIANT_FAMILIES) -> DataFrame:
    """manuscript, abbreviations (first definition wins), terms (family -> majority spelling, of two uses or more), figures."""
    own = bodies(docs, manuscript, "doc_id", text="text")
    abbr = definitions(own, manuscript).groupBy(manuscript, "acronym").agg(F.min_by("expansion", F.struct("doc_id", "kind", "pos")).alias("x"))
    abbr = abbr.groupBy(manuscript).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("acronym", "x")))).alias("abbreviations"))
    terms = variant_counts(own, manuscript, families=families).groupBy(manuscript, "family").agg(F.max_by("variant", F.struct("cnt", -F.col("ord"))).alias("v"), F.sum("cnt").alias("n")).where("n >= 2")
    terms = terms.groupBy(manuscript).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "v")))).alias("terms"))
    figures = own.select(manuscript, F.explode(T.figure_numbers(F.col("text"))).alias("f")).groupBy(manuscript).agg(F.sort_array(F.collect_set("f")).alias("figures"))
    return docs.select(manuscript).distinct().join(abbr, manuscript, "left").join(terms, manuscript, "left").join(figures, manuscript, "left")


def contexts(docs: DataFrame, field: str = "source", key: str = "doc_id", most: int = 3) -> DataFrame:
    """field, acronym, ord, context, key: the last contexts in which plausible definitions of an acronym stand."""
    t = F.coalesce("text", F.lit(""))
    both = F.zip_with(T.definitions(t), T.definition_contexts(t), lambda d, c: F.struct(d["acronym"].alias("acronym"), d["expansion"].alias("expansion"), F.trim(c).alias("context")))
    rows = docs.where(t.rlike(r"\([A-Za-z]")).select(field, key, F.posexplode(both).alias("pos", "d")).select(field, key, "pos", "d.*")
    rows = rows.where(T.plausible_expansion(F.col("expansion")) & ~F.col("acronym").isin(*X.ACRONYM_STOPWORDS, *X.ELEMENTS))
    place = F.row_number().over(Window.partitionBy(field, "acronym").orderBy(F.desc(key), F.desc("pos")))
    return rows.withColumn("_p", place).where(F.col("_p") <= most).select(field, "acronym", F.col("_p").alias("ord"), "context", key)
