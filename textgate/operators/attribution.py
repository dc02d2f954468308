"""Licence gate and attribution records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .places import running

ALLOWED = "CC BY 4.0"


def active(docs: DataFrame, records: DataFrame, key: str = "rel_path") -> DataFrame:
    return docs.join(records.where("status = 'active'").select(key), key, "left_semi")


def not_excluded(docs: DataFrame, excluded: DataFrame, key: str = "rel_path") -> DataFrame:
    return docs.join(excluded.select(key), key, "left_anti")


def records(manifest: DataFrame, licences: DataFrame, key: str = "relative_pdf_path") -> DataFrame:
    """record_id, path, title, authors, year, subject, doi, licence, status: licensed papers are active, others excluded.
    Numbers run over (Subject, DOI); they are given per subject and offset by the subjects before (a row per subject)."""
    named = manifest.join(licences, key, "left").withColumn("licence", F.coalesce("licence", F.lit("unknown")))
    per = named.groupBy("Subject").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("Subject").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = running(named, ["Subject"], "DOI", "_place", key, keys_of=manifest).join(before, "Subject")
    rid = F.concat(F.lit("ART-"), F.lpad((F.col("_before") + F.col("_place")).cast("string"), 4, "0"))
    status = F.when(F.col("licence") == ALLOWED, "active").otherwise("excluded")
    return numbered.select(rid.alias("record_id"), F.col(key).alias("path"), "title", T.authors(F.col("authors")).alias("authors"), F.substring("publication_date", 1, 4).alias("year"), F.col("Subject").alias("subject"), F.col("DOI").alias("doi"), "licence", status.alias("status"))


def papers_per_subject(recs: DataFrame, subject: str = "subject") -> DataFrame:
    return recs.groupBy(subject).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), subject)


def blocklist(existing: DataFrame, recs: DataFrame) -> DataFrame:
    """existing with the DOIs of excluded records that it doesn't have yet, each once."""
    new = recs.where("status = 'excluded' and doi is not null").select("doi").distinct().join(existing.select("doi"), "doi", "left_anti")
    return existing.select("doi").unionByName(new)


def excluded_paths(registry: DataFrame, path: str = "relative_pdf_path") -> DataFrame:
    """The registry with its paths in plain form; a path that leaves the corpus raises."""
    plain = T.relative_path(F.col(path))
    return registry.withColumn(path, F.when(plain.isNull(), F.raise_error(F.concat(F.lit("path escapes corpus: "), F.coalesce(path, F.lit("")))).cast("string")).otherwise(plain))


def with_provenance(controls: DataFrame, manifest: DataFrame, key: str = "rel_path", field: str = "field") -> DataFrame:
    """controls with their manifest's columns; one that the manifest lacks or has for another field raises."""
    known = manifest.withColumnRenamed(field, "_field")
    both = controls.join(known, key, "left")
    bad = F.col("_field").isNull() | (F.col("_field") != F.col(field))
    return both.withColumn(field, F.when(bad, F.raise_error(F.concat(F.lit("source is absent or of another field: "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(field))).drop("_field")


def new_works(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Works that aren't known yet, each once."""
    return found.join(known.select(key), key, "left_anti").dropDuplicates([key])
