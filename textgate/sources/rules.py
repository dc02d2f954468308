"""Rule files: routing terms, tell phrases and overlay term lists, read from markdown or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of text files; a file is one row first, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def headed(lines: DataFrame) -> DataFrame:
    """lines with the markdown heading above each."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(F.col("value").rlike(r"^#+\s"), F.lower(F.trim(F.regexp_replace("value", r"^#+\s*", "")))), ignorenulls=True).over(w))


def overlay_terms(lines: DataFrame) -> DataFrame:
    """file, term under the heading `top terms`: all back-ticked strings, as they are."""
    return headed(lines).where("heading = 'top terms'").select("file", F.explode(F.regexp_extract_all("value", F.lit("`([^`]+)`"), F.lit(1))).alias("term"))


def routing_terms(lines: DataFrame) -> DataFrame:
    """field, term, weight 1 under headings that contain `top terms`: list items, in lower case."""
    term = F.regexp_extract("value", r"^-\s*`?([A-Za-z][A-Za-z0-9 /-]+?)`?\s*(?:—|\(|$)", 1)
    return headed(lines).where(F.contains("heading", F.lit("top terms"))).select(F.col("file").alias("field"), F.lower(term).alias("term"), F.lit(1).alias("weight")).where("term <> ''")


def tell_phrases(lines: DataFrame, least: int = 7) -> DataFrame:
    """file, line, phrase: quoted strings of bullets, with repeats; from the first heading of phrases that are no tells on, nothing
    is read. Replacements (` -> `) and patterns that begin with a placeholder `X ` are no phrases."""
    stop = F.min(F.when(F.col("value").rlike(r"^#") & F.lower("value").contains("non-tell"), F.col("line"))).over(Window.partitionBy("file"))
    bullets = lines.withColumn("_stop", stop).where("(_stop is null or line < _stop) and trim(value) like '- %'")
    found = bullets.select("file", "line", F.explode(F.regexp_extract_all("value", F.lit(f'"([^"]{{{least},}})"'), F.lit(1))).alias("phrase"))
    return found.where(~F.contains("phrase", F.lit(" -> ")) & ~F.startswith("phrase", F.lit("X ")))


def first_svg(html: DataFrame, column: str = "html") -> DataFrame:
    return html.withColumn("svg", F.regexp_extract(column, r"(?is)<svg\b[^>]*>.*?</svg>", 0))
