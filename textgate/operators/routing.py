"""Routing documents to fields by weighted whole-word term hits. Terms that are one word are matched by an equi-join on
tokens; only the others need a regular expression per term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X


def field_scores(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, field, score of (field, term, weight) rows; the term table is small by nature, but Spark decides how to join."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(rf"{X.W}+"), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("hits"))
    single = terms.where(F.col("term").rlike(rf"^{X.W}+$")).select("field", F.lower("term").alias("term"), "weight")
    many = terms.where(~F.col("term").rlike(rf"^{X.W}+$")).select("field", F.lower("term").alias("term"), "weight", F.concat(F.lit(X.NOT_BEFORE), F.regexp_replace("term", r"([^\p{L}\p{N} _])", r"\\$1"), F.lit(X.NOT_AFTER)).alias("p"))
    by_word = words.join(single, "term").select(key, "field", (F.col("hits") * F.col("weight")).alias("s"))
    # A term of several words is looked for only where its first word is.
    first = many.withColumn("w", F.regexp_extract("term", rf"{X.W}+", 0))
    near = words.select(key, F.col("term").alias("w")).join(first, "w").select(key, "field", "p", "weight")
    by_phrase = docs.select(key, F.lower(text).alias("_t")).join(near, key).select(key, "field", (F.regexp_count("_t", F.col("p")) * F.col("weight")).alias("s"))
    return by_word.unionByName(by_phrase).groupBy(key, "field").agg(F.sum("s").cast("bigint").alias("score")).where("score > 0")


def route(docs: DataFrame, terms: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """key, rank, field, score: the n best fields; ties in the order of the term table (column ord, else the name)."""
    scores = field_scores(docs, terms, key)
    if "ord" in terms.columns:
        scores = scores.join(terms.groupBy("field").agg(F.min("ord").alias("_ord")), "field")
    tie = "_ord" if "ord" in terms.columns else "field"
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n).select(key, F.col("rank").cast("bigint").alias("rank"), "field", "score")
