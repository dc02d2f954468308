"""Corpus mining: statistics, terms, collocations, notation and section metrics per field. Documents stay rows; sums meet
per field, so no field's text is ever gathered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import text as T
from .sections import split_sections


def document_stats(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.select(*keys, F.size(T.mining_words(t)).cast("bigint").alias("words"), F.size(T.sentences(t, 3)).cast("bigint").alias("sentences"), T.count(t, X.PASSIVE).alias("passives"), T.count(t, X.FIRST_PERSON).alias("we"))


def field_stats(docs: DataFrame, field: str = "source", text: str = "text") -> DataFrame:
    """field, words, sentences, avg_sentence_words, passive_per_10k, we_per_10k. Denominators are 1 at least; sentences are
    counted per document."""
    s = document_stats(docs, field, text=text).groupBy(field).agg(*[F.sum(c).alias(c) for c in ("words", "sentences", "passives", "we")])
    floor = lambda c: F.greatest(F.col(c), F.lit(1))
    return s.select(field, "words", "sentences", (F.col("words") / floor("sentences")).alias("avg_sentence_words"), (F.col("passives") * 10000 / floor("words")).alias("passive_per_10k"), (F.col("we") * 10000 / floor("words")).alias("we_per_10k"))


def tokens(docs: DataFrame, field: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """field, order, pos, term (lower case, of words that aren't all capitals)."""
    return docs.select(field, order, F.posexplode(T.mining_words(F.col(text))).alias("pos", "word")).select(field, order, "pos", "word", F.lower("word").alias("term"))


def top_terms(docs: DataFrame, stop: Iterable[str], n: int = 30, field: str = "source", least: int = 3) -> DataFrame:
    """field, rank, term, cnt: the n most frequent words; ties go to the term that comes first in the field."""
    stop = sorted(stop)
    t = tokens(docs, field).where((F.length("term") >= least) & (F.col("word") != F.upper("word")))
    t = t.where(~F.col("term").isin(stop)) if stop else t
    counted = t.groupBy(field, "term").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(field).orderBy(F.desc("cnt"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select(field, F.col("rank").cast("bigint").alias("rank"), "term", "cnt")


def phrase_bank(docs: DataFrame, verbs: Iterable[str] = X.PHRASE_VERBS, stop: Iterable[str] = (), n: int = 20, field: str = "source") -> DataFrame:
    """field, rank, phrase, cnt: for each anchor verb the leftmost qualifying word among the four before it. The window is in
    the document's row (zip of shifted arrays), so a hot field needs no ordered pass."""
    stop = sorted(stop)
    split = docs.select(field, "doc_id", F.transform(T.mining_words(F.col("text")), F.lower).alias("_words"))
    words = F.col("_words")  # a column of its own: inside the lambda the expression would run for each word
    ok = lambda w: (F.length(w) >= 3) & (~w.isin(stop) if stop else F.lit(True))
    anchors = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("verb"), i.alias("pos"))), lambda h: h["verb"].isin(sorted(verbs)))
    before = lambda h: F.filter(F.slice(words, F.greatest(h["pos"] - 3, F.lit(1)), F.least(h["pos"], F.lit(4))), ok)
    hits = F.filter(F.transform(anchors, lambda h: F.struct(h["verb"].alias("verb"), h["pos"].alias("pos"), before(h).alias("before"))), lambda h: F.size(h["before"]) > 0)
    rows = split.select(field, "doc_id", F.explode(hits).alias("h")).select(field, "doc_id", "h.pos", F.concat(F.col("h.before")[0], F.lit(" "), F.col("h.verb")).alias("phrase"))
    counted = rows.groupBy(field, "phrase").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(field).orderBy(F.desc("cnt"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select(field, F.col("rank").cast("bigint").alias("rank"), "phrase", "cnt")


def variant_counts(docs: DataFrame, *keys: str, families=X.VARIANT_FAMILIES, text: str = "text") -> DataFrame:
    """keys, family, ord, variant, cnt of every spelling of every family: one pass over the text, one aggregate."""
    low = F.lower(T.normalize(F.col(text)))
    items = [F.struct(F.lit(f[0]).alias("family"), F.lit(i).alias("ord"), F.lit(v).alias("variant"), T.literal_count(F.col("_low"), v).alias("cnt")) for f in families for i, v in enumerate(f)]
    rows = docs.select(*keys, low.alias("_low")).select(*keys, F.explode(F.array(*items)).alias("v")).where("v.cnt > 0")
    return rows.groupBy(*keys, "v.family", "v.ord", "v.variant").agg(F.sum("v.cnt").alias("cnt"))


def notation_watch(docs: DataFrame, field: str = "source", families=X.VARIANT_FAMILIES) -> DataFrame:
    return variant_counts(docs, field, families=families).select(field, "family", "variant", "cnt")


def section_metrics(docs: DataFrame, field: str = "source") -> DataFrame:
    """field, role, sections, avg_sentence_words, passive_per_10k over sections other than front matter and references."""
    parts = split_sections(docs, field, text="text").where(~F.col("role").isin("frontmatter", "references"))
    s = document_stats(parts, field, "role", text="body").where("words > 0")
    rate = F.bround(F.col("passives") * 10000 / F.greatest("words", F.lit(1)), 1)  # a section's rate has one decimal
    return s.groupBy(field, "role").agg(F.count("*").alias("sections"), (F.sum("words") / F.greatest(F.sum("sentences"), F.lit(1))).alias("avg_sentence_words"), (F.sum(rate * F.col("words")) / F.sum("words")).alias("passive_per_10k"))


def maturity(stats: DataFrame, files: str = "files") -> DataFrame:
    return stats.withColumn("mature", (F.col(files) >= X.MATURE_FILES) & (F.col("words") >= X.MATURE_WORDS))
