"""Sinks: per-field reports, versioned snapshots and small renderers over aggregated rows."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlays(stats: DataFrame, terms: DataFrame, phrases: DataFrame, field: str = "source") -> DataFrame:
    """field, markdown: one report per field, built in the query from ranked rows (bounded by the ranks)."""
    bullets = lambda d, c: d.groupBy(field).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c, "cnt"))), lambda x: F.concat(F.lit("- `"), x[c], F.lit("` ("), x["cnt"].cast("string"), F.lit(")"))), "\n").alias(c))
    joined = stats.join(bullets(terms, "term"), field, "left").join(bullets(phrases, "phrase"), field, "left")
    head = F.concat(F.lit("# "), F.col(field), F.lit("\n\nWords: "), F.format_number("words", 0), F.lit("; words a sentence: "), F.format_number("avg_sentence_words", 1))
    return joined.select(field, F.concat(head, F.lit("\n\n## Top terms\n"), F.coalesce("term", F.lit("")), F.lit("\n\n## Phrases\n"), F.coalesce("phrase", F.lit(""))).alias("markdown"))


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that df has; with a full df after a gate, mode overwrite prunes stale ones."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A page with the first rows of an aggregated frame; everything is escaped and the order is the frame's."""
    rows = df.limit(most).collect()
    cell = lambda x: escape("" if x is None else str(x))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{cell(title)}</title><h1>{cell(title)}</h1><table><tr>{head}</tr>\n{body}</table>\n"


def replace_block(text: str, name: str, block: str) -> str:
    """text with the block between its markers replaced, or put at the end if there is none; two blocks are an error."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if text.count(start) > 1 or text.count(start) != text.count(end):
        raise ValueError("markers must stand once")
    new = f"{start}\n{block}\n{end}"
    if start not in text:
        return text.rstrip("\n") + "\n\n" + new + "\n"
    a, b = text.index(start), text.index(end) + len(end)
    return text[:a] + new + text[b:]


def shown(df: DataFrame, n: int = 20) -> str:
    return df._show_string(n, False)
