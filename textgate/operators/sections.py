"""Sections of documents: a section runs from a heading with a role to the next one; without headings all is `body`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


def split_column(text: Column) -> Column:
    """array<struct(ord, name, role, start_line, body)> of a text. Text before the first heading is `frontmatter` if it has
    any. No shuffle: the lines of a document are an array of its row."""
    name = lambda line: F.regexp_extract(line, X.HEADING, 1)
    head = lambda line, i: F.struct((i + 1).alias("line"), F.trim(name(line)).alias("name"), T.section_role(name(line)).alias("role"))
    found = lambda lines: F.filter(F.transform(lines, head), lambda h: h["role"].isNotNull())
    return T.let(T.lines(text), lambda lines: T.let(found(lines), lambda heads: _sections(text, lines, heads)))


def _sections(text: Column, lines: Column, heads: Column) -> Column:
    body = lambda a, n: F.trim(F.array_join(F.slice(lines, a, F.greatest(n, F.lit(0))), "\n"))
    at = lambda i: F.coalesce(F.try_element_at(heads, i + 2)["line"], F.size(lines) + 1)
    named = F.transform(heads, lambda h, i: F.struct(h["name"].alias("name"), h["role"].alias("role"), h["line"].alias("start_line"), body(h["line"] + 1, at(i) - h["line"] - 1).alias("body")))
    whole = F.array(F.struct(F.lit("body").alias("name"), F.lit("body").alias("role"), F.lit(1).alias("start_line"), text.alias("body")))
    front = F.coalesce(F.try_element_at(heads, F.lit(1))["line"], F.lit(1)) - 1
    lead = lambda before: F.array(F.struct(F.lit("frontmatter").alias("name"), F.lit("frontmatter").alias("role"), F.lit(1).alias("start_line"), before.alias("body")))
    headed = T.let(body(F.lit(1), front), lambda before: F.when(before != "", F.concat(lead(before), named)).otherwise(named))
    return F.when(F.size(heads) == 0, whole).otherwise(headed)


def split_sections(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, ord, name, role, start_line, body: a row per section."""
    rows = docs.select(*keys, F.posexplode(split_column(F.coalesce(F.col(text), F.lit("")))).alias("ord", "s"))
    return rows.select(*keys, "ord", "s.name", "s.role", "s.start_line", "s.body")


def body_text(text: Column, drop: tuple[str, ...] = ("references",)) -> Column:
    """The bodies of all sections but those of the roles in drop."""
    kept = F.filter(split_column(F.coalesce(text, F.lit(""))), lambda s: ~s["role"].isin(*drop))
    return F.trim(F.array_join(F.transform(kept, lambda s: s["body"]), "\n\n"))


def bodies(docs: DataFrame, *keys: str, **texts: str) -> DataFrame:
    """keys and, for each name, body_text of a column. The one-element explode keeps the optimizer from putting the expression into
    what reads it: it runs once a row, and Arrow UDFs get plain columns."""
    rows = docs.select(*keys, F.explode(F.array(F.struct(*[body_text(F.col(c)).alias(n) for n, c in texts.items()]))).alias("_bodies"))
    return rows.select(*keys, "_bodies.*")


def align_sections(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, ord, name, role, original, corrected, changed: each section of the original beside the last of its name in the corrected text
    (empty if there is none), then the sections whose name only that text has. Both texts are arrays of their row: no shuffle."""
    split = pairs.select(key, F.explode(F.array(F.struct(split_column(F.coalesce("original", F.lit(""))).alias("o"), split_column(F.coalesce("corrected", F.lit(""))).alias("c")))).alias("s")).select(key, "s.*")
    row = lambda s, o, c: F.struct(s["name"].alias("name"), s["role"].alias("role"), o.alias("original"), c.alias("corrected"))
    other = lambda s: F.coalesce(F.try_element_at(F.filter("c", lambda x: x["name"] == s["name"]), F.lit(-1))["body"], F.lit(""))
    both = F.transform("o", lambda s: row(s, s["body"], other(s)))
    new = F.transform(F.filter("c", lambda x: ~F.exists("o", lambda s: s["name"] == x["name"])), lambda x: row(x, F.lit(""), x["body"]))
    rows = split.select(key, F.posexplode(F.concat(both, new)).alias("ord", "r")).select(key, "ord", "r.*")
    return rows.withColumn("changed", F.col("original") != F.col("corrected"))
